"""Drop the tables the library created."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from lakeweave.sinks.ddl import drop_table
from lakeweave.sources.bindings import CatalogBinding


def reset(spark: SparkSession, targets: Iterable[tuple[CatalogBinding, str]]) -> DataFrame:
    """Drop each table and report the outcome; a failure does not stop the rest."""
    report = []
    for binding, table in targets:
        try:
            outcome = drop_table(spark, binding, table)
        except Exception as error:  # reported to the caller, one row per table
            outcome = f"failed: {str(error).splitlines()[0]}"
        report.append((binding.name, table, outcome))
    return spark.createDataFrame(report, "catalog_name string, tbl string, outcome string")
