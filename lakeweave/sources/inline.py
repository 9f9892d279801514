"""Rows written out in the program."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from lakeweave.schemas import TableSpec


def inline_rows(spark: SparkSession, rows: Iterable[Sequence | Mapping], spec: TableSpec) -> DataFrame:
    """A DataFrame under the declared schema, never an inferred one.

    A mapping is read by name and may leave columns out; a sequence is read by position.
    """
    ordered = [
        tuple(row.get(name) for name in spec.names) if isinstance(row, Mapping) else tuple(row)
        for row in rows
    ]
    return spark.createDataFrame(ordered, spec.schema)
