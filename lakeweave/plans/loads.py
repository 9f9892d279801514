"""Loads of the operational tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from lakeweave.operators.counts import labelled_counts
from lakeweave.schemas import OPERATIONAL, TableSpec
from lakeweave.sinks.ddl import create_table, ensure_namespace
from lakeweave.sinks.history import Load, record_loads
from lakeweave.sinks.writes import append
from lakeweave.sources.bindings import CatalogBinding
from lakeweave.sources.tables import scan_table


def create_tables(
    spark: SparkSession, target: CatalogBinding, specs: Mapping[str, TableSpec], comment: str = ""
) -> None:
    ensure_namespace(spark, target, comment)
    for name, spec in specs.items():
        create_table(spark, target, name, spec)


def append_batches(
    spark: SparkSession,
    target: CatalogBinding,
    batches: Mapping[str, DataFrame],
    specs: Mapping[str, TableSpec],
    positional: bool,
) -> dict[str, int]:
    done: list[Load] = []
    try:
        for name, batch in batches.items():
            rows = append(
                spark, target, name, batch, positional=positional, partition_by=specs[name].partition_by
            )
            done.append(Load(name, "append", rows))
    finally:  # a failing table must not hide the ones before it
        record_loads(spark, target, done)
    return {load.table: load.rows for load in done}


def counts_of(spark: SparkSession, target: CatalogBinding, names: Mapping[str, object]) -> DataFrame:
    return labelled_counts({name: scan_table(spark, target, name) for name in names})


def load_tables(
    spark: SparkSession,
    target: CatalogBinding,
    batches: Mapping[str, DataFrame],
    specs: Mapping[str, TableSpec] = OPERATIONAL,
    positional: bool = False,
) -> DataFrame:
    """Append a batch to each table, creating the tables when needed, and count the tables."""
    create_tables(spark, target, specs)
    append_batches(spark, target, batches, specs, positional)
    return counts_of(spark, target, batches)


def load_with_reconciliation(
    spark: SparkSession,
    target: CatalogBinding,
    batches: Mapping[str, DataFrame],
    specs: Mapping[str, TableSpec] = OPERATIONAL,
    positional: bool = False,
) -> DataFrame:
    """Append a batch to each existing table and compare the counts around it.

    ``rows_added`` is what the sink was handed, counted on the way in; ``reconciled`` says
    whether the table grew by exactly that.
    """
    before = {row["tbl"]: row["rows"] for row in counts_of(spark, target, batches).collect()}
    added = append_batches(spark, target, batches, specs, positional)
    after = {row["tbl"]: row["rows"] for row in counts_of(spark, target, batches).collect()}
    report = [
        (name, before[name], int(added[name]), after[name], before[name] + added[name] == after[name])
        for name in batches
    ]
    return spark.createDataFrame(
        report, "tbl string, rows_before bigint, rows_added bigint, rows_after bigint, reconciled boolean"
    )
