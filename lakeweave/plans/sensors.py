"""Sensor readings: ingest, then deduplicate and band into another catalog."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lakeweave.operators.readings import distinct_rows, rank_readings
from lakeweave.plans.replicate import cross_catalog_copy
from lakeweave.schemas import RANKED_READINGS, SENSOR_READINGS, TableSpec
from lakeweave.sinks.ddl import create_table, ensure_namespace
from lakeweave.sinks.history import Load, record_loads
from lakeweave.sinks.writes import append
from lakeweave.sources.bindings import CatalogBinding
from lakeweave.sources.tables import scan_table


@dataclass(frozen=True)
class DedupReport:
    raw_rows: int
    distinct_rows: int


def ingest_readings(
    spark: SparkSession,
    target: CatalogBinding,
    readings: DataFrame,
    table: str = "sensor_readings",
    spec: TableSpec = SENSOR_READINGS,
    target_files: int | None = None,
) -> DataFrame:
    """Append readings, creating namespace and table when needed, and scan the table.

    Running it again appends again; :func:`dedup_and_rank` is what removes repeats.
    """
    ensure_namespace(spark, target)
    create_table(spark, target, table, spec)
    rows = append(spark, target, table, readings, target_files=target_files)
    record_loads(spark, target, [Load(table, "append", rows)])
    return scan_table(spark, target, table)


def dedup_and_rank(
    spark: SparkSession,
    source: CatalogBinding,
    target: CatalogBinding,
    source_table: str = "sensor_readings",
    target_table: str = "sensor_readings_ac",
    spec: TableSpec = RANKED_READINGS,
    sort_within: Sequence[str] = (),
) -> DedupReport:
    """Overwrite the target with the distinct source rows and their band.

    One pass makes the rows: the distinct count is taken as they are written, and the raw
    count comes from the source's file footers.
    """
    written = cross_catalog_copy(
        spark,
        source,
        source_table,
        target,
        target_table,
        spec,
        lambda df: rank_readings(distinct_rows(df)),
        sort_within,
    )
    return DedupReport(scan_table(spark, source, source_table).count(), int(written))
