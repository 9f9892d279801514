"""Copies between catalogs: whole tables, or chosen partitions only."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.schemas import TableSpec
from lakeweave.sinks.ddl import create_table, ensure_namespace
from lakeweave.sinks.history import Load, record_loads
from lakeweave.sinks.writes import counted, empty_partitions, overwrite, overwrite_partitions, written
from lakeweave.sources.bindings import CatalogBinding
from lakeweave.sources.tables import partition_predicate, scan_partitions, scan_table


def cross_catalog_copy(
    spark: SparkSession,
    source: CatalogBinding,
    source_table: str,
    target: CatalogBinding,
    target_table: str,
    spec: TableSpec,
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
    sort_within: Sequence[str] = (),
) -> int:
    """Overwrite a table of one catalog with (a transform of) a table of another.

    ``sort_within`` orders the rows of each file.
    """
    ensure_namespace(spark, target)
    create_table(spark, target, target_table, spec)
    rows = overwrite(
        spark,
        target,
        target_table,
        transform(scan_table(spark, source, source_table)),
        partition_by=spec.partition_by,
        sort_within=sort_within,
    )
    record_loads(spark, target, [Load(target_table, "overwrite", rows)])
    return rows


def replicate_partitions(
    spark: SparkSession,
    source: CatalogBinding,
    target: CatalogBinding,
    table: str,
    spec: TableSpec,
    values: Mapping[str, Sequence[str]] | None = None,
    ranges: Mapping[str, tuple[str, str]] | None = None,
) -> int:
    """Copy the selected partitions, replacing them in the target and nothing else.

    Selected partitions of the target that the source no longer has are emptied. Whole partitions are selected, and the scan opens no others. The source is laid out by
    the same columns, so its files go across without a shuffle and a big partition is
    copied by as many tasks as it has file splits.
    """
    ensure_namespace(spark, target)
    create_table(spark, target, table, spec)
    chosen = scan_partitions(scan_table(spark, source, table), spec, values, ranges)
    if target.kind == "v2":
        copied, seen = counted(chosen)
        copied.writeTo(target.table(table)).overwrite(partition_predicate(spec.partition_by, values, ranges))
        rows = written(seen)
    else:
        rows = overwrite_partitions(spark, target, table, chosen)
        held = scan_partitions(scan_table(spark, target, table), spec, values, ranges)
        there, here = (df.select(*spec.partition_by).distinct() for df in (held, chosen.toDF(*chosen.columns)))
        here = here.toDF(*(f"source_{c}" for c in spec.partition_by))
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"source_{c}")) for c in spec.partition_by))
        gone = there.join(here, same, "left_anti").collect()  # one row per partition, no data
        empty_partitions(spark, target, table, [row.asDict() for row in gone])
    record_loads(spark, target, [Load(table, "overwrite", rows)])
    return rows
