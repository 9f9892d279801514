"""Scans of catalog tables and of Parquet folders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.schemas import LOAD_HISTORY, TableSpec
from lakeweave.sources.bindings import CatalogBinding

# Partitions that a table of them may name and still be sent to every executor.
BROADCAST_PARTITIONS = 100_000
# The largest bucket that a scan keeps whole, in means of all buckets.
MOST_SKEW = 4.0
# Fixed value: how Spark names the files of a bucket.
BUCKET_NAME = r"_([0-9]{5})(?:\.c[0-9]+)?\.[a-z.]+$"


def scan_table(spark: SparkSession, binding: CatalogBinding, table: str) -> DataFrame:
    return spark.table(binding.table(table))


def bucket_sizes(spark: SparkSession, binding: CatalogBinding, table: str) -> list[int]:
    """Bytes of each bucket of a bucketed table, from its file list."""
    files = spark.table(binding.table(table)).select("_metadata.file_name", "_metadata.file_size", "_metadata.file_path").distinct()
    bucket = F.regexp_extract("file_name", BUCKET_NAME, 1)
    return [r[1] for r in files.groupBy(bucket).agg(F.sum("file_size")).collect()]  # one row per bucket


def scan_bucketed(spark: SparkSession, binding: CatalogBinding, table: str, most_skew: float = MOST_SKEW) -> DataFrame:
    """A bucketed table, with its buckets as long as they are of about one size.

    A task reads a bucket as a whole, and nothing could split it. Where the largest has more than ``most_skew`` times the mean, the files are
    read as any others: joins shuffle them then, and adaptive execution splits the hot key.
    """
    sizes, df = bucket_sizes(spark, binding, table), spark.table(binding.table(table))
    if sizes and max(sizes) > most_skew * sum(sizes) / len(sizes):
        described = spark.sql(f"DESCRIBE TABLE EXTENDED {binding.table(table)}").where("col_name = 'Location'").first()
        return spark.read.schema(df.schema).format(binding.format).load(described["data_type"])
    return df


def scan_files(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    """Parquet folder under its declared schema.

    With a declared schema Spark opens no footer to infer one, and partition values such as
    ``2024-06-01`` stay the strings they were declared as.
    """
    return spark.read.schema(spec.schema).parquet(path).select(*spec.names)


def partition_predicate(
    partition_by: Sequence[str],
    values: Mapping[str, Sequence[str]] | None = None,
    ranges: Mapping[str, tuple[str, str]] | None = None,
) -> Column:
    """Conjunction over bare partition columns, so that it prunes folders.

    ``values`` lists the wanted values of a column, ``ranges`` gives inclusive bounds.
    """
    values, ranges = values or {}, ranges or {}
    strangers = sorted({*values, *ranges} - set(partition_by))
    if strangers:
        raise ValueError(f"not partition columns: {', '.join(strangers)}")
    if not values and not ranges:
        raise ValueError("name at least one partition column")
    terms = [F.col(name).isin(list(wanted)) for name, wanted in values.items()]
    terms += [F.col(name).between(low, high) for name, (low, high) in ranges.items()]
    predicate = terms[0]
    for term in terms[1:]:
        predicate = predicate & term
    return predicate


def scan_partitions(
    df: DataFrame,
    spec: TableSpec,
    values: Mapping[str, Sequence[str]] | None = None,
    ranges: Mapping[str, tuple[str, str]] | None = None,
    chosen: DataFrame | None = None,
) -> DataFrame:
    """Only the selected partitions of a partitioned table's scan.

    ``chosen`` is a table of partitions: some or all partition columns, and other columns that are not looked at; NULL
    means the partition of NULL. Spark reads it first and then opens the folders of the partitions in it. It goes
    to every executor if its partitions were counted to be at most ``BROADCAST_PARTITIONS``.
    """
    if chosen is None:
        return df.where(partition_predicate(spec.partition_by, values, ranges))
    if values or ranges:
        df = df.where(partition_predicate(spec.partition_by, values, ranges))
    keys = [c for c in spec.partition_by if c in chosen.columns]
    if not keys:
        raise ValueError("the table of partitions has no partition column")
    wanted = chosen.select(*keys).distinct()
    # Pruning takes plain equality, which NULL has none of: each combination of columns that are NULL is a scan of its own.
    parts = []
    for row in wanted.select(*[F.col(k).isNull().alias(k) for k in keys]).distinct().collect():
        given, absent = ([k for k in keys if row[k] == flag] for flag in (False, True))
        part, list_ = df, wanted
        for k in absent:
            part, list_ = part.where(F.col(k).isNull()), list_.where(F.col(k).isNull())
        if given:
            list_ = list_.select(*given).dropna()
            few = list_.limit(BROADCAST_PARTITIONS + 1).count() <= BROADCAST_PARTITIONS
            part = part.join(F.broadcast(list_) if few else list_, given, "left_semi")
        parts.append(part.select(*df.columns))
    return reduce(DataFrame.unionAll, parts) if parts else df.limit(0)


def commit_history(spark: SparkSession, binding: CatalogBinding, table: str) -> DataFrame:
    """Writes to ``table``, oldest first.

    A lakehouse table keeps its own list of snapshots; elsewhere the rows come from the
    ``load_history`` table that the library's writes append to. Without writes there is none,
    and no rows.
    """
    if binding.format == "iceberg":
        snapshots = spark.table(f"{binding.table(table)}.snapshots").select(
            F.col("snapshot_id").cast("string").alias("run_id"),
            "operation",
            F.col("summary")["added-records"].cast("bigint").alias("rows_written"),
            "committed_at",
        )
        return snapshots.orderBy("committed_at")
    if spark.catalog.tableExists(binding.table("load_history")):
        loads = scan_table(spark, binding, "load_history")
    else:
        loads = spark.createDataFrame([], LOAD_HISTORY.schema)
    return (
        loads.where(F.col("tbl") == table)
        .select("run_id", "operation", "rows_written", "committed_at")
        .orderBy("committed_at")
    )
