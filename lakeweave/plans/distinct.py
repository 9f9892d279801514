"""A table of distinct rows that grows by what is new in each batch.

Every row is stored with a fingerprint of 128 bits, in a partition by the first bits of it. A batch is compared
with the fingerprints of the partitions its own rows fall into; other columns and partitions are not read, and no
file is written again. Row and fingerprint are one write, so a failure cannot part them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.operators.readings import distinct_rows, rank_readings
from lakeweave.schemas import RANKED_READINGS, TableSpec, column
from lakeweave.session import workspace
from lakeweave.sinks.ddl import create_table, ensure_namespace
from lakeweave.sinks.history import Load, record_loads
from lakeweave.sinks.writes import append, conform, hashable
from lakeweave.sources.bindings import CatalogBinding
from lakeweave.sources.tables import scan_table

# Partitions of the table. A batch writes a file into each that it has a new row for.
BUCKETS = 64

_PRINTS = ("fingerprint_a", "fingerprint_b")
_BUCKET = "fingerprint_bucket"


def fingerprinted(spec: TableSpec) -> TableSpec:
    """A table of distinct rows: the columns of ``spec``, the fingerprint and its bucket."""
    prints = [column(name, T.LongType(), "hash of the row") for name in _PRINTS]
    bucket = column(_BUCKET, T.IntegerType(), "partition: bucket of the hash")
    return TableSpec(T.StructType([*spec.schema, *prints, bucket]), spec.comment, (_BUCKET,))


def with_fingerprint(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """NULL equals NULL and differs from every value; 0.0 equals -0.0."""
    columns = hashable(df)
    absent = [F.col(c).isNull() for c in columns]
    prints = [F.xxhash64(F.lit(seed), *absent, *columns).alias(name) for seed, name in enumerate(_PRINTS)]
    return df.select("*", *prints).withColumn(_BUCKET, F.pmod(F.col(_PRINTS[0]), F.lit(buckets)).cast("int"))


def append_distinct(
    spark: SparkSession,
    target: CatalogBinding,
    table: str,
    batch: DataFrame,
    spec: TableSpec,
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
    buckets: int = BUCKETS,
) -> int:
    """Append the rows of ``batch`` that the table does not hold yet, each once; returns how many there were.

    ``transform`` derives what is stored from different rows of the batch, row by row. ``buckets`` stays the same
    for a table. The batch's distinct rows are written down once and read twice. A failed call leaves the table as it was or
    with all new rows, and can be repeated.
    """
    ensure_namespace(spark, target)
    create_table(spark, target, table, fingerprinted(spec))
    stored = conform(transform(distinct_rows(batch)), spec.schema)
    path = f"{workspace(spark)}/batch"
    fresh = with_fingerprint(distinct_rows(stored), buckets)
    fresh.write.parquet(path)
    fresh = spark.read.schema(fresh.schema).parquet(path)
    touched = [row[0] for row in fresh.select(_BUCKET).distinct().collect()]  # at most ``buckets`` numbers
    held = scan_table(spark, target, table).where(F.col(_BUCKET).isin(touched)).select(*_PRINTS, _BUCKET)
    new = fresh.join(held, [_BUCKET, *_PRINTS], "left_anti").select(*fresh.columns)
    rows = append(spark, target, table, new, partition_by=(_BUCKET,))
    record_loads(spark, target, [Load(table, "append", rows)])
    return int(rows)


def scan_distinct(spark: SparkSession, binding: CatalogBinding, table: str) -> DataFrame:
    """The stored rows without their fingerprints."""
    return scan_table(spark, binding, table).drop(*_PRINTS, _BUCKET)


def dedup_increment(
    spark: SparkSession,
    target: CatalogBinding,
    readings: DataFrame,
    table: str = "sensor_readings_distinct",
    spec: TableSpec = RANKED_READINGS,
    buckets: int = BUCKETS,
) -> int:
    """``dedup_and_rank`` for one batch of readings: its new rows, with their band, are added to the target."""
    return append_distinct(spark, target, table, readings, spec, rank_readings, buckets)
