"""Replication of what differs, found by comparing hash trees.

The leaves of a table's tree are its key buckets within its partitions: their number of rows and the sum
of the rows' hashes. Partitions are sums of leaves, and the table is the sum of its partitions. The source's leaves take
one pass that is reduced in the map tasks; those of the target were kept by the last replication beside the
table, so its data is not read. Roots are compared first, partitions only if they differ, buckets only within partitions that do.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.schemas import TableSpec, column
from lakeweave.session import workspace
from lakeweave.sinks.ddl import create_table, ensure_namespace
from lakeweave.sinks.history import Load, record_loads
from lakeweave.sinks.writes import empty_partitions, hashable, overwrite_partitions, replace_files
from lakeweave.sources.bindings import CatalogBinding, quoted
from lakeweave.sources.tables import partition_predicate, scan_partitions, scan_table

KEY_BUCKETS = 64

_SUM = "decimal(38,0)"


def row_hash(df: DataFrame) -> Column:
    """Hash of a row that tells a NULL in one column from a NULL in another."""
    columns = hashable(df)
    return F.xxhash64(*[F.col(c).isNull() for c in columns], *columns)


def digest_spec(spec: TableSpec) -> TableSpec:
    """The table of leaves that belongs to a table."""
    parts = [f for f in spec.schema if f.name in spec.partition_by]
    leaf = [
        column("key_bucket", T.IntegerType(), "bucket of the key's hash"),
        column("leaf_rows", T.LongType(), "rows"),
        column("leaf_hash", T.DecimalType(38, 0), "sum of the rows' hashes"),
    ]
    return TableSpec(T.StructType([*parts, *leaf]), "row counts and hashes by partition and key bucket")


def digest_leaves(df: DataFrame, spec: TableSpec, key: Sequence[str], buckets: int = KEY_BUCKETS) -> DataFrame:
    """Leaves of the hash tree of ``df``, which has the columns of ``spec``."""
    bucket = F.pmod(F.xxhash64(*[quoted(k) for k in key]), F.lit(buckets)).cast("int")
    each = df.select(*spec.partition_by, bucket.alias("key_bucket"), row_hash(df.select(*spec.names)).cast(_SUM).alias("h"))
    return each.groupBy(*spec.partition_by, "key_bucket").agg(
        F.count(F.lit(1)).alias("leaf_rows"), F.sum("h").cast(_SUM).alias("leaf_hash")
    )


def _summed(leaves: DataFrame, *by: str) -> DataFrame:
    return leaves.groupBy(*by).agg(F.sum("leaf_rows").alias("rows"), F.sum("leaf_hash").cast(_SUM).alias("hash"))


def _compared(source: DataFrame, held: DataFrame, by: Sequence[str]) -> DataFrame:
    """Nodes of one level that differ: the columns ``by`` and ``change``, one of new, gone and changed."""
    ours, theirs = _summed(source, *by).alias("s"), _summed(held, *by).alias("t")
    same = reduce(lambda a, b: a & b, (F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by))
    both = ours.join(theirs, same, "full_outer")
    change = (
        F.when(F.col("t.rows").isNull(), "new")
        .when(F.col("s.rows").isNull(), "gone")
        .when((F.col("s.rows") != F.col("t.rows")) | (F.col("s.hash") != F.col("t.hash")), "changed")
    )
    # A node without a partner has NULL in all columns of the other side; one that lies in the partition of NULL has them in both.
    at = [F.when(F.col("s.rows").isNull(), F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in by]
    return both.select(*at, change.alias("change")).where("change IS NOT NULL")


def same_root(source: DataFrame, held: DataFrame) -> bool:
    ours, theirs = (_summed(leaves).first() for leaves in (source, held))
    return tuple(ours) == tuple(theirs)


def differing_partitions(source: DataFrame, held: DataFrame, spec: TableSpec) -> DataFrame:
    """Partitions whose leaves do not add up to the same: partition columns and ``change``."""
    return _compared(source, held, spec.partition_by)


def differing_buckets(source: DataFrame, held: DataFrame, spec: TableSpec, partitions: DataFrame) -> DataFrame:
    """Key buckets that differ, looked for in the given partitions only."""
    within = [_within(leaves, partitions, spec.partition_by) for leaves in (source, held)]
    return _compared(*within, [*spec.partition_by, "key_bucket"])


def _within(leaves: DataFrame, partitions: DataFrame, by: Sequence[str]) -> DataFrame:
    other = partitions.select(*[F.col(c).alias(f"wanted {c}") for c in by])
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"`wanted {c}`")) for c in by))
    return leaves.join(other, same, "left_semi")


@dataclass(frozen=True)
class Synced:
    """What a replication did: rows written, partitions by kind, and the partitions themselves."""

    rows: int
    new: int
    changed: int
    gone: int
    partitions: DataFrame | None = None


class Replica:
    """A table of one catalog that follows a partitioned table of another, partition by partition.

    ``key`` are the columns that deal rows to buckets, the same in every run, as is ``buckets``.
    """

    def __init__(
        self,
        spark: SparkSession,
        source: CatalogBinding,
        target: CatalogBinding,
        table: str,
        spec: TableSpec,
        key: Sequence[str],
        buckets: int = KEY_BUCKETS,
    ) -> None:
        if not spec.partition_by:
            raise ValueError("only partitioned tables can be replicated by partition")
        self.spark, self.source, self.target, self.table = spark, source, target, table
        self.spec, self.key, self.buckets = spec, list(key), buckets
        self.digests = f"{table}_digests"

    def _saved(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{workspace(self.spark)}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def leaves(self, binding: CatalogBinding, condition: Column | None = None) -> DataFrame:
        """Leaves of the table as the binding's catalog has it, written down."""
        rows = scan_table(self.spark, binding, self.table).select(*self.spec.names)
        rows = rows if condition is None else rows.where(condition)
        return self._saved(digest_leaves(rows, self.spec, self.key, self.buckets), "leaves")

    def held(self) -> DataFrame:
        """Leaves as the last replication left them."""
        return scan_table(self.spark, self.target, self.digests)

    def sync(
        self, values: Mapping[str, Sequence[str]] | None = None, ranges: Mapping[str, tuple[str, str]] | None = None, recheck: bool = False
    ) -> Synced:
        """Make the target's (selected) partitions equal to the source's; those that are equal already are left alone.

        New and changed partitions are replaced in one write, and partitions that the source lost are emptied. The target's leaves are
        written last and in one switch: after a failure on the way they still tell of the difference, and the next run
        does the rest. ``recheck`` reads the target's data for its leaves, where others may have written to it.
        """
        ensure_namespace(self.spark, self.target)
        create_table(self.spark, self.target, self.table, self.spec)
        create_table(self.spark, self.target, self.digests, digest_spec(self.spec))
        condition = partition_predicate(self.spec.partition_by, values, ranges) if values or ranges else None
        source = self.leaves(self.source, condition)
        kept = self.leaves(self.target) if recheck else self.held()
        held = kept if condition is None else kept.where(condition)
        if same_root(source, held) and not recheck:
            return Synced(0, 0, 0, 0)
        partitions = self._saved(differing_partitions(source, held, self.spec), "partitions")
        kinds = {row["change"]: row["count"] for row in partitions.groupBy("change").count().collect()}
        rows = 0
        if kinds.get("new") or kinds.get("changed"):
            wanted = partitions.where("change <> 'gone'")
            scan = scan_table(self.spark, self.source, self.table)
            rows = overwrite_partitions(self.spark, self.target, self.table, scan_partitions(scan, self.spec, chosen=wanted))
        if kinds.get("gone"):
            gone = partitions.where("change = 'gone'").select(*self.spec.partition_by).collect()  # one row per partition, no data
            empty_partitions(self.spark, self.target, self.table, [row.asDict() for row in gone])
        others = [] if condition is None else [kept.where(~F.coalesce(condition, F.lit(False)))]
        names = digest_spec(self.spec).names
        replace_files(self.spark, self.target, self.digests, reduce(DataFrame.unionByName, others, source).select(*names))
        record_loads(self.spark, self.target, [Load(self.table, "overwrite", rows)])
        return Synced(int(rows), *(kinds.get(k, 0) for k in ("new", "changed", "gone")), partitions)

    def row_changes(self) -> DataFrame:
        """Rows in which the target differs from the source: partition columns, the key and ``change``.

        Rows are read from differing partitions and compared in differing buckets only. ``change`` is what happened in the
        source since: added, removed or changed. Rows repeated under a key count as changed if their number or any of them differs.
        """
        source, held = self.leaves(self.source), self.held()
        partitions = self._saved(differing_partitions(source, held, self.spec), "partitions")
        buckets = self._saved(differing_buckets(source, held, self.spec, partitions), "buckets")
        by = [*self.spec.partition_by, *self.key]

        def rows_of(binding: CatalogBinding) -> DataFrame:
            scan = scan_table(self.spark, binding, self.table).select(*self.spec.names)
            rows = scan_partitions(scan, self.spec, chosen=partitions)
            bucket = F.pmod(F.xxhash64(*[quoted(k) for k in self.key]), F.lit(self.buckets)).cast("int")
            marked = rows.select(*by, bucket.alias("key_bucket"), row_hash(rows).cast(_SUM).alias("h"))
            found = _within(marked, buckets, [*self.spec.partition_by, "key_bucket"])
            return found.groupBy(*by).agg(F.count(F.lit(1)).alias("leaf_rows"), F.sum("h").cast(_SUM).alias("leaf_hash"))

        kinds = F.element_at(F.create_map(*map(F.lit, ("new", "added", "gone", "removed", "changed", "changed"))), F.col("change"))
        return _compared(rows_of(self.source), rows_of(self.target), by).withColumn("change", kinds)
