"""Tables written on the way, and joins whose broadcast is checked first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.session import workspace

# Most rows of (key, a few numbers) sent to every executor: about 64 MB with Spark's own overhead.
BROADCAST_ROWS = 1_000_000


class Scratch:
    """Tables of one run, in the folder that ``spark.checkpoint.dir`` names.

    A saved table cuts the lineage: an executor lost later costs a read of shared files and
    no recomputation. Files stay until the folder is cleared, as with ``checkpoint()``.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = workspace(spark)
        self.saved = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.saved += 1
        path = f"{self.root}/{self.saved:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``most`` rows; reads no more than it must to tell."""
    return df.limit(most + 1).count() <= most


def semi_join(df: DataFrame, ids: DataFrame, on: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose key is among ``ids``.

    A key list whose size was checked goes to every executor, so that wide rows are not
    shuffled to find a few of them; a longer one is joined by shuffle.
    """
    return df.join(F.broadcast(ids) if small(ids, most) else ids, on, "left_semi")


def anti_join(df: DataFrame, ids: DataFrame, on: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose key is not among ``ids``, rows without a key included; as ``semi_join``."""
    return df.join(F.broadcast(ids) if small(ids, most) else ids, on, "left_anti")


# Rows of (key, a few numbers) that the driver holds with little memory, about 8 MB. Bits for a longer list of keys:
# so many for each, in parts of PART_BITS (4 KB), 8 MB in all at most.
FEW_ROWS = 100_000
BITS_PER_KEY, MOST_BITS = 16, 1 << 26
PART_BITS = 1 << 15


def _place(key: Column, bits: int) -> tuple[Column, Column]:
    """The part that holds the bit of a key, and where it is in there."""
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    return F.floor(at / PART_BITS), at % PART_BITS


def lean_semi_join(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """As ``semi_join``, for a list of any length that lies in a table: the driver holds ``FEW_ROWS`` keys or 8 MB.

    Of a longer list two bytes a key are sent, bits at the hashes of the keys. They drop most other rows (15 of 16,
    fewer where the list is beyond four million) where they are read, and what is left is joined by shuffle.
    """
    n = ids.count()
    if n <= FEW_ROWS:
        return df.join(F.broadcast(ids), on, "left_semi")
    bits = min(n * BITS_PER_KEY, MOST_BITS)
    part, at = _place(F.col(on), bits)
    marked = F.broadcast(ids.groupBy(part.alias("part")).agg(F.bitmap_construct_agg(at).alias("marks")))
    part, at = _place(df[on], bits)
    byte = F.substring(marked["marks"], F.floor(at / 8).cast("int") + 1, F.lit(1))
    is_set = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (at % 8).cast("int")) == 1
    return df.join(marked, (part == marked["part"]) & is_set, "left_semi").join(ids, on, "left_semi")


ROW_KEY = "lakeweave row"


def with_row_key(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with a key in ``ROW_KEY`` that rows have in common only if their id and text are equal.

    It is the ``doc_id`` where that tells texts apart. Rows without one, and all rows of an id that
    different texts carry, get a hash of id and text.
    """
    text = F.xxhash64(F.col("text").isNull(), "text")
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("h")).where("doc_id IS NOT NULL")
    texts = known.groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high")
    shared = scratch.save(texts.select(F.col("doc_id").alias("shared id")), "shared-ids")
    key, hashed = F.col("doc_id").cast("long"), F.xxhash64(F.lit("row"), "doc_id", F.col("text").isNull(), "text")
    if shared.isEmpty():
        return docs.withColumn(ROW_KEY, F.coalesce(key, hashed))
    shared = F.broadcast(shared) if small(shared) else shared
    marked = docs.withColumn(ROW_KEY, key).join(shared, F.col(ROW_KEY) == F.col("`shared id`"), "left")
    return marked.withColumn(ROW_KEY, F.when(F.col("`shared id`").isNull(), F.coalesce(key, hashed)).otherwise(hashed)).drop("shared id")
