"""Folds and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.llm.shared import BROADCAST_ROWS, semi_join


def remainder(folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null without an id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def training_labels(labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """(doc_id, y) of labelled rows to learn from; with several labels for an id the largest."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    return rows.where(learn & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.max("y").alias("y"))


def first_by_hash(rows: DataFrame, most: int, salt: int) -> DataFrame:
    """At most ``most`` rows, chosen by a hash of the id alone."""
    return rows.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(most)


def sample_texts(docs: DataFrame, chosen: DataFrame, most_bytes: int) -> list[tuple[int, bytes]]:
    """(y, text) of the chosen rows (doc_id, y) in the driver, in order of their hash, as
    far as they fit into ``most_bytes`` of a kind. A text longer than a hundredth of that gives a
    part of this length from a place set by its hash, so none keeps others out. Both bounds are the caller's parameters; ``chosen`` is small."""
    found = semi_join(docs.select("doc_id", "text"), chosen.select("doc_id"), "doc_id", BROADCAST_ROWS)
    found = found.where(F.length("text") > 0).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    order = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    # A code point has at most four bytes.
    most = max(most_bytes // 400, 1)
    place = F.pmod(F.xxhash64("doc_id", F.lit(most)), F.greatest(F.length("text") - most, F.lit(0)) + 1)
    part = F.when(F.octet_length("text") > 4 * most, F.substring("text", place.cast("int") + 1, F.lit(most)))
    found = found.withColumn("text", F.coalesce(part, "text"))
    sizes = found.select("doc_id", "y", F.octet_length("text").alias("size"))
    fits = sizes.withColumn("upto", F.sum("size").over(order)).where(F.col("upto") <= most_bytes).select("doc_id")
    rows = found.join(F.broadcast(fits), "doc_id", "left_semi").select("doc_id", "y", "text").collect()
    return [(r["y"], r["text"].encode()) for r in sorted(rows, key=lambda r: r["doc_id"])]
