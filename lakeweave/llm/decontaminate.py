"""Benchmark passages in documents, found by spaced seeds.

A seed is the hash of the words that a mask selects from a window of ``SPAN`` words; the
words it leaves out may differ. Seeds of benchmark items are joined with seeds of all windows
of all documents. A hit fixes how a document lies against an item; the words of both are then
compared along that alignment, and the best run of words decides: every equal word counts 1,
every other word costs ``MISMATCH``.

Everything is a DataFrame function. Windows are formed from shifted copies of an array, so the
generated code hashes them without a sort or a shuffle of the documents; only hits are shuffled,
reduced to one row per alignment in the map tasks. The seeds of the benchmark go to all
executors if their checked number allows, and are joined by shuffle beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.shared import BROADCAST_ROWS, Scratch, semi_join, small
from lakeweave.llm.words import lower_ascii, words

# 1: the word counts, 0: it is ignored. Two windows of 15 words that differ in one word share a
# seed, wherever that word is.
MASKS = ("111100001111", "110110110110", "101011110101")
SPAN = 12
MISMATCH = 2
LEAST_SCORE = 12


def _seeds(hashes: Column) -> tuple[Column, Column]:
    """(generator of windows, seeds of a window): to be applied one after the other."""
    count = F.size(hashes) - (SPAN - 1)
    shifted = [F.slice(hashes, k + 1, F.greatest(count, F.lit(0))).alias(f"w{k}") for k in range(SPAN)]
    seeds = F.array(
        *[
            F.xxhash64(F.lit(m), *[F.col(f"window.w{k}") for k, bit in enumerate(mask) if bit == "1"])
            for m, mask in enumerate(MASKS)
        ]
    )
    return F.posexplode(F.arrays_zip(*shifted)).alias("at", "window"), F.explode(seeds).alias("seed")


def _with_seeds(texts: DataFrame, key: str) -> DataFrame:
    """(key, at, seed) for every window and mask."""
    hashed = texts.select(key, F.transform(words(lower_ascii(F.col("text"))), lambda w: F.xxhash64(w)).alias("h"))
    windows, seeds = _seeds(F.col("h"))
    return hashed.select(key, windows).select(key, "at", seeds)


def _score(shift: Column, doc: Column, item: Column) -> Column:
    """Best sum over a run of aligned words; word ``i`` of the item lies at ``shift + i``."""
    low = F.greatest(shift, F.lit(0))
    size = F.greatest(F.least(F.size(doc), shift + F.size(item)) - low, F.lit(0))
    equal = F.zip_with(F.slice(doc, low + 1, size), F.slice(item, low - shift + 1, size), lambda a, b: a == b)
    state = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, same: Column) -> Column:
        run = F.greatest(s["run"] + F.when(same, 1).otherwise(-MISMATCH), F.lit(0))
        return F.struct(run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(equal, state, step)["best"]


def contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document and benchmark item it holds: doc_id, item_id, overlap_score, n_alignments.

    ``docs`` has ``doc_id`` and ``text``, ``benchmark`` has ``item_id`` and ``text``; other
    columns are not read. Words are lower-cased (A-Z). ``overlap_score`` is the best score over
    all alignments with a common seed; ``n_alignments`` counts those that reach ``LEAST_SCORE``,
    for several texts under one id in the text that has most.

    Null, empty and short texts (fewer than ``SPAN`` words) have no window, so they hold no
    item and are none. Rows without an id are not searched. Rows repeated under an id count
    once, several texts under one id as texts of one document. Empty tables give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL").distinct()
    wanted = scratch.save(
        _with_seeds(items, "item_id").select("item_id", F.col("at").alias("item_at"), "seed").distinct(), "seeds"
    )
    wanted_seeds = F.broadcast(wanted) if small(wanted, broadcast_rows) else wanted
    hits = _with_seeds(texts, "doc_id").join(wanted_seeds, "seed")
    hits = hits.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    hits = scratch.save(hits, "hits")

    item_words = items.select("item_id", words(lower_ascii(F.col("text"))).alias("item_words"))
    found = semi_join(texts, hits.select("doc_id").distinct(), "doc_id", broadcast_rows).distinct()
    found = found.select("doc_id", words(lower_ascii(F.col("text"))).alias("doc_words"))
    # A text lies against an item in at most as many ways as it has words, so its row stays bounded
    # by the text; were each way a row, a repetitive text would be copied to all of them.
    ways = hits.groupBy("doc_id", "item_id").agg(F.collect_list("shift").alias("shifts"))
    each = ways.join(found, "doc_id").join(item_words, "item_id")
    scores = F.transform("shifts", lambda shift: _score(shift, F.col("doc_words"), F.col("item_words")))
    scored = each.select("doc_id", "item_id", F.filter(scores, lambda x: x >= LEAST_SCORE).alias("scores"), "shifts")
    best = scored.where(F.size("scores") > 0).select("doc_id", "item_id", F.array_max("scores").alias("best"), F.size("scores").alias("n"))
    return best.groupBy("doc_id", "item_id").agg(
        F.max("best").alias("overlap_score"), F.max("n").cast("long").alias("n_alignments")
    )
