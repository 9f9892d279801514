"""Spelling variants: words of a vocabulary that differ by one edit, grouped around the frequent ones.

One edit between two words, the shorter of ``size`` code points, lies in the first or in the
second half of the shorter word; what is outside that window ``[lo, hi)`` both words share. So
every word goes into buckets by what is outside of a window, as a word of its own length and as
one a code point longer than its partner, and only what is inside, its rest, is compared there.

Spark sorts every bucket by the rest. A bucket is searched by scanning its sorted list for one word
after the other: the row of the edit matrix for each prefix of a list entry is kept, only the
three cells around the diagonal, and an entry continues from the row at the length of its common
prefix with the entry before. Once all cells of a row exceed one edit, every following entry that
shares this prefix is skipped.

A bucket of more than ``LARGEST`` words is not searched: its window is halved and its words are
dealt out again, if need be down to windows of one code point, where a bucket cannot grow beyond
the alphabet. No bucket is cut short, and no pairs are listed but those found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.shared import Scratch, anti_join, semi_join, small

# Words of a bucket that are searched in one list.
LARGEST = 100
# A word's form occurs at least so many times as often as the word.
DOMINANT = 2

_PAIRS = "word string, near string, near_n long"


def common_prefix(a: str, b: str) -> int:
    """Number of code points at the start of both."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    at = 0
    while a[at] == b[at]:
        at += 1
    return at


def within_one_edit(query: str, entries: list[str], lcps: list[int]) -> list[int]:
    """Indexes of the sorted entries that are one edit or none away from the query.

    ``lcps[k]`` is the common prefix of entries ``k - 1`` and ``k``. ``rows[d]`` holds the cells of
    the edit matrix at ``d`` code points of the entry and ``d - 1``, ``d`` and ``d + 1`` of the query.
    """
    size, found = len(query), []
    rows = [(2, 0, 1)]
    k, total, depth = 0, len(entries), 0
    while k < total:
        entry = entries[k]
        if depth > lcps[k]:
            depth = lcps[k]
            del rows[depth + 1 :]
        left, middle, right = rows[depth]
        end = len(entry)
        while depth < end:
            c = entry[depth]
            # One code point more of the entry; costs of 2 and more are all alike.
            low = left if 0 < depth <= size and c == query[depth - 1] else left + 1
            if middle + 1 < low:
                low = middle + 1
            mid = middle if depth < size and c == query[depth] else middle + 1
            if right + 1 < mid:
                mid = right + 1
            if low + 1 < mid:
                mid = low + 1
            high = right if depth + 1 < size and c == query[depth + 1] else right + 1
            if mid + 1 < high:
                high = mid + 1
            depth += 1
            left, middle, right = low, mid, high
            if low > 1 and mid > 1 and high > 1:
                break
            rows.append((low, mid, high))
        else:
            # The whole entry is read; the cell at the end of the query tells the distance.
            at = size - end
            if -1 <= at <= 1 and (left, middle, right)[at + 1] <= 1:
                found.append(k)
            k += 1
            continue
        # No word with these ``depth`` first code points can be near.
        k += 1
        while k < total and lcps[k] >= depth:
            k += 1
        depth -= 1
    return found


def search_bucket(size: int, last: bool, rests: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs of a bucket's sorted rests that are exactly one edit apart, the shorter or equal one first.

    ``size`` is the length of a window, and the rest of a word is that long or one longer. ``last``
    tells whether the window ends with the word. An edit that fits several windows counts in the
    rightmost: what agrees in all of a window is left to the next one.
    """
    lcps = [0] * len(rests)
    for k in range(1, len(rests)):
        lcps[k] = common_prefix(rests[k - 1], rests[k])
    for i, rest in enumerate(rests):
        if len(rest) == size:
            for j in within_one_edit(rest, rests, lcps):
                other = rests[j]
                if other != rest and (last or not other.startswith(rest)):
                    yield i, j


def _search_lists(rows: pa.RecordBatch, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(word, near, near_n) for rows (size, last, rest, word, n) of buckets that end at ``ends``."""
    begins = np.concatenate(([0], ends[:-1]))
    several = ends - begins > 1
    begins, ends = begins[several], ends[several]
    firsts, others = [], []
    for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
        size, last = rows.column("size")[begin].as_py(), rows.column("last")[begin].as_py()
        rests = rows.column("rest").slice(begin, end - begin).to_pylist()
        for i, j in search_bucket(size, last, rests):
            firsts.append(begin + i)
            others.append(begin + j)
            if len(rests[j]) > size:
                firsts.append(begin + j)
                others.append(begin + i)
    if firsts:
        word, n = rows.column("word"), rows.column("n")
        yield pa.RecordBatch.from_arrays([word.take(pa.array(firsts)), word.take(pa.array(others)), n.take(pa.array(others))],
                                         names=["word", "near", "near_n"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all buckets of a sorted partition; the one that a batch ends in waits for the next batch."""
    held = None
    for batch in batches:
        if batch.num_rows:
            rows = batch if held is None else pa.concat_batches([held, batch])
            ends = pc.run_end_encode(rows.column("key")).run_ends.to_numpy().astype(np.int64)
            begin = int(ends[-2]) if len(ends) > 1 else 0
            yield from _search_lists(rows, ends[:-1])
            held = rows.slice(begin)
    if held is not None:
        yield from _search_lists(held, np.array([held.num_rows]))


def _windows(vocabulary: DataFrame) -> DataFrame:
    """(word, n, size, lo, hi): both halves, of the word as the shorter and as the longer of a pair."""
    n = F.length("word")
    halves = [F.struct(size.alias("size"), lo.alias("lo"), hi.alias("hi")) for size in (n, n - 1)
              for lo, hi in ((F.lit(0), (size / 2).cast("int")), ((size / 2).cast("int"), size))]
    each = vocabulary.select("word", "n", F.explode(F.array(*halves)).alias("window"))
    return each.select("word", "n", "window.*").where("hi > lo")


def _halved(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    parts = [F.struct(lo.alias("lo"), hi.alias("hi")) for lo, hi in ((F.col("lo"), middle), (middle, F.col("hi")))]
    return rows.select("word", "n", "size", F.explode(F.array(*parts)).alias("window")).select("word", "n", "size", "window.*")


def _keyed(rows: DataFrame) -> DataFrame:
    """The bucket of every row: its window, and what is before and after it."""
    before = F.substring("word", F.lit(1), F.col("lo"))
    after = F.substring("word", F.col("hi") + F.length("word") - F.col("size") + 1, F.col("size") - F.col("hi"))
    return rows.withColumn("key", F.concat_ws("\x00", F.hex("size"), F.hex("lo"), F.hex("hi"), before, after))


def _searched(keyed: DataFrame) -> DataFrame:
    window = F.col("hi") - F.col("lo")
    rest = F.substring("word", F.col("lo") + 1, window + F.length("word") - F.col("size"))
    lists = keyed.select("key", window.alias("size"), (F.col("hi") == F.col("size")).alias("last"), rest.alias("rest"), "word", "n")
    return lists.repartition("key").sortWithinPartitions("key", "rest").mapInArrow(_search, _PAIRS)


def near_words(vocabulary: DataFrame, scratch: Scratch, largest: int = LARGEST) -> DataFrame:
    """(word, near, near_n) for every ordered pair of words exactly one edit apart, each once.

    ``vocabulary`` has distinct, non-empty ``word`` and ``n``, and is cheap to read again.
    """
    keyed = _keyed(_windows(vocabulary))
    found = []
    while True:
        sizes = keyed.groupBy("key", (F.col("hi") - F.col("lo")).alias("window")).count()
        large = scratch.save(sizes.where((F.col("count") > largest) & (F.col("window") > 1)).select("key"), "large-buckets")
        if large.isEmpty():
            break
        found.append(_searched(anti_join(keyed, large, "key")))
        keyed = scratch.save(_keyed(_halved(semi_join(keyed, large, "key").select("word", "n", "size", "lo", "hi"))), "halved")
    out = _searched(keyed)
    for more in found:
        out = out.unionByName(more)
    return out


def _roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the end of the chain of forms, whose length doubles in every round."""
    links = scratch.save(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("far"))
        onward = F.broadcast(onward) if small(onward, 100_000) else onward
        step = links.join(onward, "root", "left")
        links = scratch.save(step.select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        if links.where("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")


def spelling_variants(vocabulary: DataFrame, largest: int = LARGEST) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    ``vocabulary`` has ``word`` and ``n``, how often it occurs; other columns are not read. Words
    are near if exactly one inserted, deleted or replaced code point tells them apart. ``form`` is
    the near word with the largest ``n`` (of several the smallest in code-point order) if that is at least
    ``DOMINANT`` times the word's own, else null, and ``form_n`` its ``n``. ``root`` is reached from the word by
    following forms; the word itself if it has none. ``n_near`` counts the near words.

    The ``n`` of rows repeated for a word are added up. Null and empty words, and words whose ``n`` is null
    or adds up to less than 1, are left out. Letters are compared as they are. Words of any length are
    compared whole; an empty table gives an empty result.
    """
    scratch = Scratch(vocabulary.sparkSession)
    total = vocabulary.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n")).where("word <> ''")
    words = scratch.save(total.groupBy("word").agg(F.sum("n").alias("n")).where("n >= 1"), "words")
    near = near_words(words, scratch, largest)
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("form")))
    stats = scratch.save(near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")), "near")
    known = words.join(stats, "word", "left").withColumn("top", -F.col("best.order"))
    has_form = F.col("top") >= DOMINANT * F.col("n")
    known = known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("best.form")).alias("form"),
        F.when(has_form, F.col("top")).alias("form_n"),
    )
    known = scratch.save(known, "known")
    roots = _roots(scratch, known.where("form IS NOT NULL"))
    out = known.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
