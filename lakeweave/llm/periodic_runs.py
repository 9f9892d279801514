"""Runs: stretches of words that repeat with a period and cannot be extended.

A root of a run, read from the right place, is a Lyndon word under one of the two orders of the
words (smallest first or largest first), and is the longest one that starts there. So the longest
Lyndon word from every position under both orders, extended to both sides as far as the text
repeats itself at that distance, gives all runs.

The lengths of these Lyndon words come from the first phase of a suffix sorter by grouping. Positions
begin in groups by their word. The groups are taken from the highest to the lowest; for every position in the taken group
the nearest position to the left that is in a lower group is looked up. Those found move to
new groups right above their own, apart by how often they were found, and the string that their group
shares grows by as many copies of the taken group's string. When a group is taken its string is the longest Lyndon word
of its positions. The order within groups, the second phase, is not needed.

How far a text repeats itself is looked up in names of blocks of 1, 2, 4, ... words, equal blocks with
equal names, so that it is exact.

Only runs of ``LEAST_PERIODS`` periods and ``LEAST_WORDS`` words are wanted. Each three words in a row
in such a run occur at least three times in it. Texts are therefore first cut at every three words that occur
less often, the pieces again, and so on until nothing changes; a run is never cut, and in most texts nothing is left to
search. All of it works on slices of many texts; a text is never cut into slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.textbytes import Texts, slices

LEAST_PERIODS = 4
LEAST_WORDS = 6

_RUNS = "array<struct<start: long, length: long, period: long>>"


def lyndon_lengths(symbols: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word from every position; 0 stands for the end of a text.

    ``symbols`` are integers from 0 on, the first and last of them 0. A position that holds 0 has length 1.
    """
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    # A group is known by the place of its first member in ``members``.
    begin = np.zeros(len(symbols), np.int64)
    begin[order] = np.repeat(first, np.diff(np.append(first, len(symbols))))
    members, group = order.tolist(), begin.tolist()
    place = np.empty(len(symbols), np.int64)
    place[order] = np.arange(len(symbols))
    place = place.tolist()
    sizes = dict(zip(first.tolist(), np.diff(np.append(first, len(symbols))).tolist(), strict=True))
    shared = dict.fromkeys(first.tolist(), 1)
    lengths = [1] * len(symbols)
    # Where to go on looking to the left of a position that is in no lower group.
    left = list(range(-1, len(symbols) - 1))
    end = len(members)
    while group[members[end - 1]]:
        taken = group[members[end - 1]]
        length = shared[taken]
        hits: dict[int, int] = {}
        # From left to right, so that equal neighbours find each other's result.
        for i in members[taken:end] if end - taken == 1 else sorted(members[taken:end]):
            lengths[i] = length
            p = left[i]
            if group[p] >= taken:
                passed = []
                while group[p] >= taken:
                    passed.append(p)
                    p = left[p]
                for q in passed:
                    left[q] = p
                left[i] = p
            hits[p] = hits.get(p, 0) + 1
        end = taken
        moves: dict[tuple[int, int], list[int]] = {}
        for p, times in hits.items():
            if group[p]:
                moves.setdefault((times, group[p]), []).append(p)
        # The most often found go to the end of their group first.
        for times, old in sorted(moves, reverse=True):
            moved = moves[times, old]
            new = old + sizes[old] - len(moved)
            if new == old:
                shared[old] += times * length
                continue
            at = old + sizes[old]
            for p in moved:
                at -= 1
                other, here = members[at], place[p]
                members[at], members[here] = p, other
                place[p], place[other] = at, here
                group[p] = new
            sizes[old], sizes[new] = new - old, len(moved)
            shared[new] = shared[old] + times * length
    return np.array(lengths, np.int64)


class Blocks:
    """Names of all blocks of 1, 2, 4, ... symbols: how far two places agree to the right and to the left."""

    def __init__(self, symbols: np.ndarray, longest: int) -> None:
        self.names = [symbols.astype(np.int64)]
        while 2 << (len(self.names) - 1) <= longest:
            half, names = 1 << (len(self.names) - 1), self.names[-1]
            pairs = names[:-half] * (len(symbols) + 1) + names[half:]
            self.names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))

    def _equal(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        names = self.names[level]
        inside = (np.minimum(a, b) >= 0) & (np.maximum(a, b) < len(names))
        out = np.zeros(len(a), bool)
        out[inside] = names[a[inside]] == names[b[inside]]
        return out

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal symbols from ``a`` and from ``b`` on."""
        out = np.zeros(len(a), np.int64)
        active = np.arange(len(a))
        # The longest block may fit several times.
        while len(active):
            active = active[self._equal(len(self.names) - 1, a[active] + out[active], b[active] + out[active])]
            out[active] += 1 << (len(self.names) - 1)
        for level in range(len(self.names) - 2, -1, -1):
            out += self._equal(level, a + out, b + out).astype(np.int64) << level
        return out

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal symbols before ``a`` and before ``b``."""
        out = np.zeros(len(a), np.int64)
        active, top = np.arange(len(a)), 1 << (len(self.names) - 1)
        while len(active):
            active = active[self._equal(len(self.names) - 1, a[active] - out[active] - top, b[active] - out[active] - top)]
            out[active] += top
        for level in range(len(self.names) - 2, -1, -1):
            size = 1 << level
            out += self._equal(level, a - out - size, b - out - size).astype(np.int64) << level
        return out


def runs_of(symbols: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, length, period) of all long enough runs, by start and period.

    ``symbols`` are integers from 1 on, with a 0 before and after every text; no text holds more than ``longest``.
    """
    blocks = Blocks(symbols, longest)
    highest = symbols.max() + 1
    found = []
    for order in (symbols, np.where(symbols > 0, highest - symbols, 0)):
        period = lyndon_lengths(order)
        at = np.flatnonzero(symbols)
        at = at[symbols[at] == symbols[at + period[at]]]
        period = period[at]
        back = blocks.left(at, at + period)
        length = back + period + blocks.right(at, at + period)
        long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        found.append(np.stack([at - back, length, period], axis=1)[long])
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def repetitive_parts(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of the parts that may hold a run.

    ``words`` are hashes of all words of some texts, and ``text`` the text of each, in ascending order.
    """
    if len(words) < LEAST_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        triples = (words[:-2] * np.uint64(0x9E3779B97F4A7C15) + words[1:-1]) * np.uint64(0xD6E8FEB86659FD93) + words[2:]
    at = np.flatnonzero(text[2:] == text[:-2])
    part = text[at]
    while len(at):
        order = np.lexsort((triples[at], part))
        key, where = triples[at][order], part[order]
        new = np.append(True, (key[1:] != key[:-1]) | (where[1:] != where[:-1]))
        begins = np.flatnonzero(new)
        times = np.diff(np.append(begins, len(at)))
        often = np.zeros(len(at), bool)
        often[order] = np.repeat(times >= LEAST_PERIODS - 1, times)
        kept, before = at[often], part[often]
        if not len(kept):
            break
        # Neighbours of the same part stay together; a part of too few words goes.
        apart = np.append(True, (np.diff(kept) != 1) | (np.diff(before) != 0))
        label = np.cumsum(apart) - 1
        large = np.bincount(label)[label] >= LEAST_WORDS - 2
        kept, label = kept[large], label[large]
        if len(kept) == len(at):
            firsts = np.flatnonzero(np.append(True, np.diff(label) != 0))
            return kept[firsts], np.diff(np.append(firsts, len(kept))) + 2
        at, part = kept, label
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


def text_runs(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Rows (first word, length, period) of all runs, words counted over all texts, and the text of each."""
    with np.errstate(over="ignore"):
        words = texts.word_hashes()
    text = np.repeat(np.arange(texts.size), texts.n_words)
    first, size = repetitive_parts(words, text)
    if not len(first):
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    # The parts one after the other, with a 0 around each.
    begin = np.cumsum(size + 1) - size
    at = np.repeat(first - begin, size) + (inside := np.arange(size.sum()) + np.repeat(np.arange(len(size)) + 1, size))
    symbols = np.zeros(int(size.sum() + len(size) + 1), np.int64)
    symbols[inside] = np.unique(words[at], return_inverse=True)[1] + 1
    rows = runs_of(symbols, int(size.max()))
    part = np.searchsorted(begin, rows[:, 0], "right") - 1
    rows[:, 0] += (first - begin)[part]
    return rows, text[rows[:, 0]] if len(rows) else np.zeros(0, np.int64)


def collapsed(texts: Texts, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts without what runs repeat, words joined by one space."""
    drops = np.zeros(len(texts.starts) + 1, np.int64)
    np.add.at(drops, rows[:, 0] + rows[:, 2], 1)
    np.add.at(drops, rows[:, 0] + rows[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(drops)[:-1] == 0)
    # A byte counts if it is in a kept word, or follows one that is not the last of its text.
    text = np.searchsorted(texts.first_word, kept, "right") - 1
    spaced = kept[:-1][text[1:] == text[:-1]]
    edges = np.zeros(len(texts.buf) + 1, np.int8)
    edges[texts.starts[kept]] += 1
    edges[texts.ends[kept]] -= 1
    mask = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
    out = texts.raw.copy()
    out[texts.ends[spaced]] = 0x20
    mask[texts.ends[spaced]] = True
    upto = np.concatenate(([0], np.cumsum(mask)))
    return out[mask], upto[texts.offsets]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, texts in slices(batch.column(1)):
            rows, text = text_runs(texts)
            data, offsets = collapsed(texts, rows)
            start = rows[:, 0] - texts.first_word[text]
            fields = [pa.array(c) for c in (start, rows[:, 1], rows[:, 2])]
            bounds = np.searchsorted(text, np.arange(texts.size + 1)).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            texts_left = pa.LargeStringArray.from_buffers(texts.size, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
            columns = [batch.column(0).slice(row, texts.size), pa.array(texts.n_words.astype(np.int64)), runs, texts_left.cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, runs, collapsed.

    ``docs`` has ``doc_id`` and ``text``; other columns are not read. Words are what stands between
    blanks (0x20, 0x09-0x0D), compared as they are. ``runs`` holds, by start and period, all stretches of words with
    smallest period ``period`` and ``length`` of at least ``LEAST_PERIODS`` periods and ``LEAST_WORDS`` words that no neighbouring word
    extends; ``start`` counts words from 0. ``collapsed`` are the words that are not, in any
    run, beyond its first period, joined by one space.

    A null, empty or blank text has no words and no runs. Rows come back as often as they went in, whatever
    their ``doc_id``; an empty table gives an empty result. Nothing is shuffled; a task holds one Arrow batch, and
    arrays for one slice of texts, or for one text that is longer.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_found, f"doc_id long, n_words long, runs {_RUNS}, collapsed string")
