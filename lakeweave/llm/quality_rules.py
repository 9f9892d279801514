"""Quality rules: base counts of words and lines, and compression bands.

The text as a whole and its chunks of ``CHUNK`` bytes are compressed with zstandard; a rest of less than half a
chunk belongs to the chunk before it, as a few bytes compress to more than they are. What
compresses far better than the other documents is repetitive, what compresses far worse is no
language. How well prose compresses depends on its length, so every band of length has limits
of its own, one pair for whole texts and one for chunks: ``SPREADS`` robust spreads below and
above the median share of all distinct texts or chunks of that length, where the spread of a
side is taken from its quartile. The shares of all documents are counted by Spark in a
histogram of bounded size. ``BANDS`` are outer limits, which hold in any case and alone where a
band has fewer than ``LEAST_TEXTS`` different texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.textbytes import SPACE, Texts, slices

LEVEL = 3
CHUNK = 4096
# Outer limits: (bytes from which on the band holds, least and most compressed share of the text).
BANDS = ((0, 0.0, 9.0), (512, 0.30, 0.80), (2048, 0.25, 0.72), (8192, 0.20, 0.66), (65_536, 0.15, 0.62))
# Bands with limits of their own: from 2**k bytes to the next power of two.
LEAST_BAND, MOST_BAND = 6, 26
SPREADS, LEAST_SPREAD, LEAST_TEXTS = 4.0, 0.008, 50
# Quartiles of a normal distribution lie so many standard deviations from its median.
QUARTILE = 0.6745
# The histogram has so many bins for each unit of the compressed share.
BINS_PER_UNIT = 1000
# Share of a text's bytes that may be in chunks outside the limits of their own band.
BAD_CHUNKS = 0.1
LEAST_WORDS = 50
REPEAT_PERCENT = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
# A code point begins at every byte that does not continue one.
_BEGINS = (np.arange(256) & 0xC0) != 0x80
_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_bytes long, ratio double, n_chunks long, n_bad_chunks long, bands_failed boolean"
)
_COLUMNS = [part.split()[0] for part in _SCHEMA.split(", ")]


def _repeats(group: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the values occur twice or more in their group."""
    order = np.lexsort((h, group))
    g, v = group[order], h[order]
    same = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def repeated_words(texts: Texts) -> np.ndarray:
    """Words of each text that lie in a 3-word window found twice or more in it."""
    h, at, bounds = texts.windows(texts.word_hashes(), 3)
    twice = at[_repeats(np.repeat(np.arange(texts.size), np.diff(bounds)), h)]
    marked = np.zeros(len(texts.starts) + 1, np.int64)
    for j in range(3):
        marked[twice + j] = 1
    total = np.concatenate(([0], np.cumsum(marked)))
    return total[texts.first_word[1:]] - total[texts.first_word[:-1]]


def duplicate_lines(texts: Texts) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier line of it."""
    if len(texts.buf) == 0:
        return np.zeros(texts.size, np.int64)
    begins = np.union1d(np.flatnonzero(texts.buf == 0x0A) + 1, texts.offsets[:-1])
    begins = begins[begins < len(texts.buf)]
    # A line goes up to the next one, without the line feed that ends it.
    ends = np.append(begins[1:], len(texts.buf))
    ends = ends - (texts.buf[ends - 1] == 0x0A)
    worded = np.searchsorted(texts.starts, begins) < np.searchsorted(texts.starts, ends)
    begins, ends = begins[worded], ends[worded]
    doc = np.searchsorted(texts.offsets, begins, "right") - 1
    h = texts.hashes(begins, ends)
    order = np.lexsort((h, doc))
    later = (np.diff(doc[order]) == 0) & (h[order][1:] == h[order][:-1])
    return np.bincount(doc[order][1:][later], minlength=texts.size).astype(np.int64)


def outside(size: int, packed: int, bands: Sequence[tuple[int, float, float]]) -> bool:
    """Whether a text of so many bytes, compressed to so many, breaks the limits of its band."""
    if not size:
        return False
    _, least, most = max(band for band in bands if band[0] <= size)
    return not least <= packed / size <= most


def band_of(size: int) -> int:
    """The band of length of a text of so many bytes."""
    return min(max(size.bit_length() - 1, LEAST_BAND), MOST_BAND)


@dataclass(frozen=True)
class Limits:
    """Least and most compressed share: the outer ones, and those of (is chunk, band of length)."""

    outer: tuple[tuple[int, float, float], ...]
    learned: dict[tuple[bool, int], tuple[float, float]]

    def broken(self, size: int, packed: int, chunk: bool) -> bool:
        """Whether a text or chunk of so many bytes, compressed to so many, breaks its limits."""
        if not size:
            return False
        least, most = self.learned.get((chunk, band_of(size)), (0.0, np.inf))
        return outside(size, packed, self.outer) or not least <= packed / size <= most


def limits_of(bins: np.ndarray, counts: np.ndarray) -> tuple[float, float] | None:
    """The limits that a histogram of compressed shares sets; none if it counts too few."""
    order = np.argsort(bins)
    upto = np.cumsum(counts[order])
    if not len(upto) or upto[-1] < LEAST_TEXTS:
        return None
    low, middle, high = ((bins[order][np.searchsorted(upto, q * upto[-1])] + 0.5) / BINS_PER_UNIT for q in (0.25, 0.5, 0.75))
    below, above = (max(d / QUARTILE, LEAST_SPREAD) for d in (middle - low, high - middle))
    return middle - SPREADS * below, middle + SPREADS * above


def _packer() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)


def chunks(data: bytes) -> list[bytes]:
    """The chunks of a text; none if it is a single one."""
    n = (len(data) + CHUNK // 2) // CHUNK
    return [data[j * CHUNK : (j + 1) * CHUNK if j + 1 < n else len(data)] for j in range(n)] if n > 1 else []


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = _packer()
    for batch in batches:
        for _, texts in slices(batch.column(0)):
            rows = []
            for i in range(texts.size):
                data = texts.bytes_of(i)
                for chunk, part in ((False, data), *((True, c) for c in chunks(data))):
                    if part:
                        key = int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little", signed=True)
                        rows.append((key, chunk, band_of(len(part)), len(packer.compress(part)) * BINS_PER_UNIT // len(part)))
            if rows:
                key, chunk, band, level = zip(*rows, strict=True)
                columns = [pa.array(key, pa.int64()), pa.array(chunk), pa.array(band, pa.int32()), pa.array(level, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "chunk", "band", "bin"])


def learn_limits(docs: DataFrame, bands: Sequence[tuple[int, float, float]] = BANDS) -> Limits:
    """Limits of every band, from the compressed shares of all texts and chunks of ``docs``.

    Equal texts, and equal chunks, count once, so that one text in many copies does not make
    the spread. The driver gets one row for each bin of each band.
    """
    each = docs.select("text").mapInArrow(_shares, "key long, chunk boolean, band int, bin int").distinct()
    table = each.groupBy("chunk", "band", "bin").agg(F.count("*").alias("c")).collect()
    learned = {}
    for kind in {(r["chunk"], r["band"]) for r in table}:
        rows = [r for r in table if (r["chunk"], r["band"]) == kind]
        found = limits_of(np.array([r["bin"] for r in rows]), np.array([r["c"] for r in rows]))
        if found:
            learned[kind] = found
    return Limits(tuple(bands), learned)


class Rules:
    """Counts and verdicts of texts under some limits."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits
        self.packer = _packer()

    def bands_of(self, data: bytes) -> tuple[float, int, int, bool]:
        """(compressed share, chunks, chunks outside their limits, whether the text breaks the rule)."""
        if not data:
            return 0.0, 0, 0, False
        packed = len(self.packer.compress(data))
        parts = chunks(data)
        bad = [len(p) for p in parts if self.limits.broken(len(p), len(self.packer.compress(p)), True)]
        failed = self.limits.broken(len(data), packed, False) or sum(bad) > BAD_CHUNKS * len(data)
        return packed / len(data), max(len(parts), 1), len(bad), failed

    def measure(self, texts: Texts) -> list[np.ndarray]:
        """The columns after ``doc_id``."""
        with np.errstate(over="ignore"):
            repeat, lines = repeated_words(texts), duplicate_lines(texts)
        word_chars = texts.sums(_BEGINS[texts.buf] & ~SPACE[texts.buf])
        shares, chunks, bad, failed = zip(*(self.bands_of(texts.bytes_of(i)) for i in range(texts.size)), strict=True)
        return [
            texts.n_words.astype(np.int64), word_chars, texts.sums(_SYMBOL[texts.buf]), lines, repeat,
            np.diff(texts.offsets), np.array(shares, float), np.array(chunks, np.int64), np.array(bad, np.int64),
            np.array(failed, bool),
        ]


def _measured(limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(limits)
        for batch in batches:
            for row, texts in slices(batch.column(1)):
                columns = [pa.array(c) for c in rules.measure(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, texts.size), *columns], names=_COLUMNS)

    return run


def _passing(limits: Limits, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(limits)
        for batch in batches:
            for row, texts in slices(batch.column(text)):
                n_words, *_, failed = found = rules.measure(texts)
                good = (n_words >= LEAST_WORDS) & (found[4] * 100 <= n_words * REPEAT_PERCENT) & ~failed
                yield batch.slice(row, texts.size).filter(pa.array(good))

    return run


def keep_good(docs: DataFrame, bands: Sequence[tuple[int, float, float]] = BANDS) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns."""
    return docs.mapInArrow(_passing(learn_limits(docs, bands), docs.columns.index("text")), docs.schema)


def quality_rules(docs: DataFrame, bands: Sequence[tuple[int, float, float]] = BANDS) -> DataFrame:
    """One row per document: counts, compression figures, ``base_failed`` and ``kept``.

    ``docs`` has ``doc_id`` and ``text``; other columns are not read. A null text counts as
    empty: no words, so the base rule fails and the document is not kept. Rows come back as
    often as they went in, whatever their ``doc_id``; an empty table gives an empty result.
    One pass sets the limits, another measures; only hashes and shares of the first are
    shuffled. A task holds one Arrow batch of texts.
    """
    limits = learn_limits(docs, bands)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measured(limits), _SCHEMA)
    repeats = F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT
    failed = (F.col("n_words") < LEAST_WORDS) | repeats
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.col("bands_failed"))
