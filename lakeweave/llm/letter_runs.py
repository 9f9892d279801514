"""Words of letters in many texts: runs of A-Z, a-z and À-ÿ, counted where they are read.

Worked out on the UTF-8 bytes of slices of texts: a letter from À to ÿ is the byte 0xC3 and the one after it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.textbytes import Texts, slices

# Runs of more bytes get their checksum one by one.
LONG = 64

_ALPHA = np.zeros(256, bool)
_ALPHA[ord("a") : ord("z") + 1] = _ALPHA[0xC3] = True


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> 1), c >> 1)
    return c


_CRC = _crc_table()


def letter_runs(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the end, and code points of every run in lower-cased texts."""
    buf, n = texts.buf, len(texts.buf)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    letter = _ALPHA[buf]
    lead = buf == 0xC3
    letter[1:] |= lead[:-1]
    first = np.zeros(n + 1, bool)
    first[texts.offsets] = True
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1] | first[1:n]
    ends[:-1] &= ~letter[1:] | first[1:n]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    upto = np.concatenate(([0], np.cumsum(lead)))
    return starts, stops, stops - starts - (upto[stops] - upto[starts])


def checksums(texts: Texts, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of every run, going on from the checksum ``before`` it."""
    order = np.argsort(starts - ends, kind="stable")
    at, size, c = starts[order], (ends - starts)[order], ~before[order].astype(np.uint32)
    # Runs by decreasing length: those that have a byte at ``k`` come first.
    having = np.searchsorted(-size, -np.arange(LONG), "left")
    for k in range(LONG):
        m = having[k]
        if not m:
            break
        c[:m] = _CRC[(c[:m] ^ texts.buf[at[:m] + k]) & np.uint32(255)] ^ (c[:m] >> np.uint32(8))
    out = np.empty(len(at), np.uint32)
    out[order] = ~c
    for i in np.flatnonzero(ends - starts > LONG):
        out[i] = zlib.crc32(texts.buf[starts[i] : ends[i]].tobytes(), int(before[i]))
    return out


def _strings(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    upto = np.concatenate(([0], np.cumsum(size)))
    data = texts.buf[np.arange(upto[-1]) + np.repeat(starts - upto[:-1], size)]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def _without(texts: Texts, start: int, end: int, h: int) -> str:
    run = texts.buf[start:end].tobytes().decode()
    return run[: h % len(run)] + run[h % len(run) + 1 :]


def _counted(least: int, lost: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, texts in slices(batch.column(1), lower=True):
                starts, ends, size = letter_runs(texts)
                kept = size >= least
                starts, ends, size = starts[kept], ends[kept], size[kept]
                shorter: list[str] = []
                if lost and len(starts):
                    of = np.searchsorted(texts.offsets, starts, "right") - 1
                    known = ids[row : row + texts.size]
                    before = np.array([zlib.crc32(f"{i}:".encode()) for i in known], np.uint32)
                    h = checksums(texts, starts, ends, before[of])
                    hit = (h % np.uint32(lost) == 0) & np.array([i is not None for i in known])[of]
                    for i in np.flatnonzero(hit & (size > least)).tolist():
                        shorter.append(_without(texts, int(starts[i]), int(ends[i]), int(h[i])))
                    starts, ends = starts[~hit], ends[~hit]
                if not len(starts) and not shorter:
                    continue
                with np.errstate(over="ignore"):
                    _, example, counts = np.unique(texts.hashes(starts, ends), return_index=True, return_counts=True)
                words = pa.concat_arrays([_strings(texts, starts[example], ends[example]), pa.array(shorter, pa.string())])
                counts = np.concatenate((counts, np.ones(len(shorter), np.int64)))
                yield pa.RecordBatch.from_arrays([words, pa.array(counts)], names=["word", "n"])

    return run


def letter_words(docs: DataFrame, least: int = 1, lost: int | None = None) -> DataFrame:
    """(word, n): every run of letters of at least ``least`` code points in ``docs`` and how often it occurs.

    ``docs`` has ``doc_id`` and ``text``; other columns are not read. Runs are as long as can be, A-Z in lower
    case. With ``lost``, misspellings are made by rule: where it divides the crc32 of ``<doc_id>:<run>``, the run's code point at
    that number modulo its length goes, and what is left counts if it is long enough; a row without ``doc_id`` keeps all.

    Null and empty texts have no words; an empty table gives an empty result. Words are counted by slices of texts,
    then in the map tasks, then over all.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_counted(least, lost), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
