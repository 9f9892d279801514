"""Toxicity by compression distance.

Three zstandard dictionaries are trained: on toxic texts, on ordinary texts, and on both. What both
kinds of text share says nothing, so the first two are pruned to the runs of bytes that occur
in a clearly larger share of their own kind's texts, and the third, without these runs, stands before
either of them at the same distance from the text. A text is cut into windows; each is compressed
with either dictionary, and the difference of the two lengths is its distance: what is common costs
the same in both, and a chance match with a run of one kind gains nothing where the common part has
one as long. A logistic function of the distances' summary, fitted on other labelled rows than the
dictionaries, gives the score.

The dictionaries and the fit come from bounded samples of labelled rows (``SAMPLE_TEXTS``
texts of each kind and ``SAMPLE_BYTES`` bytes of them, ``FIT_ROWS`` rows for the fit). All whole texts are scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.labelled import first_by_hash, remainder, sample_texts, training_labels
from lakeweave.llm.shared import Scratch
from lakeweave.llm.textbytes import LOWER, slices

SAMPLE_TEXTS, SAMPLE_BYTES, FIT_ROWS = 3000, 8_000_000, 20_000
# A dictionary is this share of its texts, within limits, as the trainer advises.
SHARE, LEAST_BYTES, MOST_BYTES, PIECE = 32, 16_384, 65_536, 256
# Bytes of the dictionary of what both kinds share, the usual size of a dictionary. The window of PARAMETERS holds it
# and what is specific to a kind, whose most frequent runs lie nearest.
COMMON_BYTES = 112_640
# A run of RUN bytes is kept if at least LEAST_TEXTS texts of its kind hold it, if their share is at
# least RATIO times that of the other kind, and if the shares differ by SURE standard errors.
RUN, LEAST_TEXTS, RATIO, SURE = 5, 5, 4, 6
WINDOW, LEVEL = 128, 3
# Matches shorter than a run would be chance.
PARAMETERS = {"strategy": zstandard.STRATEGY_LAZY, "min_match": RUN, "window_log": 17, "hash_log": 17, "chain_log": 17}
APART = b"\1"
# Every window begins with the same run, which either dictionary compresses alike: a match in
# the window then costs and saves its own bytes only.
LEAD = b"\0" * 32
THRESHOLD = 0.3

_GAPS = re.compile(rb"[\x20\x09-\x0D]+")
FEATURES = ("mean", "share1", "share2", "share4", "most", "most3", "log_windows")


def plain(text: bytes) -> bytes:
    """Lower-cased (A-Z), with one space between words and around the text."""
    lowered = LOWER[np.frombuffer(text, np.uint8)].tobytes()
    return b" " + _GAPS.sub(b" ", lowered).strip() + b" "


def windows(text: bytes) -> list[bytes]:
    """Windows of at most ``WINDOW`` bytes, cut before a blank where there is one."""
    out, at = [], 0
    while at < len(text):
        end = at + WINDOW
        if end < len(text):
            blank = text.rfind(b" ", at + 1, end)
            end = blank if blank > at else end
        out.append(LEAD + text[at:end])
        at = end
    return out


def _trained(texts: Sequence[bytes], size: int | None = None) -> bytes:
    samples = [t[k : k + PIECE] for t in texts for k in range(0, len(t), PIECE)]
    size = size or min(max(sum(map(len, texts)) // SHARE, LEAST_BYTES), MOST_BYTES)
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: the texts are the dictionary
        return b"".join(samples)[:size]


def _whole_words(run: bytes) -> bytes:
    """The run without the beginnings and ends of words beside its own."""
    first, last = run.find(b" "), run.rfind(b" ")
    if first != last:
        return run[first : last + 1]
    return run if first < 0 else max(run[first:], run[: first + 1], key=len)


def pruned(trained: bytes, own: Sequence[bytes], other: Sequence[bytes]) -> bytes:
    """The runs of a dictionary that are specific to its own kind, the most frequent last."""
    runs = [trained[k : k + RUN] for k in range(len(trained) - RUN + 1)]
    wanted = set(runs)

    def texts_with(texts: Sequence[bytes]) -> Counter:
        return Counter(run for t in texts for run in {t[k : k + RUN] for k in range(len(t) - RUN + 1)} & wanted)

    here, there = texts_with(own), texts_with(other)
    m, n = max(len(own), 1), max(len(other), 1)

    def specific(run: bytes) -> bool:
        a, b = here[run], there[run]
        both = (a + b) / (m + n)
        error = (both * (1 - both) * (1 / m + 1 / n)) ** 0.5
        return a >= LEAST_TEXTS and a * n >= RATIO * (b + 1) * m and a / m - b / n >= SURE * error

    good = [specific(r) for r in runs]
    kept, k = {}, 0
    while k < len(good):
        end = k
        while end < len(good) and good[end]:
            end += 1
        if end > k:
            piece = _whole_words(trained[k : end + RUN - 1])
            if len(piece) >= RUN:
                kept[piece] = max(kept.get(piece, 0), here[runs[k]])
        k = max(end, k + 1)
    single = [p for p in kept if not any(p != q and p in q for q in kept)]
    return APART.join(sorted(single, key=lambda p: (kept[p], p)))


def without(trained: bytes, pieces: Sequence[bytes]) -> bytes:
    """A dictionary less all runs that occur in one of the pieces."""
    runs = {p[k : k + RUN] for p in pieces for k in range(len(p) - RUN + 1)}
    kept = bytearray(b"\1" * len(trained))
    for k in range(len(trained) - RUN + 1):
        if trained[k : k + RUN] in runs:
            kept[k : k + RUN] = bytes(RUN)
    return bytes(compress(trained, kept))


def dictionaries(texts: Sequence[tuple[int, bytes]]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionaries from (y, text): what both kinds share, then what is specific to the kind.

    Padding makes the specific parts equally long, so that the common part lies equally far from a window.
    """
    kinds = [list(dict.fromkeys(plain(t) for y, t in texts if y == kind)) for kind in (0, 1)]
    own = [pruned(_trained(kinds[k]), kinds[k], kinds[1 - k]) for k in (0, 1)]
    as_many = min(map(len, kinds))
    common = _trained(kinds[0][:as_many] + kinds[1][:as_many], COMMON_BYTES)
    common = without(common, [piece for o in own for piece in o.split(APART)])
    size = max(map(len, own))
    return tuple(common + APART + o.rjust(size, APART) for o in own)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(content.rjust(64, APART), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    parameters = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=WINDOW + len(LEAD), dict_size=len(data), **PARAMETERS
    )
    data.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(compression_params=parameters, dict_data=data)


def summary(distances: np.ndarray) -> list[float]:
    top = np.sort(distances)[::-1]
    shares = [float((distances >= k).mean()) for k in (1, 2, 4)]
    return [float(distances.mean()), *shares, float(top[0]), float(top[:3].mean()), float(np.log(len(top)))]


def _distances(ordinary: bytes, toxic: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _compressor(ordinary), _compressor(toxic)
        for batch in batches:
            for row, texts in slices(batch.column(1)):
                rows = []
                for i in range(texts.size):
                    parts = windows(plain(texts.bytes_of(i)))
                    rows.append(summary(np.array([len(a.compress(w)) - len(b.compress(w)) for w in parts])))
                columns = [pa.array(c, pa.float64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, texts.size), *columns], names=["doc_id", *FEATURES]
                )

    return run


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights (intercept first) of a penalised logistic regression on the columns as they are."""
    scale = x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), x / scale]
    ridge = np.diag([1e-6, *[penalty] * x.shape[1]])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ w)
    return np.r_[w[0], w[1:] / scale]


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    ``docs`` has ``doc_id`` and ``text``, ``labels`` has ``doc_id`` and ``toxic``; other
    columns are not read. Nothing is learned from rows that are ``held_out`` (crc32 of the id
    modulo 4 is 2). Null counts as an empty text, which is scored as one window without
    content. Rows come back as often as they went in; without an id they are not held out and
    not learned from. Without labelled rows of both kinds the score is the share of toxic ones
    among them, 0 if there are none.
    """
    held_out = F.coalesce(remainder(4) == 2, F.lit(False)) if held_out is None else held_out
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = scratch.save(training_labels(labels, "toxic", ~held_out & F.col("doc_id").isNotNull()), "labels")
    # Half of the rows make the dictionaries, the other half the fit.
    half = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2))
    chosen = [first_by_hash(known.where((half == 0) & (F.col("y") == y)), SAMPLE_TEXTS, 9) for y in (0, 1)]
    chosen = scratch.save(chosen[0].unionByName(chosen[1]), "chosen")
    ordinary, toxic = dictionaries(sample_texts(docs, chosen, SAMPLE_BYTES))
    kinds = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)
    found = scratch.save(docs.mapInArrow(_distances(ordinary, toxic), kinds), "distances")
    fit = first_by_hash(known.where(half == 1), FIT_ROWS, 9)
    rows = found.join(F.broadcast(fit), "doc_id").dropDuplicates(["doc_id"]).select("y", *FEATURES).toArrow().to_pandas()
    y = rows["y"].to_numpy(float)
    if len(set(y)) == 2:
        w = logistic(rows[list(FEATURES)].to_numpy(float), y)
        z = sum((F.col(f) * float(v) for f, v in zip(FEATURES, w[1:], strict=True)), F.lit(float(w[0])))
        score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    else:
        score = F.lit(float(y.mean()) if len(y) else 0.0)
    return found.select("doc_id", held_out.alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
