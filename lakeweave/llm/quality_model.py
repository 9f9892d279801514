"""Text quality by a generalised additive model with pairwise interactions.

Numbers are taken from every whole text. Each is cut into bins at quantiles, and a lookup
table over the bins is learned by cyclic boosting: feature after feature, a shallow tree over the
bins is fitted to the gradient of the logistic loss and a small part of it is added to the
feature's table. Then the pairs of features whose joint tables reduce the loss most get tables of
their own, learned the same way from trees with one cut in either feature. A score is the
logistic function of a sum of table entries.

The tables are learned in numpy from at most ``TRAIN_ROWS`` labelled rows of numbers, chosen by a
hash of their ids; no text reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.labelled import first_by_hash, remainder, training_labels
from lakeweave.llm.quality_rules import duplicate_lines, repeated_words
from lakeweave.llm.shared import Scratch
from lakeweave.llm.textbytes import SPACE, Texts, slices

TRAIN_ROWS = 20_000
BINS, ROUNDS, RATE, LEAST_ROWS = 32, 300, 0.05, 20
PAIRS, PAIR_BINS, PAIR_ROUNDS = 6, 8, 100
THRESHOLD = 0.3

FEATURES = (
    "log_words", "word_length", "long_words", "symbols", "digits", "capitals", "marks", "full_stops", "beyond_ascii",
    "repeated", "duplicate_lines", "line_words", "distinct_words", "commonest", "single_characters", "blanks",
)


def _bytes_in(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_KINDS = {
    "symbols": _bytes_in("#*$%&|<>_=~^{}[]\\@+"),
    "digits": _bytes_in("0123456789"),
    "capitals": _bytes_in("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "marks": _bytes_in("!?;:"),
    "full_stops": _bytes_in(".,"),
    "beyond_ascii": np.arange(256) >= 0x80,
}


def text_numbers(texts: Texts) -> np.ndarray:
    """One row of numbers per text; all 0 for a text without words but for its blanks."""
    sizes = np.diff(texts.offsets)
    n, per_word, per_byte = texts.n_words, np.maximum(texts.n_words, 1), np.maximum(sizes, 1)
    lengths = texts.ends - texts.starts
    owner = np.repeat(np.arange(texts.size), n)
    by_text = lambda values: np.bincount(owner, values, minlength=texts.size)
    h = texts.word_hashes()
    order = np.lexsort((h, owner))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    firsts = np.flatnonzero(new)
    counts = np.diff(np.append(firsts, len(h)))
    most = np.zeros(texts.size)
    np.maximum.at(most, owner[order][firsts], counts)
    lines = texts.sums(texts.buf == 0x0A) + 1
    shares = {name: texts.sums(kind[texts.buf]) / per_byte for name, kind in _KINDS.items()}
    numbers = {
        "log_words": np.log1p(n),
        "word_length": by_text(lengths) / per_word,
        "long_words": by_text(lengths > 15) / per_word,
        **shares,
        "repeated": repeated_words(texts) / per_word,
        "duplicate_lines": duplicate_lines(texts) / lines,
        "line_words": np.log1p(n / lines),
        "distinct_words": np.bincount(owner[order][firsts], minlength=texts.size) / per_word,
        "commonest": most / per_word,
        "single_characters": by_text(lengths == 1) / per_word,
        "blanks": texts.sums(SPACE[texts.buf]) / per_byte,
    }
    return np.column_stack([numbers[f] for f in FEATURES])


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, texts in slices(batch.column(1)):
            with np.errstate(over="ignore"):
                x = text_numbers(texts)
            columns = [pa.array(np.ascontiguousarray(c), pa.float64()) for c in x.T]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, texts.size), *columns], names=["doc_id", *FEATURES])


@dataclass
class AdditiveModel:
    """``edges`` of the bins of each feature, its table, and the tables of pairs over coarser bins."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of table entries of each row."""
        out = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edges, x[:, j], "right")]
        coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.pair_edges)] if self.pairs else []
        for i, j, table in self.pairs:
            out += table[coarse[i], coarse[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(g.sum() / (h.sum() + 1.0))


def shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Value of every bin by a tree over their order: ``g``, ``h`` and ``n`` are sums by bin."""
    if depth and len(g) > 1:
        left_g, left_h, left_n = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
        gain = left_g**2 / (left_h + 1) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1)
        gain[(left_n < LEAST_ROWS) | (n.sum() - left_n < LEAST_ROWS)] = -1
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > g.sum() ** 2 / (h.sum() + 1):
            return np.concatenate([shallow_tree(a[0], a[1], a[2], depth - 1) for a in ((g[:cut], h[:cut], n[:cut]), (g[cut:], h[cut:], n[cut:]))])
    return np.full(len(g), _leaf(g, h))


def quadrant_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values) of the best cut in both features of a table of sums."""
    sums = [a.cumsum(0).cumsum(1) for a in (g, h, n)]

    def quarters(s: np.ndarray) -> list[np.ndarray]:
        a, row, column, whole = s[:-1, :-1], s[:-1, -1:], s[-1:, :-1], s[-1, -1]
        return [a, row - a, column - a, whole - row - column + a]

    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    qg, qh, qn = (quarters(s) for s in sums)
    gain = sum(a**2 / (b + 1) for a, b in zip(qg, qh, strict=True))
    gain = np.where(np.minimum.reduce(qn) < LEAST_ROWS, -1, gain)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if gain[i, j] < 0:
        return 0.0, np.zeros(g.shape)
    values = [float(a[i, j] / (b[i, j] + 1)) for a, b in zip(qg, qh, strict=True)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(gain[i, j] - g.sum() ** 2 / (h.sum() + 1)), out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Learn the tables; without rows of both kinds the score is the share of ones (0.5 without rows)."""
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    model = AdditiveModel(base=float(np.log(share / (1 - share))))
    if len(set(y)) < 2:
        return model
    model.edges = [_edges(c, BINS) for c in x.T]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, c, "right") for e, c in zip(model.edges, x.T, strict=True)]
    raw = np.full(len(y), model.base)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, bins in enumerate(at):
            g, h = gradient()
            size = len(model.tables[j])
            step = RATE * shallow_tree(np.bincount(bins, g, size), np.bincount(bins, h, size), np.bincount(bins, minlength=size))
            model.tables[j] += step
            raw += step[bins]

    model.pair_edges = [_edges(c, PAIR_BINS) for c in x.T]
    coarse = [np.searchsorted(e, c, "right") for e, c in zip(model.pair_edges, x.T, strict=True)]

    def tree(i: int, j: int) -> tuple[float, np.ndarray]:
        shape = (len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)
        cell = coarse[i] * shape[1] + coarse[j]
        g, h = gradient()
        return quadrant_tree(*(np.bincount(cell, w, shape[0] * shape[1]).reshape(shape) for w in (g, h, np.ones(len(y)))))

    gains = sorted(((tree(i, j)[0], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)[:PAIRS]
    chosen = [[i, j, np.zeros((len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1))] for gain, i, j in gains if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for pair in chosen:
            i, j, table = pair
            step = RATE * tree(i, j)[1]
            table += step
            raw += step[coarse[i], coarse[j]]
    model.pairs = [tuple(p) for p in chosen]
    return model


def _scores(model: AdditiveModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    ``docs`` has ``doc_id`` and ``text``, ``labels`` has ``doc_id`` and ``quality``; other
    columns are not read. Nothing is learned from rows that are ``held_out`` (crc32 of the id
    modulo 5 is 0). Null counts as an empty text; an empty text has numbers as any other and is
    scored by them. Rows come back as often as they went in; without an id they are not held
    out and not learned from. Without labelled rows of both kinds every score is the share of
    ones, 0.5 without labels.
    """
    held_out = F.coalesce(remainder(5) == 0, F.lit(False)) if held_out is None else held_out
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kinds = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)
    numbers = scratch.save(docs.mapInArrow(_numbers, kinds), "numbers")
    known = training_labels(labels, "quality", ~held_out & F.col("doc_id").isNotNull())
    chosen = F.broadcast(first_by_hash(known, TRAIN_ROWS, 6))  # at most TRAIN_ROWS rows
    rows = numbers.join(chosen, "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow().to_pandas()
    model = fit(rows[list(FEATURES)].to_numpy(float), rows["y"].to_numpy(float))
    found = numbers.mapInArrow(_scores(model), "doc_id long, score double")
    return found.select("doc_id", held_out.alias("held_out"), "score").withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
