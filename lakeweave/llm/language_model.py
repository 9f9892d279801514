"""Scores of texts under a log-bilinear language model and under smoothed word counts.

Counts of all words of all training texts are tables. The most frequent words are symbols of
the model; every other word belongs to one of some classes, which are symbols too. The class of a
word follows from its last two bytes; endings are dealt to classes by the tokens they cover. The
model predicts a symbol from the one before: the context's vector is mapped by a matrix, and its
products with all vectors, plus a bias for each symbol, are the log-weights. A word of a class has
the probability of the class in its context times its smoothed share of the class in the full
count table. So every token is predicted and is a context.

The model is trained in numpy by noise-contrastive estimation on the counts of all pairs of
neighbours in the training texts, which the tasks sum up: at most ``MODEL_WORDS`` squared numbers.
Each of ``PASSES`` passes takes the exact gradient over all these counts, and over all noise
symbols by their expectation; nothing is drawn. One matrix product then gives the log-probabilities
of every symbol after every other, normalised; tasks look their tokens up in them.

Words are known by 64-bit hashes. Counts of ``HEAD_WORDS`` frequent words go to every task; the
rest, rare words all of them, are joined by shuffle.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.labelled import remainder
from lakeweave.llm.shared import Scratch
from lakeweave.llm.textbytes import Texts, slices

HEAD_WORDS = 131_072
MODEL_WORDS = 2_048
# One symbol in so many is a class of words.
CLASS_SHARE = 4
DIMENSIONS, NOISE, PASSES, RATE = 32, 64, 300, 0.1
# Rows of the pair matrix that a pass works on at once.
BLOCK = 256
ENDINGS = 1 << 16
# Distinct words a task gathers before it passes their counts on.
MOST_COUNTS = 1_000_000

END = np.uint64(0x5DEECE66D1234567)
END_ID = 0


def endings(texts: Texts) -> np.ndarray:
    """The last two bytes of every word as a number; a word of one byte has its byte."""
    last = texts.buf[texts.ends - 1].astype(np.int64)
    return last | np.where(texts.ends - texts.starts > 1, texts.buf[texts.ends - 2].astype(np.int64) << 8, 0)


def _merged(keys: list[np.ndarray], ends: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    found, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return [found, np.concatenate(ends)[first], np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)]


def _rows(keys: np.ndarray, counts: np.ndarray, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=[name, "c"])


def _words(keys: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(keys.view(np.int64)), pa.array(ends.astype(np.int32)), pa.array(counts)]
    return pa.RecordBatch.from_arrays(columns, names=["word", "ending", "c"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, texts_seen, size = [], 0, 0
    for batch in batches:
        for _, texts in slices(batch.column(0), lower=True):
            with np.errstate(over="ignore"):
                k, first, c = np.unique(texts.word_hashes(), return_index=True, return_counts=True)
            parts.append([k, endings(texts)[first], c])
            texts_seen += texts.size
            size += len(k)
            if size > MOST_COUNTS:
                parts = [_merged(*zip(*parts, strict=True))]
                size = len(parts[0][0])
                if size > MOST_COUNTS // 2:
                    yield _words(*parts[0])
                    parts, size = [], 0
    if parts:
        yield _words(*_merged(*zip(*parts, strict=True)))
    if texts_seen:
        yield _words(np.array([END]), np.array([0]), np.array([texts_seen]))


def classes_of(tokens: np.ndarray, size: int) -> np.ndarray:
    """The class of every ending, from the tokens of each outside the model's words.

    Endings go by decreasing tokens to the class that has fewest, so frequent ones stand alone.
    """
    out = np.arange(len(tokens)) % size
    load = [(0, k) for k in range(size)]
    for e in sorted(np.flatnonzero(tokens), key=lambda e: (-tokens[e], e)):
        n, k = heapq.heappop(load)
        out[e] = k
        heapq.heappush(load, (n + int(tokens[e]), k))
    return out


@dataclass
class Vocabulary:
    """Frequent words: sorted hashes, their counts, and whether they are among the model's words.

    Symbols below ``n_words`` are words, the others classes; ``classes`` has the class of each ending.
    """

    words: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    n_words: int
    size: int
    classes: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, counts: np.ndarray, size: int) -> Vocabulary:
        """From words by decreasing count; the end token has id 0 and is always among them."""
        is_end = words == END
        words = np.concatenate(([END], words[~is_end]))
        counts = np.concatenate((counts[is_end] if is_end.any() else [0], counts[~is_end])).astype(np.int64)
        n_classes = max(size // CLASS_SHARE, 1)
        n_words = min(size - n_classes, len(words))
        order = np.argsort(words)
        none = np.zeros(ENDINGS, np.int64)
        return cls(words[order], counts[order], np.arange(len(words))[order], n_words, n_words + n_classes, none)

    def model_words(self) -> np.ndarray:
        return self.words[self.ids < self.n_words]

    def find(self, h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether among the words, count, symbol) of each hash and ending."""
        at = np.searchsorted(self.words, h)
        at[at == len(self.words)] = 0
        known = self.words[at] == h
        own = known & (self.ids[at] < self.n_words)
        return known, np.where(known, self.counts[at], 0), np.where(own, self.ids[at], self.n_words + self.classes[ends])


def neighbours(texts: Texts, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(previous, id) of all words and then of the end of every text; a text begins after an end."""
    first, n = texts.first_word[:-1], texts.n_words
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[first[n > 0]] = END_ID
    last = np.full(texts.size, END_ID, np.int64)
    last[n > 0] = ids[(first + n - 1)[n > 0]]
    return before, ids, last, np.full(texts.size, END_ID, np.int64)


def _pair_counts(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(*vocabulary.value)
        total = np.zeros(v.size * v.size, np.int64)
        for batch in batches:
            for _, texts in slices(batch.column(0), lower=True):
                with np.errstate(over="ignore"):
                    ids = v.find(texts.word_hashes(), endings(texts))[2]
                before, here, last, end = neighbours(texts, ids)
                codes = np.concatenate((before * v.size + here, last * v.size + end))
                total += np.bincount(codes, minlength=len(total))
        found = np.flatnonzero(total)
        if len(found):
            yield _rows(found, total[found], "pair")

    return run


def train(pairs: np.ndarray, counts: np.ndarray, size: int, steps: int = PASSES) -> np.ndarray:
    """Log-probabilities (base 10) of every symbol after every other, from counts of pairs.

    Noise-contrastive estimation: each pair is told from ``NOISE`` symbols with the symbol
    frequencies. Each of ``steps`` passes takes all pairs with their counts and the expectation
    over the noise. AdaGrad steps; the seed is fixed.
    """
    rng = np.random.default_rng(4)
    unigram = np.bincount(pairs % size, counts, size) + 1.0
    unigram /= unigram.sum()
    log_noise = np.log(NOISE * unigram).astype(np.float32)
    noise = (NOISE * unigram).astype(np.float32)
    vectors = rng.normal(0, 0.1, (size, DIMENSIONS)).astype(np.float32)
    mapping = np.eye(DIMENSIONS, dtype=np.float32)
    bias = np.log(unigram).astype(np.float32)
    seen = [np.full(p.shape, 1e-20, np.float32) for p in (vectors, mapping, bias)]
    share = np.zeros(size * size, np.float32)
    if len(counts):
        share[pairs] = counts / counts.sum()
    share = share.reshape(size, size)
    context_share = share.sum(1, keepdims=True)
    for _ in range(steps if len(counts) else 0):
        gradient = [np.zeros_like(p) for p in (vectors, mapping, bias)]
        query = vectors @ mapping
        back = np.empty_like(vectors)
        for k in range(0, size, BLOCK):
            rows = slice(k, k + BLOCK)
            z = query[rows] @ vectors.T
            z += bias - log_noise
            is_pair = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            error = share[rows] * (1 - is_pair) - context_share[rows] * noise * is_pair
            gradient[0] += error.T @ query[rows]
            back[rows] = error @ vectors
            gradient[2] += error.sum(0)
        gradient[0] += back @ mapping.T
        gradient[1] += vectors.T @ back
        for p, g, s in zip((vectors, mapping, bias), gradient, seen, strict=True):
            s += g * g
            p += RATE * g / np.sqrt(s)
    weights = (vectors.astype(np.float64) @ mapping) @ vectors.T + bias
    weights -= weights.max(1, keepdims=True)
    weights -= np.log(np.exp(weights).sum(1, keepdims=True))
    return (weights / np.log(10)).astype(np.float32)


_SCORES = (
    "row long, doc_id long, n_tokens long, n_known long, base double, model double, n_rare long, rare array<long>"
)


def _scores(vocabulary, table, all_upto: float, class_upto: np.ndarray):
    """Sums over the tokens whose counts are at hand, and the hashes of the others.

    ``all_upto`` and ``class_upto`` are the totals that smoothed counts of all words and of the
    words of each class are divided by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, log_p = Vocabulary(*vocabulary.value), table.value
        _, end_count, _ = v.find(np.array([END]), np.array([0]))
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start, texts in slices(batch.column(1), lower=True):
                with np.errstate(over="ignore"):
                    h = texts.word_hashes()
                known, counts, ids = v.find(h, endings(texts))
                before, here, last, end = neighbours(texts, ids)
                base = np.where(known, np.log10((counts + 1) / all_upto), 0.0)
                model = log_p[before, here].astype(np.float64)
                # Counts of rare words, which are all in a class, come from the table later.
                in_class = ids >= v.n_words
                model -= np.where(in_class, np.log10(class_upto[np.maximum(ids - v.n_words, 0)]), 0.0)
                model += np.where(in_class & known, np.log10(counts + 1), 0.0)
                bounds = texts.first_word

                def by_text(values: np.ndarray, bounds: np.ndarray = bounds) -> np.ndarray:
                    upto = np.concatenate(([0], np.cumsum(values)))
                    return upto[bounds[1:]] - upto[bounds[:-1]]

                n = texts.size
                rare = h[~known]
                rare_bounds = np.searchsorted(np.flatnonzero(~known), bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)),
                        batch.column(0).slice(start, n),
                        pa.array(texts.n_words.astype(np.int64) + 1),
                        pa.array(by_text(known).astype(np.int64) + int(end_count[0] > 0)),
                        pa.array(by_text(base) + np.log10((end_count[0] + 1) / all_upto)),
                        pa.array(by_text(model) + log_p[last, end]),
                        pa.array(np.diff(rare_bounds).astype(np.int64)),
                        pa.ListArray.from_arrays(rare_bounds.astype(np.int32), pa.array(rare.view(np.int64))),
                    ],
                    names=[part.split()[0] for part in _SCORES.split(", ")],
                )
                row += n

    return run


def score_texts(docs: DataFrame, held_out: Column | None = None, model_words: int = MODEL_WORDS, head_words: int = HEAD_WORDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``docs`` has ``doc_id`` and ``text``; other columns are not read. Words are lower-cased
    (A-Z); a text is its words and an end token. ``base_score`` sums the log10 of add-one
    smoothed frequencies, ``score`` is the model's log10 probability of the whole text. Nothing
    is counted or learned from ``held_out`` rows (crc32 of the id modulo 7 is 2), nor from rows
    without an id, which are not held out either.

    Null and empty texts are an end token. Rows come back, and count, as often as they went in.
    Without training rows the counts are 0 and the model knows the end and its classes only.
    """
    scratch = Scratch(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    folds = F.col("doc_id").isNotNull() & ~remainder_is_held() if held_out is None else ~held_out
    held_out = F.coalesce(remainder_is_held(), F.lit(False)) if held_out is None else held_out
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    training = docs.where(folds).select("text")
    counts = training.mapInArrow(_word_counts, "word long, ending int, c long")
    counts = counts.groupBy("word").agg(F.min("ending").alias("ending"), F.sum("c").alias("c"))
    counts = scratch.save(counts, "counts")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    head = counts.orderBy(F.desc("c"), "word").limit(head_words).toArrow()  # at most head_words rows of two numbers
    vocabulary = Vocabulary.of(head["word"].to_numpy().view(np.uint64), head["c"].to_numpy(), model_words)
    own = docs.sparkSession.createDataFrame([(int(w),) for w in vocabulary.model_words().view(np.int64)], "word long")
    others = counts.join(F.broadcast(own), "word", "left_anti").groupBy("ending")
    others = others.agg(F.sum("c").alias("n"), F.count("*").alias("v")).toArrow()  # at most ENDINGS rows
    tokens, words = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    tokens[others["ending"].to_numpy()] = others["n"].to_numpy()
    words[others["ending"].to_numpy()] = others["v"].to_numpy()
    n_classes = vocabulary.size - vocabulary.n_words
    vocabulary.classes = classes_of(tokens, n_classes)
    class_upto = np.bincount(vocabulary.classes, tokens + words, n_classes) + 1.0

    shared = context.broadcast(tuple(getattr(vocabulary, f.name) for f in fields(vocabulary)))
    pairs = training.mapInArrow(_pair_counts(shared), "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))
    pairs = pairs.toArrow().sort_by("pair")  # at most model_words squared rows of two numbers
    table = train(pairs["pair"].to_numpy(), pairs["c"].to_numpy().astype(np.float64), vocabulary.size)
    all_upto = float(n + v + 1)
    rows = docs.mapInArrow(_scores(shared, context.broadcast(table), all_upto, class_upto), _SCORES)
    rows = scratch.save(rows, "rows")

    rare = rows.select("row", F.explode("rare").alias("word")).join(counts, "word")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.col("c") + 1)).alias("logs"), F.count("*").alias("found"))
    logs, found = F.coalesce("logs", F.lit(0.0)), F.coalesce("found", F.lit(0))
    return rows.drop("rare").join(rare, "row", "left").select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        (F.col("n_known") + found).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_rare") * float(np.log10(all_upto))).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )


def remainder_is_held() -> Column:
    return remainder(7) == 2
