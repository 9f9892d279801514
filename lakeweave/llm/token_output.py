"""Token ids of documents, packed into rows of one length and written as binary columns.

A task tokenizes the texts of its part of the table and packs them window by window with
best-fit decreasing: pieces by decreasing length, each into the bin with the least room that
holds it, found in a segment tree over room. Documents stay in the task that read them, so
nothing is shuffled. A row holds the ids as little-endian integers, the cumulative lengths of
its segments, where positions begin again at 0, and which part of which document a segment is.

Tokenizing is done once for each different run of characters of a window: texts are cut where
the vocabulary's own rule cuts them at blanks, equal parts are encoded once, and the ids are
put together with array operations.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm.textbytes import SPACE, Texts, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# How texts are cut before byte pairs are merged, and the free id that ends a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256

CAPACITY = 2048
# Tokens that are packed together, and encoded parts that a task remembers.
WINDOW_TOKENS = 1 << 21
REMEMBERED = 1_000_000

ROWS = (
    "part int, bin int, n_tokens int, doc_ids array<long>, offsets array<long>, cu_seqlens array<int>, "
    "resets array<int>, ids binary"
)
# Blanks beyond ASCII join the runs of blanks around them; texts that hold one are encoded whole.
_OTHER_BLANKS = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_BYTES = [chr(c).encode() for c in _OTHER_BLANKS]
_LEAD = np.zeros(256, bool)
_LEAD[[raw[0] for raw in _BYTES]] = True
_TWO, _THREE = ([int.from_bytes(raw) for raw in _BYTES if len(raw) == n] for n in (2, 3))


def with_other_blanks(texts: Texts) -> np.ndarray:
    """Indexes of the texts that hold a blank beyond ASCII, found by their first bytes."""
    buf = texts.buf
    leads = np.flatnonzero(_LEAD[buf])
    rest = [buf[np.minimum(leads + k, len(buf) - 1)].astype(np.int64) for k in range(3)]
    two = (rest[0] << 8 | rest[1]) if len(leads) else np.zeros(0, np.int64)
    found = np.isin(two, _TWO) | np.isin(two << 8 | rest[2], _THREE)
    return np.unique(np.searchsorted(texts.offsets, leads[found], "right") - 1)


def read_vocabulary(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file; Spark reads it, so it may lie wherever Spark can read."""
    lines = (row.value.split() for row in spark.read.text(path).collect())  # one row per token of the vocabulary
    return {base64.b64decode(token): int(rank) for token, rank in lines}


def encoding(ranks: dict[bytes, int]) -> tiktoken.Encoding:
    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class SegmentTree:
    """Bins by room: the bin with the least room of at least some size, in log(capacity) steps."""

    def __init__(self, capacity: int) -> None:
        self.base = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.base)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        at = self.base + room
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, b: int) -> None:
        self.bins[room].append(b)
        self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, bin), removed; of bins with equal room the latest."""
        at = self.base + size
        if not self.count[at]:
            # Up to the first right neighbour that holds a bin, then down its leftmost branch.
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.base:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.base
        self._add(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Indexes of the sizes in every bin."""
    tree, bins = SegmentTree(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[i])
        if found is None:
            bins.append([i])
            left = capacity - sizes[i]
        else:
            room, b = found
            bins[b].append(i)
            left = room - sizes[i]
        tree.put(left, len(bins) - 1 if found is None else found[1])
    return bins


class Encoder:
    """Token ids of texts; equal parts of them are encoded once.

    Parts are known by their hash. Their ids lie one after the other in ``flat``, from ``begins`` on.
    """

    def __init__(self, ranks: dict[bytes, int], end: int) -> None:
        self.encoding, self.end = encoding(ranks), end
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begins, self.sizes = np.zeros((2, 0), np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def _parts(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Where the parts begin, and the first part of each text."""
        blank = SPACE[texts.buf]
        starts = texts.starts
        inside = np.ones(len(texts.buf) + 1, bool)
        inside[texts.offsets] = False  # a text begins here
        led = (starts > 0) & inside[starts] & (texts.buf[starts - 1] == 0x20)
        # A blank other than a space before a word stands alone; a space goes with the word.
        alone = starts[(starts > 0) & inside[starts] & ~led & blank[starts - 1]] - 1
        marked = np.zeros(len(texts.buf) + 1, bool)
        for cuts in (starts - led, texts.ends, alone, texts.offsets):
            marked[cuts] = True
        cuts = np.flatnonzero(marked[:-1])
        return cuts, np.searchsorted(cuts, texts.offsets)

    def _learn(self, at: np.ndarray, keys: np.ndarray, parts: list[str]) -> None:
        """Encode parts whose keys belong at these places of the sorted keys."""
        ids = [self.encoding.encode_ordinary(part) for part in parts]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        new = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
        if self.used + len(new) > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.empty(self.used + 2 * len(new), np.int32)))
        self.flat[self.used : self.used + len(new)] = new
        self.keys, self.sizes = np.insert(self.keys, at, keys), np.insert(self.sizes, at, sizes)
        self.begins = np.insert(self.begins, at, self.used + np.cumsum(sizes) - sizes)
        self.used += len(new)

    def encode(self, texts: Texts) -> list[np.ndarray]:
        """Ids of every text, followed by the end id."""
        end = np.array([self.end], np.int32)
        if not len(texts.buf):
            return [end] * texts.size
        if len(self.keys) > REMEMBERED:
            self.forget()
        cuts, first = self._parts(texts)
        after = np.append(cuts[1:], len(texts.buf))
        with np.errstate(over="ignore"):
            kinds, example, which = np.unique(texts.hashes(cuts, after), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, kinds)
        new = np.append(self.keys, 0)[at] != kinds
        new[at == len(self.keys)] = True
        if new.any():
            bounds = zip(cuts[example[new]].tolist(), after[example[new]].tolist(), strict=True)
            raw = texts.raw.tobytes()
            self._learn(at[new], kinds[new], [raw[a:b].decode() for a, b in bounds])
            at = np.searchsorted(self.keys, kinds)
        begins, counts = self.begins[at][which], self.sizes[at][which]
        ends = np.cumsum(counts)
        tokens = self.flat[np.arange(ends[-1]) + np.repeat(begins - (ends - counts), counts)]
        bounds = np.concatenate(([0], ends))[first]
        out = [np.concatenate((tokens[a:b], end)) for a, b in zip(bounds, bounds[1:], strict=False)]
        # Blanks beyond ASCII join those around them, so such a text is encoded whole.
        for i in with_other_blanks(texts).tolist():
            out[i] = np.append(np.array(self.encoding.encode_ordinary(texts.bytes_of(i).decode()), np.int32), end)
        return out


def _pack(ranks, end: int, capacity: int, window: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value, end)
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def packed() -> pa.RecordBatch:
            rows = []
            for k, at in enumerate(best_fit_decreasing([len(p[2]) for p in held], capacity)):
                ends = np.cumsum([len(held[i][2]) for i in at])
                ids = np.full(capacity, end, width)
                ids[: ends[-1]] = np.concatenate([held[i][2] for i in at])
                bounds = [0, *ends.tolist()]
                resets = bounds if bounds[-1] < capacity else bounds[:-1]
                rows.append(
                    (part, made + k, bounds[-1], [held[i][0] for i in at], [held[i][1] for i in at], bounds, resets, ids.tobytes())
                )
            kinds = [pa.int32()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.int32())] * 2 + [pa.binary()]
            names = [field.split()[0] for field in ROWS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, texts in slices(batch.column(1)):
                for doc_id, tokens in zip(ids[row : row + texts.size], encoder.encode(texts), strict=True):
                    for offset in range(0, len(tokens), capacity):
                        held.append((doc_id, offset, tokens[offset : offset + capacity].astype(width)))
                    size += len(tokens)
                    if size >= window:
                        out = packed()
                        made, held, size = made + out.num_rows, [], 0
                        yield out
        if held:
            yield packed()

    return run


def packed_tokens(
    docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, capacity: int = CAPACITY, window: int = WINDOW_TOKENS
) -> DataFrame:
    """One row per packed sequence: part, bin, n_tokens, doc_ids, offsets, cu_seqlens, resets, ids.

    ``docs`` has ``doc_id`` and ``text``; other columns are not read. Segment ``k`` holds ids
    ``cu_seqlens[k]`` to ``cu_seqlens[k + 1]`` of the row, which are those of document
    ``doc_ids[k]`` from token ``offsets[k]`` on. ``resets`` lists where positions start at 0:
    every segment and the padding, which repeats ``end``. ``ids`` is a row of ``capacity``
    little-endian integers: 2 bytes each if the vocabulary allows, else 4.

    A document has its tokens and ``end``; one longer than ``capacity`` is split without loss.
    Null and empty texts have ``end`` alone. Rows repeated under an id are packed each, and a
    null id is an id. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ranks = read_vocabulary(spark, vocabulary)
    width = "<u2" if max(end, len(ranks)) < 1 << 16 else "<u4"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_pack(spark.sparkContext.broadcast(ranks), end, capacity, window, width), ROWS)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the rows as Parquet; the binary column holds the id matrix row by row."""
    packed.write.parquet(path)


def id_matrix(ids: Sequence[bytes], capacity: int) -> np.ndarray:
    """The ids of some rows as a matrix."""
    raw = b"".join(ids)
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * capacity * len(ids) else "<u4").reshape(len(ids), capacity)
