"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are dealt to shards by their id, and every task packs its shard window by window, so
nothing grows with the data but the number of shards. A window's pieces are taken by decreasing
length. A piece goes to the open bin with the least room that holds it. If there is none, a bin
is opened with the permitted length that costs least for each token it can be expected to hold:
the piece, and as much of what is still to come as fits. In the end every bin is cut down to the
shortest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.shared import Scratch
from lakeweave.llm.words import words

LENGTHS = (512, 1024, 2048, 4096)
# Documents in a shard on average, and pieces that are packed together.
SHARD_ROWS = 16_384
WINDOW = 65_536

BINS = (
    "shard int, bin int, capacity int, n_tokens int, doc_ids array<long>, offsets array<long>, lengths array<int>"
)


def cost(length: int) -> float:
    """Cost of a sequence: a fixed share, its tokens, and attention that grows with the square."""
    return 64.0 + length + length * length / 16_384


def pieces(size: int, most: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of the parts of a document; all but the last have the full length."""
    for offset in range(0, size, most):
        yield offset, min(most, size - offset)


def best_fit(sizes: Sequence[int], lengths: Sequence[int], cost: Callable[[int], float] = cost) -> list[tuple[int, list[int]]]:
    """(capacity, indexes of pieces) of every bin; pieces are given by decreasing size."""
    lengths = sorted(lengths)
    price = {c: cost(c) for c in lengths}
    to_come = sum(sizes)
    bins: list[tuple[int, list[int]]] = []
    room: list[tuple[int, int]] = []  # (room, bin), sorted
    for i, size in enumerate(sizes):
        to_come -= size
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left = min(
                (c for c in lengths if c >= size), key=lambda c: (price[c] / (size + min(c - size, to_come)), c)
            )
            b = len(bins)
            bins.append((left, []))
        bins[b][1].append(i)
        if left > size:
            insort(room, (left - size, b))
    return [(lengths[bisect_left(lengths, sum(sizes[i] for i in held))], held) for _, held in bins]


def _pack(lengths: Sequence[int], window: int):
    most = max(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, made, held = TaskContext.get().partitionId(), 0, []

        def packed() -> pa.RecordBatch:
            held.sort(key=lambda p: -p[2])  # stable: equal lengths stay in the order of their ids
            rows = [
                (shard, made + k, c, sum(held[i][2] for i in at), *(list(x) for x in zip(*(held[i] for i in at), strict=True)))
                for k, (c, at) in enumerate(best_fit([p[2] for p in held], lengths))
            ]
            kinds = [pa.int32()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.int32())]
            names = [part.split()[0] for part in BINS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for doc_id, size in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                for offset, length in pieces(size, most):
                    held.append((doc_id, offset, length))
                    if len(held) == window:
                        out = packed()
                        made, held = made + out.num_rows, []
                        yield out
        if held:
            yield packed()

    return run


def best_fit_packing(
    sizes: DataFrame, lengths: Sequence[int] = LENGTHS, shard_rows: int = SHARD_ROWS, window: int = WINDOW
) -> DataFrame:
    """One row per bin: shard, bin, capacity, n_tokens, and the doc_ids, offsets and lengths of its pieces.

    ``sizes`` has ``doc_id`` and ``n_tokens``; other columns are not read. A document longer than
    the longest permitted length is split into pieces; together they hold every token once.
    Documents with null or no tokens take no room and are in no bin. Rows repeated under an id
    are packed each; a null id is an id. An empty table gives no bins.
    """
    scratch = Scratch(sizes.sparkSession)
    sizes = sizes.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("n_tokens"))
    sizes = scratch.save(sizes.where("n_tokens > 0"), "sizes")
    shards = max(1, -(-sizes.count() // shard_rows))
    dealt = sizes.repartition(shards, F.xxhash64("doc_id", "n_tokens")).sortWithinPartitions("doc_id", "n_tokens")
    return dealt.mapInArrow(_pack(tuple(lengths), window), BINS)


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): words of each text and one end token."""
    return docs.select("doc_id", (F.size(words(F.col("text"))) + 1).alias("n_tokens"))
