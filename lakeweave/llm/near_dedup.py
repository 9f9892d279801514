"""Near-duplicate documents by MinHash with tensored banding.

A document is the set of its distinct five-word shingles. ``COLLECTIONS`` small collections
of ``PER_COLLECTION`` minhashes each are computed; a table key combines two collections, so
that 32 minhashes serve 120 tables of four. Two documents with similarity 0.75 share a table
unless fewer than two collections agree, which happens 4 times in 100,000; at 0.8 once in a
million. Candidates are confirmed on the full sets, and links are followed to components.

What keeps it going at scale:

* Documents with equal sets are one node from the start, so copies are never compared.
* A table key can only meet another if both of its collections do. Collections that occur
  once are dropped before any table key is made; most documents end there.
* Tables that hold the same documents in a bucket give one bucket. Pairs are made only in
  buckets of up to ``SMALL_BUCKET`` documents.
* Larger buckets that share documents are merged to a cluster. A few pivots are compared with
  all of a cluster; that ties copies of one original together. Documents still apart are
  compared with all of the cluster in blocks: a task takes two blocks of texts and counts the
  common shingles of all their pairs as a matrix product, and returns links of a spanning
  forest. Nothing is skipped, and no bucket or cluster is collected.
* Minimum and joins back instead of windows: a hot key is reduced in the map tasks. What came of it is
  written down before it is joined back by the same key: adaptive execution splits a hot key only
  in a join of tables, not of an aggregate that still lies in the join's own stage.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.components import components
from lakeweave.llm.shared import Scratch, lean_semi_join
from lakeweave.llm.textbytes import Texts, mix, slices

SHINGLE = 5
COLLECTIONS, PER_COLLECTION = 16, 2
SIMILAR = (75, 100)
# Documents of a bucket whose pairs are made; pivots of a cluster, and documents of a block in it.
SMALL_BUCKET = 16
PIVOTS = 8
BLOCK = 256

_RNG = np.random.default_rng(7)
_SCALE = _RNG.integers(0, 1 << 63, COLLECTIONS * PER_COLLECTION, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 1 << 63, COLLECTIONS * PER_COLLECTION, dtype=np.uint64)
_SALT = np.uint64(0xA24BAED4963EE407)

FEATURES = "doc_id long, n_shingles long, set_a long, set_b long, collections array<long>"


def shingle_sets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, one text after the other, and the bounds by text.

    A text with fewer than five words has its whole sequence of words as one shingle; a
    text without words has none.
    """
    words = texts.word_hashes()
    h, _, bounds = texts.windows(words, SHINGLE)
    sets = []
    for i, n in enumerate(texts.n_words):
        if n >= SHINGLE:
            sets.append(np.unique(h[bounds[i] : bounds[i + 1]]))
        elif n:
            whole = np.uint64(n)
            for w in words[texts.first_word[i] : texts.first_word[i + 1]]:
                whole = whole * _SALT + w
            sets.append(mix(np.array([whole], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            ids = batch.column(0)
            for row, texts in slices(batch.column(1), lower=True):
                h, bounds = shingle_sets(texts)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                at = bounds[:-1][full]
                low = np.zeros((len(_SCALE), texts.size), np.uint64)
                sums = np.zeros((2, texts.size), np.uint64)
                if len(full):
                    for k, (scale, shift) in enumerate(zip(_SCALE, _SHIFT, strict=True)):
                        low[k, full] = np.minimum.reduceat(h * scale + shift, at)
                    sums[0, full] = np.add.reduceat(mix(h), at)
                    sums[1, full] = np.add.reduceat(mix(h ^ _SALT), at)
                joined = np.zeros((COLLECTIONS, texts.size), np.uint64)
                for k in range(PER_COLLECTION):
                    joined = mix(joined * _SALT + low[k::PER_COLLECTION])
                flat = joined.T.copy().view(np.int64).ravel()
                steps = np.arange(0, len(flat) + 1, COLLECTIONS, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(row, texts.size).cast(pa.int64()),
                        pa.array(sizes),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        pa.ListArray.from_arrays(steps, pa.array(flat)),
                    ],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "collections"],
                )


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of texts whose shingle sets are similar enough."""
    part, whole = SIMILAR
    with np.errstate(over="ignore"):
        for batch in batches:
            sides = []
            for name in ("text_a", "text_b"):
                sets = []
                for _, texts in slices(batch.column(name), lower=True):
                    h, bounds = shingle_sets(texts)
                    sets += [h[bounds[i] : bounds[i + 1]] for i in range(texts.size)]
                sides.append(sets)
            keep = []
            for a, b in zip(*sides, strict=True):
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both > 0 and whole * both >= part * (len(a) + len(b) - both))
            kept = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            if kept.num_rows:
                yield kept


def _shared_collections(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """(node, keys): the collections of a node that another node has as well, if two or more."""
    each = nodes.select("node", F.posexplode("collections").alias("i", "v"))
    shared = each.groupBy("i", "v").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared = scratch.save(shared.where("low <> high").select("i", "v"), "shared")
    return (
        each.join(shared, ["i", "v"])
        .groupBy("node")
        .agg(F.array_sort(F.collect_set(F.struct("i", "v"))).alias("keys"))
        .where(F.size("keys") >= 2)
    )


def _buckets(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """(key, node) for every table in which both halves of the key are shared."""
    pairs = F.array(*[F.array(F.lit(i), F.lit(j)) for i, j in combinations(range(COLLECTIONS), 2)])
    halves = _shared_collections(scratch, nodes).select("node", "keys", F.explode(pairs).alias("at"))
    first, second = F.get("keys", F.col("at")[0]), F.get("keys", F.col("at")[1])
    return halves.where(second.isNotNull()).select(F.xxhash64(first, second).alias("key"), "node")


def _different(rows: DataFrame) -> DataFrame:
    """One bucket of those with the same members, and none with a single member."""
    spread = [F.sum(F.xxhash64("node", F.lit(k)) % (1 << 40)).alias(f"s{k}") for k in range(2)]
    sums = rows.groupBy("key").agg(F.count("*").alias("members"), *spread).where("members > 1")
    keys = sums.groupBy("members", "s0", "s1").agg(F.min("key").alias("key")).select("key")
    return rows.join(keys, "key")


def _pairs(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """All pairs of nodes in the given buckets, each once."""
    few = rows.join(keys, "key")
    other = few.select("key", F.col("node").alias("b"))
    return few.join(other, "key").where("node < b").select(F.col("node").alias("a"), "b")


def _against_pivots(scratch: Scratch, clusters: DataFrame) -> DataFrame:
    """Pairs of a few nodes of each cluster with all its nodes, each once."""
    best = [F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(PIVOTS)]
    chosen = clusters.groupBy("cluster").agg(F.array_distinct(F.array(*best)).alias("chosen"))
    chosen = scratch.save(chosen.select("cluster", F.explode("chosen").alias("pivot")), "pivots")
    against = clusters.join(chosen, "cluster").where("node <> pivot")
    return against.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b"))


def _still_apart(scratch: Scratch, clusters: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of clusters that hold more than one component, with their component as ``comp``."""
    state = clusters.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    mixed = state.groupBy("cluster").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    return state.join(scratch.save(mixed.select("cluster"), "mixed"), "cluster")


def _block_pairs(scratch: Scratch, state: DataFrame) -> DataFrame:
    """(cluster, x, y, side, node, comp): blocks of the nodes outside a cluster's largest component
    (side 0) against blocks of all its nodes (side 1)."""
    sizes = state.groupBy("cluster", "comp").count()
    sizes = sizes.groupBy("cluster").agg(F.max_by("comp", "count").alias("main"), F.sum("count").alias("n"), F.max("count").alias("most"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    sizes = sizes.select("cluster", "main", blocks(F.col("n") - F.col("most")).alias("xs"), blocks(F.col("n")).alias("ys"))
    state = state.join(scratch.save(sizes, "sizes"), "cluster")
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outside = state.where("comp <> main").withColumn("x", at("xs")).withColumn("y", every("ys"))
    inside = state.withColumn("x", every("xs")).withColumn("y", at("ys"))
    cols = ["cluster", "x", "y", "node", "comp"]
    return outside.select(F.lit(0).alias("side"), *cols).unionByName(inside.select(F.lit(1).alias("side"), *cols))


def common_shingles(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of every set on the left with every set on the right."""
    where = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float64)
    for start in range(0, len(where), 4096):
        part = where[start : start + 4096]
        ones = [np.zeros((len(sets), len(part)), np.float32) for sets in (left, right)]
        for matrix, sets in zip(ones, (left, right), strict=True):
            for i, s in enumerate(sets):
                at = np.searchsorted(part, s)
                at[at == len(part)] = 0
                matrix[i, at[part[at] == s]] = 1
        out += ones[0] @ ones[1].T
    return out


def _linked_blocks(table: pa.Table) -> pa.Table:
    """Links between the two blocks: a spanning forest of those between components."""
    part, whole = SIMILAR
    sides = []
    with np.errstate(over="ignore"):
        for side in (0, 1):
            rows = table.filter(pa.compute.equal(table["side"], side))
            sets = []
            for _, texts in slices(rows["text"], lower=True):
                h, bounds = shingle_sets(texts)
                sets += [h[bounds[i] : bounds[i + 1]] for i in range(texts.size)]
            sides.append((rows["node"].to_numpy(), rows["comp"].to_numpy(), sets))
    (u, comp_u, left), (v, comp_v, right) = sides
    if not left or not right:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    both = common_shingles(left, right)
    sizes = np.add.outer([len(s) for s in left], [len(s) for s in right])
    linked = (whole * both >= part * (sizes - both)) & np.not_equal.outer(comp_u, comp_v)
    parent = {c: c for c in (*comp_u.tolist(), *comp_v.tolist())}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    found = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        x, y = root(int(comp_u[i])), root(int(comp_v[j]))
        if x != y:
            parent[x] = y
            found.append((int(u[i]), int(v[j])))
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _members(scratch: Scratch, linkable: DataFrame) -> DataFrame:
    """Every document with the smallest one of equal sets as its node; only that one carries its collections on."""
    same = ["set_a", "set_b", "n_shingles"]
    least = scratch.save(linkable.groupBy(*same).agg(F.min("doc_id").alias("node")), "sets")
    return linkable.join(least, same).select(
        "doc_id", "n_shingles", "node", F.when(F.col("doc_id") == F.col("node"), F.col("collections")).alias("collections")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``docs`` has ``doc_id`` and ``text``; other columns are not read. Words are lower-cased
    (A-Z). Documents are linked if 100 * intersection >= 75 * union of their shingle sets.

    A null or empty text, or one without words, has no shingles and is linked with nothing.
    Rows without ``doc_id`` are returned unlinked, with a null component, and kept. Repeated
    rows come back as often as they went in; several texts under one ``doc_id`` are linked
    where any of them is. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    features = scratch.save(texts.mapInArrow(_features, FEATURES), "features")
    linkable = features.where("n_shingles > 0 AND doc_id IS NOT NULL")
    members = scratch.save(_members(scratch, linkable), "members")
    nodes = members.where("doc_id = node").select("node", "n_shingles", "collections")
    rows = scratch.save(_different(scratch.save(_buckets(scratch, nodes), "tables")), "buckets")
    roots = _link(scratch, texts, nodes.select("node", "n_shingles"), rows)

    # The root is the smallest node, and a node is the smallest document of equal sets.
    found = members.join(roots, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "node").alias("component_id")
    )
    alone = features.where("n_shingles = 0 OR doc_id IS NULL").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _link(scratch: Scratch, texts: DataFrame, sizes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, root) of the nodes that have a link."""
    part, whole = SIMILAR
    sizes = sizes.distinct()

    def needed(ids: DataFrame) -> DataFrame:
        ids = scratch.save(ids.select(F.col("node").alias("doc_id")).distinct(), "needed")
        return scratch.save(lean_semi_join(texts, ids, "doc_id").distinct(), "texts")

    members = scratch.save(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low")), "bucket-sizes")
    pairs = _pairs(rows, members.where(F.col("n") <= SMALL_BUCKET).select("key"))
    large = rows.join(members.where(F.col("n") > SMALL_BUCKET), "key").select("node", "low").distinct()
    tied = components(scratch, scratch.save(large, "large"), "node", "low")
    clusters = tied.unionByName(tied.select(F.col("root").alias("node"), "root").distinct())
    clusters = clusters.withColumnRenamed("root", "cluster")

    pairs = pairs.unionByName(_against_pivots(scratch, clusters)).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}")), side)
    fits = F.col("n_a").between(F.ceil(F.col("n_b") * part / whole), F.floor(F.col("n_b") * whole / part))
    pairs = scratch.save(pairs.where(fits).select("a", "b"), "pairs")
    found = needed(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    for side in ("b", "a"):
        pairs = pairs.join(found.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}")), side)
    links = pairs.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed, "a long, b long")
    roots = components(scratch, scratch.save(links, "links"), "a", "b")

    apart = scratch.save(_still_apart(scratch, clusters, roots), "apart")
    if apart.isEmpty():
        return roots
    blocks = scratch.save(_block_pairs(scratch, apart), "blocks")
    found = needed(blocks.select("node")).withColumnRenamed("doc_id", "node")
    # Blocks repeat their nodes, so that the driver would hold 40 times what their files suggest.
    more = blocks.hint("merge").join(found, "node").groupBy("cluster", "x", "y").applyInArrow(_linked_blocks, "a long, b long")
    known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(scratch, known.unionByName(scratch.save(more, "links")), "a", "b")
