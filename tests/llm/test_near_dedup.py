import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from lakeweave.llm import components, near_dedup, pii, shared
from lakeweave.llm.near_dedup import near_duplicates
from lakeweave.llm.shared import Scratch, lean_semi_join
from tests import oracle

from . import brute


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_equals_brute_force(make_docs, corpus):
    got = by_id(near_duplicates(make_docs(corpus.items())))
    expected = brute.components(corpus)
    assert {i: r["component_id"] for i, r in got.items()} == expected
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(brute.shingles(t)) for i, t in corpus.items()}
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_blocks_of_large_buckets_equal_brute_force(make_docs, corpus, monkeypatch):
    """Nearly every bucket counts as large, and blocks are small."""
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(near_dedup, "PIVOTS", 1)
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    got = by_id(near_duplicates(make_docs(corpus.items())))
    assert {i: r["component_id"] for i, r in got.items()} == brute.components(corpus)


def test_long_lists_equal_brute_force(make_docs, corpus, monkeypatch):
    """Links and needed texts count as too many for the driver, and most buckets as large."""
    monkeypatch.setattr(components, "FEW_LINKS", 3)
    monkeypatch.setattr(shared, "FEW_ROWS", 3)
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 2)
    got = by_id(near_duplicates(make_docs(corpus.items())))
    assert {i: r["component_id"] for i, r in got.items()} == brute.components(corpus)


@pytest.fixture
def broadcast_rows(monkeypatch):
    """Rows of every table that is sent to the driver and all executors on request."""
    rows, broadcast = [], F.broadcast

    def counted(df):
        rows.append(df.count())
        return broadcast(df)

    monkeypatch.setattr(F, "broadcast", counted)
    return rows


DRIVER_ROWS = 100_000


def test_the_driver_holds_few_links(spark, broadcast_rows):
    """60,000 paths of three nodes."""
    ids = spark.range(0, 180_000, 1, 4).where("id % 3 < 2")
    links = ids.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    roots = components.components(Scratch(spark), links, "a", "b")
    assert roots.count() == 120_000
    assert roots.where("root <> node - node % 3").isEmpty()
    assert max(broadcast_rows, default=0) <= DRIVER_ROWS


def test_the_driver_holds_few_keys(spark, broadcast_rows, monkeypatch):
    """A list of 171,000 keys; rows without a key and clashing columns beside them."""
    key = F.when(F.col("id") % 7 > 0, F.col("id") - 1000)
    docs = spark.range(0, 400_000, 1, 4).select(key.alias("doc_id"), F.lit("a").alias("marks"), F.lit("b").alias("part"))
    ids = Scratch(spark).save(docs.where("doc_id % 2 = 0").select("doc_id"), "ids")
    assert ids.count() > DRIVER_ROWS
    for most in (shared.MOST_BITS, 100_003):
        monkeypatch.setattr(shared, "MOST_BITS", most)
        got = lean_semi_join(docs, ids, "doc_id")
        assert got.columns == docs.columns
        assert got.groupBy().agg(F.count("*"), F.sum("doc_id"), F.countDistinct("doc_id")).first() == ids.groupBy().agg(
            F.count("*"), F.sum("doc_id"), F.countDistinct("doc_id")
        ).first()
    assert max(broadcast_rows) <= DRIVER_ROWS


def test_edge_rows(make_docs, edge_rows):
    rows = near_duplicates(make_docs(edge_rows)).collect()
    assert len(rows) == len(edge_rows)
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert all(r["component_id"] == r["doc_id"] for r in rows)


def test_empty_table(make_docs):
    assert near_duplicates(make_docs([])).collect() == []


SPLITS = {
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "12",
}


@pytest.fixture
def splitting(spark):
    before = {key: spark.conf.get(key, None) for key in SPLITS}
    for key, value in SPLITS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def is_split(df) -> bool:
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_the_join_of_equal_sets_is_split(spark, splitting):
    """A third of the documents have one set."""
    ids = spark.range(0, 60_000, 1, 6).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")))
    features = ids.select(
        F.col("id").alias("doc_id"), F.lit(9).cast("long").alias("n_shingles"), F.xxhash64("k").alias("set_a"), F.xxhash64("k", F.lit(1)).alias("set_b"),
        F.array(*[F.xxhash64("k", F.lit(i)) for i in range(near_dedup.COLLECTIONS)]).alias("collections"),
    )
    scratch = Scratch(spark)
    features = scratch.save(features, "features")
    assert is_split(near_dedup._members(scratch, features))


def test_the_join_of_a_hot_node_is_split(spark, splitting, monkeypatch):
    """One node has two thirds of the links, the others are paths."""
    monkeypatch.setattr(components, "FEW_LINKS", 1000)
    ids = spark.range(1, 60_000, 1, 6)
    links = ids.select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") - 1).alias("a"), F.col("id").alias("b"))
    joined, scratch = [], Scratch(spark)
    save = Scratch.save

    def kept(self, df, name):
        if name == "large":
            joined.append(df)
        return save(self, df, name)

    monkeypatch.setattr(Scratch, "save", kept)
    assert components.components(scratch, links, "a", "b").where("root <> 0").isEmpty()
    assert is_split(joined[0])


def test_the_join_of_a_hot_pattern_is_split(spark, splitting, monkeypatch):
    """A third of the places of candidates have one pattern."""
    ids = spark.range(0, 60_000, 1, 6)
    pattern = F.when(F.col("id") % 3 == 0, "before my number").otherwise(F.concat(F.lit("before "), (F.col("id") % 9000).cast("string")))
    graph = ids.select(pattern.alias("pattern"), F.xxhash64("id").alias("instance"), (F.col("id") % 50 > 1).cast("int").alias("seed"))
    joined, scratch = [], Scratch(spark)
    save = Scratch.save

    def kept(self, df, name):
        if name == "scores":
            joined.append(df)
        return save(self, df, name)

    monkeypatch.setattr(Scratch, "save", kept)
    scores = pii._scores(scratch, graph)
    assert scores.count() == 60_000
    assert is_split(joined[0])


def test_query_equals_sql(spark, sf_dir):
    name = "op7_minhash_near_dedup"
    assert oracle.spark_answer(contract.queries()[name](spark, sf_dir)) == oracle.sql_answer(oracle.connect(sf_dir), contract.oracle_sql()[name])
