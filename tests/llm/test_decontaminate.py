import random

import __spark_entry__ as contract
from lakeweave.llm.decontaminate import LEAST_SCORE, MASKS, MISMATCH, contaminated
from tests import oracle

from . import brute
from .conftest import sentence


def case():
    rng = random.Random(5)
    items = {i: sentence(rng, n) for i, n in enumerate([12, 15, 15, 30, 60, 11, 0])}
    docs = {}
    for k in range(60):
        w = sentence(rng, rng.randint(0, 80)).split()
        item = items[k % 7].split()
        for _ in range(k % 4):  # substitutions
            if item:
                item[rng.randrange(len(item))] = "changed"
        if k % 3:
            at = rng.randint(0, len(w))
            w[at:at] = item if k % 5 else item[: len(item) // 2]
        docs[k] = " ".join(w) if k % 2 else "  " + " ".join(w).upper() + "\n"
    return docs, items


def run(spark, make_docs, docs, items, **kw):
    items = spark.createDataFrame(items, "item_id long, text string, seed string")
    return contaminated(make_docs(docs), items, **kw)


def test_equals_brute_force_by_broadcast_and_by_shuffle(spark, make_docs):
    docs, items = case()
    expected = {}
    for d, text in docs.items():
        for i, item in items.items():
            best, scores = brute.overlap(brute.words(text), brute.words(item), MASKS, MISMATCH)
            if best >= LEAST_SCORE:
                expected[d, i] = (best, sum(s >= LEAST_SCORE for s in scores))
    assert len(expected) > 15
    rows = [(i, t, "clash") for i, t in items.items()]
    for most in (10**6, 0):
        found = run(spark, make_docs, docs.items(), rows, broadcast_rows=most).collect()
        assert {(r["doc_id"], r["item_id"]): (r["overlap_score"], r["n_alignments"]) for r in found} == expected


def test_any_single_substitution_in_fifteen_words_is_found(spark, make_docs):
    item = [f"t{i}" for i in range(15)]
    docs = [(k, " ".join(["before", *item[:k], "other", *item[k + 1 :], "after"])) for k in range(15)]
    found = run(spark, make_docs, docs, [(1, " ".join(item), "")]).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(15))


def test_edge_rows_and_empty_tables(spark, make_docs, edge_rows):
    items = [(None, "a b " * 20, ""), (1, None, ""), (2, "a b " * 10, ""), (2, "a b " * 10, "")]
    found = run(spark, make_docs, edge_rows, items).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(7, 2)]
    assert run(spark, make_docs, [], items).collect() == []
    assert run(spark, make_docs, edge_rows, []).collect() == []


def test_query_equals_sql(spark, sf_dir):
    name = "op2_decontamination"
    assert oracle.spark_answer(contract.queries()[name](spark, sf_dir)) == oracle.sql_answer(oracle.connect(sf_dir), contract.oracle_sql()[name])
