"""Each stage on its own input, against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeweave.llm.decontaminate import LEAST_SCORE, MASKS, MISMATCH

from . import brute
from .conftest import sentence

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    item = sentence(rng, 25)
    texts = {i: sentence(rng, rng.randint(60, 200)) for i in range(40)}
    texts |= {40 + i: texts[i] + " more" for i in range(5)}
    texts |= {50: sentence(rng, 60) + " " + item, 51: "few words", 52: "again and again " * 60, 53: None}
    texts |= {54: sentence(rng, 70) + ' token = "' + "0123456789abcdef" * 3 + '"'}
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts.items()]
    path = tmp_path_factory.mktemp("tables")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), texts, item


def test_stages_in_turn(spark, folder):
    path, texts, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns

    docs = STAGES["quality_rules"](spark, docs, path)
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {i: t for i, t in texts.items() if (q := brute.quality(t))[0] >= 50 and 100 * q[4] <= 50 * q[0]}
    assert kept == good and docs.columns == columns

    docs = STAGES["near_dedup"](spark, docs, path)
    roots = brute.components(good)
    assert {r["doc_id"] for r in docs.collect()} == set(roots.values()) and docs.columns == columns

    docs = STAGES["decontamination"](spark, docs, path)
    clean = {
        i for i in roots.values()
        if brute.overlap(brute.words(texts[i]), brute.words(item), MASKS, MISMATCH)[0] < LEAST_SCORE
    }
    assert {r["doc_id"] for r in docs.collect()} == clean and 50 not in clean and docs.columns == columns

    docs = STAGES["secret_scans"](spark, docs, path)
    after = {r["doc_id"]: r for r in docs.collect()}
    assert set(after) == clean and docs.columns == columns
    assert after[54]["text"].endswith("[SECRET]\"") and after[54]["n_chars"] == len(after[54]["text"])
    assert all(after[i]["text"] == texts[i] for i in clean - {54})

    bins = STAGES["best_fit_packing"](spark, docs, path).collect()
    assert sorted(d for r in bins for d in r["doc_ids"]) == sorted(clean)
    assert sum(r["n_tokens"] for r in bins) == sum(len(brute.words(after[i]["text"])) + 1 for i in clean)

    run = corpus_pipeline.run(spark, path).collect()
    assert sorted(map(str, run)) == sorted(map(str, bins))


def test_stages_on_edge_rows_and_empty_tables(spark, folder, make_docs, edge_rows):
    path, *_ = folder
    for rows in (edge_rows, []):
        docs = make_docs(rows).withColumn("n_chars", F.length("text").cast("long"))
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, docs, path)
            if name == "near_dedup":  # a repeated row goes
                assert out.count() == (len(rows) - 1 if rows else 0) and out.columns == docs.columns
            elif name != "best_fit_packing":
                assert out.columns == docs.columns and out.count() == len(rows)
            else:
                out.collect()
        assert STAGES["quality_rules"](spark, docs, path).count() == 0


def test_rows_without_an_id_and_texts_that_share_one(spark, folder, make_docs):
    """Each row is judged by its own text, whatever its id."""
    path, _, item = folder
    rng = random.Random(8)
    a, b, c, d = (sentence(rng, 120) for _ in range(4))
    leak = f"{sentence(rng, 60)} {item}"
    rows = [(None, a), (None, a + " more"), (None, b), (7, c), (7, d), (7, c + " more"), (8, d), (9, leak), (9, b + " x"), (None, leak), (7, c)]
    docs = make_docs(rows)
    kept = [(r["doc_id"], r["text"]) for r in STAGES["near_dedup"](spark, docs, path).collect()]
    texts = dict(enumerate(t for _, t in rows))
    groups = {}
    for i, root in brute.components(texts).items():
        groups.setdefault(root, set()).add(rows[i])
    assert len(kept) == len(groups) == 5
    assert all(sum(row in group for row in kept) == 1 for group in groups.values())

    clean = [(r["doc_id"], r["text"]) for r in STAGES["decontamination"](spark, docs, path).collect()]
    assert sorted(map(str, clean)) == sorted(str(row) for row in rows if row[1] != leak)
