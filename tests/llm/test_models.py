import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lakeweave.llm import quality_model, toxicity
from lakeweave.llm.labelled import sample_texts
from lakeweave.llm.language_model import score_texts, train
from lakeweave.llm.quality_model import score_quality
from lakeweave.llm.toxicity import dictionaries, plain, score_toxicity, windows, without

from . import brute
from .conftest import sentence


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def test_word_counts_and_base_scores_equal_brute_force(make_docs, corpus, edge_rows):
    rows = [*corpus.items(), *edge_rows]
    learned = [t for i, t in rows if i is not None and fold(i, 7) != 2]
    tokens = {t: [*brute.words(t), "\nend"] for _, t in rows}
    counts = Counter(w for t in learned for w in tokens[t])
    n, v = sum(counts.values()), len(counts)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    found = score_texts(make_docs(rows), model_words=64, head_words=100).collect()
    assert len(found) == len(rows)
    for r in found:
        options = []
        for t in texts[r["doc_id"]]:
            known = sum(counts[w] > 0 for w in tokens[t])
            base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens[t])
            options.append((len(tokens[t]), known, pytest.approx(base, rel=1e-9)))
        assert (r["n_tokens"], r["n_known"], r["base_score"]) in options
        assert r["train_tokens"] == n and r["score"] < 0
        assert r["held_out"] == (r["doc_id"] is not None and fold(r["doc_id"], 7) == 2)


def test_model_is_normalised_and_learns_what_follows_what():
    rng = np.random.default_rng(0)
    size = 20
    follows = rng.permutation(size)
    pairs = np.array([a * size + b for a in range(size) for b in range(size)])
    counts = np.array([200.0 if follows[a] == b else 1.0 for a in range(size) for b in range(size)])
    table = train(pairs, counts, size)
    assert np.allclose((10.0 ** table.astype(float)).sum(1), 1, atol=1e-5)
    learned = (table.ravel() * counts).sum() / counts.sum()
    assert learned > (train(pairs, counts, size, steps=0).ravel() * counts).sum() / counts.sum() + 0.3


def test_words_outside_the_model_are_predicted_by_class(make_docs):
    """Rare words of two endings that depend on the word before, as words and as contexts."""
    rng = random.Random(12)
    held = {i for i in range(400) if fold(i, 7) == 2}
    rows = []
    for i in range(400):
        pairs = [(f"lead{k}", f"r{rng.randrange(10**6)}{'ing' if k else 'est'}", f"tail{k}") for k in rng.choices((0, 1), k=30)]
        # The same words with the endings of the other kind: as likely by their counts alone.
        if i in held and i % 2:
            pairs = [(a, b[:-3] + ("est" if b.endswith("ing") else "ing"), c) for a, b, c in pairs]
        rows.append((i, " ".join(" ".join(p) for p in pairs)))
    found = [r for r in score_texts(make_docs(rows), model_words=40).collect() if r["held_out"]]
    per_token = {odd: [r["score"] / r["n_tokens"] for r in found if r["doc_id"] % 2 == odd] for odd in (0, 1)}
    assert min(per_token[0]) > max(per_token[1]) + 0.1


def test_language_model_of_an_empty_table(make_docs):
    assert score_texts(make_docs([])).collect() == []
    only_held_out = next(i for i in range(100) if fold(i, 7) == 2)
    (row,) = score_texts(make_docs([(only_held_out, "a b")])).collect()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)


@pytest.fixture(scope="module")
def labelled():
    """(rows, labels): junk of several kinds, prose, and insults of few words in some prose."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(700):
        toxic, junk = i % 5 == 0, i % 4 == 1
        w = sentence(rng, rng.randint(20, 200), 100_000).split()
        if toxic:
            for _ in range(max(2, len(w) // 15)):
                w.insert(rng.randrange(len(w)), rng.choice(["grobblenit", "Snarvexkop", "plimdorfic"]))
        text = " ".join(w)
        if junk:
            text = " | ".join(w) if i % 3 else text.upper().replace(" ", "!! ")
        rows.append((i, text))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


def labels_of(spark, labels):
    odd = [(None, 1, 1), (5, None, None), (99_999, 0, 0), *labels[3:4]]
    return spark.createDataFrame([(*x, "clash") for x in labels + odd], "doc_id long, quality int, toxic int, y string")


@pytest.mark.parametrize(("score", "at", "folds", "held"), [(score_quality, 1, 5, 0), (score_toxicity, 2, 4, 2)])
def test_held_out_rows_are_told_apart(spark, make_docs, labelled, score, at, folds, held):
    rows, labels = labelled
    truth = {x[0]: x[at] for x in labels}
    found = score(make_docs(rows), labels_of(spark, labels)).collect()
    assert len(found) == len(rows)
    assert all(r["held_out"] == (fold(r["doc_id"], folds) == held) for r in found)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    right = [r["predicted"] == truth[r["doc_id"]] for r in found if r["held_out"]]
    assert len(right) > 80 and sum(right) / len(right) > 0.95


@pytest.mark.parametrize("score", [score_quality, score_toxicity])
def test_classifiers_on_edge_rows(spark, make_docs, labelled, edge_rows, score):
    rows, labels = labelled
    found = score(make_docs([*rows, *edge_rows]), labels_of(spark, labels)).collect()
    assert len(found) == len(rows) + len(edge_rows)
    assert all(r["score"] is not None and not math.isnan(r["score"]) for r in found)
    none = labels_of(spark, []).limit(0)
    assert len(score(make_docs(edge_rows), none).collect()) == len(edge_rows)
    assert score(make_docs([]), none).collect() == []


@pytest.mark.parametrize("score", [score_quality, score_toxicity])
def test_held_out_labels_teach_nothing(spark, make_docs, labelled, score):
    rows, labels = labelled
    folds, held = (5, 0) if score is score_quality else (4, 2)
    turned = [(i, 1 - q, 1 - t) if fold(i, folds) == held else (i, q, t) for i, q, t in labels]
    a, b = (
        {r["doc_id"]: r["score"] for r in score(make_docs(rows), labels_of(spark, x)).collect()}
        for x in (labels, turned)
    )
    assert a == b


def test_dictionaries_hold_what_is_specific():
    rng = random.Random(1)
    texts = [(0, sentence(rng, 60).encode()) for _ in range(200)]
    texts += [(1, (sentence(rng, 60) + " grobblenit " + sentence(rng, 5)).encode()) for _ in range(200)]
    ordinary, toxic = dictionaries(texts)
    assert b"grobblenit" in toxic and b"grobblenit" not in ordinary
    # They differ in what is specific only, and lie equally far from a window.
    assert len(toxic) == len(ordinary) > 1000
    first = next(k for k in range(len(toxic)) if toxic[k] != ordinary[k])
    assert len(toxic) - first < 200


def test_a_dictionary_without_the_runs_of_pieces():
    assert without(b"some common words", [b" common "]) == b"somewords"
    assert without(b"some", [b" common "]) == b"some" and without(b"some common", []) == b"some common"


def test_distances_equal_the_lengths_of_windows_compressed_one_by_one(make_docs):
    rng = random.Random(5)
    insults = ["grobblenit", "snarvexkop"]
    texts = [(k % 2, " ".join([sentence(rng, 40), *insults[: k % 2 * 2], sentence(rng, 5)]).encode()) for k in range(300)]
    ordinary, toxic = dictionaries(texts)
    rows = [(i, t.decode()) for i, (_, t) in enumerate(texts[:20])] + [(20, None), (21, ""), (22, "x" * 5000), (23, "grobblenit " * 400)]
    found = make_docs(rows).select("doc_id", "text").mapInArrow(
        toxicity._distances(ordinary, toxic), "doc_id long, " + ", ".join(f"{f} double" for f in toxicity.FEATURES)
    )
    found = {r["doc_id"]: list(r)[1:] for r in found.collect()}
    for i, t in rows:
        lengths = []
        for w in windows(plain((t or "").encode())):
            one = [len(toxicity._compressor(d).compress(w)) for d in (ordinary, toxic)]
            lengths.append(one[0] - one[1])
        top = sorted(lengths, reverse=True)
        shares = [sum(x >= k for x in lengths) / len(lengths) for k in (1, 2, 4)]
        assert found[i] == pytest.approx([sum(lengths) / len(lengths), *shares, top[0], sum(top[:3]) / len(top[:3]), math.log(len(lengths))])
    assert found[1][4] > 0 >= found[0][4]


def test_windows_hold_the_whole_text():
    text = plain(("word " * 500 + "x" * 1000).encode())
    from lakeweave.llm.toxicity import LEAD

    assert b"".join(w.removeprefix(LEAD) for w in windows(text)) == text


def test_trees_find_the_cut():
    g, h, n = np.array([-5.0, -5, 5, 5]), np.ones(4) * 10, np.ones(4) * 100
    tree = quality_model.shallow_tree(g, h, n)
    assert tree[0] == tree[1] < 0 < tree[2] == tree[3]
    gain, table = quality_model.quadrant_tree(np.array([[9.0, -9], [-9, 9]]), np.ones((2, 2)), np.ones((2, 2)) * 100)
    assert gain > 0 and table[0, 0] > 0 > table[0, 1]


def test_a_long_text_does_not_empty_the_sample(spark, make_docs):
    rows = [(i, "short text" if i % 5 else "long " * 50_000) for i in range(20)]
    chosen = spark.createDataFrame([(i, 1) for i, _ in rows], "doc_id long, y int")
    found = sample_texts(make_docs(rows), chosen, 100_000)
    assert len(found) == 20 and sum(len(t) for _, t in found) <= 100_000
