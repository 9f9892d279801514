import base64
import random
import string
import sysconfig
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lakeweave.llm import pii
from lakeweave.llm.pii import find_pii
from lakeweave.llm.secrets import battery, find_secrets, redact
from lakeweave.llm.shared import Scratch
from lakeweave.llm.spans import PART, apart, cut, matches, parts, replaced

from . import brute

PIECES = [
    "password=", "Secret: 'abcdef", "token=abc ", "api_key : \"x/y+z=12\"", "APIKEY=123456", "secret: \"token\": \"abcdefgh\"",
    "AKIA" + "A1" * 8, "AKIA" + "B" * 15, "AKIAAKIA" + "C" * 16, "deadbeef" * 3, "0" * 23, "f" * 24 + "G", "é", "😀 ", "\n", " ", "=", ":",
    "a@b.c", "a@b.c_d@e.f", "x.y%+z@host-1.example.org.", "a@b", "@b.c", "1.2.3.4", "1.2.3.4.5", "300.1.2.3", "0255.000.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "12 34", "+1 (017) 555-7713", "+49..(", "+1 2", "79927398713", "+123456789012345678",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    out = {k: "".join(rng.choice(PIECES) + rng.choice(["", " ", "x", "."]) for _ in range(rng.randint(0, 25))) for k in range(150)}
    return out | {1000: "1.2.3.4 " * 700, 1001: "a@b" + ".c" * 20_000, 1002: "9" * 50_000, 1003: "token" * 5000 + "=" * 50}


@pytest.mark.parametrize(
    ("find", "kinds"), [(find_secrets, brute.SECRETS), (find_pii, brute.PERSONAL)], ids=["secrets", "pii"]
)
def test_base_spans_equal_brute_force(make_docs, texts, find, kinds):
    rows = find(make_docs(texts.items())).collect()
    assert len(rows) == len(texts)
    for r in rows:
        expected = brute.base_spans(texts[r["doc_id"]], kinds)
        assert r["base_sha256"] == brute.sha256(expected), r["doc_id"]
        listed = [s for s in r["spans"].split(",") if s and s.split(":")[0] in {k for k, *_ in kinds}]
        assert ",".join(listed) == expected
        for name, *_ in kinds:
            assert r[f"n_{name}"] == sum(s.startswith(name + ":") for s in listed)


@pytest.mark.parametrize("find", [find_secrets, find_pii])
def test_edge_rows(make_docs, edge_rows, find):
    rows = find(make_docs(edge_rows)).collect()
    assert len(rows) == len(edge_rows)
    assert all(r["spans"] == "" and r["base_sha256"] == brute.sha256("") for r in rows)
    assert find(make_docs([])).collect() == []


def test_places_of_very_many_matches(spark):
    text = "".join(f"a{'b' * (i % 7)}" for i in range(3000))
    row = spark.createDataFrame([(text,)], "t string").select(matches(F.col("t"), "ab*", F.lit(True)).alias("m")).first()
    at = 0
    for i, m in enumerate(row["m"]):
        assert (m["start"], m["end"]) == (at, at + 1 + i % 7)
        at = m["end"]


SPANS = "array<struct<start:int,end:int>>"


def some_spans(rng, n, most, longest):
    starts = sorted(rng.randrange(most) for _ in range(n))
    return [(a, min(a + rng.randint(1, longest), most)) for a in starts]


def test_spans_apart_and_replaced_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [("", [], []), ("\u00e9\U0001f600", [(0, 1)], [(1, 2)]), ("x" * PART * 2, [(0, PART)], [(PART, 2 * PART)])]
    for n in (0, 1, 5, 300, 900):
        text = "".join(rng.choice("ab \n\u00e9\U0001f600") for _ in range(4000))
        rows.append((text, some_spans(rng, 300, 4000, 30), rng.sample(some_spans(rng, n, 4000, 12), n)))
    df = spark.createDataFrame(rows, f"t string, found {SPANS}, taken {SPANS}")
    pieces = F.transform("taken", lambda s: cut(parts(F.col("t")), s["start"], s["end"]))
    got = df.select("t", "found", "taken", apart(F.col("found"), F.col("taken")).alias("free"),
                    replaced(F.col("t"), F.col("taken"), "[S]").alias("clean"), pieces.alias("pieces")).collect()
    for r in got:
        assert r["free"] == [f for f in r["found"] if not any(a < f["end"] and f["start"] < b for a, b in r["taken"])]
        assert r["pieces"] == [r["t"][a:b] for a, b in r["taken"]]
        at, out = 0, ""
        for a, b in sorted(r["taken"]):
            if a >= at:
                out += r["t"][at:a] + "[S]"
            at = max(at, b)
        assert r["clean"] == out + r["t"][at:]


def test_texts_with_very_many_spans_take_time_by_their_length(make_docs):
    """A text of a megabyte, tens of thousands of spans in it: quadratic work would take many minutes."""
    rng = random.Random(9)
    log = "\n".join(f"05-{i % 28} 10:{i % 60} host{i % 7} 10.0.{i % 250}.{i % 99} GET /a/{i * 7919 % 100_003}" for i in range(22_000))
    sums = "\n".join(f"{rng.randbytes(16).hex()}  file{i}" for i in range(22_000))
    began = time.monotonic()
    assert find_pii(make_docs([(1, log)])).first()["n_ip"] == 22_000
    docs = make_docs([(1, sums)])
    assert redact(docs, find_secrets(docs)).first()["text"] == "\n".join(f"[SECRET]  file{i}" for i in range(22_000))
    assert time.monotonic() - began < 150


def test_names_in_source_code_and_paths_are_no_secrets_and_keys_among_them_are(make_docs):
    rng = random.Random(10)
    files = sorted(Path(sysconfig.get_paths()["stdlib"]).glob("*.py"))[:60]
    source = [f.read_text(errors="replace") for f in files]
    source += [f"cd {f.parent}/Modules/getaddrinfo/{f.stem}_from_some_examples PYTHON_FOR_BUILD_DEPS={f.stem.title()}RequestHandler" for f in files]
    alphabets = (string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits, "0123456789ABCDEF", string.ascii_uppercase + "234567")
    keys = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (20, 32, 40) for _ in range(25)]
    rows = [*enumerate(source), *((10_000 + k, f"x = '{key}' # used") for k, key in enumerate(keys))]
    found = {r["doc_id"]: r for r in find_secrets(make_docs(rows)).collect()}
    assert sum(found[i]["n_random"] for i in range(len(source))) <= 2
    right = [found[10_000 + k]["spans"].endswith(f":{5}:{5 + len(key)}") for k, key in enumerate(keys)]
    assert sum(right) >= 0.97 * len(keys)


def test_long_words_beside_a_span_are_no_contexts(make_docs):
    """A word cut by the reach of a context would be another word's pattern."""
    rows = [(i, f"{'q' * (100 + i)} mail user{i}@example{i}.org {'z' * (100 + i)}") for i in range(40)]
    rows += [(100, f"{'q' * 300} mail ID-99887766 {'z' * 300}")]
    assert all(r["n_context"] == 0 for r in find_pii(make_docs(rows)).collect())


def test_battery_tells_random_strings_from_words(spark):
    rng = random.Random(2)
    strings = [base64.b64encode(rng.randbytes(30)).decode() for _ in range(40)]
    strings += [rng.randbytes(20).hex() for _ in range(40)]
    plain = ["".join(rng.choice(["er", "tion", "the", "and", "in"]) for _ in range(12)) for _ in range(40)]
    plain += ["-" * 40, "abcdefghijklmnopqrstuvwxyz", "1" * 30]
    df = spark.createDataFrame([(s,) for s in strings + plain], "value string")
    p = {r["value"]: r["p"] for r in battery(df).collect()}
    assert "1" * 30 not in p  # digits only are no encoding
    assert sum(p[s] > 0.05 for s in strings) >= 75
    assert all(p[s] < 0.001 for s in plain[:-1] if s in p)


def test_unnamed_random_strings_are_secrets_and_words_are_not(make_docs):
    rng = random.Random(4)
    mixed = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    rows = [(1, f"here is {mixed} for you")] + [(10 + i, "internationalization" + "ness" * (i % 5)) for i in range(50)]
    found = {r["doc_id"]: r for r in find_secrets(make_docs(rows)).collect()}
    assert found[1]["spans"] == "random:8:48" and found[1]["n_random"] == 1
    assert all(r["spans"] == "" for i, r in found.items() if i != 1)


def test_random_values_after_a_name_and_in_mixed_runs_are_secrets(make_docs):
    rng = random.Random(6)
    key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    padded = base64.b64encode(rng.randbytes(31)).decode()
    texts = {
        1: "SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENGbPxRfiCY", 2: f"sig={padded} end", 3: f"DB_KEY={key}", 4: f"a-b_c/{key}",
        5: f"x=https://a.example/some_path-to?sig={padded}&next=1", 6: f"{key}+/+{key[::-1]}-_-{key.swapcase()}", 7: f"{padded}==",
    }
    docs = make_docs([*texts.items(), *((10 + i, "internationalization=" + "ness" * (i % 7)) for i in range(50))])
    found = find_secrets(docs)
    rows = {r["doc_id"]: r for r in found.collect()}
    spans = {i: [tuple(map(int, s.split(":")[1:])) for s in rows[i]["spans"].split(",")] for i in texts}
    parts = {i: [texts[i][a:b] for a, b in spans[i]] for i in texts}
    assert parts[1] == ["wJalrXUtnFEMI/K7MDENGbPxRfiCY"] and parts[2] == [padded] and parts[3] == [key]
    assert key in "".join(parts[4]) and parts[5] == [padded] and parts[7] == [padded + "=="]
    assert all(rows[10 + i]["spans"] == "" for i in range(50))
    clean = {r["doc_id"]: r["text"] for r in redact(docs, found).collect()}
    assert clean[2] == "sig=[SECRET] end" and not any(k in clean[6] for k in (key, key[::-1], key.swapcase()))


def test_redaction(make_docs):
    rows = [(1, "a token = \"" + "deadbeef" * 4 + "\" z"), (2, "nothing"), (3, None), (None, "password=abcdefg!")]
    docs = make_docs(rows).withColumn("n_chars", F.length("text").cast("long"))
    out = {r["doc_id"]: r for r in redact(docs, find_secrets(docs)).collect()}
    assert out[1]["text"] == 'a [SECRET]" z' and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] == "nothing" and out[3]["text"] is None
    assert out[None]["text"] == "[SECRET]!"
    assert out[1].asDict().keys() == set(docs.columns)


def test_contexts_of_seeds_find_unseen_identifiers(make_docs):
    """After the phrase of many known addresses an unknown form of identifier is one, elsewhere not."""
    rows = [(i, f"filler{i} please contact user{i}@example{i}.org today ok") for i in range(40)]
    rows += [(100, "you may please contact ID-99887766 today ok"), (101, "we sold 1234567 pieces in march")]
    found = {r["doc_id"]: r for r in find_pii(make_docs(rows)).collect()}
    assert found[100]["spans"] == "context:23:34" and found[100]["n_context"] == 1
    assert found[101]["spans"] == ""
    assert all(r["n_context"] == 0 for i, r in found.items() if i < 100)


def test_identifiers_in_groups_and_short_ones_are_found_whole(make_docs):
    forms = ["017 555 7713", "(017) 555-77 13", "(017) 555-7713", "4111 1111 1111 1112", "GB29 NWBK 6016 1331 9268 19", "AB-123", "ID-99887766"]
    rows = [(i, f"filler{i} please contact user{i}@example{i}.org today ok") for i in range(40)]
    rows += [(100 + k, f"you may please contact {form} today ok") for k, form in enumerate(forms)]
    rows += [(200, "the part AB-123 is sold out"), (201, "in march 2020 we had 5 people")]
    found = {r["doc_id"]: r for r in find_pii(make_docs(rows)).collect()}
    for k, form in enumerate(forms):
        assert found[100 + k]["spans"] == f"context:23:{23 + len(form)}", form
    assert found[200]["spans"] == "" and found[201]["spans"] == ""


def test_a_pattern_of_few_instances_says_nothing(make_docs):
    few = pii.LEAST_INSTANCES - 2
    rows = [(i, f"please contact user{i}@example.org today") for i in range(few)]
    rows += [(100, "please contact ID-99887766 today")]
    assert all(r["n_context"] == 0 for r in find_pii(make_docs(rows)).collect())


def test_what_is_found_leads_to_more(make_docs):
    """Identifiers found beside seeds make a second context sure, where there is no seed."""
    known = [f"AC-{100_000 + 7 * k}-{k}" for k in range(25)]
    rows = [(i, f"filler{i} call my number +1 (555) 010-{1000 + i:04d} right now") for i in range(300)]
    rows += [(1000 + k, f"filler call my number {known[k]} right now") for k in range(25)]
    rows += [(2000 + k, f"your account code {known[k]} was opened") for k in range(25)]
    rows += [(3000, "your account code ZX-998877-1 was opened"), (3001, "their parcel label ZY-998877-2 was shut")]
    found = {r["doc_id"]: r for r in find_pii(make_docs(rows)).collect()}
    assert all(found[1000 + k]["n_context"] == 1 and found[2000 + k]["n_context"] == 1 for k in range(25))
    assert found[3000]["spans"] == "context:18:29"
    assert found[3001]["n_context"] == 0


def graph_scores(edges: set[tuple[str, int, int]]) -> dict[int, float]:
    """The rounds over (pattern, instance, seed), one value at a time."""
    seeds = {i: float(max(s for _, j, s in edges if j == i)) for _, i, _ in edges}
    scores = dict(seeds)
    for _ in range(pii.ROUNDS):
        worth = {}
        for p in {p for p, _, _ in edges}:
            inside = [scores[i] for i in {i for q, i, _ in edges if q == p}]
            if len(inside) >= pii.LEAST_INSTANCES and sum(s >= pii.LEAST_SCORE for s in inside) >= pii.LEAST_INSTANCES:
                worth[p] = sum(inside) / len(inside)
        scores = {i: max([seeds[i], *(worth[p] for p, j, _ in edges if j == i and p in worth)]) for i in seeds}
    return scores


def test_scores_equal_brute_force(spark):
    rng = random.Random(12)
    edges = {(f"p{rng.randrange(14)}", i, int(i % 20 < 17 and i < 60)) for i in range(90) for _ in range(rng.randint(1, 3))}
    rows = [e for e in edges for _ in range(rng.randint(1, 3))]
    got = pii._scores(Scratch(spark), spark.createDataFrame(rows, "pattern string, instance long, seed int"))
    scores = {r["instance"]: r["score"] for r in got.collect()}
    expected = graph_scores(edges)
    assert scores.keys() == expected.keys() and all(abs(scores[i] - expected[i]) < 1e-9 for i in expected)
    assert any(0 < s < 1 for s in expected.values())
