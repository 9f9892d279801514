import random

import zstandard

from lakeweave.llm.quality_rules import BAD_CHUNKS, CHUNK, LEVEL, band_of, chunks, keep_good, learn_limits, outside, quality_rules

from . import brute
from .conftest import sentence

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts_equal_brute_force(make_docs, corpus):
    texts = corpus | {
        1: "a b c\na b c\n\n \na b c \nx#*$%&|<>",
        2: "\n".join(["one line"] * 4 + [""] * 3),
        3: "é ü\né ü\n" * 3,
        4: "a b a b a b a",
    }
    for r in quality_rules(make_docs(texts.items())).collect():
        expected = brute.quality(texts[r["doc_id"]])
        assert tuple(r[c] for c in COUNTS) == expected, r["doc_id"]
        n, repeat = expected[0], expected[4]
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert r["kept"] == (not r["base_failed"] and not r["bands_failed"])


def test_bands_reject_repetitive_and_incompressible_texts(make_docs):
    rng = random.Random(1)
    prose = sentence(rng, 600)
    # Every 3-word window differs, yet the text is one word in little variation.
    dull = " ".join(f"{'na' * 40}{i % 97}{i % 89}" for i in range(600))
    noise = " ".join("".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(8)) for _ in range(200))
    rows = {r["doc_id"]: r for r in quality_rules(make_docs([(1, prose), (2, dull), (3, noise)])).collect()}
    assert rows[1]["kept"]
    assert not rows[2]["base_failed"] and rows[2]["bands_failed"] and not rows[2]["kept"]
    assert not rows[3]["base_failed"] and rows[3]["bands_failed"]


def test_limits_depend_on_the_length():
    bands = ((0, 0.0, 9.0), (100, 0.2, 0.8))
    assert not outside(0, 0, bands) and not outside(99, 99, bands)
    assert outside(100, 19, bands) and not outside(100, 20, bands) and outside(100, 81, bands)


def test_edge_rows_and_filter(make_docs, edge_rows, corpus):
    docs = make_docs(edge_rows)
    assert quality_rules(docs).count() == len(edge_rows)
    assert quality_rules(make_docs([])).collect() == [] and keep_good(make_docs([])).collect() == []
    docs = make_docs([*edge_rows, *corpus.items()])
    kept = keep_good(docs)
    assert kept.schema == docs.schema
    expected = quality_rules(docs).where("kept").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in expected)


def test_limits_follow_the_documents(make_docs):
    """Texts and chunks that the outer limits allow, but that are unlike all others of their length."""
    rng = random.Random(7)
    prose = {i: sentence(rng, 58, 100_000) for i in range(80)}
    long = {100 + i: sentence(rng, 3000, 100_000) for i in range(60)}
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    noise = " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(60))
    dull = " ".join(rng.choice(["na", "no"]) + rng.choice(["nana", "nono"]) for _ in range(60))
    # A quarter of its chunks are dull, fewer than half.
    part = " ".join(f"{'na' * 40}{i % 97}{i % 89}" for i in range(50))
    mixed = long[100][: 3 * CHUNK] + " " + part[:CHUNK] + " " + long[101][: 3 * CHUNK]
    docs = make_docs([*prose.items(), *long.items(), (200, noise), (201, dull), (202, mixed)])
    assert {(False, 8), (True, 12)} <= learn_limits(docs).learned.keys()
    found = {r["doc_id"]: r for r in quality_rules(docs).collect()}
    assert not [found[i] for i in [*prose, *long] if not found[i]["kept"]]
    assert found[200]["n_bytes"] < 512 and found[200]["bands_failed"]
    assert found[201]["n_bytes"] < 512 and found[201]["bands_failed"]
    assert found[202]["n_bad_chunks"] >= 1 and found[202]["bands_failed"]


def test_copies_of_one_text_do_not_set_the_limits(make_docs):
    rng = random.Random(9)
    prose = {i: sentence(rng, 58, 100_000) for i in range(80)}
    alone = learn_limits(make_docs(prose.items()))
    assert learn_limits(make_docs([*prose.items(), *((1000 + i, prose[0]) for i in range(500))])) == alone


def test_a_short_rest_joins_the_chunk_before_it():
    for size in (0, 1, CHUNK, CHUNK + 1, CHUNK + CHUNK // 2 - 1):
        assert chunks(b"x" * size) == []
    for size in (CHUNK + CHUNK // 2, 2 * CHUNK, 2 * CHUNK + 1, 9 * CHUNK + 2000, 9 * CHUNK + 3000):
        parts = chunks(bytes(k % 251 for k in range(size)))
        assert b"".join(parts) == bytes(k % 251 for k in range(size))
        assert {len(p) for p in parts[:-1]} == {CHUNK} and CHUNK / 2 <= len(parts[-1]) < 1.5 * CHUNK


def test_the_last_bytes_of_a_text_do_not_decide(make_docs):
    """Prose cut a few bytes beyond a chunk gets the verdict of the chunk."""
    rng = random.Random(3)
    texts = {1000 * i + k: sentence(rng, 2200, 100_000).encode()[: n * CHUNK + k].decode() for i, n in enumerate((1, 2, 3) * 3) for k in range(0, 65, 4)}
    rows = quality_rules(make_docs(texts.items())).collect()
    assert len(rows) == len(texts) and all(r["kept"] and r["n_bad_chunks"] == 0 for r in rows)


def test_verdicts_equal_brute_force(make_docs, corpus):
    rng = random.Random(11)
    texts = dict(enumerate([*corpus.values(), *(sentence(rng, rng.randint(50, 4000), 9000) for _ in range(120))]))
    texts |= {5000 + i: t[:2000] + "ab" * rng.randint(0, 3000) + t[2000:] for i, t in enumerate(map(texts.get, range(240, 290))) if t}
    docs = make_docs(texts.items())
    limits = learn_limits(docs)

    def broken(part: bytes, chunk: bool) -> bool:
        share = len(zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False).compress(part)) / len(part)
        low, high = limits.learned.get((chunk, band_of(len(part))), (0, 99))
        outer = [b for b in limits.outer if b[0] <= len(part)][-1]
        return not (low <= share <= high and outer[1] <= share <= outer[2])

    rejected = 0
    for r in quality_rules(docs).collect():
        data = (texts[r["doc_id"]] or "").encode()
        bad = [p for p in chunks(data) if broken(p, True)]
        failed = bool(data) and (broken(data, False) or sum(map(len, bad)) > BAD_CHUNKS * len(data))
        assert (r["n_bad_chunks"], r["bands_failed"]) == (len(bad), failed)
        rejected += failed
    assert limits.learned and rejected
