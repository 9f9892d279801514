"""Secrets in texts: patterns, and a battery of randomness tests for what no pattern names.

Long runs of characters that encodings use are candidates; ``=`` ends a run, as padding or as
the sign between a name and its value. A run that mixes the symbols of base64 with those of
its variant for addresses is no string of either: its longest pieces that are one are tested
instead, and may overlap. The encoding is inferred (hex,
base32, base64), and under the hypothesis that its symbols are drawn at random three tests
are made: chi-squared of the symbol counts, the number of runs above and below the middle
of the alphabet, and the correlation of neighbours. The smallest p-value, times three, is the
candidate's; one below ``LEAST_RANDOM`` is no random string.

Short identifiers pass these tests too, as twenty symbols say little. So the error that is controlled is
that of the report: under the null hypothesis a candidate is an identifier, words of the corpus one after the other in
any case, with digits and separators. Pairs of letters in the corpus' own words give the probability of such a
string at least; the ratio of it to that of a random string of the encoding is a p-value (the mean of the inverse ratio over
identifiers is at most 1, so it is as small as p with probability p at most). It falls with each symbol of
a random string, so that power comes with length. The Benjamini-Hochberg procedure within bands of
length and encoding, over the candidates of all documents, then decides what is reported: at most
``FALSE_DISCOVERIES`` of what is reported in a band are identifiers, as far as these are like the words.
The procedure needs ranks only; they come from a histogram of p-values with a fixed number of
bins, so no sort of all candidates is needed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.llm.shared import Scratch, small
from lakeweave.llm.spans import apart, digest, matches, of_kind, replaced, row_key

KINDS = ("assign", "access", "hex")
FOUND = "random"
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
    r"[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"

LEAST_LENGTH = 20
# Padding belongs to a run only where no symbol follows it.
PADDING = r"(?:=++(?![A-Za-z0-9+/_-]))?+"
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{20,}}+{PADDING}"
PIECES = tuple(rf"(?<![{of}])[{of}]{{20,}}+{PADDING}" for of in ("A-Za-z0-9+/", "A-Za-z0-9_-"))
# Name, the strings it fits (padding aside) and its alphabet; the first that fits is taken.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("hex", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base64", "^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
FALSE_DISCOVERIES = 0.05
LEAST_RANDOM = 0.001
# Symbols of a word: letters in lower case, 0 for any digit, _ for the place between two words.
FOLDED = "abcdefghijklmnopqrstuvwxyz0_"
# A new word within an identifier: after a small letter, before the last of some capitals, at a separator.
NEW_WORD = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[+/_-]++"
# Share of pairs that follow no statistics, and probabilities of the case of a word and of a digit.
ANY_PAIR, OF_CASE, OF_DIGIT = 0.2, 0.25, 0.1
# Words are at least this frequent: what occurs once may be a random string itself.
LEAST_COUNT = 2
# Most bytes of spans sent to every executor.
BROADCAST_BYTES = 64_000_000
# Histogram of -log10(p): bins of 1/20 up to 20.
BINS_PER_UNIT, MOST_BINS = 20, 400


def base_spans(text: Column) -> Column:
    """Spans of the three patterns as (start, kind, end, value)."""
    marks = text.contains("=") | text.contains(":")
    assign = of_kind(
        matches(text, ASSIGN, marks), 0, lambda v: F.length(F.regexp_extract(v, ASSIGN, 2)) >= 6
    )
    access = of_kind(matches(text, ACCESS, text.contains("AKIA")), 1)
    hexes = of_kind(matches(text, HEX, F.lit(True)), 2)
    return F.concat(assign, access, hexes)


def _tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution, by its logistic approximation (error below 0.00015)."""
    return 1 / (1 + F.exp(F.least(1.5976 * z + 0.070565988 * z * z * z, F.lit(700.0))))


def battery(candidates: DataFrame) -> DataFrame:
    """Add ``encoding``, ``length`` and ``p`` of the run of symbols in ``value``.

    Strings that fit no encoding, or consist of digits only, are left out: they are no
    encoded secrets.
    """
    body = F.rtrim(F.col("value"), F.lit("="))
    fits = [(F.lit(name), F.lit(alphabet), F.col("body").rlike(p)) for name, p, alphabet in ENCODINGS]
    pick = lambda at: reduce(lambda rest, f: F.when(f[2], f[at]).otherwise(rest), reversed(fits), F.lit(None).cast("string"))
    rows = candidates.withColumn("body", body).where(
        (F.length("body") >= LEAST_LENGTH) & ~F.col("body").rlike("^[0-9]+$")
    )
    rows = rows.withColumns({"encoding": pick(0), "alphabet": pick(1), "length": F.length("body")}).where("encoding IS NOT NULL")
    symbols = F.transform(F.split("body", "(?!^)(?!$)", -1), lambda c: F.instr(F.col("alphabet"), c) - 1)
    rows = rows.withColumns({"x": symbols, "k": F.length("alphabet").cast("double"), "n": F.col("length").cast("double")})
    add = lambda a, b: a + b
    total = lambda xs: F.aggregate(xs, F.lit(0.0), add)
    present = F.array_distinct("x")
    squares = total(F.transform(present, lambda s: F.pow(F.size(F.filter("x", lambda x: x == s)).cast("double"), F.lit(2))))
    chi = F.col("k") / F.col("n") * squares - F.col("n")
    z_chi = (chi - (F.col("k") - 1)) / F.sqrt(2 * (F.col("k") - 1) * (F.col("n") - 1) / F.col("n"))
    ahead = F.slice("x", 2, F.greatest(F.col("length") - 1, F.lit(0)))
    here = F.slice("x", 1, F.greatest(F.col("length") - 1, F.lit(0)))
    half = F.col("k") / 2
    changes = total(F.zip_with(here, ahead, lambda a, b: F.when((a >= half) != (b >= half), 1.0).otherwise(0.0)))
    z_runs = (changes - (F.col("n") - 1) / 2) / F.sqrt((F.col("n") - 1) / 4)
    middle = (F.col("k") - 1) / 2
    products = total(F.zip_with(here, ahead, lambda a, b: (a - middle) * (b - middle)))
    z_serial = products / ((F.col("k") * F.col("k") - 1) / 12) / F.sqrt(F.col("n") - 1)
    tests = (_tail(z_chi), 2 * _tail(F.abs(z_runs)), 2 * _tail(F.abs(z_serial)))
    return rows.withColumn("p", F.least(3 * F.least(*tests), F.lit(1.0))).drop("body", "alphabet", "x", "k", "n")


def pieces(run: Column) -> Column:
    """What to test of a run (start, end, value): the whole if one encoding fits it, or its pieces."""
    value, start = run["value"], run["start"]
    found = F.concat(*[matches(value, pattern, F.lit(True)) for pattern in PIECES])
    moved = F.transform(
        found,
        lambda m: F.struct((start + m["start"]).alias("start"), (start + m["end"]).alias("end"), m["value"].alias("value")),
    )
    return F.when(value.rlike("[+/]") & value.rlike("[_-]"), moved).otherwise(F.array(run))


def _symbols(folded: Column) -> Column:
    """Places in ``FOLDED`` of all symbols of a string, a blank place at either end."""
    every = F.split(F.concat(F.lit("_"), folded, F.lit("_")), "(?!^)(?!$)", -1)
    return F.transform(every, lambda c: F.instr(F.lit(FOLDED), c) - 1)


def _fold(value: Column) -> Column:
    return F.translate(F.lower(value), "123456789", "000000000")


def pair_logs(docs: DataFrame) -> list[float]:
    """log10 of the probability of each symbol after each, by ``FOLDED``, in the words of all texts.

    A word of fewer than ``LEAST_LENGTH`` letters and digits weighs by the logarithm of its count, so that no copied text and
    no single word decides. There are as many groups as pairs of symbols.
    """
    k = len(FOLDED)
    words = docs.select(F.explode(F.split(F.lower(F.col("text")), "[^a-z0-9]+", -1)).alias("w"))
    words = words.where(F.length("w").between(1, LEAST_LENGTH - 1)).groupBy("w").count().where(F.col("count") >= LEAST_COUNT)
    x = words.select(_symbols(_fold(F.col("w"))).alias("x"), (1 + F.log2("count")).alias("c"))
    pairs = F.zip_with(F.slice("x", 1, F.size("x") - 1), F.slice("x", 2, F.size("x") - 1), lambda a, b: a * k + b)
    # Whole numbers add up alike in any order.
    total = F.sum(F.round(F.col("c") * 1000).cast("long"))
    found = x.select(F.explode(pairs).alias("pair"), "c").groupBy("pair").agg(total.alias("c")).collect()
    counts = [[500] * k for _ in range(k)]
    for r in found:
        counts[r["pair"] // k][r["pair"] % k] += r["c"]
    return [math.log10((1 - ANY_PAIR) * c / sum(row) + ANY_PAIR / k) for row in counts for c in row]


def with_null(tested: DataFrame, logs: Sequence[float]) -> DataFrame:
    """Add ``evidence``: -log10 of the p-value of the null hypothesis that ``value`` is an identifier."""
    k = len(FOLDED)
    body = F.rtrim(F.col("value"), F.lit("="))
    rows = tested.withColumn("x", _symbols(_fold(F.regexp_replace(body, NEW_WORD, "_"))))
    table = F.lit([float(v) for v in logs])
    pairs = F.zip_with(
        F.slice("x", 1, F.size("x") - 1), F.slice("x", 2, F.size("x") - 1), lambda a, b: F.get(table, a * k + b)
    )
    count = lambda symbol: F.size(F.filter("x", lambda s: s == FOLDED.index(symbol)))
    own = F.aggregate(pairs, F.lit(0.0), lambda a, b: a + b)
    own = own + math.log10(OF_CASE) * (count("_") - 1) + math.log10(OF_DIGIT) * count("0")
    sizes = {name: len(alphabet) for name, _, alphabet in ENCODINGS}
    size = reduce(lambda rest, e: F.when(F.col("encoding") == e[0], math.log10(e[1])).otherwise(rest), sizes.items(), F.lit(0.0))
    return rows.withColumn("evidence", F.greatest(-own - size * F.col("length"), F.lit(0.0))).drop("x")


def reported(tested: DataFrame) -> DataFrame:
    """(band, cut): bins from ``cut`` on are no identifiers, by Benjamini-Hochberg within the band."""
    counts = tested.groupBy("band", "bin").agg(F.count("*").alias("c"))
    up = Window.partitionBy("band").orderBy(F.desc("bin"))
    ranked = counts.withColumns({"rank": F.sum("c").over(up), "m": F.sum("c").over(Window.partitionBy("band"))})
    # The largest p of a bin is that of its lower edge.
    passes = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_UNIT) <= F.col("rank") / F.col("m") * FALSE_DISCOVERIES
    return ranked.where(passes).groupBy("band").agg(F.min("bin").alias("cut"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random, row_key.

    ``docs`` has ``doc_id`` and ``text``; other columns are not read. Null counts as an empty
    text, which has no spans. Rows come back as often as they went in, whatever their id (null
    too); an empty table gives no rows. Random runs that overlap a base span are not listed
    again. Texts with the same id and text share their result.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        row_key(F.col("doc_id"), F.col("text")).alias("row_key"),
        base_spans(text).alias("base"),
        matches(text, CANDIDATE, F.lit(True)).alias("runs"),
    )
    candidates = apart(F.flatten(F.transform("runs", pieces)), F.col("base"))
    rows = scratch.save(rows.select("doc_id", "row_key", "base", candidates.alias("candidates")), "spans")
    each = rows.where(F.size("candidates") > 0).select("row_key", F.explode("candidates").alias("c"))
    each = scratch.save(battery(each.select("row_key", "c.*").distinct()), "battery")
    none = [0.0] * len(FOLDED) ** 2
    tested = with_null(each, none if each.isEmpty() else pair_logs(docs))
    # Bands of length: powers of the square root of two, so that strings of like power are compared.
    band = F.concat_ws(":", "encoding", F.floor(2 * F.log2("length")).cast("string"))
    level = F.least(F.floor(F.col("evidence") * BINS_PER_UNIT), F.lit(MOST_BINS)).cast("int")
    level = F.when(F.col("p") < LEAST_RANDOM, 0).otherwise(level)
    tested = scratch.save(tested.withColumns({"band": band, "bin": level}), "tested")
    cuts = reported(tested)  # at most one row per band, and there are some hundred bands
    random = tested.join(F.broadcast(cuts), "band").where("bin >= cut")
    return digest(rows.select("doc_id", "row_key", "base"), random.select("row_key", "start", "end"), KINDS, FOUND)


def redact(docs: DataFrame, found: DataFrame, mark: str = "[SECRET]", length: str = "n_chars") -> DataFrame:
    """``docs`` with every span of ``find_secrets`` replaced; rows without spans are as they were.

    Overlapping spans are replaced by one mark. The column ``length``, if there is one, gets the
    length of a text that changed. Other columns stay.
    """
    hits = found.where("spans <> ''").select("row_key", "spans").distinct()
    at = lambda s, k: F.get(F.split(s, ":"), F.lit(k)).cast("int")
    spans = F.transform(F.split("__spans", ","), lambda s: F.struct(at(s, 1).alias("start"), at(s, 2).alias("end")))
    size = hits.agg(F.sum(F.octet_length("spans"))).first()[0] or 0
    hits = hits.withColumnRenamed("row_key", "__key").withColumnRenamed("spans", "__spans")
    keyed = docs.withColumn("__key", row_key(F.col("doc_id"), F.col("text")))
    joined = keyed.join(F.broadcast(hits) if size <= BROADCAST_BYTES and small(hits) else hits, "__key", "left")
    out = joined.withColumn("__clean", F.when(F.col("__spans").isNotNull(), replaced(F.col("text"), spans, mark)))
    if length in docs.columns:
        changed = F.length("__clean").cast(docs.schema[length].dataType)
        out = out.withColumn(length, F.coalesce(changed, F.col(length)))
    return out.withColumn("text", F.coalesce("__clean", "text")).select(*docs.columns)
