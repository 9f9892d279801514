"""Personal data in texts: patterns, and identifiers bootstrapped from their contexts.

Matches of the base patterns are seeds. The words around a seed are lexical patterns (the two
words before it; the word before and the word after). Tokens that look like identifiers but
match no base pattern are candidates; they share patterns with seeds or not. Patterns and
instances form a graph that is scored in rounds: a pattern is worth the mean score of the
different instances it occurs with, an instance the score of its best pattern, and seeds are
worth 1. Candidates that good patterns score highly are promoted and support further patterns
in the next round.

The graph is two tables; a round is two joins and two aggregates, reduced in the map tasks. A
pattern of very common words meets very many instances: the join by pattern is split, and
its mean is low, so it promotes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.llm.shared import Scratch
from lakeweave.llm.spans import apart, cut, digest, let, matches, of_kind, parts, row_key
from lakeweave.llm.words import lower_ascii

KINDS = ("email", "ip", "card", "phone")
FOUND = "context"
# A match begins where the one before ended or where its first run of characters does.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_VALID = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# A token without blanks that holds a digit or an at sign.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
# Tokens with digits in a row, joined by blanks as phones, cards and account numbers are; one group
# of capitals may lie between two of them. A longer row than 16 is cut: it is a table of numbers.
GROUP = r"[^\x20\x09-\x0D0-9@]*+[0-9][^\x20\x09-\x0D@]*+(?![^\x20\x09-\x0D])"
RUN = rf"(?<![^\x20\x09-\x0D]){GROUP}(?:(?<=[A-Za-z0-9)/-])\x20++(?:[A-Z]{{1,4}}\x20++)?{GROUP}){{1,15}}+"
# Shorter numbers stand for different things in different places: they count by place.
LEAST_DIGITS = 6
# Code points looked at on either side of a span for its context.
CONTEXT = 80
ROUNDS = 3
LEAST_INSTANCES = 3
LEAST_SCORE = 0.9


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), "(?!^)(?!$)", -1), lambda c: c.cast("int"))
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    weighted = F.transform(each, lambda d, i: F.when(i % 2 == 1, double(d)).otherwise(d))
    return F.aggregate(weighted, F.lit(0), lambda a, b: a + b) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the four patterns as (start, kind, end, value)."""
    count = lambda v: F.length(_digits(v))
    email = of_kind(matches(text, EMAIL, text.contains("@")), 0)
    ip = of_kind(matches(text, IP, text.rlike(r"[0-9]\.[0-9]")), 1, lambda v: v.rlike(IP_VALID))
    card = of_kind(
        matches(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")), 2, lambda v: F.when(count(v).between(12, 19), luhn(_digits(v))).otherwise(False)
    )
    phone = of_kind(matches(text, PHONE, text.contains("+")), 3, lambda v: count(v).between(9, 15))
    return F.concat(email, ip, card, phone)


def _contexts(of: Column, size: Column, start: Column, end: Column) -> Column:
    """Lexical patterns around a span of a text in parts; fewer where the text has fewer words there.

    A word that does not lie whole within ``CONTEXT`` code points of the span is part of no pattern.
    """
    blank = r"[\x20\x09-\x0D]+"
    low, high = F.greatest(start - CONTEXT, F.lit(0)), F.least(end + CONTEXT, size)

    def patterns(left: Column, right: Column) -> Column:
        # The last of the left is beside the span, the first may be the end of a longer word.
        word = lambda back: F.when(F.size(left) - back >= F.when(low > 0, 1).otherwise(0), F.get(left, F.size(left) - back))
        whole = (F.size(right) > 2) | ((F.size(right) == 2) & (high == size))
        two, one, after = word(3), word(2), F.when(whole, F.get(right, F.lit(1)))
        return F.array(
            F.when((two != "") & (one != ""), F.concat_ws(" ", F.lit("before"), two, one)),
            F.when((one != "") & (after != ""), F.concat_ws(" ", F.lit("around"), one, after)),
        )

    words = lambda a, b: F.split(lower_ascii(cut(of, a, b)), blank, -1)
    found = let(words(low, start), lambda left: let(words(end, high), lambda right: patterns(left, right)))
    return F.filter(found, lambda p: p.isNotNull())


def _scores(scratch: Scratch, graph: DataFrame) -> DataFrame:
    """(instance, score) after some rounds over (pattern, instance, seed).

    A pattern is worth the mean score of its instances, and an instance as much as its best pattern; seeds are worth 1. A
    pattern counts once ``LEAST_INSTANCES`` of its instances are sure, seeds or promoted in a round before, so that what is found
    in one context leads to others. Worth falls with each step away from the seeds, as unknown instances lower the mean.
    """
    edges = scratch.save(
        graph.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "graph"
    )
    seeds = scratch.save(edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score")), "seeds")
    scores = seeds
    for _ in range(ROUNDS):
        sure = F.count_if(F.col("score") >= LEAST_SCORE)
        worth = edges.join(scores, "instance").groupBy("pattern").agg(
            F.avg("score").alias("worth"), F.count("*").alias("n"), sure.alias("sure")
        )
        # Patterns with few instances, or without several sure ones among them, say nothing.
        worth = worth.where((F.col("n") >= LEAST_INSTANCES) & (F.col("sure") >= LEAST_INSTANCES)).select("pattern", "worth")
        # Written down, so that the join with a hot pattern's rows can be split.
        worth = scratch.save(worth, "worth")
        best = edges.join(worth, "pattern").groupBy("instance").agg(F.max("worth").alias("worth"))
        scores = (
            seeds.join(best, "instance", "left")
            .select("instance", F.greatest("score", F.coalesce("worth", F.lit(0.0))).alias("score"))
        )
        scores = scratch.save(scores, "scores")
    return scores


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context,
    row_key.

    ``docs`` has ``doc_id`` and ``text``; other columns are not read. Null counts as an empty
    text, which has no spans. Rows come back as often as they went in, whatever their id (null
    too); an empty table gives no rows. Candidates are tokens with a digit or an at sign, and
    runs of tokens with digits joined by blanks, that overlap no base span; of spans that lie in
    each other the longest is listed. One with fewer than ``LEAST_DIGITS`` digits and no at sign is
    an instance of its own in every context. Texts with the same id and text share their result.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    # A run has a blank and a token has none: no span is in both.
    tokens = F.concat(matches(text, RUN, text.rlike("[0-9]")), matches(text, TOKEN, F.lit(True)))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        row_key(F.col("doc_id"), F.col("text")).alias("row_key"),
        text.alias("text"),
        base_spans(text).alias("base"),
        tokens.alias("tokens"),
    )

    def place(s: Column, seed: int, of: Column, size: Column) -> Column:
        lasting = F.lit(seed == 1) | s["value"].contains("@") | (F.length(_digits(s["value"])) >= LEAST_DIGITS)
        value = F.lower(s["value"])
        return let(
            _contexts(of, size, s["start"], s["end"]),
            lambda patterns: F.struct(
                s["start"].alias("start"),
                s["end"].alias("end"),
                F.when(lasting, F.xxhash64(value)).otherwise(F.xxhash64(value, patterns)).alias("instance"),
                F.lit(seed).alias("seed"),
                patterns.alias("patterns"),
            ),
        )

    def places(of: Column, size: Column) -> Column:
        free = apart(F.col("tokens"), F.col("base"))
        return F.concat(F.transform("base", lambda s: place(s, 1, of, size)), F.transform(free, lambda t: place(t, 0, of, size)))

    every = let(parts(F.col("text")), lambda of: let(F.length("text"), lambda size: places(of, size)))
    rows = scratch.save(rows.select("doc_id", "row_key", "base", every.alias("places")), "spans")
    found = rows.where(F.size("places") > 0).select("row_key", F.explode("places").alias("p")).select("row_key", "p.*")
    graph = found.select(F.explode("patterns").alias("pattern"), "instance", "seed")
    scores = _scores(scratch, graph).where(F.col("score") >= LEAST_SCORE)
    extra = found.where("seed = 0").join(scores, "instance").select("row_key", "start", "end").distinct()
    # Spans lie in each other or apart: one is within another if an earlier or equal start ends no sooner.
    before = Window.partitionBy("row_key").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    extra = extra.withColumn("upto", F.max("end").over(before)).where("upto IS NULL OR end > upto").drop("upto")
    return digest(rows.select("doc_id", "row_key", "base"), extra, KINDS, FOUND)
