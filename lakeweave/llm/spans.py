"""Where a pattern matches in a text, as Spark columns, and the digest of such places."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lengths are added up and spans compared in blocks of this many, so that a text with very many matches
# costs about this many steps for each and not one for each pair.
BLOCK = 256
# Code points in a part of a text.
PART = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` or a lambda in it uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, zero: int, merge: Callable[[Column, Column], Column]) -> Column:
    """All ``values`` (computed once, as by ``let``) before each of them in one, by ``merge``; ``zero`` changes nothing."""
    total = lambda part: F.aggregate(part, F.lit(zero), merge)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")),
        lambda b: total(F.slice(values, b * BLOCK + 1, BLOCK)),
    )
    before = let(blocks, lambda sums: F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b))))
    return let(
        before,
        lambda sums: F.transform(
            values,
            lambda _, i: merge(
                F.get(sums, F.floor(i / BLOCK).cast("int")), total(F.slice(values, i - i % BLOCK + 1, (i % BLOCK).cast("int")))
            ),
        ),
    )


def parts(text: Column) -> Column:
    """The text in parts of ``PART`` code points, to ``cut`` places out of it without counting from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}+"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` of a text in ``parts``; empty if there are none."""
    first, last = (start / PART).cast("int"), ((end - 1) / PART).cast("int")
    around = F.array_join(F.slice(parts, first + 1, last - first + 1), "")
    return F.when(end > start, F.substring(around, start - first * PART + 1, end - start)).otherwise("")


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """The text with every span (start, end) replaced; spans that overlap share one mark."""

    def body(of: Column, ordered: Column, ends: Column) -> Column:
        upto = _running(ends, 0, lambda a, b: F.greatest(a, b))
        pieces = F.zip_with(
            ordered, upto, lambda s, at: F.when(s["start"] >= at, F.concat(cut(of, at, s["start"]), F.lit(mark))).otherwise("")
        )
        return F.concat(F.array_join(pieces, ""), cut(of, F.array_max(ends), F.length(text)))

    with_ends = lambda of, ordered: let(F.transform(ordered, lambda s: s["end"]), lambda ends: body(of, ordered, ends))
    found = let(parts(text), lambda of: let(F.array_sort(spans), lambda ordered: with_ends(of, ordered)))
    return F.when(F.size(spans) > 0, found).otherwise(text)


def apart(found: Column, taken: Column) -> Column:
    """The spans of ``found`` that overlap none of ``taken``.

    Taken spans lie in blocks by their start; a span looks at all blocks and into those that it meets.
    """
    plain = F.array_sort(F.transform(taken, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def blocks(ordered: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor((F.size(ordered) - 1) / BLOCK).cast("int"))
        inside = F.transform(cuts, lambda b: F.slice(ordered, b * BLOCK + 1, BLOCK))
        return F.transform(
            inside,
            lambda part: F.struct(
                F.get(part, F.lit(0))["start"].alias("start"),
                F.array_max(F.transform(part, lambda s: s["end"])).alias("end"),
                part.alias("inside"),
            ),
        )

    meet = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    free = lambda f, heads: ~F.exists(heads, lambda h: meet(h, f) & F.exists(h["inside"], lambda s: meet(s, f)))
    kept = let(let(plain, blocks), lambda heads: F.filter(found, lambda f: free(f, heads)))
    return F.when(F.size(taken) > 0, kept).otherwise(found)


def _placed(gaps: Column, values: Column) -> Column:
    """(start, end, value) of matches, given what lies before each of them."""
    steps = F.zip_with(gaps, values, lambda gap, v: F.length(gap) + F.length(v))
    ends = let(steps, lambda lengths: F.zip_with(_running(lengths, 0, lambda a, b: a + b), lengths, lambda at, n: at + n))
    return F.zip_with(
        ends,
        values,
        lambda end, v: F.struct(
            (end - F.length(v)).cast("int").alias("start"), end.cast("int").alias("end"), v.alias("value")
        ),
    )


def matches(text: Column, pattern: str, gate: Column) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, value) in code points, end exclusive.

    ``gate`` is a cheap condition that every text with a match meets.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    found = let(values, lambda v: let(F.slice(gaps, F.lit(1), F.size(v)), lambda g: _placed(g, v)))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(gate & text.rlike(pattern), found).otherwise(none)


def of_kind(found: Column, kind: int, valid: Callable[[Column], Column] | None = None) -> Column:
    """Matches that are valid, as (start, kind, end, value)."""
    if valid is not None:
        found = F.filter(found, lambda m: valid(m["value"]))
    return F.transform(
        found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["value"].alias("value"))
    )


def joined(spans: Column, kinds: Sequence[str]) -> Column:
    """``kind:start:end`` of all spans by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    plain = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.array_join(
        F.transform(F.array_sort(plain), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def row_key(doc_id: Column, text: Column) -> Column:
    """Rows with the same id and text share a key; their results are the same."""
    return F.xxhash64(doc_id, text)


def digest(rows: DataFrame, extra: DataFrame, kinds: Sequence[str], found: str) -> DataFrame:
    """Result rows from ``rows`` (doc_id, row_key, base) and ``extra`` (row_key, start, end).

    Base kinds are counted and hashed on their own; the spans the method added have the kind
    ``found`` and are listed with the others. ``row_key`` stays, to find the rows again.
    """
    added = F.struct(
        F.col("start").cast("int").alias("start"), F.lit(len(kinds)).alias("kind"), F.col("end").cast("int").alias("end")
    )
    extra = extra.distinct().groupBy("row_key").agg(F.collect_list(added).alias("added"))
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    every = F.concat(base, F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{name}") for kind, name in enumerate(kinds)]
    return rows.join(extra, "row_key", "left").select(
        "doc_id",
        *counts,
        F.sha2(joined(F.col("base"), kinds).cast("binary"), 256).alias("base_sha256"),
        joined(every, [*kinds, found]).alias("spans"),
        F.size(F.coalesce("added", F.array())).cast("long").alias(f"n_{found}"),
        "row_key",
    )
