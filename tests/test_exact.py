"""Sums of doubles do not depend on the order, and lose no more than one rounding at the end."""

from __future__ import annotations

import math
import random
import struct
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lakeweave.functions.exact import exact_sums, folded, sum_bin, sum_parts


def bits(x: float) -> int:
    return struct.unpack("<q", struct.pack("<d", x))[0]


def values() -> dict[str, list[float]]:
    rng = random.Random(4)
    out = {
        "prices": [rng.randint(1, 50) * (rng.randint(100, 10**7) / 100 / 7) for _ in range(3000)],
        "cancelling": [x * s for x in (rng.uniform(0, 1) * 10 ** rng.randint(-30, 30) for _ in range(500)) for s in (1, -1)] + [0.1],
        "wide": [rng.uniform(-1, 1) * 2.0 ** rng.randint(-900, 900) for _ in range(500)],
        "borders": [s * 2.0 ** (8 * k + d) * f for k in range(-20, 20) for d in (-1, 0, 1) for f in (1, 1 - 2**-53, 1 + 2**-52) for s in (1, -1, 1)],
        "zeros": [0.0, -0.0, 0.0],
        "large": [1.7e308, -1.6e308, 1e292],
        "tiny": [5e-324] * 1000,
        "one": [0.1],
    }
    return out


@pytest.fixture(scope="module")
def numbers(spark):
    rows = [(k, v) for k, vs in values().items() for v in vs] + [("prices", None), ("none", None)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "k string, v double")


def totals(df):
    return {r["k"]: r["total"] for r in exact_sums(df, ["k"], "v", "total").collect()}


def test_sums_are_right_to_a_rounding(numbers):
    got = totals(numbers)
    assert got.pop("none") is None and got.pop("tiny") == 0.0  # below the lowest unit
    for k, total in got.items():
        exact = math.fsum(values()[k])
        size = max(map(abs, values()[k]))
        # One rounding for each bin that takes part, the largest first.
        assert total == exact or abs(Fraction(total) - Fraction(exact)) <= Fraction(math.ulp(exact)) * 4 or abs(total - exact) < size * 2**-52, k
    assert got["cancelling"] == 0.1 and got["one"] == 0.1


def test_any_partitioning_gives_the_same_bits(numbers):
    expected = {k: None if v is None else bits(v) for k, v in totals(numbers).items()}
    for df in (numbers.repartition(1), numbers.repartition(13), numbers.orderBy("v"), numbers.orderBy(F.desc("v"))):
        assert {k: None if v is None else bits(v) for k, v in totals(df).items()} == expected


def test_partial_sums_merge_in_any_grouping(spark, numbers):
    expected = totals(numbers)
    split = numbers.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(7)))
    parts = split.groupBy("k", "part", sum_bin("v").alias("b")).agg(sum_parts("v").alias("p"))
    merged = parts.groupBy("k", "b").agg(F.sum("p").cast("decimal(38,0)").alias("p")).groupBy("k").agg(folded("b", "p").alias("total"))
    assert {r["k"]: r["total"] for r in merged.collect()} == expected
    # Bins that come in several rows are added up first.
    unmerged = parts.groupBy("k").agg(folded("b", "p").alias("total"))
    assert {r["k"]: r["total"] for r in unmerged.collect()} == expected


def test_infinities_and_nan(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("plus", [1.0, inf]), ("minus", [-inf, 1e300]), ("both", [inf, -inf]), ("nan", [1.0, nan])]
    df = spark.createDataFrame([(k, v) for k, vs in rows for v in vs], "k string, v double")
    got = totals(df)
    assert got["plus"] == inf and got["minus"] == -inf and math.isnan(got["both"]) and math.isnan(got["nan"])


def test_a_hot_key_is_reduced_before_the_shuffle(numbers, capsys):
    capsys.readouterr()
    exact_sums(numbers, ["k"], "v", "total").explain("formatted")
    plan = capsys.readouterr().out
    assert "partial_sum" in plan and "EvalPython" not in plan
