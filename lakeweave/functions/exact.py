"""Sums of doubles that do not depend on the order of the rows.

A double is an integer of 53 bits times a power of two. Values of about the same size go into one bin of
exponents, where they are whole multiples of one unit, and are added up as integers, without rounding. What the
bins add up to is rounded once, from the largest bin to the smallest. Partial sums can be added in any order and
kept in tables: rows of (keys, bin, part), added up by key and bin.

    parts = rows.groupBy("k", sum_bin("x").alias("bin")).agg(sum_parts("x").alias("part"))
    parts.groupBy("k").agg(folded("bin", "part").alias("total"))
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Exponents to a bin. A value, its 52 further bits and two bits to spare fit a BIGINT.
WIDTH = 8
# Smaller values share the lowest bin and are rounded to its unit of 2**-974.
LOWEST = -115
# Bins of what is no number on the line.
NAN, PLUS, MINUS = 1000, 1001, 1002
# Room for as many rows as a table can have.
PART = "decimal(28,0)"
TOTAL = "decimal(38,0)"


def _unit(b: Column) -> Column:
    """How many units of its bin make 1."""
    return F.pow(F.lit(2.0), (54 - WIDTH * b).cast("double"))


def sum_bin(value: str | Column) -> Column:
    """The bin of a double; NULL without a value."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    size = F.abs(v)
    rough = F.floor(F.log2(F.when((size > 0) & (size < float("inf")), size)) / WIDTH).cast("int")
    # A logarithm may be off next to a power of two.
    low = F.pow(F.lit(2.0), (WIDTH * rough).cast("double"))
    b = rough - (size < low).cast("int") + (size / F.lit(float(2**WIDTH)) >= low).cast("int")
    special = F.when(F.isnan(v), NAN).when(v == float("inf"), PLUS).when(v == float("-inf"), MINUS)
    return F.when(v.isNotNull(), F.coalesce(special, F.when(v == 0, LOWEST), F.greatest(b, F.lit(LOWEST))))


def sum_part(value: str | Column) -> Column:
    """The value as a whole number of its bin's units."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    b = sum_bin(v)
    return F.when(b < NAN, F.rint(v * _unit(b)).cast("bigint").cast(PART)).when(b.isNotNull(), F.lit(0).cast(PART))


def sum_parts(value: str | Column) -> Column:
    """Aggregate: the sum of a bin."""
    return F.sum(sum_part(value)).cast(TOTAL)


def folded(b: str, part: str) -> Column:
    """Aggregate over the bins of a key: their sum as a double; NULL without any value.

    There are at most 244 bins. A bin may come in several rows, which are added up exactly first. NaN, and
    infinities of both signs, make NaN.
    """
    pairs = F.collect_list(F.when(F.col(b).isNotNull() & F.col(part).isNotNull(), F.struct(F.col(b).alias("b"), F.col(part).cast(TOTAL).alias("p"))))
    found = lambda kind: F.exists(pairs, lambda x: x["b"] == kind)
    bins = F.reverse(F.array_sort(F.array_distinct(F.transform(F.filter(pairs, lambda x: x["b"] < NAN), lambda x: x["b"]))))
    of_bin = lambda b: F.aggregate(
        pairs, F.lit(0).cast(TOTAL), lambda a, x: (a + F.when(x["b"] == b, x["p"]).otherwise(F.lit(0).cast(TOTAL))).cast(TOTAL)
    )
    total = F.aggregate(bins, F.lit(0.0), lambda a, b: a + of_bin(b).cast("double") / _unit(b))
    special = (
        F.when(found(NAN) | (found(PLUS) & found(MINUS)), F.lit(float("nan")))
        .when(found(PLUS), F.lit(float("inf")))
        .when(found(MINUS), F.lit(float("-inf")))
    )
    return F.when(F.size(pairs) > 0, F.coalesce(special, total))


def exact_sums(df: DataFrame, keys: list[str], value: str | Column, name: str) -> DataFrame:
    """The sum of a double by key, equal to the last bit however the rows are spread and ordered.

    Two aggregations: by key and bin, which reduces hot keys in the map tasks, then over the few bins of a key.
    """
    v = F.col(value) if isinstance(value, str) else value
    parts = df.groupBy(*keys, sum_bin(v).alias("sum_bin")).agg(sum_parts(v).alias("sum_part"))
    return parts.groupBy(*keys).agg(folded("sum_bin", "sum_part").alias(name))
