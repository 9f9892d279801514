from __future__ import annotations

from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lakeweave.functions import band, iso_date, is_bad_date, typed_dates
from lakeweave.operators import distinct_rows, rank_readings
from tests.conftest import rows

BAND_EDGES = [
    (None, "C"),
    (float("nan"), "C"),
    (float("inf"), "C"),
    (float("-inf"), "A"),
    (-5.0, "A"),
    (0.0, "A"),
    (-0.0, "A"),
    (20.0, "A"),
    (20.4, "B"),
    (20.999, "B"),
    (21.0, "B"),
    (50.0, "B"),
    (50.0000001, "C"),
]


def test_band_edges(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(BAND_EDGES)], "i int, value double")
    got = {row["i"]: row["ranking"] for row in rank_readings(df).collect()}
    assert got == {i: label for i, (_, label) in enumerate(BAND_EDGES)}


def test_bands_are_data(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (9.0,), (99.0,)], "v double")
    bounds = [(1, "low"), (5, "mid"), (10, "high")]
    got = [row[0] for row in df.select(band("v", bounds, "off")).collect()]
    assert got == ["low", "mid", "high", "off"]


@pytest.mark.parametrize("bounds", [[], [(2, "x"), (1, "y")], [(1, "x"), (1, "y")]])
def test_bands_must_ascend(bounds):
    with pytest.raises(ValueError):
        band("v", bounds)


def test_distinct_treats_null_and_signed_zero_as_equal(spark):
    df = spark.createDataFrame(
        [(1, 0.0), (1, -0.0), (1, None), (1, None), (1, float("nan")), (1, float("nan")), (2, 0.0)],
        "id int, value double",
    )
    assert distinct_rows(df).count() == 4


DATES = [
    ("2024-06-01", date(2024, 6, 1)),
    ("2024-02-30", None),
    ("2024-6-1", None),
    ("01.06.2024", None),
    ("2024-06-01T00:00", None),
    (" 2024-06-01", None),
    ("", None),
]


def test_iso_dates(spark):
    df = spark.createDataFrame([(s,) for s, _ in DATES] + [(None,)], "s string")
    got = df.select("s", iso_date("s").alias("d"), is_bad_date("s").alias("bad")).collect()
    assert {row["s"]: row["d"] for row in got} == {**dict(DATES), None: None}
    assert {row["s"] for row in got if row["bad"]} == {s for s, d in DATES if d is None}


def test_typed_dates_refuse_what_they_cannot_read(spark):
    good = spark.createDataFrame([("2024-06-01",), (None,)], "s string")
    assert rows(typed_dates(good, "s")) == [(None,), (date(2024, 6, 1),)]
    bad = spark.createDataFrame([("june",)], "s string")
    with pytest.raises(PySparkException, match="not an ISO date"):
        typed_dates(bad, "s").agg(F.max("s")).collect()
