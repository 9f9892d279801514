"""Sensor readings: distinct rows and their band."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from lakeweave.functions.banding import SENSOR_BANDS, SENSOR_DEFAULT_BAND, band


def distinct_rows(df: DataFrame) -> DataFrame:
    """Each different row once.

    NULL equals NULL and -0.0 equals 0.0. Copies are dropped in the map tasks before the
    shuffle, so a row repeated millions of times is no hot spot.
    """
    return df.dropDuplicates()


def rank_readings(
    df: DataFrame,
    bounds: Sequence[tuple[float, str]] = SENSOR_BANDS,
    default: str = SENSOR_DEFAULT_BAND,
) -> DataFrame:
    """Add ``ranking``, the band of ``value``."""
    return df.withColumn("ranking", band("value", bounds, default))
