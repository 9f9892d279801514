"""ISO-8601 dates kept in strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A plain cast to DATE also takes blanks, single digits and a time of day.
ISO_FORM = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def iso_date(column: str | Column) -> Column:
    """DATE value of an ISO string, NULL when the text is not exactly ``yyyy-MM-dd``."""
    text = F.col(column) if isinstance(column, str) else column
    return F.when(text.rlike(ISO_FORM), text.try_cast("date"))


def is_bad_date(column: str | Column) -> Column:
    """True for a non-null string that is not an ISO date."""
    text = F.col(column) if isinstance(column, str) else column
    return text.isNotNull() & iso_date(text).isNull()


def typed_dates(df: DataFrame, *columns: str) -> DataFrame:
    """Turn ISO string columns into DATE columns, failing on a malformed value.

    MIN and MAX of a string make Spark sort before aggregating, MIN and MAX of a DATE do
    not. Text order and date order agree on ISO dates only, so a malformed value is an
    error here rather than a quietly different answer.
    """
    typed = {}
    for name in columns:
        text, parsed = F.col(name), iso_date(name)
        complaint = F.raise_error(F.concat(F.lit(f"{name} is not an ISO date: "), text)).cast("date")
        typed[name] = F.coalesce(parsed, F.when(text.isNotNull(), complaint))
    return df.withColumns(typed)
