"""Checks of what the tables declare about themselves but nothing enforces.

Each check reports violations with the number of rows behind them. Rows are counted by
value ahead of every join, so a value shared by many rows is cheap. NULL is no violation.

``weight`` names a column with the number of rows a row stands for, for input that has been
counted already.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.functions.dates import is_bad_date


def row_count(weight: str | None) -> Column:
    return (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("rows")


def orphan_keys(
    child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, weight: str | None = None
) -> DataFrame:
    """Foreign keys without a parent row, and the child rows that carry them."""
    used = (
        child.where(F.col(child_key).isNotNull())
        .groupBy(F.col(child_key).alias("orphan_key"))
        .agg(row_count(weight))
    )
    known = parent.select(F.col(parent_key).alias("known_key")).distinct()
    return used.join(known, F.col("orphan_key") == F.col("known_key"), "left_anti")


def domain_violations(
    df: DataFrame, column: str, allowed: Collection[str], weight: str | None = None
) -> DataFrame:
    """Values outside the declared list, and their rows."""
    return (
        df.where(F.col(column).isNotNull() & ~F.col(column).isin(list(allowed)))
        .groupBy(F.col(column).alias("value"))
        .agg(row_count(weight))
    )


def duplicate_keys(df: DataFrame, *keys: str, weight: str | None = None) -> DataFrame:
    """Keys that more than one row carries, and how many do."""
    return df.groupBy(*keys).agg(row_count(weight)).where("rows > 1")


def bad_dates(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """Strings that are not ISO dates, and their rows."""
    return df.where(is_bad_date(column)).groupBy(F.col(column).alias("value")).agg(row_count(weight))


# The attributes an event's payload may carry, and the one each type must.
PAYLOAD_FIELDS = "page string, product_id bigint, order_id bigint"
REQUIRED_FIELD = {
    "page_view": "page",
    "add_to_cart": "product_id",
    "purchase": "order_id",
    "refund": "order_id",
}


def payload_fields(events: DataFrame, fields: str = PAYLOAD_FIELDS, payload: str = "payload") -> DataFrame:
    """Attributes of the JSON payload as columns beside the event's key and type."""
    return events.select(
        "event_id", "event_type", F.from_json(payload, fields).alias("attributes")
    ).select("event_id", "event_type", "attributes.*")


def payload_gaps(
    events: DataFrame,
    required: Mapping[str, str] = REQUIRED_FIELD,
    fields: str = PAYLOAD_FIELDS,
    payload: str = "payload",
) -> DataFrame:
    """By event type: events, and those whose payload lacks the type's attribute.

    A type that requires none has no gaps; malformed JSON lacks every attribute.
    """
    parsed = payload_fields(events, fields, payload)
    gap = F.lit(False)
    for event_type, name in required.items():
        gap = gap | ((F.col("event_type") == event_type) & F.col(name).isNull())
    return parsed.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(gap).alias("gaps")
    )
