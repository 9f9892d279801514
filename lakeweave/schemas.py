"""Declared tables: columns, types, comments and partitioning."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import types as T


def column(name: str, dtype: T.DataType, comment: str) -> T.StructField:
    return T.StructField(name, dtype, True, {"comment": comment})


@dataclass(frozen=True)
class TableSpec:
    """What a table looks like before any row is loaded."""

    schema: T.StructType
    comment: str = ""
    partition_by: Sequence[str] = ()

    @property
    def names(self) -> list[str]:
        return self.schema.fieldNames()


# Column names and types of the operational and analytical tables.
_INT, _LONG, _DOUBLE = T.IntegerType(), T.LongType(), T.DoubleType()
_TEXT, _FLAG, _TIME = T.StringType(), T.BooleanType(), T.TimestampType()

CUSTOMERS = TableSpec(
    T.StructType(
        [
            column("customer_id", _LONG, "customer key"),
            column("name", _TEXT, "customer name"),
            column("email", _TEXT, "contact address"),
            column("region", _TEXT, "sales region"),
            column("tier", _TEXT, "contract level"),
            column("signup_date", _TEXT, "day of registration, yyyy-MM-dd"),
        ]
    ),
    "one row for each customer",
)

PRODUCTS = TableSpec(
    T.StructType(
        [
            column("product_id", _LONG, "product key"),
            column("name", _TEXT, "product name"),
            column("category", _TEXT, "main group"),
            column("sub_category", _TEXT, "group within the category"),
            column("list_price", _DOUBLE, "catalogue price"),
            column("is_active", _FLAG, "still on sale"),
        ]
    ),
    "one row for each product",
)

ORDERS = TableSpec(
    T.StructType(
        [
            column("order_id", _LONG, "order key"),
            column("customer_id", _LONG, "refers to customers"),
            column("product_id", _LONG, "refers to products"),
            column("quantity", _INT, "units"),
            column("unit_price", _DOUBLE, "price of one unit when ordered"),
            column("order_date", _TEXT, "day of the order, yyyy-MM-dd"),
            column("status", _TEXT, "PENDING, SHIPPED, DELIVERED or CANCELLED"),
        ]
    ),
    "one row for each order line",
)

RAW_EVENTS = TableSpec(
    T.StructType(
        [
            column("event_id", _LONG, "event key"),
            column("customer_id", _LONG, "refers to customers"),
            column("event_type", _TEXT, "page_view, add_to_cart, purchase or refund"),
            column("session_id", _TEXT, "visit the event belongs to"),
            column("payload", _TEXT, "JSON attributes of the event"),
            column("event_date", _TEXT, "partition: day of the event, yyyy-MM-dd"),
            column("region", _TEXT, "partition: sales region"),
        ]
    ),
    "customer events by day and region",
    ("event_date", "region"),
)

SENSOR_READINGS = TableSpec(
    T.StructType(
        [
            column("sensor_id", _INT, "sensor"),
            column("location", _TEXT, "where it stands"),
            column("metric", _TEXT, "what it measures"),
            column("value", _DOUBLE, "measured value"),
            column("recorded_at", _TIME, "time of the reading"),
        ]
    ),
    "sensor readings as they arrived, repeats included",
)

RANKED_READINGS = TableSpec(
    T.StructType([*SENSOR_READINGS.schema.fields, column("ranking", _TEXT, "band of the value: A, B or C")]),
    "distinct sensor readings with their band",
)

REGIONAL_SUMMARY = TableSpec(
    T.StructType(
        [
            column("region", _TEXT, "sales region"),
            column("tier", _TEXT, "contract level"),
            column("customer_count", _LONG, "customers in the segment"),
            column("earliest_signup", _TEXT, "first registration"),
            column("latest_signup", _TEXT, "last registration"),
        ]
    ),
    "customers by region and tier",
)

PRODUCT_REVENUE = TableSpec(
    T.StructType(
        [
            column("product_name", _TEXT, "product name"),
            column("category", _TEXT, "main group"),
            column("sub_category", _TEXT, "group within the category"),
            column("order_count", _LONG, "order lines"),
            column("total_units", _LONG, "units sold"),
            column("total_revenue", _DOUBLE, "revenue, two digits"),
        ]
    ),
    "revenue of orders that were not cancelled, by product",
)

CUSTOMER_LTV = TableSpec(
    T.StructType(
        [
            column("customer_id", _LONG, "customer key"),
            column("customer_name", _TEXT, "customer name"),
            column("region", _TEXT, "sales region"),
            column("tier", _TEXT, "contract level"),
            column("total_orders", _LONG, "fulfilled order lines"),
            column("lifetime_value", _DOUBLE, "revenue of fulfilled orders, two digits"),
            column("last_order_date", _TEXT, "day of the last fulfilled order"),
        ]
    ),
    "fulfilled orders by customer, customers without any included",
)

EVENT_FUNNEL = TableSpec(
    T.StructType(
        [
            column("region", _TEXT, "sales region"),
            column("event_type", _TEXT, "kind of event"),
            column("event_count", _LONG, "events"),
            column("unique_users", _LONG, "different customers"),
        ]
    ),
    "events and customers by region and event type",
)

LOAD_HISTORY = TableSpec(
    T.StructType(
        [
            column("run_id", _TEXT, "identifier of the write"),
            column("tbl", _TEXT, "table written to"),
            column("operation", _TEXT, "append or overwrite"),
            column("rows_written", _LONG, "rows handed to the sink"),
            column("committed_at", _TIME, "time the write had finished"),
        ]
    ),
    "writes done through the library",
)

OPERATIONAL = {
    "customers": CUSTOMERS,
    "products": PRODUCTS,
    "orders": ORDERS,
    "raw_events": RAW_EVENTS,
}

ANALYTICAL = {
    "regional_summary": REGIONAL_SUMMARY,
    "product_revenue": PRODUCT_REVENUE,
    "customer_ltv": CUSTOMER_LTV,
    "event_funnel": EVENT_FUNNEL,
}
