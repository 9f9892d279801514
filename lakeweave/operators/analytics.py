"""The four aggregates over the operational star, and the report of best customers.

Fact rows are aggregated by their foreign key before they meet a dimension. A key that
holds a large share of the facts is thereby reduced to one row per map task before the
shuffle, and the joins run over one row per key on either side. Dimension rows are
collapsed in the same way, with a count of their copies, because a load that ran twice
leaves every row twice and both copies take part in the join.

Results carry no order; ask for one with ``orderBy`` when they are shown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The order states each aggregate goes by.
CANCELLED = "CANCELLED"
FULFILLED = ("DELIVERED", "SHIPPED")


def collapsed(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.expr("count(*) AS copies"))


def sales_by(orders: DataFrame, key: str) -> DataFrame:
    """Order lines, units and revenue per foreign key; nothing is rounded yet."""
    return orders.groupBy(key).agg(
        F.expr("count(order_id) AS lines"),
        F.expr("sum(quantity) AS units"),
        F.expr("sum(quantity * unit_price) AS revenue"),
        F.expr("max(order_date) AS last_date"),
    )


def regional_summary(customers: DataFrame) -> DataFrame:
    """Customers, first and last signup by region and tier."""
    return customers.groupBy("region", "tier").agg(
        F.expr("count(*) AS customer_count"),
        F.expr("CAST(min(signup_date) AS STRING) AS earliest_signup"),
        F.expr("CAST(max(signup_date) AS STRING) AS latest_signup"),
    )


def product_revenue(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Order lines, units and revenue by product name, category and sub-category.

    Cancelled lines and lines without a status do not count. Products are told apart by
    name, so two keys with the same name and groups share a row.
    """
    sold = sales_by(orders.where(F.col("status") != CANCELLED), "product_id")
    named = collapsed(
        products.withColumnRenamed("name", "product_name"), "product_id", "product_name", "category", "sub_category"
    )
    return (
        sold.join(named, "product_id")
        .groupBy("product_name", "category", "sub_category")
        .agg(
            F.expr("sum(lines * copies) AS order_count"),
            F.expr("sum(units * copies) AS total_units"),
            F.expr("round(sum(revenue * copies), 2) AS total_revenue"),
        )
    )


def customer_ltv(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Fulfilled order lines and their value for every customer.

    The condition on the status belongs to the join, so it filters the orders ahead of it:
    a customer without a fulfilled order stays, with 0 orders, value 0.0 and no last date.
    """
    bought = sales_by(orders.where(F.col("status").isin(*FULFILLED)), "customer_id")
    known = collapsed(
        customers.withColumnRenamed("name", "customer_name"), "customer_id", "customer_name", "region", "tier"
    )
    return known.join(bought, "customer_id", "left").selectExpr(
        "customer_id",
        "customer_name",
        "region",
        "tier",
        "coalesce(lines * copies, 0L) AS total_orders",
        "coalesce(round(revenue * copies, 2), 0.0D) AS lifetime_value",
        "CAST(last_date AS STRING) AS last_order_date",
    )


def top_customers(ltv: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` customers of highest value; equal values go by customer key."""
    return (
        ltv.orderBy(F.desc("lifetime_value"), "customer_id")
        .limit(k)
        .select("customer_name", "region", "tier", "total_orders", "lifetime_value")
    )


def event_funnel(events: DataFrame, weight: str | None = None) -> DataFrame:
    """Events and different customers by region and event type.

    ``weight`` names a column with the number of events a row stands for, for input that
    has been counted per customer already. An event without a customer counts as an event
    only. The distinct count spreads over customers first, so a region with most of the
    events is no hot spot.
    """
    events_in_row = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return events.groupBy("region", "event_type").agg(
        events_in_row.cast("bigint").alias("event_count"),
        F.count_distinct("customer_id").alias("unique_users"),
    )
