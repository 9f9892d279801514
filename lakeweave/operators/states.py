"""Partial states of the aggregates: what batches add up to, so that results need no old rows.

A state is a table. ``of`` makes that of a batch, ``merged`` that of several states; both reduce in the map tasks.
Results are made of states alone, and equal those of ``operators.analytics`` over all batches together: sums
of doubles are exact (``functions.exact``), and customers are counted in bitmaps, 32,768 keys to each.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.functions.dates import typed_dates
from lakeweave.functions.exact import folded, sum_bin, sum_parts
from lakeweave.operators.analytics import CANCELLED, FULFILLED
from lakeweave.schemas import TableSpec, column


def _add(name: str) -> Column:
    return F.sum(name)


def _add_exact(name: str) -> Column:
    return F.sum(name).cast("decimal(38,0)")


@dataclass(frozen=True)
class State:
    """One state table: the batch's table it comes from, its keys, and how each of its values is merged."""

    source: str
    keys: Sequence[str]
    merge: Mapping[str, Callable[[str], Column]]
    of: Callable[[DataFrame], DataFrame]
    types: str

    @property
    def spec(self) -> TableSpec:
        fields = T.StructType.fromDDL(self.types)
        return TableSpec(T.StructType([column(f.name, f.dataType, "key" if f.name in self.keys else "partial") for f in fields]))

    def merged(self, states: Sequence[DataFrame]) -> DataFrame:
        """One state of several; the key NULL is a key."""
        rows = reduce(DataFrame.unionByName, states)
        out = rows.groupBy(*self.keys).agg(*[rule(name).alias(name) for name, rule in self.merge.items()])
        return out.select(*self.spec.names)


def _with_dates(df: DataFrame, name: str) -> DataFrame:
    return typed_dates(df, name) if dict(df.dtypes).get(name) == "string" else df


def _regions(customers: DataFrame) -> DataFrame:
    signed = _with_dates(customers, "signup_date")
    return signed.groupBy("region", "tier").agg(
        F.count(F.lit(1)).alias("customers"), F.min("signup_date").alias("first_day"), F.max("signup_date").alias("last_day")
    )


def _copies(keys: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))


def _sales(key: str, wanted: str) -> Callable[[DataFrame], DataFrame]:
    def of(orders: DataFrame) -> DataFrame:
        amount = F.col("quantity") * F.col("unit_price")
        lines = _with_dates(orders, "order_date").where(wanted)
        return lines.groupBy(key, sum_bin(amount).alias("amount_bin")).agg(
            F.count("order_id").alias("lines"),
            F.sum("quantity").alias("units"),
            sum_parts(amount).alias("amount_part"),
            F.max("order_date").alias("last_day"),
        )

    return of


def _users(events: DataFrame) -> DataFrame:
    # Bitmaps are aggregated over sorted rows: only different customers are left to sort.
    each = events.groupBy("region", "event_type", "customer_id").agg(F.count(F.lit(1)).alias("n"))
    bucket = F.bitmap_bucket_number("customer_id")
    return each.groupBy("region", "event_type", bucket.alias("bucket")).agg(
        F.sum("n").alias("events"), F.bitmap_construct_agg(F.bitmap_bit_position("customer_id")).alias("users")
    )


_SALES_MERGE = {"lines": _add, "units": _add, "amount_part": _add_exact, "last_day": F.max}
_SALES_TYPES = "{} bigint, amount_bin int, lines bigint, units bigint, amount_part decimal(38,0), last_day date"
_BUYER = ("customer_id", "name", "region", "tier")
_PRODUCT = ("product_id", "name", "category", "sub_category")

STATES = {
    "state_regions": State(
        "customers", ("region", "tier"), {"customers": _add, "first_day": F.min, "last_day": F.max}, _regions,
        "region string, tier string, customers bigint, first_day date, last_day date",
    ),
    "state_buyers": State(
        "customers", _BUYER, {"copies": _add}, _copies(_BUYER), "customer_id bigint, name string, region string, tier string, copies bigint"
    ),
    "state_products": State(
        "products", _PRODUCT, {"copies": _add}, _copies(_PRODUCT),
        "product_id bigint, name string, category string, sub_category string, copies bigint",
    ),
    "state_sold": State(
        "orders", ("product_id", "amount_bin"), _SALES_MERGE, _sales("product_id", f"status <> '{CANCELLED}'"), _SALES_TYPES.format("product_id")
    ),
    "state_bought": State(
        "orders", ("customer_id", "amount_bin"), _SALES_MERGE, _sales("customer_id", f"status IN {FULFILLED}"),
        _SALES_TYPES.format("customer_id"),
    ),
    "state_users": State(
        "raw_events", ("region", "event_type", "bucket"), {"events": _add, "users": F.bitmap_or_agg}, _users,
        "region string, event_type string, bucket bigint, events bigint, users binary",
    ),
}

# The states that each result is made of.
NEEDED = {
    "regional_summary": ("state_regions",),
    "product_revenue": ("state_sold", "state_products"),
    "customer_ltv": ("state_buyers", "state_bought"),
    "event_funnel": ("state_users",),
}


def regional_summary(regions: DataFrame) -> DataFrame:
    return regions.select(
        "region", "tier", F.col("customers").alias("customer_count"), F.col("first_day").cast("string").alias("earliest_signup"),
        F.col("last_day").cast("string").alias("latest_signup"),
    )


def product_revenue(sold: DataFrame, products: DataFrame) -> DataFrame:
    """Products of one name and groups share a row; copies of a product count each."""
    named = products.withColumnRenamed("name", "product_name")
    rows = sold.join(named, "product_id")
    rows = rows.select(
        "product_name", "category", "sub_category", "amount_bin", *[(F.col(c) * F.col("copies")).alias(c) for c in ("lines", "units")],
        (F.col("amount_part") * F.col("copies")).cast("decimal(38,0)").alias("amount_part"),
    )
    # By bin first: products of one name may be many.
    by = ("product_name", "category", "sub_category")
    rows = rows.groupBy(*by, "amount_bin").agg(
        F.sum("lines").alias("lines"), F.sum("units").alias("units"), _add_exact("amount_part").alias("amount_part")
    )
    return rows.groupBy(*by).agg(
        F.sum("lines").alias("order_count"),
        F.sum("units").alias("total_units"),
        F.round(folded("amount_bin", "amount_part"), 2).alias("total_revenue"),
    )


def customer_ltv(buyers: DataFrame, bought: DataFrame) -> DataFrame:
    sales = bought.groupBy("customer_id").agg(
        F.sum("lines").alias("lines"), F.collect_list(F.struct("amount_bin", "amount_part")).alias("amounts"), F.max("last_day").alias("last_day")
    )
    known = buyers.withColumnRenamed("name", "customer_name").join(sales, "customer_id", "left")
    part = F.explode_outer("amounts").alias("amount")
    by = ["customer_id", "customer_name", "region", "tier", "copies", "lines", "last_day"]
    rows = known.select(*by, part).select(
        *by, F.col("amount.amount_bin").alias("b"), (F.col("amount.amount_part") * F.col("copies")).cast("decimal(38,0)").alias("p")
    )
    value = rows.groupBy(*by).agg(folded("b", "p").alias("value"))
    return value.selectExpr(
        "customer_id", "customer_name", "region", "tier", "coalesce(lines * copies, 0L) AS total_orders",
        "coalesce(round(value, 2), 0.0D) AS lifetime_value", "CAST(last_day AS STRING) AS last_order_date",
    )


def event_funnel(users: DataFrame) -> DataFrame:
    return users.groupBy("region", "event_type").agg(
        F.sum("events").alias("event_count"), F.sum(F.bitmap_count("users")).alias("unique_users")
    )


RESULTS = {
    "regional_summary": regional_summary,
    "product_revenue": product_revenue,
    "customer_ltv": customer_ltv,
    "event_funnel": event_funnel,
}
