"""The benchmark tables seen as the operational star and as sensor readings.

Every view reads only the columns it needs. Dates stay DATE: the sinks turn them into the
ISO strings the tables declare, the aggregates work on them directly.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column types of the benchmark files the views read.
FILE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

# Status of an order line by the order's state, unless the line was returned.
STATUS_OF_STATE = {"F": "DELIVERED", "O": "SHIPPED", "P": "PENDING"}
RETURNED_STATUS = "CANCELLED"
NOT_CANCELLED = tuple(STATUS_OF_STATE.values())


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(FILE_SCHEMAS[name]) if name in FILE_SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def customer_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer columns with the region's name.

    No broadcast hint: Spark broadcasts nation and region because it sees how small their
    files are, and would shuffle them if they were not.
    """
    regions = read(spark, sf_dir, "nation").join(
        read(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"), "left"
    )
    return (
        read(spark, sf_dir, "customer")
        .join(regions, F.expr("c_nationkey = n_nationkey"), "left")
        .selectExpr("c_custkey", "c_name", "c_mktsegment", "r_name AS region")
    )


def customers(spark: SparkSession, sf_dir: str, signup: bool = True, region: bool = True) -> DataFrame:
    """Customers; the day of their first order stands for the signup date.

    ``signup=False`` leaves that column, and the pass over the orders behind it, out;
    ``region=False`` does the same with the region and its join.
    """
    df = customer_regions(spark, sf_dir) if region else read(spark, sf_dir, "customer")
    if signup:
        first_orders = (
            read(spark, sf_dir, "orders")
            .groupBy("o_custkey")
            .agg(F.expr("CAST(min(o_orderdate) AS DATE) AS signup_date"))
        )
        df = df.join(first_orders, F.expr("c_custkey = o_custkey"), "left")
    return df.selectExpr(
        "c_custkey AS customer_id",
        "c_name AS name",
        *(["region"] if region else []),
        "c_mktsegment AS tier",
        *(["signup_date"] if signup else []),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products; an odd size stands for a product on sale."""
    return read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS product_id",
        "p_name AS name",
        "p_type AS category",
        "p_brand AS sub_category",
        "p_retailprice AS list_price",
        "p_size % 2 = 1 AS is_active",
    )


def line_status() -> str:
    states = " ".join(f"WHEN o_orderstatus = '{state}' THEN '{name}'" for state, name in STATUS_OF_STATE.items())
    return f"CASE WHEN l_returnflag = 'R' THEN '{RETURNED_STATUS}' {states} END"


def order_lines(spark: SparkSession, sf_dir: str, statuses: Collection[str] | None = None) -> DataFrame:
    """One row per order line, optionally only those of some statuses.

    A status is made of a column of each side, so a filter on it could only run after the
    join. When cancelled lines are not wanted the two halves of the condition are applied
    to the two scans instead, which keeps the unwanted rows out of the shuffle.
    """
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    if statuses is not None and RETURNED_STATUS not in statuses:
        states = [state for state, name in STATUS_OF_STATE.items() if name in statuses]
        lines = lines.where("l_returnflag IS NULL OR l_returnflag <> 'R'")
        orders = orders.where(F.col("o_orderstatus").isin(states))
    joined = lines.join(orders, F.expr("l_orderkey = o_orderkey")).selectExpr(
        "o_orderkey AS order_id",
        "o_custkey AS customer_id",
        "l_partkey AS product_id",
        "CAST(l_quantity AS INT) AS quantity",
        "l_extendedprice / l_quantity AS unit_price",
        "CAST(o_orderdate AS DATE) AS order_date",
        f"{line_status()} AS status",
    )
    return joined if statuses is None else joined.where(F.col("status").isin(list(statuses)))


def order_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and units by order, those of returned lines beside them, joined to the order.

    For questions that need no single line. Counting ahead of the join brings an order with
    very many lines down to one row, and the shuffle of the count serves the join.
    """
    counted = (
        read(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.expr("count(*) AS lines"),
            F.expr("sum(CAST(l_quantity AS INT)) AS units"),
            F.expr("count_if(l_returnflag = 'R') AS returned_lines"),
            F.expr("coalesce(sum(CAST(l_quantity AS INT)) FILTER (WHERE l_returnflag = 'R'), 0) AS returned_units"),
        )
    )
    return counted.join(read(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and units by status: at most one row for each status."""
    states = " ".join(f"WHEN o_orderstatus = '{state}' THEN '{name}'" for state, name in STATUS_OF_STATE.items())
    by_order = order_line_counts(spark, sf_dir).selectExpr(
        f"stack(2, '{RETURNED_STATUS}', returned_lines, returned_units,"
        f" CASE {states} END, lines - returned_lines, units - returned_units) AS (status, lines, units)"
    )
    return by_order.where("lines > 0").groupBy("status").agg(F.expr("sum(lines) AS lines"), F.expr("sum(units) AS units"))


def with_region(events: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add the region of each event's customer; events of unknown customers keep NULL."""
    regions = customer_regions(spark, sf_dir).select("c_custkey", "region")
    return events.join(regions, F.expr("user_id = c_custkey"), "left").drop("c_custkey")


def raw_events(spark: SparkSession, sf_dir: str, region: bool = True) -> DataFrame:
    """Events; ``region=False`` leaves the region, and the join behind it, out."""
    events = read(spark, sf_dir, "events")
    if region:
        events = with_region(events, spark, sf_dir)
    return events.selectExpr(
        "event_id",
        "user_id AS customer_id",
        "event_type",
        "CAST(NULL AS STRING) AS session_id",
        "props AS payload",
        "CAST(ts AS DATE) AS event_date",
        *(["region"] if region else []),
    )


def event_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted by customer and type, with the customer's region.

    Counting before the region is looked up sends one row per customer and type into the
    join instead of every event, however many events a single customer has.
    """
    activity = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.expr("count(*) AS events"))
    return with_region(activity, spark, sf_dir).withColumnRenamed("user_id", "customer_id")


def sensor_readings(spark: SparkSession, sf_dir: str, location: bool = True) -> DataFrame:
    """Events as readings; the customer's region stands for the location."""
    events = read(spark, sf_dir, "events")
    if location:
        events = with_region(events, spark, sf_dir)
    return events.selectExpr(
        "event_id AS sensor_id",
        *(["region AS location"] if location else []),
        "event_type AS metric",
        "value",
        "CAST(ts AS TIMESTAMP) AS recorded_at",
    )
