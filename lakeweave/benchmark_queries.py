"""The library run over the benchmark tables, one function per operator.

Each function takes a session and the folder of the tables and reads those tables whole.
Functions whose operator writes do the writes when called, in a fresh workspace, and
return what the written tables hold.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave import operators as ops
from lakeweave import plans, sinks
from lakeweave.functions.exact import exact_sums, folded, sum_bin, sum_parts
from lakeweave.schemas import (
    ANALYTICAL,
    CUSTOMERS,
    OPERATIONAL,
    ORDERS,
    PRODUCTS,
    RAW_EVENTS,
    SENSOR_READINGS,
    TableSpec,
    column,
)
from lakeweave.session import workspace
from lakeweave.sinks.ddl import LAKEHOUSE_PROPERTIES
from lakeweave.sinks.writes import empty_partitions
from lakeweave.sources import star_views as star
from lakeweave.sources.bindings import CatalogBinding
from lakeweave.sources.files import file_ranges, file_report, overlapping_files, write_evidence
from lakeweave.sources.inline import inline_rows
from lakeweave.sources.inventory import federated_inventory
from lakeweave.sources.tables import commit_history, scan_bucketed, scan_files, scan_partitions, scan_table

# Event keys of the benchmark outgrow the INT that sensors are numbered with.
READINGS = TableSpec(
    T.StructType([column("sensor_id", T.LongType(), "sensor"), *SENSOR_READINGS.schema.fields[1:]]),
    SENSOR_READINGS.comment,
)
RANKED = TableSpec(T.StructType([*READINGS.schema.fields, column("ranking", T.StringType(), "band of the value")]))

STAR_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
OTHER_TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# The loads take the benchmark in two batches that make up the whole.
FIRST_BATCH = {
    "customers": "tier IN ('AUTOMOBILE', 'BUILDING')",
    "products": "is_active",
    "orders": "order_date < DATE '1998-01-01'",
    "raw_events": "event_date < DATE '2024-01-15'",
}

# What the first batch leaves. Days are taken from the columns behind the views: a test of a cast for
# NULL would keep the condition from the scans.
REST = {
    "customers": "tier NOT IN ('AUTOMOBILE', 'BUILDING') OR tier IS NULL",
    "products": "NOT is_active OR is_active IS NULL",
    "orders": "o_orderdate >= TIMESTAMP_NTZ '1998-01-01 00:00:00' OR o_orderdate IS NULL",
    "raw_events": "ts >= TIMESTAMP_NTZ '2024-01-15 00:00:00' OR ts IS NULL",
}

# A result with partitions.
DAILY_EVENTS = TableSpec(
    T.StructType(
        [
            column("event_date", T.StringType(), "day"),
            column("event_type", T.StringType(), "kind of event"),
            column("events", T.LongType(), "events"),
            column("region", T.StringType(), "partition: sales region"),
        ]
    ),
    "events by day, kind and region",
    ("region",),
)

# The slice of partitions that the pruned scan and the replication select.
CHOSEN_REGIONS = {"region": ["ASIA", "EUROPE"]}
CHOSEN_DAYS = {"event_date": ("2024-01-05", "2024-01-20")}


def with_time_text(readings: DataFrame) -> DataFrame:
    return readings.withColumn("recorded_at", F.date_format("recorded_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def bindings(spark: SparkSession) -> tuple[CatalogBinding, CatalogBinding]:
    """An operational and an analytical catalog of their own for one run."""
    root, run = workspace(spark), uuid.uuid4().hex[:12]
    pair = tuple(
        CatalogBinding(name, f"lakeweave_{run}_{name}", f"{root}/{name}") for name in ("operational", "analytical")
    )
    for binding in pair:
        sinks.ensure_namespace(spark, binding)
    return pair


def without_email(customers: DataFrame) -> DataFrame:
    """The benchmark has no address of its customers: the table's column stays NULL."""
    return customers.withColumn("email", F.lit(None).cast("string"))


def star_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "customers": without_email(star.customers(spark, sf_dir)),
        "products": star.products(spark, sf_dir),
        "orders": star.order_lines(spark, sf_dir),
        "raw_events": star.raw_events(spark, sf_dir),
    }


def stacked(parts: Mapping[str, DataFrame], label: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn(label, F.lit(name)) for name, df in parts.items()])


# Aggregates


def regional_summary(spark, sf_dir):
    return ops.regional_summary(star.customers(spark, sf_dir))


def product_revenue(spark, sf_dir):
    return ops.product_revenue(
        star.order_lines(spark, sf_dir, statuses=star.NOT_CANCELLED), star.products(spark, sf_dir)
    )


def customer_ltv(spark, sf_dir):
    return ops.customer_ltv(
        star.customers(spark, sf_dir, signup=False),
        star.order_lines(spark, sf_dir, statuses=ops.analytics.FULFILLED),
    )


def event_funnel(spark, sf_dir):
    return ops.event_funnel(star.event_activity(spark, sf_dir), weight="events")


def customer_ltv_top5(spark, sf_dir):
    return ops.top_customers(customer_ltv(spark, sf_dir), 5)


# Readings


def sensor_ranking(spark, sf_dir):
    ranked = ops.rank_readings(star.sensor_readings(spark, sf_dir, location=False))
    return ranked.select("sensor_id", "metric", "value", "ranking")


def dedup_distinct(spark, sf_dir):
    rows = star.read(spark, sf_dir, "events").select(
        "user_id", "event_type", F.floor("value").alias("whole_value")
    )
    return ops.distinct_rows(rows)


def ingest_readings(spark, sf_dir):
    operational, _ = bindings(spark)
    stored = plans.ingest_readings(spark, operational, star.sensor_readings(spark, sf_dir), spec=READINGS)
    return with_time_text(stored)


def _ingest_twice(spark, sf_dir, target):
    readings = star.sensor_readings(spark, sf_dir)
    plans.ingest_readings(spark, target, readings, spec=READINGS)
    return plans.ingest_readings(spark, target, readings, spec=READINGS)


def dedup_and_rank(spark, sf_dir):
    operational, analytical = bindings(spark)
    _ingest_twice(spark, sf_dir, operational)
    plans.dedup_and_rank(spark, operational, analytical, spec=RANKED, sort_within=["sensor_id"])
    return with_time_text(scan_table(spark, analytical, "sensor_readings_ac"))


def rerun_append_growth(spark, sf_dir):
    operational, analytical = bindings(spark)
    _ingest_twice(spark, sf_dir, operational)
    report = plans.dedup_and_rank(spark, operational, analytical, spec=RANKED)
    return spark.createDataFrame(
        [(report.raw_rows, report.distinct_rows)], "raw_rows bigint, distinct_rows bigint"
    )


# Loads


def load_reconciliation(spark, sf_dir):
    operational, _ = bindings(spark)
    tables = star_tables(spark, sf_dir)
    first = {name: df.where(FIRST_BATCH[name]) for name, df in tables.items()}
    rest = {name: df.where(REST[name]) for name, df in tables.items()}
    plans.load_tables(spark, operational, first)
    return plans.load_with_reconciliation(spark, operational, rest)


def labelled_counts(spark, sf_dir):
    return ops.labelled_counts({name: star.read(spark, sf_dir, name) for name in STAR_TABLES + OTHER_TABLES})


def positional_append(spark, sf_dir):
    operational, _ = bindings(spark)
    unnamed = star.products(spark, sf_dir).toDF("c1", "c2", "c3", "c4", "c5", "c6")
    plans.load_tables(spark, operational, {"products": unnamed}, {"products": PRODUCTS}, positional=True)
    return scan_table(spark, operational, "products")


def _stored_events(spark, sf_dir, target):
    plans.load_tables(
        spark, target, {"raw_events": star.raw_events(spark, sf_dir)}, {"raw_events": RAW_EVENTS}
    )


def partitioned_roundtrip(spark, sf_dir):
    operational, _ = bindings(spark)
    _stored_events(spark, sf_dir, operational)
    stored = scan_files(spark, operational.location("raw_events"), RAW_EVENTS)
    return stored.groupBy("event_date", "region").agg(
        F.count(F.lit(1)).alias("events"),
        F.min("event_id").alias("first_event"),
        F.max("event_id").alias("last_event"),
    )


def pruned_read(spark, sf_dir):
    operational, _ = bindings(spark)
    _stored_events(spark, sf_dir, operational)
    chosen = scan_partitions(
        scan_table(spark, operational, "raw_events"), RAW_EVENTS, CHOSEN_REGIONS, CHOSEN_DAYS
    )
    return chosen.select("event_id", "customer_id", "event_type", "payload", "event_date", "region")


def replicate_partitions(spark, sf_dir):
    """Two regions copied in turn; then a day of the first goes in the source, and it is copied again."""
    operational, analytical = bindings(spark)
    _stored_events(spark, sf_dir, operational)
    regions = CHOSEN_REGIONS["region"]
    copy = lambda region: plans.replicate_partitions(
        spark, operational, analytical, "raw_events", RAW_EVENTS, {"region": [region]}, CHOSEN_DAYS
    )
    for region in regions:
        copy(region)
    empty_partitions(
        spark, operational, "raw_events", [{"event_date": CHOSEN_DAYS["event_date"][0], "region": regions[0]}]
    )
    copy(regions[0])
    return (
        scan_table(spark, analytical, "raw_events")
        .groupBy("event_date", "region", "event_type")
        .agg(F.count(F.lit(1)).alias("events"))
    )


def write_evidence_by_partition(spark, sf_dir):
    operational, _ = bindings(spark)
    _stored_events(spark, sf_dir, operational)
    files = write_evidence(spark, operational.location("raw_events"))
    parts = r"event_date=([^/]+)/region=([^/]+)/"
    # Spaces of a partition value are kept in the path or escaped, depending on the listing; a plus
    # sign stands for itself, and a NULL for Hive's default name.
    region = F.url_decode(F.replace(F.regexp_extract("path", parts, 2), F.lit("+"), F.lit("%2B")))
    return (
        files.where(F.col("size_bytes") > 0)
        .select(
            F.regexp_extract("path", parts, 1).alias("event_date"),
            F.nullif(region, F.lit("__HIVE_DEFAULT_PARTITION__")).alias("region"),
        )
        .distinct()
    )


def load_history(spark, sf_dir):
    operational, analytical = bindings(spark)
    _ingest_twice(spark, sf_dir, operational)
    plans.dedup_and_rank(spark, operational, analytical, spec=RANKED)
    return stacked(
        {
            "sensor_readings": commit_history(spark, operational, "sensor_readings"),
            "sensor_readings_ac": commit_history(spark, analytical, "sensor_readings_ac"),
        },
        "tbl",
    ).select("tbl", "operation", "rows_written")


# Publishing


def _published(spark, sf_dir):
    _, analytical = bindings(spark)
    plans.register(spark, analytical)
    results = {
        "regional_summary": regional_summary(spark, sf_dir),
        "product_revenue": product_revenue(spark, sf_dir),
        "customer_ltv": customer_ltv(spark, sf_dir),
        "event_funnel": event_funnel(spark, sf_dir),
    }
    for name in results:  # a session that has seen the empty table must see the rows later
        scan_table(spark, analytical, name).count()
    return analytical, plans.publish(spark, analytical, results)


def publish_self_read(spark, sf_dir):
    """A result published over the table it reads: the late half of the funnel's events goes."""
    _, analytical = bindings(spark)
    specs = {"event_funnel": ANALYTICAL["event_funnel"]}
    plans.register(spark, analytical, specs)
    plans.publish(spark, analytical, {"event_funnel": event_funnel(spark, sf_dir)}, specs)
    held = scan_table(spark, analytical, "event_funnel")
    plans.publish(spark, analytical, {"event_funnel": held.where("event_type <> 'view'")}, specs)
    return scan_table(spark, analytical, "event_funnel")


def aggregates_from_tables(spark, sf_dir):
    """The four aggregates over loaded tables, summed up to a row each."""
    operational, _ = bindings(spark)
    plans.load_tables(spark, operational, star_tables(spark, sf_dir))
    stored = [scan_table(spark, operational, n) for n in ("customers", "products", "orders", "raw_events")]
    results = plans.compute_aggregates(*stored)
    sums = {
        "regional_summary": ("customer_count", "0", "max(latest_signup)"),
        "product_revenue": ("order_count", "sum(total_revenue)", "NULL"),
        "customer_ltv": ("total_orders", "sum(lifetime_value)", "max(last_order_date)"),
        "event_funnel": ("event_count", "sum(unique_users)", "NULL"),
    }
    return stacked(
        {
            name: results[name].selectExpr(
                "count(*) AS rows", f"sum({count}) AS total", f"round(CAST({amount} AS DOUBLE), 0) AS amount",
                f"CAST({last} AS STRING) AS last_date",
            )
            for name, (count, amount, last) in sums.items()
        },
        "tbl",
    )


def directory_publish(spark, sf_dir):
    analytical, _ = _published(spark, sf_dir)
    return scan_table(spark, analytical, "customer_ltv")


def publish_verification(spark, sf_dir):
    analytical, written = _published(spark, sf_dir)
    return plans.verify(spark, analytical, written)


def overwrite_idempotent(spark, sf_dir):
    operational, _ = bindings(spark)
    sinks.create_table(spark, operational, "products", PRODUCTS)
    for _ in range(2):
        sinks.overwrite(spark, operational, "products", star.products(spark, sf_dir), sort_within=["product_id"])
    return scan_table(spark, operational, "products")


def cross_catalog_copy(spark, sf_dir):
    operational, analytical = bindings(spark)
    plans.load_tables(
        spark, operational, {"customers": without_email(star.customers(spark, sf_dir))}, {"customers": CUSTOMERS}
    )
    plans.cross_catalog_copy(spark, operational, "customers", analytical, "customers_copy", CUSTOMERS)
    return scan_table(spark, analytical, "customers_copy").drop("email")


# Writes in order, replication of differences, results kept up to date


def ordered_write(spark, sf_dir):
    """Order lines written in the order of their days, and what the files say of it."""
    operational, _ = bindings(spark)
    sinks.create_table(spark, operational, "orders", ORDERS)
    sinks.overwrite(spark, operational, "orders", star.order_lines(spark, sf_dir), order_by=["order_date"], target_files=8)
    ranges = file_ranges(scan_table(spark, operational, "orders"), "order_date")
    late = overlapping_files(ranges).agg(F.count(F.lit(1)).alias("overlapping_files"))
    whole = ranges.agg(
        F.count(F.lit(1)).alias("files"), F.sum("record_count").alias("rows"), F.min("low").alias("first_day"), F.max("high").alias("last_day")
    )
    both = whole.unionByName(late, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("files", "rows", "first_day", "last_day", "overlapping_files")])


def replicate_changes(spark, sf_dir):
    """A replica follows its source: a row changes there, a partition goes, and only these are dealt with."""
    operational, analytical = bindings(spark)
    _stored_events(spark, sf_dir, operational)
    replica = plans.Replica(spark, operational, analytical, "raw_events", RAW_EVENTS, ["event_id"])
    replica.sync()
    (first_day, last_day), regions = CHOSEN_DAYS["event_date"], CHOSEN_REGIONS["region"]
    one = star.raw_events(spark, sf_dir).where((F.col("event_date") == F.lit(first_day)) & (F.col("region") == regions[0]))
    least = one.agg(F.min("event_id")).first()[0]
    payload = F.when(F.col("event_id") == F.lit(least), "changed").otherwise(F.col("payload"))
    sinks.overwrite_partitions(spark, operational, "raw_events", one.withColumn("payload", payload))
    empty_partitions(spark, operational, "raw_events", [{"event_date": last_day, "region": regions[1]}])
    by = ["event_date", "region"]
    rows = replica.row_changes().groupBy(*by).agg(F.count(F.lit(1)).alias("row_changes"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)  # the partitions that differ: two at most
    synced = replica.sync()
    held = scan_table(spark, analytical, "raw_events").groupBy(*by).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("payload") == "changed").alias("changed_events")
    )
    copied = held.unionByName(synced.partitions, allowMissingColumns=True).unionByName(rows, allowMissingColumns=True)
    return copied.groupBy(*by).agg(
        F.coalesce(F.max("events"), F.lit(0)).alias("events"), F.coalesce(F.max("changed_events"), F.lit(0)).alias("changed_events"),
        F.max("change").alias("change"), F.coalesce(F.max("row_changes"), F.lit(0)).alias("row_changes"),
    )


def chosen_partitions(spark, sf_dir):
    """The events of each region's busiest day, opened by a table of partitions."""
    operational, _ = bindings(spark)
    _stored_events(spark, sf_dir, operational)
    stored = scan_table(spark, operational, "raw_events")
    days = stored.groupBy("event_date", "region").agg(F.count(F.lit(1)).alias("events"))
    busiest = days.groupBy("region").agg(F.min(F.struct((-F.col("events")).alias("order"), "event_date")).alias("best"))
    control = busiest.select("region", "best.event_date")
    return scan_partitions(stored, RAW_EVENTS, chosen=control).select("event_id", "event_type", "event_date", "region")


def published_partitions(spark, sf_dir):
    """A partitioned result published twice; the second time it reads the table that it replaces."""
    _, analytical = bindings(spark)
    specs = {"daily_events": DAILY_EVENTS}
    plans.register(spark, analytical, specs)
    daily = star.raw_events(spark, sf_dir).groupBy(F.col("event_date").cast("string").alias("event_date"), "event_type", "region")
    plans.publish(spark, analytical, {"daily_events": daily.agg(F.count(F.lit(1)).alias("events"))}, specs)
    held = scan_table(spark, analytical, "daily_events")
    plans.publish(spark, analytical, {"daily_events": held.where("event_type <> 'view'")}, specs)
    return scan_table(spark, analytical, "daily_events")


def _refreshed(spark, sf_dir, result):
    """A result after two batches; the second one comes twice."""
    _, analytical = bindings(spark)
    tables = star_tables(spark, sf_dir)
    first = {name: df.where(FIRST_BATCH[name]) for name, df in tables.items()}
    rest = {name: df.where(REST[name]) for name, df in tables.items()}
    for batch_id, batch in (("first", first), ("rest", rest), ("rest", rest)):
        plans.refresh(spark, analytical, batch_id, batch, [result])
    return plans.refreshed(spark, analytical, result)


def refreshed_regions(spark, sf_dir):
    return _refreshed(spark, sf_dir, "regional_summary")


def refreshed_revenue(spark, sf_dir):
    return _refreshed(spark, sf_dir, "product_revenue")


def refreshed_ltv(spark, sf_dir):
    return _refreshed(spark, sf_dir, "customer_ltv")


def refreshed_funnel(spark, sf_dir):
    return _refreshed(spark, sf_dir, "event_funnel")


def exact_revenue(spark, sf_dir):
    """Revenue by status added up along three routes, and how many different doubles come out."""
    lines = star.order_lines(spark, sf_dir)
    amount = F.col("quantity") * F.col("unit_price")

    def by_way_of(column_name):
        parts = lines.groupBy("status", column_name, sum_bin(amount).alias("bin")).agg(sum_parts(amount).alias("part"))
        merged = parts.groupBy("status", "bin").agg(F.sum("part").cast("decimal(38,0)").alias("part"))
        return merged.groupBy("status").agg(folded("bin", "part").alias("total"))

    routes = [exact_sums(lines, ["status"], amount, "total"), by_way_of("order_date"), by_way_of("customer_id")]
    totals = reduce(DataFrame.unionByName, routes)
    return totals.groupBy("status").agg(
        F.round(F.max("total"), 2).alias("revenue"), F.count_distinct("total").alias("different_totals"), F.count(F.lit(1)).alias("routes")
    )


def incremental_distinct(spark, sf_dir):
    """Distinct ranked readings from batches that overlap; the last one brings nothing new."""
    _, analytical = bindings(spark)
    readings = star.sensor_readings(spark, sf_dir)
    early = readings.where("recorded_at < TIMESTAMP '2024-01-15 00:00:00'")
    for batch in (early, early.unionByName(early), readings, readings):
        plans.dedup_increment(spark, analytical, batch, spec=RANKED)
    return with_time_text(plans.scan_distinct(spark, analytical, "sensor_readings_distinct"))


def bucketed_ltv(spark, sf_dir):
    """Lifetime values of tables that are bucketed by customer, joined without a shuffle."""
    operational, _ = bindings(spark)
    buckets = ("customer_id", 16)
    loads = {
        "customers": (without_email(star.customers(spark, sf_dir, signup=False).withColumn("signup_date", F.lit(None).cast("string"))), CUSTOMERS),
        "orders": (star.order_lines(spark, sf_dir), ORDERS),
    }
    for name, (rows, spec) in loads.items():
        sinks.create_table(spark, operational, name, spec, bucket_by=buckets)
        sinks.append(spark, operational, name, rows, bucket_by=buckets)
    return ops.customer_ltv(*(scan_bucketed(spark, operational, name) for name in loads))


def resumed_copy(spark, sf_dir):
    """Products copied in groups of files; the copy stops at the third group and is called again."""
    operational, analytical = bindings(spark)
    sinks.create_table(spark, operational, "products", PRODUCTS)
    sinks.append(spark, operational, "products", star.products(spark, sf_dir), target_files=6)
    seen = []

    def stops(df):
        seen.append(df)
        if len(seen) == 3:
            raise InterruptedError
        return df

    copy = lambda f: plans.resumable_copy(
        spark, operational, "products", analytical, "products_copy", PRODUCTS, "copy", f, group_bytes=1
    )
    try:
        copy(stops)
    except InterruptedError:
        pass
    done = copy(lambda df: df)
    copied = scan_table(spark, analytical, "products_copy")
    return copied.withColumn("copied", F.lit(done.copied)).withColumn("skipped", F.lit(done.skipped))


def load_quarantine(spark, sf_dir):
    """Order lines that came as text, some of them no numbers, loaded with their misfits set aside."""
    operational, _ = bindings(spark)
    lines = star.order_lines(spark, sf_dir)
    odd = lambda every, text, column: f"CASE WHEN product_id % {every} = 0 THEN '{text}' ELSE CAST({column} AS STRING) END AS {column}"
    batch = lines.selectExpr(
        "order_id", "customer_id", "product_id", odd(10, "many", "quantity"), odd(15, "free", "unit_price"),
        "CAST(order_date AS STRING) AS order_date", "status",
    )
    report = plans.load_with_quarantine(spark, operational, "orders", batch, ORDERS, {"not cancelled": "status <> 'CANCELLED'"})
    counts = [("offered", report.offered), ("accepted", report.accepted), ("rejected", report.rejected)]
    counts = spark.createDataFrame([(None, what, n) for what, n in counts], "column_name string, reason string, rows bigint")
    stored = scan_table(spark, operational, "orders").agg(F.count(F.lit(1)).alias("rows"))
    stored = stored.select(F.lit(None).cast("string").alias("column_name"), F.lit("stored").alias("reason"), "rows")
    return plans.reject_reasons(spark, operational, "orders").unionByName(counts).unionByName(stored)


def audit_in_one_pass(spark, sf_dir):
    """Every check of the tables, each table scanned once, with two offenders for each."""
    customers = star.customers(spark, sf_dir, signup=False)
    tables = {
        "customers": customers,
        "building customers": customers.where("tier = 'BUILDING'"),
        "products": star.products(spark, sf_dir),
        "orders": star.order_lines(spark, sf_dir).withColumn("order_date", F.col("order_date").cast("string")),
        "raw_events": star.raw_events(spark, sf_dir, region=False),
    }
    rules = [
        ops.Domain("customers", "region", ["AMERICA", "EUROPE", "ASIA"]),
        ops.Domain("orders", "status", ["PENDING", "SHIPPED", "DELIVERED"]),
        ops.Domain("raw_events", "event_type", ["view", "purchase"]),
        ops.IsoDate("orders", "order_date"),
        ops.Unique("customers", ["customer_id"]),
        ops.Unique("orders", ["order_id"]),
        ops.Reference("orders", "customer_id", "building customers", "customer_id"),
        ops.Reference("orders", "product_id", "products", "product_id"),
        ops.Reference("raw_events", "customer_id", "customers", "customer_id"),
        ops.Payload("raw_events", required={"view": "k", "purchase": "page"}, fields="k bigint, page string"),
    ]
    summary = ops.audit_summary(ops.audit(tables, rules), rules)
    least, greatest = F.try_element_at("examples", F.lit(1)), F.try_element_at("examples", F.lit(-1))
    return summary.select("rule", "bad_values", "bad_rows", least.alias("least_value"), greatest.alias("greatest_value"))


def compacted_table(spark, sf_dir):
    """Order lines by status, one of them with half of the rows, in files of about one size."""
    operational, _ = bindings(spark)
    by_status = TableSpec(T.StructType([f for f in ORDERS.schema if f.name != "status"] + [ORDERS.schema["status"]]), "", ("status",))
    sinks.create_table(spark, operational, "orders", by_status, listed=True)
    lines = star.order_lines(spark, sf_dir).select(*by_status.names)
    sinks.append(spark, operational, "orders", lines.repartition(16), partition_by=())
    sizes = [size for *_, size in scan_sizes(spark, operational)]
    target = max(sum(sizes) // 12, 1)
    plans.compact(spark, operational, "orders", by_status, target)
    after = scan_sizes(spark, operational)
    large = {status for status, total, _ in after if total > 1.5 * target}
    even = all(0.5 * target <= size <= 1.5 * target for status, _, size in after if status in large)
    rows = scan_table(spark, operational, "orders").groupBy("status").agg(F.count(F.lit(1)).alias("rows"))
    return rows.withColumn("fewer_files", F.lit(len(after) < len(sizes))).withColumn("even_files", F.lit(even))


def scan_sizes(spark, binding):
    """(status, bytes of the status, bytes of the file) for each file."""
    files = scan_table(spark, binding, "orders").select("status", "_metadata.file_path", "_metadata.file_size").distinct().collect()
    total = {}
    for r in files:
        total[r["status"]] = total.get(r["status"], 0) + r["file_size"]
    return [(r["status"], total[r["status"]], r["file_size"]) for r in files]


# Projections, filters, sorts


def filter_ne_in(spark, sf_dir):
    """Lines and units by status under two conditions, from one count by status."""
    status = F.col("status")
    labels = F.array(
        F.when(status != "CANCELLED", "not cancelled"), F.when(status.isin("DELIVERED", "SHIPPED"), "fulfilled")
    )
    counts = star.status_counts(spark, sf_dir).select(F.explode(labels).alias("selection"), "status", "lines", "units")
    return counts.where("selection IS NOT NULL")


def labelled_projection(spark, sf_dir):
    return star.order_lines(spark, sf_dir).select(
        F.lit("orders").alias("tbl"),
        "product_id",
        "order_id",
        F.col("quantity").cast("bigint").alias("units"),
        F.round(F.col("quantity") * F.col("unit_price"), 2).alias("amount"),
        F.coalesce("status", F.lit("UNKNOWN")).alias("status"),
    )


def sort_multi_key(spark, sf_dir):
    return star.customers(spark, sf_dir, signup=False).orderBy("region", "tier", F.desc("customer_id"))


# Metadata


def _registered(spark, sf_dir):
    operational, analytical = bindings(spark)
    for binding, names in ((operational, STAR_TABLES), (analytical, OTHER_TABLES)):
        for name in names:
            sinks.register_files(spark, binding, name, f"{sf_dir}/{name}.parquet")
    return operational, analytical


def inventory(spark, sf_dir):
    return federated_inventory(spark, _registered(spark, sf_dir)).select(
        "catalog_name", "table_name", "position", "column_name", "data_type", "row_count"
    )


def file_report_by_table(spark, sf_dir):
    operational, analytical = _registered(spark, sf_dir)
    reports = {name: file_report(spark, operational, name) for name in STAR_TABLES}
    reports |= {name: file_report(spark, analytical, name) for name in OTHER_TABLES}
    return (
        stacked(reports, "tbl")
        .groupBy("tbl", "file_format")
        .agg(F.sum("record_count").alias("record_count"))
    )


def reset_owned(spark, sf_dir):
    operational, analytical = bindings(spark)
    plans.load_tables(
        spark,
        operational,
        {"products": star.products(spark, sf_dir), "raw_events": star.raw_events(spark, sf_dir)},
        {name: OPERATIONAL[name] for name in ("products", "raw_events")},
    )
    sinks.register_files(spark, analytical, "customer", f"{sf_dir}/customer.parquet")
    targets = [(operational, "products"), (operational, "raw_events"), (analytical, "customer")]
    first = plans.reset(spark, targets).withColumnRenamed("outcome", "first_outcome")
    second = plans.reset(spark, targets).withColumnRenamed("outcome", "second_outcome")
    remaining = ops.labelled_counts(
        {
            "products": scan_files(spark, operational.location("products"), PRODUCTS),
            "raw_events": scan_files(spark, operational.location("raw_events"), RAW_EVENTS),
            "customer": scan_table(spark, analytical, "customer"),
        }
    ).withColumnRenamed("rows", "rows_in_files")
    for name in ("products", "raw_events"):  # made anew, they are empty
        sinks.create_table(spark, operational, name, OPERATIONAL[name])
    anew = {name: scan_table(spark, operational, name) for name in ("products", "raw_events")}
    anew = ops.labelled_counts(anew).withColumnRenamed("rows", "rows_made_anew")
    return first.join(second, ["catalog_name", "tbl"]).join(remaining, "tbl").join(anew, "tbl", "left")


# Rows in the program, few files, comments and properties


def inline_rows_joined(spark, sf_dir):
    """Rows written out in the program, by name and by place, beside the customers of their region."""
    spec = TableSpec(T.StructType([column("region", T.StringType(), "name"), column("code", T.StringType(), "short")]))
    named = inline_rows(spark, [{"region": "ASIA", "code": "AS"}, {"region": "EUROPE"}], spec)
    placed = inline_rows(spark, [("AFRICA", "AF")], spec)
    customers = star.customers(spark, sf_dir, signup=False).groupBy("region").agg(F.expr("count(*) AS customers"))
    return named.unionByName(placed).join(customers, "region", "left")


def few_files(spark, sf_dir):
    """A table appended in as many files as asked for."""
    operational, _ = bindings(spark)
    sinks.create_table(spark, operational, "products", PRODUCTS)
    sinks.append(spark, operational, "products", star.products(spark, sf_dir), target_files=2)
    return file_report(spark, operational, "products").agg(
        F.count(F.lit(1)).alias("files"), F.sum("record_count").alias("rows")
    )


def table_comments(spark, sf_dir):
    """Comments of the columns of a loaded table, and how many values each has."""
    operational, _ = bindings(spark)
    plans.load_tables(spark, operational, {"products": star.products(spark, sf_dir)}, {"products": PRODUCTS})
    listed = federated_inventory(spark, [operational]).where("table_name = 'products'")
    stored = scan_table(spark, operational, "products")
    values = stored.agg(*[F.count(name).alias(name) for name in PRODUCTS.names]).unpivot([], PRODUCTS.names, "column_name", "n_values")
    return listed.select("column_name", "comment").join(values, "column_name")


def table_properties(spark, sf_dir):
    """File format and codec asked for when a table is made, beside its rows."""
    operational, _ = bindings(spark)
    sinks.create_table(spark, operational, "products", PRODUCTS, LAKEHOUSE_PROPERTIES)
    sinks.append(spark, operational, "products", star.products(spark, sf_dir))
    kept = spark.sql(f"SHOW TBLPROPERTIES {operational.table('products')}").where(F.col("key").isin(*LAKEHOUSE_PROPERTIES))
    counts = ops.labelled_counts({"products": scan_table(spark, operational, "products")})
    return kept.withColumn("tbl", F.lit("products")).join(counts, "tbl").select("key", "value", "rows")


# Contracts


def _references(spark, sf_dir):
    """Child rows with their key and weight, and the parents they refer to."""
    buying = star.order_line_counts(spark, sf_dir)
    bought = star.order_lines(spark, sf_dir)
    events = star.raw_events(spark, sf_dir, region=False)
    buyers = star.customers(spark, sf_dir, signup=False, region=False)
    offered = star.products(spark, sf_dir)
    return {
        "orders.customer_id": (buying, "o_custkey", buyers, "customer_id", "lines"),
        "orders.product_id": (bought, "product_id", offered, "product_id", None),
        "raw_events.customer_id": (events, "customer_id", buyers, "customer_id", None),
    }


def orphan_keys(spark, sf_dir):
    """Child rows of every reference, and those whose key no parent has."""
    reports = {}
    for name, (child, key, parent, parent_key, weight) in _references(spark, sf_dir).items():
        rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
        orphans = ops.orphan_keys(child, key, parent, parent_key, weight=weight)
        orphans = orphans.agg(F.count(F.lit(1)).alias("orphan_keys"), F.coalesce(F.sum("rows"), F.lit(0)).alias("orphan_rows"))
        counts = orphans.unionByName(child.agg(rows.alias("child_rows")), allowMissingColumns=True)
        reports[name] = counts.agg(*[F.max(c).alias(c) for c in ("child_rows", "orphan_keys", "orphan_rows")])
    return stacked(reports, "reference")


def orphan_keys_of_filtered_parents(spark, sf_dir):
    """Keys whose parent is of another segment, or no longer offered."""
    chosen = {"customer_id": "tier = 'BUILDING'", "product_id": "is_active"}
    found = {
        name: ops.orphan_keys(child, key, parent.where(chosen[parent_key]), parent_key, weight=weight)
        for name, (child, key, parent, parent_key, weight) in _references(spark, sf_dir).items()
    }
    return stacked(found, "reference")


def domain_violations(spark, sf_dir):
    regions = star.customers(spark, sf_dir, signup=False)
    tiers = star.customers(spark, sf_dir, signup=False, region=False)
    lines = star.status_counts(spark, sf_dir)
    events = star.raw_events(spark, sf_dir, region=False)
    known_statuses = ["PENDING", "SHIPPED", "DELIVERED"]
    return stacked(
        {
            "customers.region": ops.domain_violations(regions, "region", ["AMERICA", "EUROPE", "ASIA"]),
            "customers.tier": ops.domain_violations(tiers, "tier", ["BUILDING", "MACHINERY"]),
            "orders.status": ops.domain_violations(lines, "status", known_statuses, weight="lines"),
            "raw_events.event_type": ops.domain_violations(events, "event_type", ["view", "purchase"]),
        },
        "domain",
    )


def duplicate_keys(spark, sf_dir):
    customers = star.customers(spark, sf_dir, signup=False, region=False)
    events = star.raw_events(spark, sf_dir, region=False)
    found = {
        "customers": ops.duplicate_keys(customers, "customer_id"),
        "products": ops.duplicate_keys(star.products(spark, sf_dir), "product_id"),
        "orders": ops.duplicate_keys(star.order_line_counts(spark, sf_dir), "o_orderkey", weight="lines"),
        "raw_events": ops.duplicate_keys(events, "event_id"),
    }
    return stacked({name: df.toDF("key", "rows") for name, df in found.items()}, "tbl")


def bad_dates(spark, sf_dir):
    orders = star.read(spark, sf_dir, "orders")
    lines = star.order_line_counts(spark, sf_dir).selectExpr(
        "CAST(CAST(o_orderdate AS DATE) AS STRING) AS order_date", "lines"
    )
    times = orders.selectExpr("CAST(o_orderdate AS STRING) AS o_orderdate")
    return stacked(
        {
            "order_date": ops.bad_dates(lines, "order_date", weight="lines"),
            "o_orderpriority": ops.bad_dates(orders, "o_orderpriority"),
            "o_orderdate": ops.bad_dates(times, "o_orderdate"),
        },
        "column_name",
    )


def payload_fields(spark, sf_dir):
    return ops.payload_fields(star.read(spark, sf_dir, "events"), "k bigint", "props")


def payload_gaps(spark, sf_dir):
    return ops.payload_gaps(
        star.read(spark, sf_dir, "events"),
        {"view": "k", "purchase": "page"},
        "k bigint, page string",
        "props",
    )


QUERIES = {
    "regional_summary": regional_summary,
    "product_revenue": product_revenue,
    "customer_ltv": customer_ltv,
    "event_funnel": event_funnel,
    "customer_ltv_top5": customer_ltv_top5,
    "sensor_ranking": sensor_ranking,
    "dedup_distinct": dedup_distinct,
    "ingest_readings": ingest_readings,
    "dedup_and_rank": dedup_and_rank,
    "rerun_append_growth": rerun_append_growth,
    "load_reconciliation": load_reconciliation,
    "labelled_counts": labelled_counts,
    "positional_append": positional_append,
    "partitioned_roundtrip": partitioned_roundtrip,
    "pruned_read": pruned_read,
    "replicate_partitions": replicate_partitions,
    "write_evidence": write_evidence_by_partition,
    "load_history": load_history,
    "directory_publish": directory_publish,
    "publish_verification": publish_verification,
    "publish_self_read": publish_self_read,
    "aggregates_from_tables": aggregates_from_tables,
    "overwrite_idempotent": overwrite_idempotent,
    "cross_catalog_copy": cross_catalog_copy,
    "ordered_write": ordered_write,
    "replicate_changes": replicate_changes,
    "chosen_partitions": chosen_partitions,
    "published_partitions": published_partitions,
    "refreshed_regions": refreshed_regions,
    "refreshed_revenue": refreshed_revenue,
    "refreshed_ltv": refreshed_ltv,
    "refreshed_funnel": refreshed_funnel,
    "exact_revenue": exact_revenue,
    "incremental_distinct": incremental_distinct,
    "bucketed_ltv": bucketed_ltv,
    "resumed_copy": resumed_copy,
    "load_quarantine": load_quarantine,
    "audit_in_one_pass": audit_in_one_pass,
    "compacted_table": compacted_table,
    "filter_ne_in": filter_ne_in,
    "labelled_projection": labelled_projection,
    "sort_multi_key": sort_multi_key,
    "federated_inventory": inventory,
    "file_report": file_report_by_table,
    "reset_owned": reset_owned,
    "inline_rows_joined": inline_rows_joined,
    "few_files": few_files,
    "table_comments": table_comments,
    "table_properties": table_properties,
    "orphan_keys": orphan_keys,
    "orphan_keys_of_filtered_parents": orphan_keys_of_filtered_parents,
    "domain_violations": domain_violations,
    "duplicate_keys": duplicate_keys,
    "bad_dates": bad_dates,
    "payload_fields": payload_fields,
    "payload_gaps": payload_gaps,
}
