"""Plans: what is pushed down, what is shuffled, and what happens to hot keys."""

from __future__ import annotations

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from lakeweave import benchmark_queries as queries
from lakeweave import operators as ops
from lakeweave import plans, sinks
from lakeweave.functions import typed_dates
from lakeweave.schemas import OPERATIONAL, ORDERS, PRODUCTS, RAW_EVENTS
from lakeweave.session import CHECKPOINT_DIR, cluster_conf, shuffle_partitions, workspace
from lakeweave.sinks.writes import laid_out
from lakeweave.sources import file_report, inline_rows, scan_partitions, scan_table
from lakeweave.sources import star_views as star
from tests import seed

ADAPTIVE = "spark.sql.adaptive."


@contextmanager
def settings(spark, conf):
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def plan_of(df, capsys, mode="formatted"):
    capsys.readouterr()
    df.explain(mode)
    return capsys.readouterr().out


def test_filters_and_columns_reach_the_scan(spark, sf_dir, capsys):
    plan = plan_of(queries.product_revenue(spark, sf_dir), capsys)
    assert "In(o_orderstatus, [F,O,P])" in plan
    assert "Or(IsNull(l_returnflag),Not(EqualTo(l_returnflag,R)))" in plan
    assert (
        "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double,l_extendedprice:double,"
        "l_returnflag:string>" in plan
    )
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def test_status_pushdown_changes_no_row(spark, sf_dir):
    every = star.order_lines(spark, sf_dir)
    for statuses in (("DELIVERED", "SHIPPED"), ("PENDING",), ("CANCELLED", "PENDING")):
        chosen = star.order_lines(spark, sf_dir, statuses)
        assert chosen.exceptAll(every.where(F.col("status").isin(*statuses))).count() == 0
        assert chosen.count() == every.where(F.col("status").isin(*statuses)).count() > 0


def test_partition_filters_prune_folders(spark, operational, capsys, sf_dir):
    sinks.create_table(spark, operational, "raw_events", RAW_EVENTS)
    events = star.raw_events(spark, sf_dir)
    sinks.append(spark, operational, "raw_events", events, partition_by=RAW_EVENTS.partition_by)
    table = scan_table(spark, operational, "raw_events")
    chosen = scan_partitions(table, RAW_EVENTS, {"region": ["ASIA"]}, {"event_date": ("2024-01-02", "2024-01-03")})
    plan = plan_of(chosen, capsys)
    filters = re.search(r"PartitionFilters: (.*)", plan).group(1)
    assert "region" in filters and "event_date" in filters
    files = chosen.select("_metadata.file_path").distinct().collect()
    assert files and all("region=ASIA" in row[0] and "event_date=2024-01-0" in row[0] for row in files)


def test_top_k_needs_no_sort(spark, sf_dir, capsys):
    assert "TakeOrderedAndProject" in plan_of(queries.customer_ltv_top5(spark, sf_dir), capsys)


def test_nothing_is_broadcast_by_hint_or_crossed(spark, sf_dir, capsys):
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        for query in (queries.regional_summary, queries.product_revenue, queries.customer_ltv, queries.orphan_keys):
            plan = plan_of(query(spark, sf_dir), capsys)
            assert "Broadcast" not in plan and "Cartesian" not in plan


def test_typed_dates_avoid_sorting(spark, capsys):
    dated = spark.range(100).select((F.col("id") % 7).alias("k"), F.lit("2024-01-01").alias("d"))
    dated = dated.withColumn("d", F.concat("d", F.substring(F.col("k").cast("string"), 2, 1)))
    latest = lambda df: df.groupBy("k").agg(F.max("d"))
    assert "SortAggregate" in plan_of(latest(dated), capsys)
    assert "SortAggregate" not in plan_of(latest(typed_dates(dated, "d")), capsys)


def test_facts_are_aggregated_before_the_join(spark, sf_dir, capsys):
    """The join's inputs are one row per key: an aggregate sits right below either side."""
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        for query in (queries.customer_ltv, queries.event_funnel):
            plan = plan_of(query(spark, sf_dir), capsys, "simple")
            join = next(line for line in plan.splitlines() if "SortMergeJoin" in line)
            below = plan.split(join, 1)[1]
            assert below.index("HashAggregate") < below.index("SortMergeJoin")


# Cluster-sized thresholds scaled down to the fixtures.
SMALL_SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    ADAPTIVE + "autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "16",
    ADAPTIVE + "skewJoin.skewedPartitionThresholdInBytes": "20KB",
    ADAPTIVE + "advisoryPartitionSizeInBytes": "20KB",
    ADAPTIVE + "coalescePartitions.minPartitionSize": "1KB",
    ADAPTIVE + "skewJoin.skewedPartitionFactor": "2",
}


@pytest.mark.parametrize("hot_user", [7, None])
def test_hot_customer_is_split_in_the_join(spark, sf_dir, tmp_path, capsys, hot_user):
    """A third of all events of one customer, or of none: whole in the result, split on the way."""
    n = 60_000
    events = spark.range(n).select(
        F.col("id").alias("event_id"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"),
        F.when(F.col("id") % 3 == 0, F.lit(hot_user).cast("bigint")).otherwise(F.col("id") % 150).alias("user_id"),
        F.lit("view").alias("event_type"),
        F.lit(1.0).alias("value"),
        F.sha2(F.col("id").cast("string"), 256).alias("props"),
    )
    events.repartition(12).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("customer", "nation", "region"):
        star.read(spark, sf_dir, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    with settings(spark, SMALL_SKEW):
        located = star.raw_events(spark, str(tmp_path))
        found = located.toPandas()
        plan = plan_of(located, capsys, "simple")
    assert "skew=true" in plan
    assert len(found) == n and found["event_id"].is_unique
    assert found["region"].isna().sum() == (0 if hot_user is not None else n // 3)


def test_hot_order_is_split_in_the_join(spark, tmp_path, capsys):
    """A third of all lines on one order: adaptive execution divides that partition."""
    n = 60_000
    lines = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("l_orderkey"),
        (F.col("id") % 100).alias("l_partkey"),
        F.lit(1).cast("bigint").alias("l_suppkey"),
        F.lit(1).alias("l_linenumber"),
        F.lit(2.0).alias("l_quantity"),
        F.lit(10.0).alias("l_extendedprice"),
        F.lit(0.0).alias("l_discount"),
        F.lit(0.0).alias("l_tax"),
        F.lit("N").alias("l_returnflag"),
        F.lit("O").alias("l_linestatus"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("l_shipdate"),
    )
    orders = spark.range(5000).select(
        F.col("id").alias("o_orderkey"),
        (F.col("id") % 50).alias("o_custkey"),
        F.lit("F").alias("o_orderstatus"),
        F.lit(1.0).alias("o_totalprice"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("o_orderdate"),
        F.lit("5-LOW").alias("o_orderpriority"),
    )
    lines.repartition(12).write.parquet(str(tmp_path / "lineitem.parquet"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    with settings(spark, SMALL_SKEW):
        sold = ops.analytics.sales_by(star.order_lines(spark, str(tmp_path)), "customer_id")
        rows = {row["customer_id"]: row["lines"] for row in sold.collect()}
        plan = plan_of(sold, capsys, "simple")
    assert "skew=true" in plan
    assert sum(rows.values()) == n
    assert rows[7] > n / 3


def test_hot_partition_is_written_by_several_tasks(spark, operational):
    sinks.create_table(spark, operational, "raw_events", RAW_EVENTS)
    n = 40_000
    events = (
        spark.range(n, numPartitions=8)
        .select(
            F.col("id").alias("event_id"),
            F.lit(1).alias("customer_id"),
            F.lit("page_view").alias("event_type"),
            F.lit("s").alias("session_id"),
            F.sha2(F.col("id").cast("string"), 256).alias("payload"),
            F.when(F.col("id") % 3 == 0, "2024-01-01")
            .otherwise(F.concat(F.lit("2024-02-"), F.lpad((F.col("id") % 20 + 1).cast("string"), 2, "0")))
            .alias("event_date"),
            F.lit("AMER").alias("region"),
        )
    )
    conf = {ADAPTIVE + "advisoryPartitionSizeInBytes": "200KB", "spark.sql.shuffle.partitions": "16"}
    with settings(spark, conf):
        assert sinks.append(spark, operational, "raw_events", events, partition_by=RAW_EVENTS.partition_by) == n
    files = file_report(spark, operational, "raw_events").collect()
    hot = [f for f in files if "event_date=2024-01-01" in f["file_path"]]
    cold = [f for f in files if "event_date=2024-02-05" in f["file_path"]]
    assert len(hot) > 1 and sum(f["record_count"] for f in hot) == -(-n // 3)
    assert len(cold) == 1


def test_layout_without_adaptive_execution_adds_no_hot_task(spark):
    df = spark.range(10).withColumn("p", F.lit("x"))
    with settings(spark, {"spark.sql.adaptive.enabled": "false"}):
        assert laid_out(spark, df, ["p"]) is df


def test_copies_are_dropped_before_the_shuffle(spark, capsys):
    copies = spark.range(100_000).select((F.col("id") % 3).alias("a"), F.lit("same").alias("b"))
    plan = plan_of(ops.distinct_rows(copies), capsys, "simple")
    assert plan.count("HashAggregate") == 2
    assert plan.index("HashAggregate") < plan.index("Exchange") < plan.rindex("HashAggregate")


def test_repeated_dimension_rows_are_collapsed(spark):
    """A third of the products are copies of one: they multiply its sales, as the join does."""
    goods = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("product_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), "id")).alias("name"),
        F.lit("c").alias("category"),
        F.lit("s").alias("sub_category"),
        F.lit(1.0).alias("list_price"),
        F.lit(True).alias("is_active"),
    )
    assert goods.columns == PRODUCTS.names
    sold = spark.createDataFrame([(1, 1, 1, 2, 0.5, "2024-01-01", "SHIPPED")] * 2, ORDERS.schema)
    got = {row["product_name"]: row for row in ops.product_revenue(sold, goods).collect()}
    assert got["hot"]["order_count"] == 2000 and got["hot"]["total_revenue"] == 2000.0
    assert got["p1"]["total_units"] == 4


def test_workspace_follows_the_cluster_setting(spark):
    shared = spark.conf.get(CHECKPOINT_DIR)
    first, second = workspace(spark), workspace(spark)
    assert first.startswith(shared + "/") and first != second


def test_workspace_needs_a_shared_folder_on_a_cluster():
    class Conf(dict):
        pass

    class Session:
        conf = Conf({"spark.master": "spark://somewhere"})

    with pytest.raises(ValueError, match=CHECKPOINT_DIR):
        workspace(Session)
    Session.conf = Conf({"spark.master": "local-cluster[2,1,1024]"})
    with pytest.raises(ValueError, match=CHECKPOINT_DIR):
        workspace(Session)
    for master in ("local", "local[2]", "local[*,3]"):
        Session.conf = Conf({"spark.master": master})
        assert workspace(Session)


def test_cluster_settings():
    assert shuffle_partitions(0, 8) == 16
    assert shuffle_partitions(2 * 2**40, 4000) == 10_486
    assert shuffle_partitions(100 * 2**40, 4000) == 524_288
    conf = cluster_conf(2 * 2**40, 4000)
    assert conf["spark.sql.shuffle.partitions"] == "10486"
    assert conf["spark.sql.adaptive.enabled"] == "true"


def test_aggregates_of_stored_tables_sort_nothing(spark, operational, capsys):
    star_of_seed = {n: inline_rows(spark, seed.BOTH[n], spec) for n, spec in OPERATIONAL.items()}
    plans.load_tables(spark, operational, star_of_seed)
    stored = [scan_table(spark, operational, n) for n in ("customers", "products", "orders", "raw_events")]
    for name, result in plans.compute_aggregates(*stored).items():
        plan = plan_of(result, capsys, "simple")
        assert "SortAggregate" not in plan and "HashAggregate" in plan, name


def test_malformed_dates_of_stored_tables_are_errors(spark, operational):
    customers = spark.createDataFrame([(1, "a", "EMEA", "x", "1 June")], "customer_id long, name string, region string, tier string, signup_date string")
    empty = [inline_rows(spark, [], OPERATIONAL[n]) for n in ("products", "orders", "raw_events")]
    with pytest.raises(Exception, match="not an ISO date"):
        plans.compute_aggregates(customers, *empty)["regional_summary"].collect()


def test_the_count_of_lines_serves_the_join(spark, sf_dir, capsys):
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        plan = plan_of(star.order_line_counts(spark, sf_dir), capsys, "simple")
        assert plan.count("Exchange hashpartitioning") == 2
        assert plan_of(queries.filter_ne_in(spark, sf_dir), capsys, "simple").count("SortMergeJoin") == 1


def test_both_batches_reach_the_scans(spark, sf_dir, capsys):
    orders, events = star.order_lines(spark, sf_dir), star.raw_events(spark, sf_dir, region=False)
    for batch in (queries.FIRST_BATCH, queries.REST):
        assert "(o_orderdate" in plan_of(orders.where(batch["orders"]), capsys, "formatted").split("PushedFilters", 1)[1]
        assert "(ts" in plan_of(events.where(batch["raw_events"]), capsys, "formatted").split("PushedFilters", 1)[1]
