"""A replica copies the partitions that differ, and knows which without reading its own data."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lakeweave import plans, sinks
from lakeweave.plans import sync
from lakeweave.schemas import RAW_EVENTS
from lakeweave.sinks.writes import empty_partitions
from lakeweave.sources import scan_table
from tests.conftest import rows


@pytest.fixture
def events(spark):
    """Events of 12 partitions, one of them the partition of NULL, with repeated rows and NULLs in columns."""
    region = F.when(F.col("id") % 4 < 3, F.concat(F.lit("R"), (F.col("id") % 4).cast("string")))
    each = spark.range(240).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 7 > 0, F.col("id") % 11).alias("customer_id"),
        F.lit("page_view").alias("event_type"),
        F.lit(None).cast("string").alias("session_id"),
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("payload"),
        F.concat(F.lit("2024-01-0"), (F.col("id") % 3 + 1).cast("string")).alias("event_date"),
        region.alias("region"),
    )
    return each.unionByName(each.where("event_id % 50 = 0"))


@pytest.fixture
def replica(spark, operational, analytical, events):
    sinks.create_table(spark, operational, "raw_events", RAW_EVENTS)
    sinks.append(spark, operational, "raw_events", events, partition_by=RAW_EVENTS.partition_by)
    return plans.Replica(spark, operational, analytical, "raw_events", RAW_EVENTS, ["event_id"], buckets=8)


def replace(spark, operational, events, **conditions):
    part = events
    for name, value in conditions.items():
        part = part.where(F.col(name).eqNullSafe(F.lit(value)))
    return lambda change: sinks.overwrite_partitions(spark, operational, "raw_events", change(part))


def files(spark, binding):
    return set(scan_table(spark, binding, "raw_events").inputFiles())


def test_only_what_differs_is_copied(spark, operational, analytical, events, replica):
    first = replica.sync()
    assert (first.rows, first.new, first.changed, first.gone) == (245, 12, 0, 0)
    assert rows(scan_table(spark, analytical, "raw_events")) == rows(events)
    again, before = replica.sync(), files(spark, analytical)
    assert (again.rows, again.new, again.changed, again.gone) == (0, 0, 0, 0)

    # One row of one partition changes, one partition of NULL goes, and there is a new one.
    replace(spark, operational, events, event_date="2024-01-01", region="R0")(
        lambda part: part.withColumn("payload", F.when(F.col("event_id") == 0, "changed").otherwise(F.col("payload")))
    )
    empty_partitions(spark, operational, "raw_events", [{"event_date": "2024-01-02", "region": None}])
    sinks.append(spark, operational, "raw_events", events.limit(3).withColumn("region", F.lit("new")), partition_by=RAW_EVENTS.partition_by)
    news = events.limit(3).select("event_date").distinct().count()
    changes = {(r["event_id"], r["region"], r["change"]) for r in replica.row_changes().collect()}
    assert {c for c in changes if c[2] == "changed"} == {(0, "R0", "changed")}
    assert {c[1] for c in changes if c[2] == "removed"} == {None} and {c[1] for c in changes if c[2] == "added"} == {"new"}
    second = replica.sync()
    assert (second.new, second.changed, second.gone) == (news, 1, 1)
    assert rows(scan_table(spark, analytical, "raw_events")) == rows(scan_table(spark, operational, "raw_events"))
    after = files(spark, analytical)
    touched = {f for f in before - after}
    assert touched and all("R0" in f and "2024-01-01" in f or "2024-01-02" in f and "HIVE_DEFAULT" in f for f in touched)
    assert replica.sync().rows == 0 and replica.row_changes().count() == 0


def test_the_number_of_copies_of_a_row_counts(spark, operational, analytical, events, replica):
    replica.sync()
    replace(spark, operational, events, event_date="2024-01-03", region="R2")(lambda part: part.distinct())
    assert {(r["event_id"], r["change"]) for r in replica.row_changes().collect()} == {(50, "changed")}
    assert replica.sync().changed == 1
    assert rows(scan_table(spark, analytical, "raw_events")) == rows(scan_table(spark, operational, "raw_events"))


def test_equal_partitions_cost_no_read_of_the_target(spark, analytical, replica, monkeypatch):
    replica.sync()
    read = []
    scan = sync.scan_table
    monkeypatch.setattr(sync, "scan_table", lambda s, binding, table: read.append((binding.name, table)) or scan(s, binding, table))
    replica.sync()
    assert set(read) == {("operational", "raw_events"), ("analytical", "raw_events_digests")}


def test_a_failure_on_the_way_is_made_up_for(spark, operational, analytical, events, replica, monkeypatch):
    replica.sync()
    replace(spark, operational, events, event_date="2024-01-01", region="R0")(lambda part: part.withColumn("payload", F.lit("x")))
    empty_partitions(spark, operational, "raw_events", [{"event_date": "2024-01-02", "region": "R1"}])

    def fails(*args, **kwargs):
        raise RuntimeError("stopped")

    for step in ("empty_partitions", "replace_files"):
        with monkeypatch.context() as patch:
            patch.setattr(sync, step, fails)
            with pytest.raises(RuntimeError, match="stopped"):
                replica.sync()
    assert replica.sync().rows > 0
    assert rows(scan_table(spark, analytical, "raw_events")) == rows(scan_table(spark, operational, "raw_events"))
    assert replica.sync().rows == 0


def test_selected_partitions(spark, operational, analytical, events, replica):
    part = replica.sync(values={"region": ["R0"]})
    assert part.new == 3 and part.rows == scan_table(spark, analytical, "raw_events").count()
    replace(spark, operational, events, event_date="2024-01-01", region="R0")(lambda p: p.withColumn("payload", F.lit("x")))
    other = replica.sync(values={"region": ["R1"]}, ranges={"event_date": ("2024-01-01", "2024-01-02")})
    assert (other.new, other.changed) == (2, 0)
    whole = replica.sync()
    assert (whole.new, whole.changed) == (7, 1)
    assert rows(scan_table(spark, analytical, "raw_events")) == rows(scan_table(spark, operational, "raw_events"))


def test_recheck_finds_what_others_wrote(spark, operational, analytical, events, replica):
    replica.sync()
    sinks.append(spark, analytical, "raw_events", events.limit(2), partition_by=RAW_EVENTS.partition_by)
    assert replica.sync().rows == 0
    assert replica.sync(recheck=True).changed >= 1
    assert rows(scan_table(spark, analytical, "raw_events")) == rows(scan_table(spark, operational, "raw_events"))


def test_hashes_tell_nulls_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), (None, None)], "x string, y string")
    assert df.select(sync.row_hash(df)).distinct().count() == 3


def test_an_empty_source(spark, operational, analytical):
    sinks.create_table(spark, operational, "raw_events", RAW_EVENTS)
    replica = plans.Replica(spark, operational, analytical, "raw_events", RAW_EVENTS, ["event_id"])
    assert replica.sync().rows == 0 and scan_table(spark, analytical, "raw_events").count() == 0


def test_only_partitioned_tables(spark, operational, analytical):
    with pytest.raises(ValueError, match="partitioned"):
        plans.Replica(spark, operational, analytical, "x", sync.TableSpec(RAW_EVENTS.schema), ["event_id"])
