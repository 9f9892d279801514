"""Aggregates from states equal those over all rows, and distinct rows grow by what is new."""

from __future__ import annotations

import importlib
import math
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave import plans
from lakeweave.operators.states import NEEDED, RESULTS, STATES
from lakeweave.plans.distinct import with_fingerprint
from lakeweave.schemas import OPERATIONAL, SENSOR_READINGS, TableSpec, column
from lakeweave.sources import inline_rows, scan_table
from lakeweave.sources.files import files_of
from tests import seed
from tests.conftest import rows

module = importlib.import_module("lakeweave.plans.refresh")


@pytest.fixture
def batches(spark):
    """The two loads of the operational tables, and one that repeats some of it."""
    make = lambda data: {n: inline_rows(spark, data[n], OPERATIONAL[n]) for n in OPERATIONAL}
    first, both = make(seed.BATCH_1), make(seed.BOTH)
    second = {n: both[n].exceptAll(first[n]) for n in both}
    third = {"orders": first["orders"], "customers": first["customers"].limit(2), "raw_events": both["raw_events"].withColumn("customer_id", -F.col("customer_id"))}
    return [("one", first), ("two", second), ("three", third)]


def recomputed(batches, upto):
    tables = {n: None for n in OPERATIONAL}
    for _, batch in batches[:upto]:
        for name, df in batch.items():
            tables[name] = df if tables[name] is None else tables[name].unionByName(df)
    return plans.compute_aggregates(*(tables[n] for n in ("customers", "products", "orders", "raw_events")))


def close(a, b):
    return len(a) == len(b) and all(
        x == y or (isinstance(x, float) and math.isclose(x, y, abs_tol=0.011)) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True)
    )


def test_results_equal_a_recomputation_after_every_batch(spark, analytical, batches):
    for k, (batch_id, batch) in enumerate(batches, 1):
        plans.refresh(spark, analytical, batch_id, batch)
        expected = recomputed(batches, k)
        for name in RESULTS:
            got = plans.refreshed(spark, analytical, name)
            assert got.columns == expected[name].columns and got.dtypes == expected[name].dtypes
            assert close(rows(got), rows(expected[name])), name


def test_the_order_of_batches_changes_no_bit(spark, operational, analytical, batches):
    for target, order in ((operational, batches), (analytical, batches[::-1])):
        for batch_id, batch in order:
            plans.refresh(spark, target, batch_id, batch)
    for name in RESULTS:
        assert rows(plans.refreshed(spark, operational, name)) == rows(plans.refreshed(spark, analytical, name))


def test_a_batch_is_merged_once(spark, analytical, batches, monkeypatch):
    plans.refresh(spark, analytical, *batches[0])
    replace, calls = module.replace_files, []

    def fails_at_the_third(*args, **kwargs):
        calls.append(args[2])
        if len(calls) == 3:
            raise RuntimeError("stopped")
        return replace(*args, **kwargs)

    with monkeypatch.context() as patch:
        patch.setattr(module, "replace_files", fails_at_the_third)
        with pytest.raises(RuntimeError, match="stopped"):
            plans.refresh(spark, analytical, *batches[1])
    left = plans.refresh(spark, analytical, *batches[1])
    assert set(left) == set(STATES) - set(calls[:2])
    assert plans.refresh(spark, analytical, *batches[1]) == {}
    expected = recomputed(batches, 2)
    for name in RESULTS:
        assert close(rows(plans.refreshed(spark, analytical, name)), rows(expected[name])), name


def test_only_batch_and_state_are_read(spark, analytical, batches):
    plans.refresh(spark, analytical, *batches[0])
    names = plans.refresh(spark, analytical, "two", batches[1][1], ["event_funnel"])
    assert set(names) == set(NEEDED["event_funnel"])
    files = plans.refreshed(spark, analytical, "event_funnel").inputFiles()
    assert files and all("/state_users/" in f for f in files)


def test_many_customers_take_several_bitmaps(spark, analytical):
    ids = spark.range(-40_000, 90_000, 7).select(F.col("id").alias("customer_id"))
    events = ids.unionByName(ids.where("customer_id % 3 = 0")).select("customer_id", F.lit("R").alias("region"), F.lit("view").alias("event_type"))
    other = spark.range(80_000, 200_000, 5).select(F.col("id").alias("customer_id"), F.lit("R").alias("region"), F.lit("view").alias("event_type"))
    nobody = events.limit(5).withColumn("customer_id", F.lit(None).cast("bigint"))
    for batch_id, batch in (("a", events), ("b", other.unionByName(nobody))):
        plans.refresh(spark, analytical, batch_id, {"raw_events": batch}, ["event_funnel"])
    every = events.unionByName(other).unionByName(nobody)
    expected = (every.count(), every.agg(F.count_distinct("customer_id")).first()[0])
    row = plans.refreshed(spark, analytical, "event_funnel").first()
    assert (row["event_count"], row["unique_users"]) == expected


def test_states_reduce_before_the_shuffle(spark, batches, capsys):
    for name, state in STATES.items():
        capsys.readouterr()
        state.of(batches[0][1][state.source]).explain("formatted")
        plan = capsys.readouterr().out
        assert "partial_" in plan, name
        # Events are counted by customer before any is sorted into a bitmap.
        below = plan.split("+- HashAggregate")[-1] if name == "state_users" else plan
        assert "Sort" not in below.split("\n\n")[0], name


# Distinct rows


def test_new_rows_only(spark, analytical):
    readings = inline_rows(spark, seed.READINGS, SENSOR_READINGS)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "a", -0.0, None), (1, "a", None, 0.0, None)], SENSOR_READINGS.schema)
    batch = readings.unionByName(odd)
    first = plans.dedup_increment(spark, analytical, batch.unionByName(batch), buckets=4)
    stored = lambda: plans.scan_distinct(spark, analytical, "sensor_readings_distinct")
    table = scan_table(spark, analytical, "sensor_readings_distinct")
    assert first == batch.distinct().count() == stored().count()
    before = {r["file_path"] for r in files_of(table).collect()}
    assert plans.dedup_increment(spark, analytical, batch, buckets=4) == 0
    more = batch.unionByName(odd.withColumn("sensor_id", F.lit(99)))
    assert plans.dedup_increment(spark, analytical, more, buckets=4) == odd.count()
    after = {r["file_path"] for r in files_of(scan_table(spark, analytical, "sensor_readings_distinct")).collect()}
    assert before < after
    from lakeweave.operators import rank_readings

    assert rows(stored()) == rows(rank_readings(more.distinct()))


def test_only_touched_buckets_are_read(spark, analytical, monkeypatch):
    from lakeweave.plans import distinct as module

    spec = TableSpec(T.StructType([column("k", T.LongType(), "key")]))
    plans.append_distinct(spark, analytical, "numbers", spark.range(5000).toDF("k"), spec)
    seen = []
    original = module.append

    def kept(spark, target, table, new, **how):
        seen.append(new._jdf.queryExecution().toString())
        return original(spark, target, table, new, **how)

    monkeypatch.setattr(module, "append", kept)
    assert plans.append_distinct(spark, analytical, "numbers", spark.range(4999, 5001).toDF("k"), spec) == 1
    physical = seen[0].split("== Physical Plan ==")[1].splitlines()
    scan = next(line for line in physical if re.search(r"PartitionFilters: \[[^\]]*fingerprint_bucket", line))
    assert "ReadSchema: struct<fingerprint_a:bigint,fingerprint_b:bigint>" in scan


def test_a_third_of_the_rows_alike(spark, analytical):
    spec = TableSpec(T.StructType([column("k", T.LongType(), "key")]))
    batch = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("bigint").alias("k"))
    assert plans.append_distinct(spark, analytical, "numbers", batch, spec, buckets=4) == 2001
    assert plans.append_distinct(spark, analytical, "numbers", batch.limit(0), spec, buckets=4) == 0


def test_fingerprints_tell_nulls_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), (None, None), ("a", "a")], "x string, y string")
    assert with_fingerprint(df).select("fingerprint_a").distinct().count() == 4
