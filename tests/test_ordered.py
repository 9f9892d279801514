"""Writes in order, and replacements of partitioned tables in one switch."""

from __future__ import annotations

from functools import reduce

import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave import plans, sinks
from lakeweave.schemas import RAW_EVENTS, TableSpec, column
from lakeweave.sinks import writes
from lakeweave.sinks.writes import conform, layout, location_of, tracks_partitions
from lakeweave.sources import file_ranges, inline_rows, overlapping_files, scan_partitions, scan_table
from tests import seed
from tests.conftest import rows

NUMBERS = TableSpec(T.StructType([column("k", T.LongType(), "key"), column("v", T.StringType(), "value")]))
PARTED = TableSpec(T.StructType([*NUMBERS.schema.fields, column("p", T.StringType(), "partition")]), "", ("p",))


@pytest.fixture
def events(spark):
    return inline_rows(spark, seed.BOTH["raw_events"], RAW_EVENTS)


@pytest.fixture
def skewed(spark):
    """A third of the rows carry one key, and half of those are equal rows; some keys are NULL."""
    k = F.when(F.col("id") % 3 == 0, 500).when(F.col("id") % 100 != 1, F.pmod(F.xxhash64("id"), F.lit(1000)))
    v = F.when((F.col("id") % 6 == 0), "same").otherwise(F.col("id").cast("string"))
    return spark.range(0, 30_000, 1, 6).select(k.alias("k"), v.alias("v"))


def in_order(df, column, by=()):
    """Whether every file holds its rows in order."""
    each = df.select("_metadata.file_path", "_metadata.row_index", column).collect()
    files = {}
    for r in sorted(each, key=lambda r: (r[0], r[1])):
        files.setdefault(r[0], []).append((r[2] is not None, r[2]))
    return len(files), all(f == sorted(f) for f in files.values())


def test_files_do_not_overlap_with_a_third_of_the_rows_on_one_key(spark, operational, skewed):
    sinks.create_table(spark, operational, "numbers", NUMBERS)
    assert sinks.overwrite(spark, operational, "numbers", skewed, order_by=["k"], target_files=12) == 30_000
    table = scan_table(spark, operational, "numbers")
    ranges = file_ranges(table, "k")
    files = [r.asDict() for r in ranges.collect()]
    assert overlapping_files(ranges).collect() == []
    assert len(files) == 12 and sum(f["record_count"] for f in files) == 30_000
    # The heavy key fills several files, and none holds much more than its share.
    assert sum(f["low"] == f["high"] == 500 for f in files) >= 2
    assert max(f["record_count"] for f in files) < 2.5 * 30_000 / 12
    assert in_order(table, "k") == (12, True)
    assert table.groupBy("k", "v").count().exceptAll(skewed.groupBy("k", "v").count()).count() == 0


def test_unordered_files_overlap(spark, operational, skewed):
    sinks.create_table(spark, operational, "numbers", NUMBERS)
    sinks.append(spark, operational, "numbers", skewed)
    assert overlapping_files(file_ranges(scan_table(spark, operational, "numbers"), "k")).count() > 0


def test_order_within_partitions(spark, operational, skewed):
    sinks.create_table(spark, operational, "parted", PARTED)
    rows = skewed.withColumn("p", F.when(F.length("v") > 3, F.substring("v", 1, 1)))
    sinks.overwrite(spark, operational, "parted", rows, partition_by=["p"], order_by=["k"], target_files=9)
    table = scan_table(spark, operational, "parted")
    assert overlapping_files(file_ranges(table, "k", ["p"]), ["p"]).collect() == []
    assert in_order(table, "k")[1]
    assert table.count() == 30_000


def test_order_by_sorts_files_already(spark, operational, skewed):
    sinks.create_table(spark, operational, "numbers", NUMBERS)
    with pytest.raises(ValueError, match="sort_within"):
        sinks.overwrite(spark, operational, "numbers", skewed, order_by=["k"], sort_within=["v"])


def test_small_ranges_are_joined_without_a_number_of_files(spark, operational, skewed):
    sinks.create_table(spark, operational, "numbers", NUMBERS)
    sinks.overwrite(spark, operational, "numbers", skewed.limit(50), order_by=["k", "v"])
    ranges = file_ranges(scan_table(spark, operational, "numbers"), "k")
    assert overlapping_files(ranges).count() == 0 and ranges.agg(F.sum("record_count")).first()[0] == 50


def test_many_rows_in_few_files_are_put_together_from_ranges(spark, operational, skewed, monkeypatch, tmp_path):
    monkeypatch.setattr(writes, "RANGE_BYTES", 64 * 1024)
    monkeypatch.setattr(writes, "workspace", lambda spark: str(tmp_path / "work"))
    with layout(spark, skewed, target_files=3, order_by=["k"]) as laid:
        ranges = sorted((tmp_path / "work" / "ranges").glob("*.parquet"))
        assert len(ranges) >= 12 and max(spark.read.parquet(str(f)).count() for f in ranges) < 30_000 / 6
        assert "Sort" not in laid._jdf.queryExecution().executedPlan().toString()
    assert not (tmp_path / "work").exists()
    sinks.create_table(spark, operational, "numbers", NUMBERS)
    for write, times in ((sinks.overwrite, 1), (sinks.append, 2)):
        assert write(spark, operational, "numbers", skewed, order_by=["k"], target_files=3) == 30_000
        table = scan_table(spark, operational, "numbers")
        assert in_order(table, "k") == (3 * times, True)
        assert table.groupBy("k", "v").count().exceptAll(reduce(DataFrame.unionAll, [skewed] * times).groupBy("k", "v").count()).count() == 0
        if times == 1:
            files = file_ranges(table, "k")
            assert overlapping_files(files).collect() == []
            assert files.agg(F.max("record_count")).first()[0] < 2 * 30_000 / 3
    assert not (tmp_path / "work").exists()
    assert spark.conf.get("spark.sql.unionOutputPartitioning", None) is None


def test_values_of_all_types_are_put_together_from_ranges(spark, operational, monkeypatch):
    monkeypatch.setattr(writes, "RANGE_BYTES", 4 * 1024)
    spec = TableSpec(
        T.StructType([column(n, T._parse_datatype_string(t), n) for n, t in (
            ("k", "string"), ("d", "date"), ("n", "decimal(20,3)"), ("a", "array<string>"), ("m", "map<string,int>"),
            ("s", "struct<x:int,y:string>"), ("b", "binary"), ("f", "double"), ("t", "timestamp"))])
    )
    df = spark.range(0, 600, 1, 3).selectExpr(
        "IF(id % 7 = 0, NULL, CAST(id % 50 AS STRING)) AS k", "DATE '2024-01-01' + CAST(id AS INT) AS d", "CAST(CAST(id AS DECIMAL(20,3)) / 7 AS DECIMAL(20,3)) AS n",
        "IF(id % 5 = 0, NULL, array('a', NULL, CAST(id AS STRING))) AS a", "map('x', CAST(id AS INT)) AS m", "named_struct('x', CAST(id AS INT), 'y', 'z') AS s",
        "CAST(CAST(id AS STRING) AS BINARY) AS b", "IF(id % 11 = 0, NULL, id / 3) AS f", "TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(CAST(id AS INT)) AS t",
    )
    sinks.create_table(spark, operational, "mixed", spec)
    assert sinks.overwrite(spark, operational, "mixed", df, order_by=["k", "d"], target_files=2) == 600
    table = scan_table(spark, operational, "mixed")
    assert in_order(table, "k") == (2, True)
    assert rows(table) == rows(conform(df, spark.table(operational.table("mixed")).schema))


def test_no_rows_in_few_files(spark, operational, skewed):
    sinks.create_table(spark, operational, "numbers", NUMBERS)
    assert sinks.overwrite(spark, operational, "numbers", skewed.limit(0), order_by=["k"], target_files=3) == 0
    assert scan_table(spark, operational, "numbers").count() == 0


@pytest.mark.parametrize("range_bytes", [1024, 2**40])
def test_few_files_in_order_are_not_written_over_what_they_are_read_from(spark, operational, skewed, monkeypatch, range_bytes):
    monkeypatch.setattr(writes, "RANGE_BYTES", range_bytes)
    sinks.create_table(spark, operational, "numbers", NUMBERS)
    sinks.append(spark, operational, "numbers", skewed.limit(500))
    table = scan_table(spark, operational, "numbers")
    with pytest.raises(AnalysisException):
        sinks.overwrite(spark, operational, "numbers", table, order_by=["k"], target_files=3)
    assert table.count() == 500


def test_ranges_of_text_count_equal_values_before_they_sort(spark, operational, skewed):
    sinks.create_table(spark, operational, "numbers", NUMBERS)
    sinks.append(spark, operational, "numbers", skewed.withColumn("v", F.expr("IF(k % 9 = 0, NULL, CAST(k % 40 AS STRING))")))
    table = scan_table(spark, operational, "numbers")
    ranges = file_ranges(table, "v")
    for used in (ranges, ranges.select("low", "high"), overlapping_files(ranges)):
        plan = used._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Aggregate [") == 2
    each = table.select("_metadata.file_path", "v").collect()
    found = {r["file_path"]: tuple(r)[1:] for r in ranges.collect()}
    assert found.keys() == {r[0] for r in each}
    for path, (n, low, high) in found.items():
        values = [r["v"] for r in each if r["file_path"] == path]
        held = [v for v in values if v is not None]
        assert (n, low, high) == (len(values), min(held), max(held))


def daily(events):
    return events.withColumn("k", F.col("event_id")).selectExpr("k", "event_type AS v", "region AS p")


def test_a_partitioned_result_is_switched_as_a_whole(spark, analytical, events):
    specs = {"parted": PARTED}
    plans.register(spark, analytical, specs)
    name = analytical.table("parted")
    assert not tracks_partitions(spark, name)
    plans.publish(spark, analytical, {"parted": daily(events)}, specs)
    first, before = location_of(spark, name), rows(scan_table(spark, analytical, "parted"))
    assert before == rows(daily(events))
    # It may read itself, and partitions that get no rows are gone.
    held = scan_table(spark, analytical, "parted")
    written = plans.publish(spark, analytical, {"parted": held.where("p <> 'EMEA'")}, specs)
    assert rows(scan_table(spark, analytical, "parted")) == rows(daily(events).where("p <> 'EMEA'"))
    assert all(r["verified"] for r in plans.verify(spark, analytical, written).collect())
    assert sinks.old_runs(spark, analytical, "parted") == [first]
    assert [f for f in scan_table(spark, analytical, "parted").inputFiles() if first in f] == []


def test_a_failing_partitioned_result_leaves_all_old_rows(spark, analytical, events):
    specs = {"parted": PARTED}
    plans.register(spark, analytical, specs)
    plans.publish(spark, analytical, {"parted": daily(events)}, specs)
    name = analytical.table("parted")
    place, before = location_of(spark, name), rows(scan_table(spark, analytical, "parted"))
    late = F.when(F.col("k") == daily(events).agg(F.max("k")).first()[0], F.raise_error(F.lit("stop")).cast("bigint")).otherwise(F.col("k"))
    with pytest.raises(PySparkException, match="stop"):
        plans.publish(spark, analytical, {"parted": daily(events).withColumn("k", late)}, specs)
    assert location_of(spark, name) == place
    assert rows(scan_table(spark, analytical, "parted")) == before
    assert len(sinks.old_runs(spark, analytical, "parted")) <= 1  # what the failed write left


def test_an_empty_partitioned_result(spark, analytical, events):
    specs = {"parted": PARTED}
    plans.register(spark, analytical, specs)
    plans.publish(spark, analytical, {"parted": daily(events)}, specs)
    plans.publish(spark, analytical, {"parted": daily(events).limit(0)}, specs)
    assert scan_table(spark, analytical, "parted").count() == 0


def test_partitions_kept_by_the_catalog_are_not_switched(spark, operational, events):
    sinks.create_table(spark, operational, "parted", PARTED)
    assert tracks_partitions(spark, operational.table("parted"))
    with pytest.raises(ValueError, match="at once"):
        sinks.replace_files(spark, operational, "parted", daily(events), partition_by=["p"])


def test_a_named_replacement_is_done_once(spark, operational, skewed):
    sinks.create_table(spark, operational, "numbers", NUMBERS)
    assert not sinks.is_done(spark, operational, "numbers", "one")
    sinks.replace_files(spark, operational, "numbers", skewed, run="one")
    assert sinks.is_done(spark, operational, "numbers", "one") and not sinks.is_done(spark, operational, "numbers", "two")
    sinks.replace_files(spark, operational, "numbers", skewed.limit(3), run="two")
    assert sinks.is_done(spark, operational, "numbers", "two") and scan_table(spark, operational, "numbers").count() == 3


def test_a_table_of_partitions_prunes_the_scan(spark, operational, events, capsys):
    sinks.create_table(spark, operational, "raw_events", RAW_EVENTS)
    more = events.unionByName(events.withColumn("region", F.lit(None).cast("string")))
    sinks.append(spark, operational, "raw_events", more, partition_by=RAW_EVENTS.partition_by)
    stored = scan_table(spark, operational, "raw_events")
    parts = stored.select("event_date", "region").distinct().orderBy("event_date", "region").collect()
    for wanted in (parts[:1], parts[1:3], [p for p in parts if p["region"] is None][:2], parts, []):
        control = spark.createDataFrame([(r["region"], r["event_date"], 1) for r in wanted], "region string, event_date string, note int")
        got = scan_partitions(stored, RAW_EVENTS, chosen=control)
        assert got.columns == stored.columns
        listed = spark.createDataFrame([tuple(r) for r in wanted], "d string, r string")
        same = F.col("event_date").eqNullSafe(F.col("d")) & F.col("region").eqNullSafe(F.col("r"))
        assert rows(got) == rows(more.join(listed, same, "left_semi").select(*stored.columns))
    some = spark.createDataFrame([(parts[-1]["event_date"],)], "event_date string")
    got = scan_partitions(stored, RAW_EVENTS, chosen=some.where("length(event_date) = 10"))
    capsys.readouterr()
    got.explain("formatted")
    assert "dynamicpruning" in capsys.readouterr().out.lower()
    assert {r["event_date"] for r in got.collect()} == {parts[-1]["event_date"]}
    with pytest.raises(ValueError, match="partition column"):
        scan_partitions(stored, RAW_EVENTS, chosen=some.toDF("day"))
