"""Rows set aside with reasons, all checks in one pass, files of one size, buckets."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave import operators as ops
from lakeweave import plans, sinks
from lakeweave.plans import quarantine
from lakeweave.plans.compact import file_sizes, planned_tasks
from lakeweave.schemas import CUSTOMERS, ORDERS, TableSpec, column
from lakeweave.sinks import history
from lakeweave.sources import commit_history, scan_bucketed, scan_table
from lakeweave.sources.tables import bucket_sizes
from tests.conftest import rows

ODD = TableSpec(
    T.StructType([column("k", T.IntegerType(), ""), column("raw", T.DoubleType(), ""), column("typed", T.DateType(), ""), column("a b", T.StringType(), "")])
)


# Rows set aside


def test_rows_that_do_not_fit_are_set_aside(spark, operational):
    batch = spark.createDataFrame(
        [("1", "1.5", "2024-01-01", "x"), ("2", "much", "2024-13-01", "y"), ("99999999999", "2", None, "z"), (None, None, None, None), ("5", "-1", "2024-01-02", "w")],
        "k string, raw string, typed string, `a b` string",
    )
    report = plans.load_with_quarantine(spark, operational, "odd", batch, ODD, {"positive": "raw > 0", "short": "length(`a b`) < 2"})
    assert (report.offered, report.accepted, report.rejected, report.reconciled) == (5, 2, 3, True)
    assert sorted(map(str, rows(scan_table(spark, operational, "odd").select("k", "raw", "a b")))) == sorted(map(str, [(1, 1.5, "x"), (None, None, None)]))
    rejects = {json.loads(r["row"])["k"]: [(x["column"], x["reason"], x["value"]) for x in r["reasons"]] for r in scan_table(spark, operational, "odd_rejects").collect()}
    assert rejects == {
        "2": [("raw", "no double", "much"), ("typed", "no date", "2024-13-01")],
        "99999999999": [("k", "no int", "99999999999")],
        "5": [(None, "positive", None)],
    }
    again = plans.load_with_quarantine(spark, operational, "odd", batch.limit(0), ODD)
    assert (again.offered, again.accepted, again.rejected, again.reconciled) == (0, 0, 0, True)
    counts = {(r["column_name"], r["reason"]): r["rows"] for r in plans.reject_reasons(spark, operational, "odd").collect()}
    assert counts == {("raw", "no double"): 1, ("typed", "no date"): 1, ("k", "no int"): 1, (None, "positive"): 1}


def test_the_batch_is_read_once(spark, operational, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    batch = spark.range(100).selectExpr("CAST(id AS STRING) AS k", "'1' AS raw", "'2024-01-01' AS typed", "'x' AS `a b`")
    report = plans.load_with_quarantine(spark, operational, "odd", batch.mapInArrow(noted, batch.schema), ODD)
    assert report.accepted == 100 and reads.value == 100


def test_a_failed_load_changes_no_row_of_the_table(spark, operational, monkeypatch):
    batch = spark.createDataFrame([("1", "1", "2024-01-01", "x"), ("a", "1", "2024-01-01", "x")], "k string, raw string, typed string, `a b` string")
    append = quarantine.append

    def fails(spark, binding, table, df, **how):
        if table == "odd":
            raise RuntimeError("stopped")
        return append(spark, binding, table, df, **how)

    with monkeypatch.context() as patch:
        patch.setattr(quarantine, "append", fails)
        with pytest.raises(RuntimeError):
            plans.load_with_quarantine(spark, operational, "odd", batch, ODD)
    assert scan_table(spark, operational, "odd").count() == 0
    assert plans.load_with_quarantine(spark, operational, "odd", batch, ODD).reconciled


def test_columns_must_be_those_of_the_table(spark, operational):
    with pytest.raises(ValueError, match="stranger"):
        plans.load_with_quarantine(spark, operational, "odd", spark.range(1).toDF("stranger"), ODD)


# All checks in one pass


@pytest.fixture
def tables(spark):
    orders = spark.createDataFrame(
        [(i // 2, i % 7 if i % 5 else None, "SHIPPED" if i % 3 else "LOST", f"2024-01-{i % 40:02d}" if i % 4 else None) for i in range(200)],
        "order_id long, customer_id long, status string, order_date string",
    )
    customers = spark.createDataFrame([(i, "R") for i in (0, 1, 2, 2, 3)] + [(None, "S")], "customer_id long, region string")
    events = spark.createDataFrame(
        [(1, "page_view", '{"page": "x"}'), (2, "page_view", "{}"), (3, "purchase", "no json"), (4, "refund", None), (5, "other", None), (6, None, None)],
        "event_id long, event_type string, payload string",
    )
    return {"orders": orders, "customers": customers, "events": events}


RULES = [
    ops.Domain("orders", "status", ["SHIPPED"]),
    ops.IsoDate("orders", "order_date"),
    ops.Unique("orders", ["order_id"]),
    ops.Unique("orders", ["order_id", "status"]),
    ops.Reference("orders", "customer_id", "customers", "customer_id"),
    ops.Unique("customers", ["customer_id"]),
    ops.Payload("events"),
]


def test_the_audit_equals_the_single_checks(spark, tables):
    found = {}
    for r in ops.audit(tables, RULES).collect():
        found.setdefault(r["rule"], {})[r["value"]] = r["rows"]
    orders, customers, events = tables["orders"], tables["customers"], tables["events"]
    plain = lambda df: {str(r[0]): r["rows"] for r in df.collect()}
    two = ops.duplicate_keys(orders, "order_id", "status").select(F.to_json(F.struct("order_id", "status")), "rows")
    expected = {
        "orders.status in its domain": plain(ops.domain_violations(orders, "status", ["SHIPPED"])),
        "orders.order_date is a date": plain(ops.bad_dates(orders, "order_date")),
        "orders(order_id) is unique": plain(ops.duplicate_keys(orders, "order_id")),
        "orders(order_id, status) is unique": plain(two),
        "orders.customer_id refers to customers": plain(ops.orphan_keys(orders, "customer_id", customers, "customer_id")),
        "customers(customer_id) is unique": plain(ops.duplicate_keys(customers.where("customer_id IS NOT NULL"), "customer_id")),
        "events.payload has its attributes": {r["event_type"]: r["gaps"] for r in ops.payload_gaps(events).collect() if r["gaps"]},
    }
    assert all(expected.values()) and found == expected


def test_one_scan_per_table(spark, tables, tmp_path, capsys):
    stored = {}
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / name))
        stored[name] = spark.read.schema(df.schema).parquet(str(tmp_path / name))
    found = ops.audit(stored, RULES)
    capsys.readouterr()
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert len(re.findall(r"^\(\d+\) Scan parquet", plan, re.M)) == 3 and "Join" not in plan and "partial_sum" in plan


def test_summary_has_every_rule_and_bounded_examples(spark, tables):
    good = ops.Domain("customers", "region", ["R", "S"])
    rules = [*RULES, good]
    summary = {r["rule"]: r for r in ops.audit_summary(ops.audit(tables, rules), rules).collect()}
    assert set(summary) == {r.name for r in rules}
    assert tuple(summary[good.name])[1:] == (0, 0, [])
    repeated = summary["orders(order_id) is unique"]
    assert (repeated["bad_values"], repeated["bad_rows"], repeated["examples"]) == (100, 200, ["0", "99"])


def test_weights_stand_for_rows(spark, tables):
    weighted = tables["orders"].groupBy(*tables["orders"].columns).agg(F.count(F.lit(1)).alias("lines"))
    rules = RULES[:3]
    assert rows(ops.audit({"orders": weighted}, rules, {"orders": "lines"})) == rows(ops.audit(tables, rules))


def test_rules_of_an_unknown_table(tables):
    with pytest.raises(ValueError, match="strangers"):
        ops.audit(tables, [ops.Unique("strangers", ["k"])])


# Files of one size

PARTED = TableSpec(T.StructType([column("k", T.LongType(), ""), column("v", T.StringType(), ""), column("p", T.StringType(), "")]), "", ("p",))


def test_plan_of_tasks():
    sizes = [({"p": n}, size, 1) for n, size in (("huge", 1000), ("a", 60), ("b", 50), ("c", 40), ("d", 45), ("border", 150), ("split", 151))]
    plan, tasks = planned_tasks(sizes, 100)
    files = {part["p"]: n for part, n, _ in plan}
    assert files == {"huge": 10, "split": 2, "border": 1, "a": 1, "b": 1, "c": 1, "d": 1}
    first = {part["p"]: task for part, _, task in plan}
    assert first["a"] == first["c"] and first["b"] == first["d"] != first["a"] and tasks == 10 + 2 + 1 + 2
    taken = [t for part, n, task in plan if part["p"] in ("huge", "split", "border") for t in range(task, task + n)]
    assert len(taken) == len(set(taken)) and not {first["a"], first["b"]} & set(taken)


def test_skewed_partitions_become_files_of_one_size(spark, operational):
    sinks.create_table(spark, operational, "parted", PARTED, listed=True)
    p = F.when(F.col("id") % 3 < 2, "large").when(F.col("id") % 30 < 12, "middle").when(F.col("id") % 100 > 3, F.concat(F.lit("s"), (F.col("id") % 8).cast("string")))
    numbers = spark.range(0, 60_000, 1, 24).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"), p.alias("p")).toDF("k", "v", "p")
    sinks.append(spark, operational, "parted", numbers)
    before = rows(scan_table(spark, operational, "parted").groupBy("p").agg(F.count("*"), F.sum("k"), F.min("v")))
    target = sum(file_sizes(spark, operational, "parted")) // 10
    done = plans.compact(spark, operational, "parted", PARTED, target, sort_within=["k"])
    assert done.rows == 60_000 and done.files_before > 3 * done.files_planned
    files = scan_table(spark, operational, "parted").select("p", "_metadata.file_path", "_metadata.file_size").distinct().collect()
    assert len(files) == done.files_planned
    total = {}
    for f in files:
        total[f["p"]] = total.get(f["p"], 0) + f["file_size"]
    assert all(0.5 * target <= f["file_size"] <= 1.5 * target for f in files if total[f["p"]] > 1.5 * target)
    assert all(n == 1 for n in [sum(f["p"] == q for f in files) for q, size in total.items() if size <= target])
    assert rows(scan_table(spark, operational, "parted").groupBy("p").agg(F.count("*"), F.sum("k"), F.min("v"))) == before


def test_a_table_without_partitions_and_an_empty_one(spark, operational):
    spec = TableSpec(T.StructType(PARTED.schema.fields[:2]))
    sinks.create_table(spark, operational, "plain", spec)
    assert plans.compact(spark, operational, "plain", spec).rows == 0
    numbers = spark.range(0, 20_000, 1, 16).select("id", F.sha2(F.col("id").cast("string"), 256)).toDF("k", "v")
    sinks.append(spark, operational, "plain", numbers)
    target = sum(file_sizes(spark, operational, "plain")) // 4
    plans.compact(spark, operational, "plain", spec, target)
    sizes = file_sizes(spark, operational, "plain")
    assert len(sizes) == 4 and all(0.5 * target <= s <= 1.5 * target for s in sizes)
    assert scan_table(spark, operational, "plain").exceptAll(numbers).count() == 0


# History


def test_the_history_stays_in_few_files(spark, operational, monkeypatch):
    monkeypatch.setattr(history, "MOST_FILES", 5)
    for k in range(23):
        sinks.record_loads(spark, operational, [sinks.Load("t", "append", k)])
    assert len(scan_table(spark, operational, "load_history").inputFiles()) <= 5
    assert [r["rows_written"] for r in commit_history(spark, operational, "t").collect()] == list(range(23))


# Buckets


def bucketed(spark, binding, orders, buckets=("customer_id", 8)):
    customers = orders.select("customer_id").distinct().selectExpr(
        "customer_id", "CAST(customer_id AS STRING) AS name", "NULL AS email", "'R' AS region", "'T' AS tier", "'2024-01-01' AS signup_date"
    )
    for name, df, spec in (("customers", customers, CUSTOMERS), ("orders", orders, ORDERS)):
        sinks.create_table(spark, binding, name, spec, bucket_by=buckets)
        sinks.append(spark, binding, name, df, bucket_by=buckets)
    return customers


def orders_of(spark, customer):
    return spark.range(6000).selectExpr(
        "id AS order_id", f"{customer} AS customer_id", "id AS product_id", "CAST(1 + id % 3 AS INT) AS quantity", "CAST(id AS DOUBLE) AS unit_price",
        "'2024-01-01' AS order_date", "'SHIPPED' AS status",
    )


def test_bucketed_tables_are_joined_without_a_shuffle(spark, operational, capsys):
    orders = orders_of(spark, "id % 300")
    customers = bucketed(spark, operational, orders)
    assert len(bucket_sizes(spark, operational, "orders")) == 8
    ltv = ops.customer_ltv(scan_bucketed(spark, operational, "customers"), scan_bucketed(spark, operational, "orders"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        capsys.readouterr()
        ltv.explain("formatted")
        assert "Exchange" not in capsys.readouterr().out
        assert rows(ltv) == rows(ops.customer_ltv(customers, orders))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_skewed_bucket_is_read_as_any_other_files(spark, operational, capsys):
    orders = orders_of(spark, "CASE WHEN id % 3 > 0 THEN 7 ELSE id % 300 END")
    bucketed(spark, operational, orders)
    scan = scan_bucketed(spark, operational, "orders", most_skew=2.0)
    assert rows(scan) == rows(orders)
    capsys.readouterr()
    scan.groupBy("customer_id").count().explain("formatted")
    assert "Exchange" in capsys.readouterr().out
    whole = scan_bucketed(spark, operational, "orders", most_skew=100.0).groupBy("customer_id").count()
    whole.explain("formatted")
    assert "Exchange" not in capsys.readouterr().out
