"""The seed rows through the whole flow give the known results."""

from __future__ import annotations

import pytest

from lakeweave import operators as ops
from lakeweave import plans
from lakeweave.schemas import OPERATIONAL
from lakeweave.sources import commit_history, file_report, inline_rows, scan_table
from tests import seed
from tests.conftest import rows


def frames(spark, batch):
    return {name: inline_rows(spark, data, OPERATIONAL[name]) for name, data in batch.items()}


@pytest.fixture(scope="module")
def star(spark):
    return frames(spark, seed.BOTH)


def ltv_by_customer(df):
    return {
        row["customer_id"]: (row["total_orders"], row["lifetime_value"], row["last_order_date"])
        for row in df.collect()
    }


def test_aggregates(star):
    assert rows(ops.regional_summary(star["customers"])) == seed.REGIONAL_SUMMARY
    assert rows(ops.product_revenue(star["orders"], star["products"])) == seed.PRODUCT_REVENUE
    ltv = ops.customer_ltv(star["customers"], star["orders"])
    assert ltv_by_customer(ltv) == seed.CUSTOMER_LTV
    assert [row["customer_name"] for row in ops.top_customers(ltv).collect()] == seed.TOP_CUSTOMERS
    assert rows(ops.event_funnel(star["raw_events"])) == seed.EVENT_FUNNEL


def test_two_loads_then_publish(spark, operational, analytical):
    first = plans.load_tables(spark, operational, frames(spark, seed.BATCH_1), positional=True)
    assert rows(first) == [("customers", 5), ("orders", 10), ("products", 5), ("raw_events", 7)]
    second = plans.load_with_reconciliation(spark, operational, frames(spark, seed.BATCH_2))
    assert rows(second) == [
        ("customers", 5, 5, 10, True),
        ("orders", 10, 10, 20, True),
        ("products", 5, 5, 10, True),
        ("raw_events", 7, 8, 15, True),
    ]
    for name in OPERATIONAL:
        history = commit_history(spark, operational, name).collect()
        assert [(h["operation"], h["rows_written"]) for h in history] == [
            ("append", len(seed.BATCH_1[name])),
            ("append", len(seed.BATCH_2[name])),
        ]
        assert rows(scan_table(spark, operational, name)) == sorted(
            seed.BOTH[name], key=lambda row: tuple((v is not None, str(v)) for v in row)
        )

    plans.register(spark, analytical)
    stored = {name: scan_table(spark, operational, name) for name in OPERATIONAL}
    results = plans.compute_aggregates(
        stored["customers"], stored["products"], stored["orders"], stored["raw_events"]
    )
    for name in results:
        assert scan_table(spark, analytical, name).count() == 0
    written = plans.publish(spark, analytical, results)
    assert written == {"regional_summary": 8, "product_revenue": 9, "customer_ltv": 10, "event_funnel": 10}
    assert all(row["verified"] for row in plans.verify(spark, analytical, written).collect())
    assert rows(scan_table(spark, analytical, "regional_summary")) == seed.REGIONAL_SUMMARY
    assert rows(scan_table(spark, analytical, "product_revenue")) == seed.PRODUCT_REVENUE
    assert ltv_by_customer(scan_table(spark, analytical, "customer_ltv")) == seed.CUSTOMER_LTV
    assert rows(scan_table(spark, analytical, "event_funnel")) == seed.EVENT_FUNNEL

    # Publishing again replaces, it does not add.
    assert plans.publish(spark, analytical, results) == written
    assert rows(scan_table(spark, analytical, "event_funnel")) == seed.EVENT_FUNNEL


def test_sensor_flow(spark, operational, analytical):
    from lakeweave.schemas import SENSOR_READINGS

    readings = inline_rows(spark, seed.READINGS, SENSOR_READINGS)
    stored = plans.ingest_readings(spark, operational, readings, target_files=1)
    assert rows(stored) == sorted(seed.READINGS, key=lambda row: tuple((True, str(v)) for v in row))
    files = file_report(spark, operational, "sensor_readings").collect()
    assert [(f["file_format"], f["record_count"]) for f in files] == [("PARQUET", 10)]

    assert plans.ingest_readings(spark, operational, readings, target_files=1).count() == 20
    for _ in range(2):
        report = plans.dedup_and_rank(spark, operational, analytical)
        assert (report.raw_rows, report.distinct_rows) == (20, 10)
    ranked = scan_table(spark, analytical, "sensor_readings_ac").collect()
    assert {row["sensor_id"]: row["ranking"] for row in ranked} == seed.BANDS
    assert len(ranked) == 10


def test_payload_of_the_seed_events(star):
    fields = {row["event_id"]: row for row in ops.payload_fields(star["raw_events"]).collect()}
    assert fields[9001]["page"] == "/home" and fields[9001]["order_id"] is None
    assert fields[9002]["product_id"] == 102
    assert fields[9015]["order_id"] == 1018
    gaps = rows(ops.payload_gaps(star["raw_events"]))
    assert gaps == [("add_to_cart", 4, 0), ("page_view", 4, 0), ("purchase", 5, 0), ("refund", 2, 0)]


def test_seed_rows_keep_their_contracts(star):
    for name, key in (("customers", "customer_id"), ("products", "product_id"), ("orders", "order_id")):
        assert ops.duplicate_keys(star[name], key).count() == 0
    assert ops.orphan_keys(star["orders"], "customer_id", star["customers"], "customer_id").count() == 0
    assert ops.orphan_keys(star["raw_events"], "customer_id", star["customers"], "customer_id").count() == 0
    assert ops.domain_violations(star["customers"], "region", ["AMER", "EMEA", "APAC"]).count() == 0
    assert ops.bad_dates(star["orders"], "order_date").count() == 0
