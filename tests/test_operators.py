"""Edge rows, and random rows against a plain Python answer."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import date

import pytest
from pyspark.sql import functions as F

from lakeweave import operators as ops
from lakeweave.functions import typed_dates
from lakeweave.schemas import CUSTOMERS, ORDERS, PRODUCTS, RAW_EVENTS
from lakeweave.sources import inline_rows
from tests.conftest import rows


def customers(spark, *data):
    return inline_rows(spark, [(i, n, None, r, t, d) for i, n, r, t, d in data], CUSTOMERS)


def orders(spark, *data):
    return inline_rows(spark, data, ORDERS)


def test_customers_without_fulfilled_orders_stay(spark):
    people = customers(
        spark,
        (1, "none", "AMER", "PREMIUM", "2024-01-01"),
        (2, "unfulfilled", "AMER", "PREMIUM", "2024-01-01"),
        (3, "one", "EMEA", "STANDARD", "2024-01-01"),
        (None, "no key", "EMEA", "STANDARD", None),
    )
    bought = orders(
        spark,
        (10, 2, 1, 1, 5.0, "2024-02-01", "CANCELLED"),
        (11, 2, 1, 1, 5.0, "2024-02-01", "PENDING"),
        (12, 3, 1, 2, 5.25, "2024-02-03", "SHIPPED"),
        (13, 3, 1, 2, 5.25, "2024-02-04", None),
        (14, None, 1, 2, 5.25, "2024-02-05", "SHIPPED"),
        (15, 99, 1, 2, 5.25, "2024-02-05", "SHIPPED"),
    )
    assert rows(ops.customer_ltv(people, bought)) == [
        (None, "no key", "EMEA", "STANDARD", 0, 0.0, None),
        (1, "none", "AMER", "PREMIUM", 0, 0.0, None),
        (2, "unfulfilled", "AMER", "PREMIUM", 0, 0.0, None),
        (3, "one", "EMEA", "STANDARD", 1, 10.5, "2024-02-03"),
    ]


def test_missing_prices_and_order_keys(spark):
    people = customers(spark, (1, "a", "AMER", "PREMIUM", None))
    bought = orders(
        spark,
        (None, 1, 1, 1, None, "2024-02-01", "SHIPPED"),
        (11, 1, 1, None, 5.0, None, "SHIPPED"),
    )
    # Keys are counted, prices that are missing add nothing.
    assert rows(ops.customer_ltv(people, bought)) == [(1, "a", "AMER", "PREMIUM", 1, 0.0, "2024-02-01")]


def test_products_of_one_name_share_a_row(spark):
    goods = inline_rows(
        spark,
        [(1, "bolt", "H", "C", 1.0, True), (2, "bolt", "H", "C", 2.0, True), (3, "bolt", "H", "D", 2.0, True)],
        PRODUCTS,
    )
    sold = orders(
        spark,
        (10, 1, 1, 1, 1.0, "2024-01-01", "PENDING"),
        (11, 1, 2, 2, 2.0, "2024-01-01", "DELIVERED"),
        (12, 1, 3, 3, 3.0, "2024-01-01", "SHIPPED"),
        (13, 1, 3, 3, 3.0, "2024-01-01", "CANCELLED"),
        (14, 1, 3, 3, 3.0, "2024-01-01", None),
        (15, 1, 4, 3, 3.0, "2024-01-01", "SHIPPED"),
    )
    assert rows(ops.product_revenue(sold, goods)) == [("bolt", "H", "C", 2, 3, 5.0), ("bolt", "H", "D", 1, 3, 9.0)]


def test_events_without_customer_count_as_events_only(spark):
    events = inline_rows(
        spark,
        [
            (1, 7, "refund", None, None, "2024-01-01", "AMER"),
            (2, 7, "refund", None, None, "2024-01-02", "AMER"),
            (3, None, "refund", None, None, "2024-01-02", "AMER"),
            (4, None, "page_view", None, None, "2024-01-02", None),
        ],
        RAW_EVENTS,
    )
    assert rows(ops.event_funnel(events)) == [(None, "page_view", 1, 0), ("AMER", "refund", 3, 1)]
    counted = events.groupBy("region", "event_type", "customer_id").count()
    assert rows(ops.event_funnel(counted, weight="count")) == rows(ops.event_funnel(events))


def test_dates_as_text_and_typed_agree(spark):
    people = customers(spark, (1, "a", "AMER", "PREMIUM", "2024-03-01"), (2, "b", "AMER", "PREMIUM", "2023-12-31"))
    want = [("AMER", "PREMIUM", 2, "2023-12-31", "2024-03-01")]
    assert rows(ops.regional_summary(people)) == want
    assert rows(ops.regional_summary(typed_dates(people, "signup_date"))) == want
    # Text that is no date is compared as text.
    odd = customers(spark, (1, "a", "AMER", "PREMIUM", "9 May"), (2, "b", "AMER", "PREMIUM", "2024-01-01"))
    assert rows(ops.regional_summary(odd)) == [("AMER", "PREMIUM", 2, "2024-01-01", "9 May")]


def test_top_customers_break_ties_by_key(spark):
    ltv = spark.createDataFrame(
        [(3, "c", "r", "t", 1, 5.0, None), (1, "a", "r", "t", 1, 5.0, None), (2, "b", "r", "t", 1, 9.0, None)],
        "customer_id long, customer_name string, region string, tier string, total_orders long,"
        " lifetime_value double, last_order_date string",
    )
    assert [row["customer_name"] for row in ops.top_customers(ltv, 2).collect()] == ["b", "a"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_aggregates_against_plain_python(spark, seed):
    """Random rows with repeated customers and products, and a key holding a third of the orders."""
    rng = random.Random(seed)
    people = [
        (
            rng.choice([None, 1, 2, 3, 4, 5]),
            rng.choice("xy"),
            rng.choice(["AMER", None]),
            rng.choice("PQ"),
            "2024-01-01",
        )
        for _ in range(25)
    ]
    goods = [(rng.randint(1, 6), rng.choice("mn"), rng.choice("HS"), "s", 1.0, True) for _ in range(12)]
    sold = [
        (
            rng.choice([None, i]),
            1 if rng.random() < 1 / 3 else rng.choice([None, 2, 3, 4, 77]),
            rng.choice([None, 1, 2, 3, 4, 5, 6, 88]),
            rng.choice([None, 1, 2, 3]),
            rng.choice([None, 0.25, 1.5, 10.0]),
            f"2024-0{rng.randint(1, 9)}-01",
            rng.choice(["PENDING", "SHIPPED", "DELIVERED", "CANCELLED", None]),
        )
        for i in range(300)
    ]

    def total(lines):
        amounts = [q * p for _, _, _, q, p, _, _ in lines if q is not None and p is not None]
        return round(sum(amounts), 2) if amounts else None

    groups = defaultdict(list)
    for i, name, region, tier, _ in people:
        lines = [o for o in sold if i is not None and o[1] == i and o[6] in ("SHIPPED", "DELIVERED")]
        groups[(i, name, region, tier)] += lines
    want = Counter(
        (*key, sum(o[0] is not None for o in lines), total(lines) or 0.0, max((o[5] for o in lines), default=None))
        for key, lines in groups.items()
    )
    got = ops.customer_ltv(customers(spark, *people), orders(spark, *sold))
    assert Counter(tuple(row) for row in got.collect()) == want

    groups = defaultdict(list)
    for i, name, category, sub, _, _ in goods:
        for o in sold:
            if o[2] == i and o[6] not in (None, "CANCELLED"):
                groups[(name, category, sub)].append(o)
    want = Counter()
    for key, lines in groups.items():
        units = [o[3] for o in lines if o[3] is not None]
        want[(*key, sum(o[0] is not None for o in lines), sum(units) if units else None, total(lines))] += 1
    got = ops.product_revenue(orders(spark, *sold), inline_rows(spark, goods, PRODUCTS))
    assert Counter(tuple(row) for row in got.collect()) == want


def test_contracts_report_violations(spark):
    people = customers(
        spark,
        (1, "a", "AMER", "PREMIUM", "2024-01-01"),
        (1, "b", "MARS", "PREMIUM", "2024-13-01"),
        (2, "c", None, "GOLD", None),
    )
    bought = orders(
        spark,
        (10, 1, 1, 1, 1.0, "2024-01-01", "SHIPPED"),
        (11, 5, 1, 1, 1.0, "soon", "SHIPPED"),
        (12, 5, 1, 1, 1.0, "soon", "LOST"),
        (13, None, 1, 1, 1.0, None, None),
    )
    assert rows(ops.orphan_keys(bought, "customer_id", people, "customer_id")) == [(5, 2)]
    assert rows(ops.domain_violations(people, "region", ["AMER", "EMEA", "APAC"])) == [("MARS", 1)]
    assert rows(ops.domain_violations(people, "tier", ["STANDARD", "PREMIUM", "ENTERPRISE"])) == [("GOLD", 1)]
    assert rows(ops.domain_violations(bought, "status", ["SHIPPED"])) == [("LOST", 1)]
    assert rows(ops.duplicate_keys(people, "customer_id")) == [(1, 2)]
    assert rows(ops.bad_dates(people, "signup_date")) == [("2024-13-01", 1)]
    assert rows(ops.bad_dates(bought, "order_date")) == [("soon", 2)]


def test_contracts_take_counted_rows(spark):
    """Rows counted beforehand give the same report as the rows themselves."""
    data = [(i % 4 or None, ["SHIPPED", "LOST", None][i % 3], ["2024-01-01", "soon"][i % 2]) for i in range(60)]
    plain = spark.createDataFrame(data, "k long, status string, d string")
    counted = plain.groupBy("k", "status", "d").agg(F.count("*").alias("n"))
    parents = spark.createDataFrame([(1,)], "id long")
    for check in (
        lambda df, w: ops.orphan_keys(df, "k", parents, "id", weight=w),
        lambda df, w: ops.domain_violations(df, "status", ["SHIPPED"], weight=w),
        lambda df, w: ops.duplicate_keys(df, "k", "status", weight=w),
        lambda df, w: ops.bad_dates(df, "d", weight=w),
    ):
        assert rows(check(counted, "n")) == rows(check(plain, None)) != []


def test_payload_gaps(spark):
    events = inline_rows(
        spark,
        [
            (1, 1, "purchase", None, '{"order_id": 5}', "2024-01-01", "AMER"),
            (2, 1, "purchase", None, '{"page": "/"}', "2024-01-01", "AMER"),
            (3, 1, "purchase", None, "not json", "2024-01-01", "AMER"),
            (4, 1, "purchase", None, None, "2024-01-01", "AMER"),
            (5, 1, "other", None, None, "2024-01-01", "AMER"),
        ],
        RAW_EVENTS,
    )
    assert rows(ops.payload_gaps(events)) == [("other", 1, 0), ("purchase", 4, 3)]


def test_labelled_counts(spark):
    counts = ops.labelled_counts({"three": spark.range(3), "none": spark.range(0)})
    assert rows(counts) == [("none", 0), ("three", 3)]


def test_typed_dates_give_dates(spark):
    people = customers(spark, (1, "a", "AMER", "PREMIUM", "2024-03-01"))
    assert typed_dates(people, "signup_date").first()["signup_date"] == date(2024, 3, 1)
