"""A copy that stopped ends with every row once."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lakeweave import plans, sinks
from lakeweave.schemas import PRODUCTS, RAW_EVENTS
from lakeweave.sources import inline_rows, scan_table
from tests import seed
from tests.conftest import rows


@pytest.fixture
def products(spark, operational):
    df = inline_rows(spark, seed.BOTH["products"], PRODUCTS)
    sinks.create_table(spark, operational, "products", PRODUCTS)
    sinks.append(spark, operational, "products", df, target_files=5)
    return df


@pytest.fixture
def copy(spark, operational, analytical):
    def run(transform=lambda df: df, run="one", group_bytes=1):
        return plans.resumable_copy(spark, operational, "products", analytical, "copied", PRODUCTS, run, transform, group_bytes)

    return run


def failing_on(product):
    wrong = F.when(F.col("product_id") == product, F.raise_error(F.lit("stop")).cast("double")).otherwise(F.col("list_price"))
    return lambda df: df.withColumn("list_price", wrong)


def copied(spark, analytical):
    return rows(scan_table(spark, analytical, "copied"))


def test_a_failed_copy_is_taken_up_again(spark, operational, analytical, products, copy):
    n = len(scan_table(spark, operational, "products").inputFiles())
    with pytest.raises(PySparkException, match="stop"):
        copy(failing_on(products.agg(F.max("product_id")).first()[0]))
    assert copied(spark, analytical) == []
    done = copy()
    assert (done.rows, done.copied + done.skipped) == (products.count(), n)
    assert copied(spark, analytical) == rows(products)
    again = copy()
    assert (again.copied, again.skipped) == (0, n) and copied(spark, analytical) == rows(products)


def test_the_old_rows_stay_until_all_groups_are_there(spark, analytical, products, copy):
    copy()
    with pytest.raises(PySparkException, match="stop"):
        copy(failing_on(products.agg(F.max("product_id")).first()[0]), run="two")
    assert copied(spark, analytical) == rows(products)
    doubled = lambda df: df.withColumn("list_price", F.col("list_price") * 2)
    copy(doubled, run="three")
    assert copied(spark, analytical) == rows(doubled(products))


def test_groups_of_replaced_files_leave_nothing_behind(spark, operational, analytical, products, copy):
    copy()
    sinks.overwrite(spark, operational, "products", products.limit(4), target_files=2)
    done = copy()
    assert done.rows == 4 and done.skipped == 0
    assert copied(spark, analytical) == rows(scan_table(spark, operational, "products"))


def test_groups_by_bytes_and_an_empty_table(spark, operational, analytical, products, copy):
    assert copy(group_bytes=1 << 40).copied == 1 and copied(spark, analytical) == rows(products)
    sinks.overwrite(spark, operational, "products", products.limit(0))
    assert copy(run="empty").rows == 0 and copied(spark, analytical) == []


def test_partitioned_tables_are_left_to_replicas(spark, operational, analytical):
    with pytest.raises(ValueError, match="Replica"):
        plans.resumable_copy(spark, operational, "x", analytical, "x", RAW_EVENTS, "one")
