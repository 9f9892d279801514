"""Register result tables, compute and write their rows, verify by reading back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions.dates import typed_dates
from lakeweave.operators.analytics import customer_ltv, event_funnel, product_revenue, regional_summary
from lakeweave.schemas import ANALYTICAL, TableSpec
from lakeweave.sinks.ddl import create_table, ensure_namespace
from lakeweave.sinks.history import Load, record_loads
from lakeweave.sinks.writes import Written, conform, fingerprint, overwrite, replace_files, tracks_partitions
from lakeweave.sources.bindings import CatalogBinding
from lakeweave.sources.tables import scan_table


def register(
    spark: SparkSession,
    target: CatalogBinding,
    specs: Mapping[str, TableSpec] = ANALYTICAL,
    comment: str = "results derived from the operational tables",
) -> None:
    """Create namespace and empty tables; no rows yet."""
    ensure_namespace(spark, target, comment)
    for name, spec in specs.items():
        create_table(spark, target, name, spec, listed=True)


def compute_aggregates(
    customers: DataFrame, products: DataFrame, orders: DataFrame, events: DataFrame
) -> dict[str, DataFrame]:
    """The four aggregates of the operational tables, or of views of them.

    Stored tables keep dates as ISO strings, whose MIN and MAX would sort all rows: they are
    turned into dates first, and a value that is none is an error.
    """
    customers, orders = with_dates(customers, "signup_date"), with_dates(orders, "order_date")
    return {
        "regional_summary": regional_summary(customers),
        "product_revenue": product_revenue(orders, products),
        "customer_ltv": customer_ltv(customers, orders),
        "event_funnel": event_funnel(events),
    }


def with_dates(df: DataFrame, column: str) -> DataFrame:
    return typed_dates(df, column) if dict(df.dtypes).get(column) == "string" else df


def write_result(
    spark: SparkSession,
    target: CatalogBinding,
    table: str,
    result: DataFrame,
    spec: TableSpec,
    sort_within: Sequence[str] = (),
) -> Written:
    """Replace a result's rows; in one switch, but for tables whose partitions the catalog keeps."""
    rows = conform(result, spec.schema)
    how = {"partition_by": spec.partition_by, "sort_within": sort_within}
    if target.kind == "v2" or (spec.partition_by and tracks_partitions(spark, target.table(table))):
        return overwrite(spark, target, table, rows, **how)
    return replace_files(spark, target, table, rows, **how)


def publish(
    spark: SparkSession,
    target: CatalogBinding,
    results: Mapping[str, DataFrame],
    specs: Mapping[str, TableSpec] = ANALYTICAL,
    sort_within: Mapping[str, Sequence[str]] | None = None,
) -> dict[str, Written]:
    """Replace the rows of each result table and return how many were written.

    Tables of the session catalog are written to a fresh folder and then pointed at it, so a
    result may read its own table and a failure leaves the old rows, partitioned or not. Tables of plugin
    catalogs, and partitioned ones that ``register`` did not make, are written through the catalog.
    ``sort_within`` orders the rows of each file of a table.
    """
    sort_within = sort_within or {}
    done: list[Load] = []
    try:
        for name, result in results.items():
            done.append(Load(name, "overwrite", write_result(spark, target, name, result, specs[name], sort_within.get(name, ()))))
    finally:  # a failing table must not hide the ones before it
        record_loads(spark, target, done)
    return {load.table: load.rows for load in done}


def verify(spark: SparkSession, target: CatalogBinding, written: Mapping[str, Written]) -> DataFrame:
    """Rows written and rows the registered table returns, side by side.

    ``verified`` takes the same number of rows and the same sum of their hashes, so stale rows
    do not pass for new ones.
    """
    tables = {name: scan_table(spark, target, name) for name in written}
    read_back = reduce(
        DataFrame.unionByName, (df.agg(*fingerprint(df)).withColumn("tbl", F.lit(name)) for name, df in tables.items())
    )
    expected = [(name, int(rows), rows.digest) for name, rows in written.items()]
    expected = spark.createDataFrame(expected, "tbl string, rows_written bigint, digest_written string")
    return expected.join(read_back, "tbl", "left").selectExpr(
        "tbl",
        "rows_written",
        "rows AS rows_read",
        "rows_written <=> rows AND digest_written <=> digest AS verified",
    )
