"""One table of everything the bound catalogs hold."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.sources.bindings import CatalogBinding, bind, quoted

COLUMN_ROWS = (
    "catalog_name string, schema_name string, table_name string, position int, column_name string,"
    " data_type string, comment string, is_partition boolean"
)
TABLE_KEY = ["catalog_name", "schema_name", "table_name"]


def table_names(spark: SparkSession, binding: CatalogBinding) -> list[str]:
    # SHOW TABLES also lists the session's temporary views, which belong to no namespace.
    rows = spark.sql(f"SHOW TABLES IN {binding.full_namespace}").collect()
    return sorted(row["tableName"] for row in rows if not row["isTemporary"])


def namespaces(spark: SparkSession, binding: CatalogBinding) -> list[str]:
    """Namespaces of the binding's catalog.

    A plugin catalog shows up in SHOW CATALOGS only after its first use; this is one.
    """
    bind(spark, binding)
    return sorted(row[0] for row in spark.sql(f"SHOW NAMESPACES IN {quoted(binding.catalog)}").collect())


def list_catalogs(spark: SparkSession, bindings: Sequence[CatalogBinding]) -> list[str]:
    """Names of the session's catalogs, those of the bindings included."""
    for binding in bindings:
        namespaces(spark, binding)
    return sorted(row[0] for row in spark.sql("SHOW CATALOGS").collect())


def table_columns(spark: SparkSession, full_name: str) -> list[tuple]:
    """Position, name, type, comment and partition flag of each column, by one DESCRIBE."""
    described = [tuple(row) for row in spark.sql(f"DESCRIBE TABLE {full_name}").collect()]
    headings = [i for i, row in enumerate(described) if not row[0] or row[0].startswith("#")]
    end = headings[0] if headings else len(described)
    partition_names = {row[0] for row in described[end:]}
    return [
        (position, name, data_type, comment, name in partition_names)
        for position, (name, data_type, comment) in enumerate(described[:end], start=1)
    ]


def table_count(spark: SparkSession, binding: CatalogBinding, table: str) -> DataFrame:
    one_row = spark.table(binding.table(table)).agg(F.count(F.lit(1)).alias("row_count"))
    key = zip((binding.name, binding.namespace, table), TABLE_KEY)
    return one_row.select(*[F.lit(value).alias(name) for value, name in key], "row_count")


def federated_inventory(
    spark: SparkSession, bindings: Sequence[CatalogBinding], with_counts: bool = True
) -> DataFrame:
    """Catalog, schema, table, column, type and comment over all bindings.

    The columns are metadata the driver asks the catalogs for; ``row_count`` is a Spark
    aggregate over each table. ``with_counts=False`` reads metadata only.
    """
    tables = [
        (binding, table)
        for binding in bindings
        if binding.namespace in namespaces(spark, binding)
        for table in table_names(spark, binding)
    ]
    columns = spark.createDataFrame(
        [
            (binding.name, binding.namespace, table, *entry)
            for binding, table in tables
            for entry in table_columns(spark, binding.table(table))
        ],
        COLUMN_ROWS,
    )
    if not with_counts or not tables:
        return columns.withColumn("row_count", F.lit(None).cast("bigint"))
    counts = reduce(DataFrame.unionAll, [table_count(spark, *table) for table in tables])
    return columns.join(counts, TABLE_KEY, "left")
