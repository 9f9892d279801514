"""Namespaces and tables: created if absent, dropped if owned."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping

from pyspark.sql import SparkSession

from lakeweave.schemas import TableSpec
from lakeweave.sources.bindings import BindingConflict, CatalogBinding, bind, quoted

# Marks the tables this library created; ``reset`` drops no other.
OWNER_PROPERTY = "lakeweave.owned"

# Whether the session catalog keeps a list of the partitions of a table made now.
TRACK_PARTITIONS = "spark.sql.hive.manageFilesourcePartitions"

# File format and codec of lakehouse tables.
LAKEHOUSE_PROPERTIES = {
    "write.format.default": "parquet",
    "write.parquet.compression-codec": "snappy",
}


def sql_string(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def property_list(properties: Mapping[str, str]) -> str:
    return "(" + ", ".join(f"{sql_string(k)} = {sql_string(v)}" for k, v in properties.items()) + ")"


def ensure_namespace(
    spark: SparkSession,
    binding: CatalogBinding,
    comment: str = "",
    properties: Mapping[str, str] | None = None,
) -> None:
    bind(spark, binding)
    clauses = [f"CREATE NAMESPACE IF NOT EXISTS {binding.full_namespace}"]
    if comment:
        clauses.append(f"COMMENT {sql_string(comment)}")
    if binding.root:
        clauses.append(f"LOCATION {sql_string(binding.root)}")
    if properties:
        clauses.append(f"WITH DBPROPERTIES {property_list(properties)}")
    spark.sql(" ".join(clauses))
    if binding.kind == "session":
        check_root(spark, binding)


def check_root(spark: SparkSession, binding: CatalogBinding) -> None:
    """Refuse a namespace that exists with another folder than the binding's."""
    plain = lambda path: re.sub("^file:/+", "/", path).rstrip("/")
    described = spark.sql(f"DESCRIBE NAMESPACE {binding.full_namespace}").collect()
    there = next(row["info_value"] for row in described if row["info_name"] == "Location")
    if plain(there) != plain(binding.root):
        raise BindingConflict(f"{binding.namespace} lies in {there}, not in {binding.root}")


def has_files(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(folder) and len(files.listStatus(folder)) > 0


def create_table(
    spark: SparkSession,
    binding: CatalogBinding,
    table: str,
    spec: TableSpec,
    properties: Mapping[str, str] | None = None,
    listed: bool = False,
    bucket_by: tuple[str, int] | None = None,
    options: Mapping[str, str] | None = None,
) -> None:
    """Create the table if it is absent, over a folder of its own when the binding has a root.

    Files that lie in the folder already, of a table dropped before, are not taken over: the new
    table gets a folder beside it.

    The partitions of a ``listed`` session table are those that its folder holds, where otherwise the catalog keeps a list
    of them: such a table can be switched to another folder as a whole.

    ``bucket_by`` is a column and a number of buckets: rows of one key share a file, and tables of the same buckets are joined and
    grouped by that column without a shuffle. Write to it with the same ``bucket_by``; read it with ``scan_bucketed``.
    ``options`` are those of the format.
    """
    name, location = binding.table(table), binding.location(table)
    if spark.catalog.tableExists(name):
        return
    if location and has_files(spark, location):
        location = f"{location}-{uuid.uuid4().hex[:12]}"
    properties = {OWNER_PROPERTY: "true", **(properties or {})}
    if binding.format == "iceberg":
        properties |= LAKEHOUSE_PROPERTIES
    clauses = [f"CREATE TABLE IF NOT EXISTS {name} ({spec.schema.toDDL()}) USING {binding.format}"]
    if options:
        clauses.append(f"OPTIONS {property_list(options)}")
    if spec.partition_by:
        clauses.append(f"PARTITIONED BY ({', '.join(map(quoted, spec.partition_by))})")
    if bucket_by:
        clauses.append(f"CLUSTERED BY ({quoted(bucket_by[0])}) INTO {bucket_by[1]} BUCKETS")
    if location:
        clauses.append(f"LOCATION {sql_string(location)}")
    if spec.comment:
        clauses.append(f"COMMENT {sql_string(spec.comment)}")
    clauses.append(f"TBLPROPERTIES {property_list(properties)}")
    kept = spark.conf.get(TRACK_PARTITIONS)
    spark.conf.set(TRACK_PARTITIONS, "false" if listed else kept)
    try:
        spark.sql(" ".join(clauses))
    finally:
        spark.conf.set(TRACK_PARTITIONS, kept)


def register_files(spark: SparkSession, binding: CatalogBinding, table: str, path: str) -> None:
    """Name Parquet files that exist already; the table takes their schema and is not owned."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {binding.table(table)} USING {binding.format} LOCATION {sql_string(path)}"
    )


def is_owned(spark: SparkSession, full_name: str) -> bool:
    rows = spark.sql(f"SHOW TBLPROPERTIES {full_name}").collect()
    return {row["key"]: row["value"] for row in rows}.get(OWNER_PROPERTY) == "true"


def drop_table(spark: SparkSession, binding: CatalogBinding, table: str) -> str:
    """Drop one owned table and say what happened.

    The files of an external table stay. A table the library did not create is left alone.
    """
    name = binding.table(table)
    if not spark.catalog.tableExists(name):
        return "absent"
    if not is_owned(spark, name):
        return "not owned"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return "dropped"


def drop_namespace(spark: SparkSession, binding: CatalogBinding) -> None:
    """Forget the namespace and its tables; files of external tables stay."""
    spark.sql(f"DROP NAMESPACE IF EXISTS {binding.full_namespace} CASCADE")
