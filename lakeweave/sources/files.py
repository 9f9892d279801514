"""What a write left behind: data files and their row counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.sources.bindings import CatalogBinding


def files_of(df: DataFrame, file_format: str = "parquet") -> DataFrame:
    """Path, format, row count and size of each file behind a file-based DataFrame.

    No data column is read: the scan takes the row counts from the file footers and adds
    the path, and each task sums its own files before anything is shuffled.
    """
    return (
        df.select(F.col("_metadata.file_path"), F.col("_metadata.file_size"))
        .groupBy("file_path", "file_size")
        .agg(F.count(F.lit(1)).alias("record_count"))
        .select(
            "file_path",
            F.lit(file_format.upper()).alias("file_format"),
            "record_count",
            F.col("file_size").alias("size_bytes"),
        )
    )


def file_report(spark: SparkSession, binding: CatalogBinding, table: str) -> DataFrame:
    """Data files of a table; a lakehouse table answers from its own file list."""
    if binding.format == "iceberg":
        return spark.table(f"{binding.table(table)}.files").select(
            "file_path", "file_format", "record_count", F.col("file_size_in_bytes").alias("size_bytes")
        )
    return files_of(spark.table(binding.table(table)), binding.format)


def file_ranges(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, least and greatest value of a column in each file behind a file-based DataFrame.

    ``by`` are partition columns, to tell partitions apart. Only ``column`` is read. Spark sorts all
    rows for MIN and MAX of a string. So equal ones of a file are counted first, and sorted are only
    the different ones.
    """
    value = df.select(*by, F.col("_metadata.file_path"), F.col(column).alias("value"))
    if not isinstance(value.schema["value"].dataType, (T.StringType, T.BinaryType)):
        return value.groupBy(*by, "file_path").agg(
            F.count(F.lit(1)).alias("record_count"), F.min("value").alias("low"), F.max("value").alias("high")
        )
    counted = value.groupBy(*by, "file_path", "value").agg(F.count(F.lit(1)).alias("n"))
    # Without the use of n, Spark would take the counting away wherever record_count is not asked for.
    held = F.when(F.col("n") > 0, F.col("value"))
    return counted.groupBy(*by, "file_path").agg(
        F.sum("n").alias("record_count"), F.min(held).alias("low"), F.max(held).alias("high")
    )


def overlapping_files(ranges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The files that begin below the end of one before them; none where the writes were in order.

    Ranges may have their border value in common. One row per file is sorted, within each partition.
    """
    before = Window.partitionBy(*by).orderBy("low", "high", "file_path").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("reached", F.max("high").over(before)).where("low < reached")


def write_evidence(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """Every matching file below ``root`` with size and time; file contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
    )
