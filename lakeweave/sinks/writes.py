"""Appends and overwrites.

Plain Parquet folders have no commit: a failed overwrite may leave the folder empty, and
readers may see a write halfway. Bind a lakehouse catalog where that matters.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager, nullcontext
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.session import workspace
from lakeweave.sources.bindings import CatalogBinding, quoted

# How much one task of a write in order is to sort, in bytes of ``sort_bytes``.
RANGE_BYTES = 128 * 1024 * 1024


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Written(int):
    """Number of rows written; ``digest`` is the sum of their hashes."""

    digest: str = "0"


def conform(
    df: DataFrame, schema: T.StructType, positional: bool = False, absent: Sequence[str] = ()
) -> DataFrame:
    """Columns in the order and of the types of ``schema``.

    Matching is by name: a column of either side that the other lacks is an error, unless
    ``absent`` names it as one that ``df`` leaves NULL. ``positional`` pairs columns by place as
    an INSERT does. A value that does not fit its type is an error, which takes ANSI mode:
    without it a cast would change values, so nothing is written then.
    """
    if df.sparkSession.conf.get("spark.sql.ansi.enabled").lower() != "true":
        raise ValueError("set spark.sql.ansi.enabled to true: values that do not fit must be errors")
    if positional:
        if len(df.columns) != len(schema):
            raise ValueError(f"{len(df.columns)} columns for a table of {len(schema)}")
        df = df.toDF(*schema.fieldNames())
    unknown = sorted(set(df.columns) - set(schema.fieldNames()))
    if unknown:
        raise ValueError(f"the table has no column {', '.join(unknown)}")
    present = set(df.columns)
    missing = sorted(set(schema.fieldNames()) - present - set(absent))
    if missing:
        raise ValueError(f"no values for {', '.join(missing)}; name in absent what is meant to be NULL")
    casts = []
    for f in schema.fields:
        value = quoted(f.name) if f.name in present else "NULL"
        casts.append(f"CAST({value} AS {f.dataType.simpleString()}) AS {quoted(f.name)}")
    return df.selectExpr(*casts)


def laid_out(
    spark: SparkSession,
    df: DataFrame,
    partition_by: Sequence[str] = (),
    target_files: int | None = None,
    sort_within: Sequence[str] = (),
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Distribute rows over write tasks.

    With ``order_by`` the whole is in order, not each file alone; see ``ranged``, and ``in_few_files`` for much in few files.

    ``target_files`` is for a caller who knows that few files are enough; everything ahead
    of the write stays parallel. A partitioned write is rebalanced on its partition columns:
    adaptive execution merges small partitions into one task and splits a big one over
    several, so a partition with a third of all rows is written by many tasks. Without
    adaptive execution nothing could split it, and tasks write what they hold.
    """
    if order_by:
        if sort_within:
            raise ValueError("order_by sorts the files too; leave sort_within out")
        return ranged(df, [*partition_by, *order_by], target_files)
    if target_files is not None:
        df = df.repartition(target_files)
    elif partition_by and spark.conf.get("spark.sql.adaptive.enabled").lower() == "true":
        df = df.hint("rebalance", *partition_by)
    return df.sortWithinPartitions(*sort_within) if sort_within else df


def hashable(df: DataFrame) -> list[str]:
    return [quoted(f.name) for f in df.schema if not isinstance(f.dataType, T.MapType)]


def ranged(df: DataFrame, keys: Sequence[str], target_files: int | None = None) -> DataFrame:
    """Rows in ranges of the keys, a write task for each, and sorted within them.

    Spark samples the rows for the bounds of the ranges. A value with a large share of the rows is split: rows
    of equal keys are dealt out further by a hash of the whole row, and equal rows by the task that holds them.
    Bounds are drawn once for a write, so none of that changes when one of its tasks is run again. So the ranges of two files have at most a border value in
    common. Without ``target_files`` there are as many ranges as shuffle partitions, and adaptive
    execution joins small neighbours.
    """
    tie = "lakeweave tie"
    order = [quoted(k) for k in keys]
    spread = [F.col(k) for k in order] + [F.xxhash64(*hashable(df)), F.col(quoted(tie))]
    tied = df.withColumn(tie, F.spark_partition_id())
    tied = tied.repartitionByRange(*spread) if target_files is None else tied.repartitionByRange(target_files, *spread)
    return tied.drop(tie).sortWithinPartitions(*order)


def sort_bytes(df: DataFrame) -> int:
    """About what the rows take in a sort: 40 bytes and 8 for each column, and what values without a fixed width hold."""
    width = F.lit(40 + 8 * len(df.columns)).cast("bigint")
    for f in df.schema:
        value = F.col(quoted(f.name))
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.to_json(F.struct(value))
        elif not isinstance(f.dataType, (T.StringType, T.BinaryType)):
            continue
        width = width + F.coalesce(F.octet_length(value), F.lit(0))
    return df.agg(F.sum(width)).first()[0] or 0


@contextmanager
def session_setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored_ranges(spark: SparkSession, df: DataFrame, keys: Sequence[str], ranges: int, folder: str) -> list[DataFrame]:
    """Ranges of the keys in their order, each sorted and stored by a task of its own."""
    number = "lakeweave range"
    tagged = ranged(df, keys, ranges).withColumn(number, F.spark_partition_id())
    tagged.write.option("maxRecordsPerFile", 0).parquet(folder)
    stored = spark.read.parquet(folder).select(F.col("_metadata.file_name"), F.col(quoted(number)).alias("number"))
    files = stored.distinct().orderBy("number").collect()  # one row for each range
    return [spark.read.schema(df.schema).parquet(f"{folder}/{r['file_name']}") for r in files]


@contextmanager
def in_few_files(spark: SparkSession, df: DataFrame, keys: Sequence[str], target_files: int) -> Iterator[DataFrame]:
    """Rows in order for ``target_files`` write tasks; write them before the context ends.

    The rows are stored in the workspace first, which tells how much there is to sort. When that is much for a task,
    more tasks sort smaller ranges and store them, and a write task reads those of its file one after the other. So what
    a task sorts does not grow with the files.
    """
    root = workspace(spark)
    try:
        df.write.parquet(f"{root}/rows")
        rows = spark.read.schema(df.schema).parquet(f"{root}/rows")
        per_file = -(-sort_bytes(rows) // (target_files * RANGE_BYTES))
        if per_file <= 1:
            yield ranged(rows, keys, target_files)
            return
        parts = stored_ranges(spark, rows, keys, target_files * per_file, f"{root}/ranges")
        remove_folder(spark, f"{root}/rows")
        files: dict[int, list[DataFrame]] = {}
        for i, part in enumerate(parts):
            files.setdefault(i * target_files // len(parts), []).append(part)
        # A union of single partitions would be a single partition itself, and so one file.
        with session_setting(spark, "spark.sql.unionOutputPartitioning", "false"):
            yield reduce(DataFrame.unionAll, [reduce(DataFrame.unionAll, of).coalesce(1) for of in files.values()])
    finally:
        remove_folder(spark, root)


@contextmanager
def layout(
    spark: SparkSession,
    df: DataFrame,
    partition_by: Sequence[str] = (),
    target_files: int | None = None,
    sort_within: Sequence[str] = (),
    order_by: Sequence[str] = (),
    replaced: str | None = None,
) -> Iterator[DataFrame]:
    """The rows distributed over write tasks, by ``in_few_files`` if few files are to be in order and else by ``laid_out``.

    A table with partitions is left to the latter: Spark would sort the rows of a write task by partition once more.
    ``replaced`` names the table that the rows replace, which they must not come from.
    """
    if not order_by or target_files is None or partition_by or sort_within:
        yield laid_out(spark, df, partition_by, target_files, sort_within, order_by)
        return
    # Spark refuses that too, but would not see it behind stored rows.
    if replaced is not None and not set(spark.table(replaced).inputFiles()).isdisjoint(df.inputFiles()):
        raise AnalysisException(f"cannot overwrite {replaced}, which is also being read from")
    with in_few_files(spark, df, order_by, target_files) as rows:
        yield rows


def fingerprint(df: DataFrame) -> tuple[Column, Column]:
    """Aggregates of all rows: their number, and the sum of their hashes as text."""
    hashes = F.sum(F.xxhash64(*hashable(df)).cast("decimal(20,0)"))
    return F.count(F.lit(1)).alias("rows"), F.coalesce(hashes, F.lit(0)).cast("string").alias("digest")


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """Count and fingerprint rows on their way into the sink.

    The metrics sit in the stage that writes, where a task that is run again is counted
    once.
    """
    seen = Observation()
    return df.observe(seen, *fingerprint(df)), seen


def written(seen: Observation) -> Written:
    out = Written(seen.get["rows"])
    out.digest = seen.get["digest"]
    return out


@contextmanager
def partition_overwrite(spark: SparkSession, mode: str) -> Iterator[None]:
    """Set what an overwrite of a session table replaces: everything, or touched partitions.

    ``insertInto`` does not heed the writer option of this name, only the session setting.
    """
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    spark.conf.set(key, mode)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def append(
    spark: SparkSession,
    binding: CatalogBinding,
    table: str,
    df: DataFrame,
    *,
    positional: bool = False,
    partition_by: Sequence[str] = (),
    target_files: int | None = None,
    sort_within: Sequence[str] = (),
    order_by: Sequence[str] = (),
    bucket_by: tuple[str, int] | None = None,
    absent: Sequence[str] = (),
) -> Written:
    """Add the rows of ``df`` to a table and return how many there were.

    ``partition_by`` names the table's partition columns, for the distribution of rows;
    ``absent`` those that ``df`` leaves NULL. ``sort_within`` orders the rows of each file, ``order_by``
    those of all files written. With ``bucket_by``, that of the table, a bucket is written by one task into one file.
    """
    name = binding.table(table)
    rows = conform(df, spark.table(name).schema, positional, absent)
    if bucket_by:
        dealt = nullcontext(rows.repartition(bucket_by[1], F.col(quoted(bucket_by[0]))))
    else:
        dealt = layout(spark, rows, partition_by, target_files, sort_within, order_by)
    with dealt as rows:
        rows, seen = counted(rows)
        if binding.kind == "v2":
            rows.writeTo(name).append()
        else:
            rows.write.insertInto(name)
    return written(seen)


def overwrite(
    spark: SparkSession,
    binding: CatalogBinding,
    table: str,
    df: DataFrame,
    *,
    partition_by: Sequence[str] = (),
    target_files: int | None = None,
    sort_within: Sequence[str] = (),
    order_by: Sequence[str] = (),
) -> Written:
    """Replace all rows of a table. Spark refuses a ``df`` that reads the same table.

    ``order_by`` puts all rows in order: the files' ranges of these columns do not overlap, within a
    partition of a partitioned table.
    """
    name = binding.table(table)
    rows = conform(df, spark.table(name).schema)
    replaced = None if binding.kind == "v2" else name
    with layout(spark, rows, partition_by, target_files, sort_within, order_by, replaced) as rows:
        rows, seen = counted(rows)
        if binding.kind == "v2":
            rows.writeTo(name).overwrite(F.lit(True))
        else:
            with partition_overwrite(spark, "static"):
                rows.write.insertInto(name, overwrite=True)
    return written(seen)


def overwrite_partitions(
    spark: SparkSession, binding: CatalogBinding, table: str, df: DataFrame, *, partition_by: Sequence[str] = ()
) -> Written:
    """Replace the partitions ``df`` has rows for and leave the others.

    Leave ``partition_by`` out, and with it a shuffle, when ``df`` comes straight from a
    table that is laid out the same way.
    """
    name = binding.table(table)
    rows = conform(df, spark.table(name).schema)
    rows = laid_out(spark, rows, partition_by)
    rows, seen = counted(rows)
    if binding.kind == "v2":
        rows.writeTo(name).overwritePartitions()
    else:
        with partition_overwrite(spark, "dynamic"):
            rows.write.insertInto(name, overwrite=True)
    return written(seen)


def empty_partitions(
    spark: SparkSession, binding: CatalogBinding, table: str, partitions: Iterable[Mapping[str, str | None]]
) -> None:
    """Remove the rows of whole partitions of a session table, files included."""
    name = binding.table(table)
    for values in partitions:
        clause = ", ".join(f"{quoted(c)} = {'NULL' if v is None else literal(v)}" for c, v in values.items())
        none = spark.table(name).drop(*values).schema
        with partition_overwrite(spark, "static"):
            spark.sql(
                f"INSERT OVERWRITE TABLE {name} PARTITION ({clause}) SELECT * FROM {{none}}",
                none=spark.createDataFrame([], none),
            )


def location_of(spark: SparkSession, name: str) -> str:
    """Folder of a table as the catalog has it."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").collect()
    return rows[0]["data_type"]


RUN_FOLDER = r"/run-[0-9a-f]{32}$"


def home_of(spark: SparkSession, name: str) -> str:
    """Folder that holds the folders of a table's runs."""
    return re.sub(RUN_FOLDER, "", location_of(spark, name).rstrip("/"))


def run_folder(spark: SparkSession, name: str, run: str | None = None) -> str:
    """Folder for one replacement of a table; the same for the same name of a run."""
    leaf = uuid.uuid4().hex if run is None else uuid.uuid5(uuid.NAMESPACE_URL, run).hex
    return f"{home_of(spark, name)}/run-{leaf}"


def replace_files(
    spark: SparkSession,
    binding: CatalogBinding,
    table: str,
    df: DataFrame,
    *,
    partition_by: Sequence[str] = (),
    sort_within: Sequence[str] = (),
    order_by: Sequence[str] = (),
    as_dealt: bool = False,
    run: str | None = None,
) -> Written:
    """Replace the rows of a session table by writing a fresh folder.

    The rows go to a new folder below the table's own; only when all are there is the table
    pointed at it. ``df`` may read the table, a failure leaves the old rows, and readers that
    have begun keep their files. Old folders stay, for the storage's lifecycle rules; ``old_runs`` lists them.

    A table with partitions has to find them in its folder (``create_table(..., listed=True)``): one statement then
    switches all of them. Where the catalog keeps a folder for each partition no statement could.

    ``as_dealt`` says that the tasks of ``df`` hold what each is to write. ``run`` names the replacement. The table's folder tells whether it is done (``is_done``), and what an earlier
    attempt of that name left behind is written over.
    """
    name = binding.table(table)
    if partition_by and tracks_partitions(spark, name):
        raise ValueError(f"{table}: the catalog keeps its partitions, so they cannot be switched at once")
    fresh = run_folder(spark, name, run)
    rows, seen = counted(df if as_dealt else laid_out(spark, df, partition_by, sort_within=sort_within, order_by=order_by))
    writer = rows.write.format(binding.format).mode("errorifexists" if run is None else "overwrite")
    writer.option("partitionOverwriteMode", "static").partitionBy(*partition_by).save(fresh)
    spark.sql(f"ALTER TABLE {name} SET LOCATION {literal(fresh)}")
    spark.catalog.refreshTable(name)
    return written(seen)


def is_done(spark: SparkSession, binding: CatalogBinding, table: str, run: str) -> bool:
    """Whether the table's rows are those of the replacement of that name."""
    name = binding.table(table)
    return location_of(spark, name).rstrip("/") == run_folder(spark, name, run)


def tracks_partitions(spark: SparkSession, name: str) -> bool:
    """Whether the catalog keeps a list of the table's partitions."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Partition Provider'").collect()
    return bool(rows) and rows[0]["data_type"] == "Catalog"


def old_runs(spark: SparkSession, binding: CatalogBinding, table: str) -> list[str]:
    """Folders of replacements that the table does not point at: earlier ones and failed ones."""
    name = binding.table(table)
    folder = spark._jvm.org.apache.hadoop.fs.Path(home_of(spark, name))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [str(f.getPath().toString()).rstrip("/") for f in files.listStatus(folder) if f.isDirectory()]
    current = location_of(spark, name).rstrip("/").rsplit("/", 1)[-1]
    return sorted(f for f in found if re.search(RUN_FOLDER, f) and f.rsplit("/", 1)[-1] != current)


def overwrite_folder(
    spark: SparkSession,
    path: str,
    df: DataFrame,
    *,
    tables: Iterable[str] = (),
    sort_within: Sequence[str] = (),
) -> Written:
    """Replace the Parquet files in ``path``, which ``df`` must not read.

    The old files go first; ``replace_files`` keeps them until the new ones are there. A session that has read a table over this path would go on reading the old file list,
    so the full names in ``tables`` are refreshed.
    """
    rows, seen = counted(laid_out(spark, df, sort_within=sort_within))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    for name in tables:
        spark.catalog.refreshTable(name)
    return written(seen)
