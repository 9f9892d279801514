"""A copy between catalogs that goes on where it stopped."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.schemas import TableSpec
from lakeweave.sinks.ddl import create_table, ensure_namespace
from lakeweave.sinks.history import Load, record_loads
from lakeweave.sinks.writes import conform, literal, run_folder
from lakeweave.sources.bindings import CatalogBinding
from lakeweave.sources.tables import scan_table

# Bytes of source files to a group: enough for one job to keep a cluster busy.
GROUP_BYTES = 256 * 1024**3


@dataclass(frozen=True)
class Copied:
    """Rows of the target, groups of files copied now, and groups found done."""

    rows: int
    copied: int
    skipped: int


def file_groups(df: DataFrame, group_bytes: int) -> Iterator[tuple[str, list[str]]]:
    """(name, paths) of groups of the files behind ``df``; the same files always make the same groups.

    The name follows from the files' paths, sizes and times, so a group with a file that was replaced is another group.
    """
    meta = [F.col(f"_metadata.{c}") for c in ("file_path", "file_size", "file_modification_time")]
    files = df.select(*meta).distinct().orderBy("file_path").collect()  # one row per file, no data
    group, size = [], 0
    for k, f in enumerate(files):
        group.append(f)
        size += f["file_size"]
        if size >= group_bytes or k == len(files) - 1:
            name = "|".join(f"{g['file_path']} {g['file_size']} {g['file_modification_time'].timestamp()}" for g in group)
            yield uuid.uuid5(uuid.NAMESPACE_URL, name).hex, [g["file_path"] for g in group]
            group, size = [], 0


def resumable_copy(
    spark: SparkSession,
    source: CatalogBinding,
    source_table: str,
    target: CatalogBinding,
    target_table: str,
    spec: TableSpec,
    run: str,
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
    group_bytes: int = GROUP_BYTES,
) -> Copied:
    """Replace a table by (a transform of) the rows of another, file group by file group.

    Each group is written to a folder of its own, and the mark that Spark's commit leaves there is the ledger: a second call with the same
    ``run`` skips the groups that are done and writes over what an unfinished one left. The table is switched to the new folder when all
    groups are there and until then keeps its old rows. Groups of source files that have been replaced meanwhile are removed first.

    ``transform`` works row by row, as it sees a group at a time. The target has no partitions; a ``Replica`` resumes for
    tables that have some. It is made by the first call, or was by an earlier one.
    """
    if spec.partition_by:
        raise ValueError("a partitioned table is copied by a Replica")
    ensure_namespace(spark, target)
    name = target.table(target_table)
    if not spark.catalog.tableExists(name):
        create_table(spark, target, target_table, spec, options={"recursiveFileLookup": "true"})
        # Groups are written below the table's folder, where it must not look.
        spark.sql(f"ALTER TABLE {name} SET LOCATION {literal(run_folder(spark, name))}")
    folder = run_folder(spark, name, run)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    files = path_of(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    groups = {f"group-{group}": paths for group, paths in file_groups(scan_table(spark, source, source_table), group_bytes)}
    if files.exists(path_of(folder)):
        for there in files.listStatus(path_of(folder)):
            if there.getPath().getName() not in groups:
                files.delete(there.getPath(), True)
    skipped = 0
    schema = scan_table(spark, source, source_table).schema
    for group, paths in groups.items():
        if files.exists(path_of(f"{folder}/{group}/_SUCCESS")):
            skipped += 1
            continue
        rows = conform(transform(spark.read.schema(schema).format(source.format).load(paths)), spec.schema)
        rows.write.mode("overwrite").format(target.format).save(f"{folder}/{group}")
    files.mkdirs(path_of(folder))
    spark.sql(f"ALTER TABLE {name} SET LOCATION {literal(folder)}")
    spark.catalog.refreshTable(name)
    total = scan_table(spark, target, target_table).count()
    record_loads(spark, target, [Load(target_table, "overwrite", total)])
    return Copied(total, len(groups) - skipped, skipped)
