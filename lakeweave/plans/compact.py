"""Tables rewritten into files of about one size."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.schemas import TableSpec
from lakeweave.sinks.history import Load, record_loads
from lakeweave.sinks.writes import hashable, replace_files
from lakeweave.sources.bindings import CatalogBinding, quoted
from lakeweave.sources.files import files_of
from lakeweave.sources.tables import scan_table

TARGET_BYTES = 256 * 1024 * 1024

_TASK = "lakeweave task"


@dataclass(frozen=True)
class Compacted:
    rows: int
    files_before: int
    files_planned: int
    tasks: int


def partition_sizes(df: DataFrame, by: Sequence[str]) -> list[tuple[dict, int, int]]:
    """(partition, bytes, files) as the file listing has them; no data column is read."""
    files = df.select(*by, F.col("_metadata.file_path"), F.col("_metadata.file_size")).distinct()
    found = files.groupBy(*by).agg(F.sum("file_size").alias("file_bytes"), F.count(F.lit(1)).alias("n_files"))
    rows = found.where("n_files > 0").collect()  # one row per partition, no data
    return [({c: r[c] for c in by}, r["file_bytes"], r["n_files"]) for r in rows]


def planned_tasks(sizes: Sequence[tuple[dict, int, int]], target_bytes: int) -> tuple[list[tuple[dict, int, int]], int]:
    """(partition, files, first task) and the number of tasks.

    A partition of more than one and a half targets gets as many files as come nearest to the target, each from a task of its own.
    Smaller ones are packed first-fit decreasing into tasks of up to one target, a file from each.
    """
    plan, tasks, room = [], 0, []
    for part, size, _ in sorted(sizes, key=lambda s: (-s[1], str(s[0]))):
        if size > 1.5 * target_bytes:
            files = max(2, round(size / target_bytes))
            plan.append((part, files, tasks))
            tasks += files
            continue
        at = next((k for k, (_, left) in enumerate(room) if left >= size), None)
        if at is None:
            room.append((tasks, target_bytes))
            at, tasks = len(room) - 1, tasks + 1
        task, left = room[at]
        room[at] = (task, left - size)
        if room[at][1] < target_bytes // 100:  # full; later ones need not look at it
            room.pop(at)
        plan.append((part, 1, task))
    return plan, tasks


def compact(
    spark: SparkSession, binding: CatalogBinding, table: str, spec: TableSpec, target_bytes: int = TARGET_BYTES, sort_within: Sequence[str] = ()
) -> Compacted:
    """Rewrite a table into files of about ``target_bytes``: large partitions split, small ones written several to a task.

    Sizes are those of the files now, so rows are taken to stay as wide and as well packed as they are. Rows of a split partition are dealt out
    by a hash of the whole row. The table is replaced in one switch; a failure leaves it as it was. A partitioned
    table has to find its partitions in its folder (``create_table(..., listed=True)``).
    """
    by = list(spec.partition_by)
    rows = scan_table(spark, binding, table).select(*spec.names)
    sizes = partition_sizes(scan_table(spark, binding, table), by)
    if not sizes:
        return Compacted(0, 0, 0, 0)
    plan, tasks = planned_tasks(sizes, target_bytes)
    if by:
        fields = ", ".join(f"`key {k}` {rows.schema[c].dataType.simpleString()}" for k, c in enumerate(by))
        chart = [(*part.values(), files, task) for part, files, task in plan]
        chart = spark.createDataFrame(chart, f"{fields}, plan_files int, plan_task int")
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"`key {k}`")) for k, c in enumerate(by)))
        # One row per partition, as in the driver just now.
        each, files, first = rows.join(F.broadcast(chart), same), F.col("plan_files"), F.col("plan_task")
    else:
        each, files, first = rows, F.lit(plan[0][1]), F.lit(plan[0][2])
    slot = F.pmod(F.xxhash64(*hashable(rows)), files)
    dealt = each.select(*[quoted(c) for c in spec.names], (first + slot).cast("int").alias(_TASK))
    dealt = dealt.repartitionById(tasks, quoted(_TASK)).select(*[quoted(c) for c in spec.names])
    if by or sort_within:
        dealt = dealt.sortWithinPartitions(*by, *sort_within)
    written = replace_files(spark, binding, table, dealt, partition_by=by, as_dealt=True)
    record_loads(spark, binding, [Load(table, "overwrite", written)])
    return Compacted(int(written), sum(n for *_, n in sizes), sum(files for _, files, _ in plan), tasks)


def file_sizes(spark: SparkSession, binding: CatalogBinding, table: str) -> list[int]:
    """Bytes of each data file of a table."""
    return [r["size_bytes"] for r in files_of(spark.table(binding.table(table))).collect()]
