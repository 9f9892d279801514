"""An audit table of the library's writes."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from lakeweave.schemas import LOAD_HISTORY
from lakeweave.sinks.ddl import create_table
from lakeweave.sinks.writes import append, replace_files
from lakeweave.sources.bindings import CatalogBinding

HISTORY_TABLE = "load_history"
# Files of the history from which on they are merged into one.
MOST_FILES = 32


@dataclass(frozen=True)
class Load:
    """One finished write."""

    table: str
    operation: str
    rows: int
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    committed_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))


def record_loads(spark: SparkSession, binding: CatalogBinding, loads: Sequence[Load]) -> None:
    """Note finished writes, all in one file; after ``MOST_FILES`` of these they become one.

    The history is replaced in one switch then, so loads of a namespace must note their writes one after the other.

    The record helps to audit; it is no snapshot to go back to. A lakehouse table keeps its
    own snapshots and needs none.
    """
    if not loads or binding.format == "iceberg":
        return
    create_table(spark, binding, HISTORY_TABLE, LOAD_HISTORY)
    entries = [(load.run_id, load.table, load.operation, int(load.rows), load.committed_at) for load in loads]
    append(spark, binding, HISTORY_TABLE, spark.createDataFrame(entries, LOAD_HISTORY.schema).coalesce(1))
    history = spark.table(binding.table(HISTORY_TABLE))
    if binding.kind == "session" and len(history.inputFiles()) > MOST_FILES:
        replace_files(spark, binding, HISTORY_TABLE, history.coalesce(1).sortWithinPartitions("committed_at"), as_dealt=True)
