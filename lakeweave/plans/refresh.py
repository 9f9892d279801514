"""The aggregates kept up to date: a batch is merged into stored states, and results are made of those."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame, SparkSession

from lakeweave.operators.states import NEEDED, RESULTS, STATES
from lakeweave.sinks.ddl import create_table, ensure_namespace
from lakeweave.sinks.history import Load, record_loads
from lakeweave.sinks.writes import conform, is_done, replace_files
from lakeweave.sources.bindings import CatalogBinding
from lakeweave.sources.tables import scan_table


def refresh(
    spark: SparkSession,
    target: CatalogBinding,
    batch_id: str,
    batch: Mapping[str, DataFrame],
    results: Collection[str] = tuple(RESULTS),
) -> dict[str, int]:
    """Merge a batch into the states that ``results`` need; returns the rows of each state written.

    ``batch`` has new rows of some of customers, products, orders and raw_events. Only the batch and the states
    are read. Each state is replaced in one switch to a folder that carries the batch's name, which is how a batch that was
    merged is known: after a failure the same call merges what is left, and a call for the batch merged last does nothing.
    Batches are merged one after the other, each under a name of its own.
    """
    ensure_namespace(spark, target)
    wanted = dict.fromkeys(name for result in results for name in NEEDED[result])
    done: list[Load] = []
    try:
        for name in wanted:
            state = STATES[name]
            create_table(spark, target, name, state.spec)
            if state.source not in batch or is_done(spark, target, name, batch_id):
                continue
            new = state.merged([conform(state.of(batch[state.source]), state.spec.schema), scan_table(spark, target, name)])
            done.append(Load(name, "overwrite", replace_files(spark, target, name, conform(new, state.spec.schema), run=batch_id)))
    finally:
        record_loads(spark, target, done)
    return {load.table: int(load.rows) for load in done}


def refreshed(spark: SparkSession, target: CatalogBinding, result: str) -> DataFrame:
    """A result over all batches merged so far, from the states alone."""
    return RESULTS[result](*(scan_table(spark, target, name) for name in NEEDED[result]))
