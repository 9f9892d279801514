"""Jobs of several steps that write tables."""

from lakeweave.plans.compact import compact
from lakeweave.plans.copying import resumable_copy
from lakeweave.plans.distinct import append_distinct, dedup_increment, scan_distinct
from lakeweave.plans.loads import load_tables, load_with_reconciliation
from lakeweave.plans.publish import compute_aggregates, publish, register, verify
from lakeweave.plans.quarantine import load_with_quarantine, reject_reasons
from lakeweave.plans.refresh import refresh, refreshed
from lakeweave.plans.replicate import cross_catalog_copy, replicate_partitions
from lakeweave.plans.reset import reset
from lakeweave.plans.sensors import dedup_and_rank, ingest_readings
from lakeweave.plans.sync import Replica, Synced

__all__ = [
    "Replica",
    "Synced",
    "append_distinct",
    "compact",
    "compute_aggregates",
    "cross_catalog_copy",
    "dedup_and_rank",
    "dedup_increment",
    "ingest_readings",
    "load_tables",
    "load_with_quarantine",
    "load_with_reconciliation",
    "publish",
    "refresh",
    "refreshed",
    "register",
    "reject_reasons",
    "replicate_partitions",
    "reset",
    "resumable_copy",
    "scan_distinct",
    "verify",
]
