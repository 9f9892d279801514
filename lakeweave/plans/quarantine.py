"""Loads that set aside the rows that do not fit, with the reasons.

One pass over the batch judges every row and writes it down, apart by the verdict; accepted rows then go to the
table and the others, as they came, to its table of rejects.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.schemas import TableSpec, column
from lakeweave.session import workspace
from lakeweave.sinks.ddl import create_table, ensure_namespace
from lakeweave.sinks.history import Load, record_loads
from lakeweave.sinks.writes import append, conform
from lakeweave.sources.bindings import CatalogBinding, quoted
from lakeweave.sources.tables import scan_table

# Names that no table has.
_RAW, _TYPED = "`judged raw`", "`judged typed`"
_REASON = "array<struct<column: string, reason: string, value: string>>"

_PART = T.StructType([T.StructField(n, T.StringType()) for n in ("column", "reason", "value")])

REJECTS = TableSpec(
    T.StructType(
        [
            column("run_id", T.StringType(), "load that rejected the row"),
            column("reasons", T.ArrayType(_PART), "what does not fit: column, reason and the value as text"),
            column("row", T.StringType(), "the row as it came, in JSON"),
        ]
    ),
    "rows that a load rejected",
)


@dataclass(frozen=True)
class Loaded:
    """What became of a batch."""

    run_id: str
    offered: int
    accepted: int
    rejected: int
    reconciled: bool


def judged(df: DataFrame, spec: TableSpec, checks: Mapping[str, str] | None = None) -> DataFrame:
    """``typed``, a row of the spec's types, ``reasons``, empty if the row fits, and ``row`` in JSON.

    A value fits its column if it can be cast; one that cannot is NULL in ``typed``. ``checks`` name SQL conditions over the typed
    columns; a row for which one is false does not fit, NULL is no violation.
    """
    unknown = sorted(set(df.columns) ^ set(spec.names))
    if unknown:
        raise ValueError(f"columns of the batch and of the table differ: {', '.join(unknown)}")
    raw, typed = (lambda name, of=of: F.col(f"{of}.{quoted(name)}") for of in (_RAW, _TYPED))

    def reason(name: str | None, why: str, value: Column) -> Column:
        return F.struct(F.lit(name).cast("string").alias("column"), F.lit(why).alias("reason"), F.substring(value, 1, 200).alias("value"))

    def as_text(name: str) -> Column:
        return raw(name) if isinstance(df.schema[name].dataType, T.StringType) else F.to_json(F.struct(raw(name).alias(name)))

    def misfit(f: T.StructField) -> Column:
        return F.when(raw(f.name).isNotNull() & typed(f.name).isNull(), reason(f.name, f"no {f.dataType.simpleString()}", as_text(f.name)))

    none = F.lit(None).cast("string")
    misfits = [misfit(f) for f in spec.schema if df.schema[f.name].dataType != f.dataType]
    broken = [F.when(~F.expr(condition), reason(None, name, none)) for name, condition in (checks or {}).items()]
    values = [F.col(quoted(f.name)).try_cast(f.dataType).alias(f.name) for f in spec.schema]
    both = df.select(F.struct(*[quoted(c) for c in df.columns]).alias(_RAW.strip("`")), F.struct(*values).alias(_TYPED.strip("`")))
    reasons = F.filter(F.array(*misfits, *broken), lambda r: r.isNotNull()) if misfits or broken else F.array()
    # The typed columns stand under their own names for the conditions.
    found = both.select(f"{_TYPED}.*", _RAW, _TYPED).select(F.col(_TYPED), reasons.cast(_REASON).alias("reasons"), F.to_json(_RAW).alias("row"))
    return found.toDF("typed", "reasons", "row")


def load_with_quarantine(
    spark: SparkSession,
    target: CatalogBinding,
    table: str,
    batch: DataFrame,
    spec: TableSpec,
    checks: Mapping[str, str] | None = None,
) -> Loaded:
    """Append what fits of a batch to the table and the rest to ``<table>_rejects``.

    The batch is read once. Rejects are written first: a load that fails before the accepted rows are in the table
    has changed nothing there and can be repeated; its rejects stay under a run of their own. ``reconciled`` tells
    whether accepted and rejected rows make up the batch and the table grew by the accepted ones.
    """
    ensure_namespace(spark, target)
    rejects = f"{table}_rejects"
    create_table(spark, target, table, spec)
    create_table(spark, target, rejects, REJECTS)
    before = scan_table(spark, target, table).count()
    run_id, seen, path = uuid.uuid4().hex, Observation(), f"{workspace(spark)}/judged"
    fits = (F.size("reasons") == 0).alias("fits")
    rows = judged(batch, spec, checks).select("*", fits)
    rows.observe(seen, F.count(F.lit(1)).alias("offered")).write.partitionBy("fits").parquet(path)
    held = spark.read.schema(rows.schema).parquet(path)
    set_aside = held.where("NOT fits").select(F.lit(run_id).alias("run_id"), "reasons", "row")
    rejected = append(spark, target, rejects, conform(set_aside, REJECTS.schema))
    accepted = append(spark, target, table, held.where("fits").select("typed.*"), partition_by=spec.partition_by)
    record_loads(spark, target, [Load(rejects, "append", rejected), Load(table, "append", accepted)])
    grown = scan_table(spark, target, table).count() - before
    offered = seen.get["offered"]
    return Loaded(run_id, offered, int(accepted), int(rejected), accepted + rejected == offered and grown == accepted)


def reject_reasons(spark: SparkSession, target: CatalogBinding, table: str) -> DataFrame:
    """Rejected rows by column and reason; a row with several reasons counts for each."""
    each = scan_table(spark, target, f"{table}_rejects").select(F.explode("reasons").alias("r"))
    return each.groupBy(F.col("r.column").alias("column_name"), F.col("r.reason").alias("reason")).agg(F.count(F.lit(1)).alias("rows"))
