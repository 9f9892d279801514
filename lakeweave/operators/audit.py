"""All checks of a set of tables in one pass over each.

Every rule turns a row into at most one value that speaks for or against it; a table's rules are worked out
side by side in one scan and counted by rule and value in one aggregation, in the map tasks first. A reference needs no join: child
and parent rows are counted under the same rule and key, and a key without parent rows is an orphan.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.functions.dates import is_bad_date
from lakeweave.operators.contracts import PAYLOAD_FIELDS, REQUIRED_FIELD
from lakeweave.sources.bindings import quoted


@dataclass(frozen=True)
class Domain:
    """Values outside a list."""

    table: str
    column: str
    allowed: Collection[str]

    name = property(lambda self: f"{self.table}.{self.column} in its domain")

    def values(self) -> dict[str, Column]:
        c = F.col(quoted(self.column))
        return {"offence": F.when(c.isNotNull() & ~c.isin(list(self.allowed)), c.cast("string"))}


@dataclass(frozen=True)
class IsoDate:
    """Texts that are no ISO dates."""

    table: str
    column: str

    name = property(lambda self: f"{self.table}.{self.column} is a date")

    def values(self) -> dict[str, Column]:
        return {"offence": F.when(is_bad_date(quoted(self.column)), F.col(quoted(self.column)))}


@dataclass(frozen=True)
class Unique:
    """Keys that several rows carry; keys of several columns in JSON."""

    table: str
    keys: Sequence[str]

    name = property(lambda self: f"{self.table}({', '.join(self.keys)}) is unique")

    def values(self) -> dict[str, Column]:
        columns = [quoted(k) for k in self.keys]
        return {"key": F.col(columns[0]).cast("string") if len(columns) == 1 else F.to_json(F.struct(*columns))}


@dataclass(frozen=True)
class Reference:
    """Keys of a table that its parent lacks."""

    table: str
    column: str
    parent: str
    parent_column: str

    name = property(lambda self: f"{self.table}.{self.column} refers to {self.parent}")

    def values(self) -> dict[str, Column]:
        return {"child": F.col(quoted(self.column)).cast("string")}

    def parent_values(self) -> dict[str, Column]:
        return {"parent": F.col(quoted(self.parent_column)).cast("string")}


@dataclass(frozen=True)
class Payload:
    """Event types whose JSON lacks the attribute that the type requires."""

    table: str
    type_column: str = "event_type"
    payload: str = "payload"
    required: Mapping[str, str] | None = None
    fields: str = PAYLOAD_FIELDS

    name = property(lambda self: f"{self.table}.{self.payload} has its attributes")

    def values(self) -> dict[str, Column]:
        kind, parsed = F.col(quoted(self.type_column)), F.from_json(quoted(self.payload), self.fields)
        lacks = [(kind == t) & parsed[name].isNull() for t, name in (self.required or REQUIRED_FIELD).items()]
        return {"offence": F.when(reduce(lambda a, b: a | b, lacks), kind)}


Rule = Domain | IsoDate | Unique | Reference | Payload

_ROLES = ("offence", "key", "child", "parent")


def _counted(df: DataFrame, entries: Sequence[tuple[str, dict[str, Column]]], weight: str | None) -> DataFrame:
    """(rule, value, rows by role) of one table, in one scan."""
    each = [
        F.struct(F.lit(name).alias("rule"), F.lit(_ROLES.index(role)).alias("role"), value.alias("value"))
        for name, values in entries
        for role, value in values.items()
    ]
    n = F.lit(1).cast("bigint") if weight is None else F.col(quoted(weight))
    said = df.select(n.alias("n"), F.explode(F.filter(F.array(*each), lambda e: e["value"].isNotNull())).alias("e"))
    said = said.select("n", "e.*")
    return said.groupBy("rule", "value").agg(
        *[F.sum(F.when(F.col("role") == k, F.col("n")).otherwise(0)).alias(role) for k, role in enumerate(_ROLES)]
    )


def audit(tables: Mapping[str, DataFrame], rules: Sequence[Rule], weights: Mapping[str, str] | None = None) -> DataFrame:
    """Violations of all rules: rule, value, and the rows behind it; no rows where all is well.

    Each table is scanned once, whatever the number of its rules. ``weights`` name a table's column with the number of rows
    that a row stands for. NULL is no violation. The counts are those of ``operators.contracts``, check by check.
    """
    entries: dict[str, list] = {}
    for rule in rules:
        entries.setdefault(rule.table, []).append((rule.name, rule.values()))
        if isinstance(rule, Reference):
            entries.setdefault(rule.parent, []).append((rule.name, rule.parent_values()))
    missing = sorted(set(entries) - set(tables))
    if missing:
        raise ValueError(f"no such table: {', '.join(missing)}")
    counted = [_counted(tables[name], found, (weights or {}).get(name)) for name, found in entries.items()]
    total = reduce(DataFrame.unionByName, counted).groupBy("rule", "value").agg(*[F.sum(role).alias(role) for role in _ROLES])
    orphaned = F.when(F.col("parent") == 0, F.col("child")).otherwise(0)
    repeated = F.when(F.col("key") > 1, F.col("key")).otherwise(0)
    return total.select("rule", "value", (F.col("offence") + repeated + orphaned).alias("rows")).where("rows > 0")


def audit_summary(violations: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule: values and rows that break it, and the least and the greatest such value as examples."""
    found = violations.groupBy("rule").agg(
        F.count(F.lit(1)).alias("bad_values"), F.sum("rows").alias("bad_rows"),
        F.array_distinct(F.array(F.min("value"), F.max("value"))).alias("examples"),
    )
    named = violations.sparkSession.createDataFrame([(rule.name,) for rule in rules], "rule string")
    joined = named.join(found, "rule", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "rule", F.coalesce("bad_values", zero).alias("bad_values"), F.coalesce("bad_rows", zero).alias("bad_rows"),
        F.coalesce("examples", F.array().cast("array<string>")).alias("examples"),
    )
