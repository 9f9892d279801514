"""Catalogs by name: what a session must know to read and write one."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

SESSION_CATALOG = "spark_catalog"


class BindingConflict(ValueError):
    """The name is taken by a catalog with other settings."""


def quoted(*parts: str) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in parts)


@dataclass(frozen=True)
class CatalogBinding:
    """One namespace of one catalog.

    ``session`` bindings are databases of the session catalog: whatever metastore the
    session was started with, or its own in-memory one. ``v2`` bindings are catalog plugins
    set up under ``spark.sql.catalog.<name>``; ``plugin`` is their class and ``conf`` holds
    the remaining keys without the prefix, such as ``type``, ``uri``, ``warehouse`` and
    ``io-impl`` of a lakehouse catalog. Object store and metastore settings
    (``spark.hadoop.*``) belong to the session's start-up configuration.
    """

    name: str
    namespace: str
    root: str | None = None
    kind: str = "session"
    format: str = "parquet"
    plugin: str | None = None
    conf: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in ("session", "v2"):
            raise ValueError(f"unknown kind of binding: {self.kind}")
        if (self.kind == "v2") != bool(self.plugin):
            raise ValueError("a v2 binding needs a plugin class, a session binding takes none")
        if self.kind == "session" and not self.root:
            raise ValueError("a session binding needs a root folder for its tables")

    @property
    def catalog(self) -> str:
        return self.name if self.kind == "v2" else SESSION_CATALOG

    @property
    def full_namespace(self) -> str:
        return quoted(self.catalog, self.namespace)

    def table(self, name: str) -> str:
        return quoted(self.catalog, self.namespace, name)

    def location(self, name: str) -> str | None:
        """Folder of an external table; None leaves the place to the catalog."""
        return f"{self.root.rstrip('/')}/{name}" if self.root else None

    def session_conf(self) -> dict[str, str]:
        if self.kind == "session":
            return {}
        prefix = f"spark.sql.catalog.{self.name}"
        return {prefix: self.plugin, **{f"{prefix}.{key}": value for key, value in self.conf.items()}}


def bind(spark: SparkSession, binding: CatalogBinding) -> bool:
    """Make the catalog known to the session; False when it already was.

    Binding the same settings again does nothing. Other settings under a bound name raise
    :class:`BindingConflict` and change nothing.
    """
    if binding.kind == "session":
        # The namespace itself is created by ``ensure_namespace``.
        return False
    wanted = binding.session_conf()
    present = {key: spark.conf.get(key, None) for key in wanted}
    clashes = sorted(key for key, value in present.items() if value not in (None, wanted[key]))
    if clashes:
        raise BindingConflict(f"{binding.name} is bound with other values for {', '.join(clashes)}")
    if all(present.values()):
        return False
    if present[f"spark.sql.catalog.{binding.name}"] is not None:
        missing = sorted(key for key, value in present.items() if value is None)
        raise BindingConflict(f"{binding.name} is bound without {', '.join(missing)}")
    for key, value in wanted.items():
        spark.conf.set(key, value)
    return True
