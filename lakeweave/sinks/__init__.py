"""Where rows go: namespaces, tables, folders and the record of writes."""

from lakeweave.sinks.ddl import OWNER_PROPERTY, create_table, drop_namespace, drop_table, ensure_namespace, is_owned, register_files
from lakeweave.sinks.history import Load, record_loads
from lakeweave.sinks.writes import (
    Written,
    append,
    conform,
    is_done,
    location_of,
    old_runs,
    overwrite,
    overwrite_folder,
    overwrite_partitions,
    replace_files,
)

__all__ = [
    "Load",
    "OWNER_PROPERTY",
    "Written",
    "append",
    "conform",
    "create_table",
    "drop_namespace",
    "drop_table",
    "ensure_namespace",
    "is_done",
    "is_owned",
    "location_of",
    "old_runs",
    "overwrite",
    "overwrite_folder",
    "overwrite_partitions",
    "record_loads",
    "register_files",
    "replace_files",
]
