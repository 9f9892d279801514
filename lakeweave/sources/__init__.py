"""Where rows and metadata come from."""

from lakeweave.sources.bindings import BindingConflict, CatalogBinding, bind
from lakeweave.sources.files import file_ranges, file_report, overlapping_files, write_evidence
from lakeweave.sources.inline import inline_rows
from lakeweave.sources.inventory import federated_inventory, list_catalogs, namespaces, table_names
from lakeweave.sources.tables import commit_history, scan_bucketed, scan_files, scan_partitions, scan_table

__all__ = [
    "BindingConflict",
    "CatalogBinding",
    "bind",
    "commit_history",
    "federated_inventory",
    "file_ranges",
    "file_report",
    "inline_rows",
    "list_catalogs",
    "namespaces",
    "overlapping_files",
    "scan_bucketed",
    "scan_files",
    "scan_partitions",
    "scan_table",
    "table_names",
    "write_evidence",
]
