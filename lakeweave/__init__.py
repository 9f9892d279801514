"""Table-level analytics across several catalogs, written for PySpark.

``sources``    catalog bindings, table scans, inline rows, file listings, inventory
``sinks``      namespaces and tables, appends and overwrites, load history
``functions``  column expressions: banding, ISO dates
``operators``  DataFrame-to-DataFrame queries: aggregates, dedup, counts, contracts
``plans``      multi-step jobs that write: ingest, load, publish, replicate, reset
"""

__version__ = "0.1.0"
