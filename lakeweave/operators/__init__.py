"""Queries from DataFrames to a DataFrame; none of them writes."""

from lakeweave.operators.analytics import (
    customer_ltv,
    event_funnel,
    product_revenue,
    regional_summary,
    top_customers,
)
from lakeweave.operators.audit import Domain, IsoDate, Payload, Reference, Unique, audit, audit_summary
from lakeweave.operators.contracts import (
    bad_dates,
    domain_violations,
    duplicate_keys,
    orphan_keys,
    payload_fields,
    payload_gaps,
)
from lakeweave.operators.counts import labelled_count, labelled_counts
from lakeweave.operators.readings import distinct_rows, rank_readings

__all__ = [
    "Domain",
    "IsoDate",
    "Payload",
    "Reference",
    "Unique",
    "audit",
    "audit_summary",
    "bad_dates",
    "customer_ltv",
    "distinct_rows",
    "domain_violations",
    "duplicate_keys",
    "event_funnel",
    "labelled_count",
    "labelled_counts",
    "orphan_keys",
    "payload_fields",
    "payload_gaps",
    "product_revenue",
    "rank_readings",
    "regional_summary",
    "top_customers",
]
