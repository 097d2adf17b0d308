"""All queries by name, with SQL where SQL can express them."""

from __future__ import annotations

from cadenza.plans import check_queries, interval_queries, job_queries, text_queries, whole_queries  # noqa: F401  they enter their queries
from cadenza.plans.base import QUERIES, SQL

FLAGSHIP = "ag15_quality_report"
