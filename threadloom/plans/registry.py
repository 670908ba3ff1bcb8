"""All registered queries and the SQL that states the same."""

from __future__ import annotations

from threadloom.plans import archive_queries, audit_queries, gate_queries, history_queries, identity_queries, index_queries, lane_queries, ledger_queries, placement_queries, resolution_queries, report_queries, revision_queries, search_queries, source_queries, stream_queries, upkeep_queries  # noqa: F401
from threadloom.plans.base import ORACLE_SQL, QUERIES  # noqa: F401


def flagship(spark, sf_dir):
    return QUERIES["agg07_project_rollup"](spark, sf_dir)
