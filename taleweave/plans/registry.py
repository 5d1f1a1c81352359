"""All registered graph and text queries."""

from __future__ import annotations

from taleweave.plans import base, chronicle_queries, evidence_queries, export_queries, graph_queries, kin_queries, kinship_queries, layout_queries, library_queries, panel_queries, resolve_queries, rule_queries, span_queries, text_queries, time_queries, view_queries

MODULES = (view_queries, graph_queries, time_queries, kin_queries, resolve_queries, text_queries, layout_queries, chronicle_queries, rule_queries, span_queries, evidence_queries, export_queries, library_queries, kinship_queries, panel_queries)


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
