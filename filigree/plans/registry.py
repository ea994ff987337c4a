"""All registered queries and their SQL oracles, collected from the plan modules."""

from __future__ import annotations

from . import audit_plans, binding_plans, dataset_plans, evidence_plans, fact_plans, filing_plans, graph_plans, metric_plans, navigation_plans, publishing_plans, ranking_plans, repair_plans, review_plans, scalar_plans

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (scalar_plans, filing_plans, fact_plans, graph_plans, ranking_plans, metric_plans, dataset_plans, binding_plans, review_plans, evidence_plans, navigation_plans, audit_plans, repair_plans, publishing_plans):
    QUERIES |= _module.PLANS.queries
    ORACLES |= _module.PLANS.oracles
