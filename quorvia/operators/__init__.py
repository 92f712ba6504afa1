"""The semantic operators, by the name they are dispatched under."""

from __future__ import annotations

from quorvia.operators import calculate, check, compare, connect, control, extract, manage, organise, typed

OPERATORS = {
    "PROMPT": typed.prompt, "NOUL": typed.noul, "CHOICE": typed.choice, "SCORE": typed.score, "EVALUATE": typed.evaluate, "ENSURE_SEMANTICS": typed.ensure_semantics,
    "CLASSIFY": organise.classify, "TAG": organise.tag, "FILTER": organise.filter_rows, "CLASSIFY_HIERARCHY": organise.classify_hierarchy,
    "COMPARE": compare.compare, "RANK": compare.rank, "RERANK": compare.rerank, "COMPOSITE_SCORE": compare.composite_score,
    "EXTRACT": extract.extract, "EXTRACT_DATE": extract.extract_date, "FIND": extract.find, "SUMMARY_EXTRACTIVE": extract.summary_extractive, "STRUCTURE": extract.structure, "EXTRACT_TABLE": extract.extract_table,
    "JOIN": connect.join, "ALIGN": connect.align, "RELATE": connect.relate, "MATCH": connect.match, "EVIDENCE_JOIN": connect.evidence_join,
    "VERIFY": check.verify, "COVER": check.cover,
    "AGGREGATE": calculate.aggregate, "CONTRAST": calculate.contrast,
    "RESOLVE": control.resolve_objective, "STATE_SCAN": control.state_scan, "TRACE": control.trace, "WORKFLOW": control.workflow, "ROUTE": control.route, "EXPLAIN_PLAN": control.explain_plan,
    "DISCOVER": manage.discover, "REVIEW": manage.review, "PROMOTE": manage.promote, "MATERIALIZE": manage.materialize, "REFRESH": manage.refresh, "SELECT_SCHEMA": manage.select_schema, "PLAN_SQL": manage.plan_sql,
}


def call(name: str, *args, **kwargs):
    """Dispatch by name, with the operator's own signature."""
    if name not in OPERATORS:
        raise KeyError(f"unknown operator {name}")
    return OPERATORS[name](*args, **kwargs)
