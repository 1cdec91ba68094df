"""SQL of what a query asks for."""

from __future__ import annotations

from ..functions import query_analysis as qa
from . import sql


def _count(column: str, patterns) -> str:
    return "(" + " + ".join(f"regexp_matches({column}, {sql.quoted(p)})::int" for p in patterns) + ")"


def visual_score(column: str) -> str:
    return f"least(1.0, 0.3 * {_count(f'lower({column})', [p for p, _, _ in qa.VISUAL_ELEMENTS])} + 0.25 * {_count(f'lower({column})', qa.VISUAL_INTENTS)})"


def weights_ctes(queries: str) -> str:
    """CTEs that end in weights(query_id, query, visual_score, modality, bm25, dense, colpali)."""
    rows = ", ".join(f"('{m}', {a}::double, {b}::double, {c}::double)" for m, (a, b, c) in qa.WEIGHTS.items())
    return f"""w_q as (select query_id, query, {visual_score('query')} as visual_score, {_count('lower(query)', [p for p, _, _ in qa.VISUAL_ELEMENTS])} as n from ({queries})),
w_m as (select *, case when visual_score >= {qa.VISUAL_AT} then 'visual' when visual_score >= {qa.MIXED_AT} then 'mixed' else 'text' end as modality from w_q),
w_base as (select q.*, v.b, v.d, case when q.n > 0 then least(v.c + least(0.1 * q.n, 0.15), 0.7) else v.c end as c from w_m q join (values {rows}) v(modality, b, d, c) on v.modality = q.modality),
weights as (select query_id, query, visual_score, modality, n, b / (case when n > 0 then b + d + c else 1 end) as bm25, d / (case when n > 0 then b + d + c else 1 end) as dense, c / (case when n > 0 then b + d + c else 1 end) as colpali from w_base)"""
