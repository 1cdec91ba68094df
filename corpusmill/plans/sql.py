"""Pieces of DuckDB SQL that several queries' oracles share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS
from ..operators.bm25 import FLOOR, K1, B


def rounded(value: Column, digits: int) -> Column:
    """A column rounded in the steps of DuckDB's round, which tells halves apart by the product."""
    return F.round(value * 10.0**digits) / 10.0**digits


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def tokens(column: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower(coalesce({column}, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda w: len(w) >= 2 and not list_contains({listed(STOP_WORDS)}, w))"


def words(column: str) -> str:
    return rf"list_filter(string_split_regex(coalesce({column}, ''), '\s+'), lambda w: w <> '')"


def strip(column: str) -> str:
    return rf"regexp_replace({column}, '^\s+|\s+$', '', 'g')"


def hits(column: str, keywords) -> str:
    return "(" + " + ".join(f"contains({column}, {quoted(k)})::int" for k in keywords) + ")"


def any_hit(column: str, keywords) -> str:
    return "(" + " or ".join(f"contains({column}, {quoted(k)})" for k in keywords) + ")"


def present(column: str, names) -> str:
    return f"list_filter({listed(names)}, lambda n: contains({column}, n))"


def first_max(scores: list[tuple[str, str]], default: str) -> str:
    best = f"greatest({', '.join(s for _, s in scores)})"
    return f"case when {best} <= 0 then {quoted(default)} " + " ".join(f"when {s} = {best} then {quoted(n)}" for n, s in scores) + " end"


def matches(column: str, patterns, flags: str = "") -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({column}, {quoted(flags + p)}))" for p in patterns) + ")"


def first_seen(column: str) -> str:
    """Distinct values of a list in the order in which they first stand."""
    return f"list_filter({column}, lambda x, i: list_position({column}, x) = i)"


def bm25_ctes(docs: str = "select doc_id as id, text from documents", queries: str = "select item_id as query_id, text as query from benchmark", k: int = 10, keep: str = "true") -> str:
    """CTEs that end in bm25(query_id, id, score, rank)."""
    return f"""b_docs as (select *, {tokens('text')} as tokens from ({docs})),
b_len as (select *, len(tokens)::bigint as dl from b_docs),
b_corpus as (select count(*) as n_docs, avg(dl) as avgdl from b_len),
b_df as (select term, count(*) as df from (select unnest(list_distinct(tokens)) as term from b_len) group by term),
b_raw as (select term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) as raw from b_df, b_corpus),
b_terms as (select term, df, case when raw < 0 then {FLOOR} * (select avg(raw) from b_raw) else raw end as idf from b_raw),
b_queries as (select query_id, term, count(*) as qtf from (select query_id, unnest({tokens('query')}) as term from ({queries})) group by all),
b_post as (select id, dl, term, count(*) as tf from (select id, dl, unnest(tokens) as term from b_len where {keep}) group by all),
b_scores as (select q.query_id, p.id, round(sum(q.qtf * t.idf * p.tf * ({K1} + 1) / (p.tf + {K1} * (1 - {B} + {B} * p.dl / c.avgdl))), 9) as score from b_queries q join b_terms t on q.term = t.term join b_post p on p.term = q.term, b_corpus c group by q.query_id, p.id),
bm25 as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from b_scores) where rank <= {k} and score > 0)"""


def dense_ctes(metric: str = "list_cosine_similarity(q.v, e.v)", k: int = 10, queries: str = "select vec_id as query_id, embedding as v from embeddings where vec_id % 50 = 0", keep: str = "true") -> str:
    """CTEs that end in dense(query_id, id, score, rank)."""
    return f"""d_q as (select query_id, v::double[] as v from ({queries})),
d_e as (select vec_id as id, embedding::double[] as v from embeddings where {keep}),
dense as (select * from (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from (select q.query_id, e.id, {metric} as score from d_q q, d_e e)) where rank <= {k})"""
