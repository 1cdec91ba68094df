"""Queries over texts: tokens, quality, chunks, sections, ids; over all documents."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import ids, quality, text
from ..operators import chunking, structure
from . import sql


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def tokenize_counts(spark, d):
    t = text.tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), text.word_count(F.col("text")).alias("n_words"), F.md5(F.array_join(t, " ")).alias("digest"))


def stable_ids(spark, d):
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    return _docs(spark, d).select("doc_id", ids.document_id(name, F.col("text")).alias("document_id"), ids.vector_uuid(name).alias("vector_id"), ids.chunk_id(name, F.lit(0), F.col("text")).alias("chunk_id"))


def exact_dup_hash(spark, d):
    return _docs(spark, d).groupBy(F.md5("text").alias("file_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def _scored(spark, d):
    return quality.with_quality(_docs(spark, d))


def quality_scores(spark, d):
    out = _scored(spark, d).select("doc_id", *[sql.rounded(F.col(f"{k}_score"), 6).alias(f"{k}_score") for k in quality.WEIGHTS], sql.rounded(F.col("overall_score"), 6).alias("overall_score"), "tier", F.array_join("issues", ";").alias("issues"), F.array_join("warnings", ";").alias("warnings"), "recommended_pipeline", "manual_review")
    return out


def quality_tier_counts(spark, d):
    return _scored(spark, d).groupBy("tier").agg(F.count("*").alias("n"))


def quality_vs_label(spark, d):
    labels = spark.read.parquet(f"{d}/labels.parquet")
    return _scored(spark, d).join(labels, "doc_id").groupBy("quality", "tier").agg(F.count("*").alias("n"), sql.rounded(F.avg("overall_score"), 6).alias("mean_score"))


def quality_metrics(spark, d):
    m = quality.metrics(F.col("text"))
    names = ("char_count", "word_count", "line_count")
    ratios = ("avg_word_length", "unique_word_ratio", "uppercase_ratio", "digit_ratio", "special_char_ratio")
    return _docs(spark, d).select("doc_id", m.alias("m")).select("doc_id", *[F.col(f"m.{n}").alias(n) for n in names], *[sql.rounded(F.col(f"m.{n}"), 6).alias(n) for n in ratios])


def quality_router(spark, d):
    return _scored(spark, d).groupBy(quality.router_config(F.col("tier")).alias("config")).agg(F.count("*").alias("n"))


def word_window_chunks(spark, d):
    out = chunking.word_windows(_docs(spark, d))
    return out.select("doc_id", "chunk_index", "start_word", "n_words", F.md5("text").alias("digest"))


def token_chunks(spark, d):
    out = chunking.token_chunks(_docs(spark, d))
    return out.select("doc_id", "chunk_index", "n_words", F.md5("text").alias("digest"))


def greedy_line_pack(spark, d):
    out = chunking.packed_chunks(_docs(spark, d), 120, "\n", "\n")
    return out.select("doc_id", "chunk_index", "start", "n_words", F.md5("text").alias("digest"))


def sentence_chunks(spark, d):
    out = chunking.sentence_chunks(_docs(spark, d))
    return out.select("doc_id", "sentence_index", "n_words", F.md5("text").alias("digest"))


def chunk_strategy_route(spark, d):
    return _scored(spark, d).groupBy("tier", chunking.strategy(F.col("tier")).alias("strategy")).agg(F.count("*").alias("n"))


def chunk_totals(spark, d):
    return chunking.totals(chunking.word_windows(_docs(spark, d)), "doc_id", "n_words")


def chunk_page_asof(spark, d):
    """Windows' first characters against pages of 1000 characters."""
    docs = _docs(spark, d)
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(337))
    chunks = docs.select("doc_id", F.explode(starts).alias("start")).withColumn("start", F.col("start").cast("long"))
    pages = docs.select("doc_id", F.posexplode(F.sequence(F.lit(100), F.length("text") + 100, F.lit(1000))).alias("p", "position")).select("doc_id", F.col("position").cast("long").alias("position"), (F.col("p") + 1).cast("long").alias("page_number"))
    return chunking.pages_as_of(chunks, pages)


def chunk_hierarchy_children(spark, d):
    """Windows of every document as children of the document's own chunk."""
    windows = chunking.word_windows(_docs(spark, d)).select("doc_id", (F.col("chunk_index") + 1).alias("chunk_index"), F.concat(F.col("doc_id").cast("string"), F.lit("_"), (F.col("chunk_index") + 1).cast("string")).alias("chunk_id"), F.concat(F.col("doc_id").cast("string"), F.lit("_0")).alias("parent_id"))
    roots = _docs(spark, d).select("doc_id", F.lit(0).cast("long").alias("chunk_index"), F.concat(F.col("doc_id").cast("string"), F.lit("_0")).alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"))
    out = chunking.with_children(roots.unionAll(windows))
    return out.select("doc_id", "chunk_index", "chunk_id", "parent_id", F.array_join("children_ids", ",").alias("children_ids"))


def semantic_chunks(spark, d):
    """Rows only: sentences joined by the similarity of hashed word vectors."""
    from ..sources.files import embedded, hashing_embedder

    pieces = chunking.sentence_chunks(_docs(spark, d)).select("doc_id", F.col("sentence_index").alias("piece_index"), "text")
    return chunking.semantic_chunks(embedded(pieces, hashing_embedder(32)), skip=2)


def document_structure(spark, d):
    out = structure.structure(_docs(spark, d))
    return out.select("doc_id", "legal_title", "legal_subtype", "is_code", "financial_title", F.array_join("fiscal_periods", ";").alias("fiscal_periods"), "has_tables")


QUERIES = {f.__name__: f for f in (
    tokenize_counts, stable_ids, exact_dup_hash, quality_scores, quality_tier_counts, quality_vs_label, quality_metrics, quality_router, word_window_chunks, token_chunks, greedy_line_pack, sentence_chunks,
    chunk_strategy_route, chunk_totals, chunk_page_asof, chunk_hierarchy_children, semantic_chunks, document_structure,
)}

_W = sql.words("text")


def _ladder(value: str, steps) -> str:
    return "case " + " ".join(f"when {value} > {a} then {p}" for a, p in steps) + " else 0.0 end"


def quality_ctes() -> str:
    """CTEs that end in scored(doc_id, the five scores, overall_score, tier). Runs of a repeated character are counted without a back reference."""
    q = quality
    gibberish = [p for p in q.GIBBERISH_PATTERNS if "\\1" not in p]
    # Repeats of five or more: characters at which a run of equal characters (in any case) begins, with their run lengths.
    return rf"""q_docs as (select doc_id, text, length(text) as n, length({sql.strip('text')}) < 50 as empty, {_W} as words, string_split(text, chr(10)) as lines from documents),
q_chars as (select doc_id, unnest(range(1, n + 1)) as i, unnest(string_split(lower(text), '')) as c from q_docs),
q_runs as (select doc_id, c, i - row_number() over (partition by doc_id, c order by i) as g from q_chars),
q_long as (select doc_id, count(*) as runs from (select doc_id, c, g, count(*) as k from q_runs where c <> chr(10) group by all having count(*) >= 5) group by doc_id),
q_parts as (select d.*, {sql.matches('text', q.OCR_PATTERNS)} / (n / 1000) as errors, ({sql.matches('text', gibberish, '(?i)')} + coalesce(l.runs, 0)) / (n / 1000) as gibberish, {sql.matches('text', q.STRUCTURE_PATTERNS, '(?m)')} as marks,
  length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) / n as alpha, length(regexp_replace(text, '[^\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) as control, list_filter(lines, lambda x: regexp_matches(x, '\S')) as full_lines, list_transform(words, lambda w: lower(w)) as low from q_docs d left join q_long l on d.doc_id = l.doc_id),
q_more as (select *, list_transform(full_lines, lambda x: length(x)::double) as sizes, len(list_distinct(list_transform(full_lines, lambda x: length(x) - length(regexp_replace(x, '^\s+', ''))))) as indents, list_sum(list_transform(low, lambda w: length(w))) / len(low) as mean_word, len(list_distinct(low)) / len(low) as distinct_share,
  len(list_filter(low, lambda w: list_contains({sql.listed(q.COMMON_WORDS)}, w))) / len(low) as common_share from q_parts),
q_scores as (select doc_id, empty,
  case when empty then 0.0 when len(words) < 10 then 0.1 else greatest(0.0, 1.0 - case when len(words) < 50 then 0.3 else 0 end - case when alpha < 0.3 then 0.3 when alpha < 0.5 then 0.1 else 0 end - case when control > 0 then least(0.3, control / n * 10) else 0 end) end as text_score,
  case when empty then 0.0 else greatest(0.0, 1.0 - {_ladder('errors', ((10, 0.5), (5, 0.3), (2, 0.1)))} - {_ladder('gibberish', ((5, 0.3), (2, 0.15)))}) end as ocr_score,
  case when empty then 0.0 else greatest(0.0, 1.0 - case when len(sizes) > 0 and list_var_pop(sizes) > 10000 then 0.2 else 0 end - case when (len(lines) - len(full_lines)) / len(lines) > 0.5 then 0.2 else 0 end - case when len(sizes) > 0 and indents > 20 then 0.1 else 0 end) end as format_score,
  case when empty then 0.0 when marks > 20 then 1.0 when marks > 10 then 0.85 when marks > 5 then 0.7 when marks > 0 then 0.6 else 0.5 end as structure_score,
  case when empty then 0.0 when len(low) < 20 then 0.5 else greatest(0.0, 1.0 - case when mean_word < 2 or mean_word > 12 then 0.3 when mean_word < 3 or mean_word > 8 then 0.1 else 0 end - case when distinct_share < 0.1 then 0.3 when distinct_share > 0.95 and len(low) > 500 then 0.1 else 0 end - case when common_share < 0.01 then 0.2 else 0 end) end as coherence_score from q_more),
q_total as (select *, 0.25::double * text_score + 0.30::double * ocr_score + 0.15::double * format_score + 0.15::double * structure_score + 0.15::double * coherence_score as overall_score from q_scores),
scored as (select *, case when overall_score >= 0.8 then 'high' when overall_score >= 0.5 then 'medium' when overall_score >= 0.2 then 'low' else 'garbage' end as tier from q_total)"""


def _doubles(text: str) -> str:
    """Decimal literals as doubles, as sums of decimals would be exact."""
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\d:])", r"\1::double", text)


def _findings(table, serious=()) -> str:
    low = {k: t for k, t, _ in serious}
    parts = ", ".join(f"case when {k}_score < {t}" + (f" and {k}_score >= {low[k]}" if k in low else "") + f" then {sql.quoted(m)} end" for k, t, m in table)
    return f"array_to_string(list_filter([{parts}], lambda x: x is not null), ';')"


def _configs() -> str:
    import json

    return " ".join(f"when {sql.quoted(k)} then {sql.quoted(json.dumps(v, sort_keys=True))}" for k, v in quality.CONFIGS.items())


_QUALITY = "with " + _doubles(quality_ctes())
_PIPE = " ".join(f"when '{t}' then '{p}'" for t, (p, _) in quality.PIPELINES.items())
_WINDOWS = f"w as (select doc_id, {_W} as words from documents), c as (select doc_id, words, unnest(range(0, len(words), 350)) as start_word from w), windows as (select doc_id, start_word // 350 as chunk_index, start_word, words[start_word + 1:start_word + 400] as part from c)"

_PACK = rf"""with recursive p as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql.strip('x')}), lambda x: x <> '') as parts from documents),
f(doc_id, parts, i, first, n, out) as (select doc_id, parts, 1, 1, 0::bigint, []::struct(a bigint, b bigint)[] from p where len(parts) > 0
  union all select doc_id, parts, i + 1, case when n + k > 120 and i > first then i else first end, case when n + k > 120 and i > first then k else n + k end, case when n + k > 120 and i > first then list_append(out, {{'a': first::bigint, 'b': (i - 1)::bigint}}) else out end
  from (select *, len({sql.words('parts[i]')}) as k from f where i <= len(parts))),
d as (select doc_id, parts, list_append(out, {{'a': first::bigint, 'b': len(parts)::bigint}}) as out from f where i = len(parts) + 1),
t as (select doc_id, list_transform(out, lambda r: array_to_string(parts[r.a:r.b], chr(10))) as texts from d),
u as (select doc_id, texts, unnest(range(1, len(texts) + 1)) as j from t)
select doc_id, j - 1 as chunk_index, coalesce(list_sum(list_transform(texts[1:j - 1], lambda x: length(x) + 1)), 0)::bigint as start, len({sql.words('texts[j]')})::bigint as n_words, md5(texts[j]) as digest from u"""

# Breaks are marked, as RE2 has no look-around: a blank run behind an end of sentence before a capital, and line starts with a capital or digit.
# A run that ends a line is a break, and the line's start another one.
_SENTENCES = rf"""with s as (select doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(text, '([.!?])\s*\n([A-Z])', '\1' || chr(1) || chr(1) || '\2', 'g'), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), '\n\s*([A-Z0-9])', chr(10) || chr(1) || '\1', 'g'), chr(1)) as parts from documents),
e as (select doc_id, unnest(range(0, len(parts))) as sentence_index, unnest(list_transform(parts, lambda x: {sql.strip('x')})) as x from s)
select doc_id, sentence_index, len({sql.words('x')})::bigint as n_words, md5(x) as digest from e where length(x) >= 20"""


def _document_structure() -> str:
    from ..functions.metadata import CAPITALS, FISCAL_PERIOD
    from ..operators.structure import CODE_SIGNS, REPORT_TITLES, SUBTYPES, TABLE_TERMS

    sub = " ".join(f"when {sql.any_hit('lower(text)', k)} then '{n}'" for n, k in SUBTYPES)
    return rf"""with l as (select *, list_transform(string_split(text, chr(10)), lambda x: {sql.strip('x')}) as lines from documents)
select doc_id, list_filter(lines[1:10], lambda x: regexp_matches(x, {sql.quoted(CAPITALS)}) or regexp_matches(x, '(?i)^(Agreement|Contract|Amendment|Exhibit)'))[1] as legal_title, case {sub} else 'general_legal' end as legal_subtype, {sql.hits('lower(text)', CODE_SIGNS)} >= 2 as is_code,
  list_filter(lines[1:15], lambda x: {sql.any_hit('lower(x)', REPORT_TITLES)})[1] as financial_title, array_to_string({sql.first_seen(f'regexp_extract_all(text, {sql.quoted(FISCAL_PERIOD)}, 1)')}, ';') as fiscal_periods, {sql.hits('lower(text)', TABLE_TERMS)} >= 3 as has_tables from l"""


ORACLES = {
    "tokenize_counts": f"with t as (select doc_id, {sql.tokens('text')} as t, {_W} as w from documents) select doc_id, len(t) as n_tokens, len(list_distinct(t)) as n_distinct, len(w) as n_words, md5(array_to_string(t, ' ')) as digest from t",
    "stable_ids": "select doc_id, 'doc' || doc_id || '_' || substr(md5(text), 1, 12) as document_id, regexp_replace(md5('doc' || doc_id), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\\1-\\2-\\3-\\4-\\5') as vector_id, substr(md5('doc' || doc_id || '_0_' || substr(text, 1, 50)), 1, 12) as chunk_id from documents",
    "exact_dup_hash": "select md5(text) as file_hash, count(*) as copies, min(doc_id) as first_id from documents group by 1 having count(*) > 1",
    "quality_scores": _QUALITY + f" select doc_id, {', '.join(f'round({k}_score::double, 6) as {k}_score' for k in quality.WEIGHTS)}, round(overall_score, 6) as overall_score, tier, case when empty then {sql.quoted(quality.NEARLY_EMPTY)} else {_findings(quality.ISSUES)} end as issues, case when empty then '' else {_findings(quality.WARNINGS, quality.ISSUES)} end as warnings, case tier {_PIPE} end as recommended_pipeline, tier in ('low', 'garbage') as manual_review from scored",
    "quality_tier_counts": _QUALITY + " select tier, count(*) as n from scored group by tier",
    "quality_vs_label": _QUALITY + " select l.quality, s.tier, count(*) as n, round(avg(s.overall_score), 6) as mean_score from scored s join labels l on s.doc_id = l.doc_id group by 1, 2",
    "quality_metrics": rf"""with m as (select doc_id, text, {_W} as w, regexp_replace(text, '[^\p{{L}}]', '', 'g') as letters from documents)
select doc_id, length(text) as char_count, len(w) as word_count, len(string_split(text, chr(10))) as line_count, round(case when len(w) > 0 then list_sum(list_transform(w, lambda x: length(x))) / len(w) else 0 end, 6)::double as avg_word_length,
  round(case when len(w) > 0 then len(list_distinct(list_transform(w, lambda x: lower(x)))) / len(w) else 0 end, 6)::double as unique_word_ratio, round(case when length(letters) > 0 then length(regexp_replace(letters, '[^\p{{Lu}}]', '', 'g')) / length(letters) else 0 end, 6)::double as uppercase_ratio,
  round(case when length(text) > 0 then length(regexp_replace(text, '[^\p{{Nd}}]', '', 'g')) / length(text) else 0 end, 6)::double as digit_ratio, round(case when length(text) > 0 then length(regexp_replace(text, '[\p{{L}}\p{{N}}\s]', '', 'g')) / length(text) else 0 end, 6)::double as special_char_ratio from m""",
    "quality_router": _QUALITY + f" select case tier {_configs()} end as config, count(*) as n from scored group by 1",
    "word_window_chunks": f"with {_WINDOWS} select doc_id, chunk_index, start_word, len(part) as n_words, md5(array_to_string(part, ' ')) as digest from windows",
    "token_chunks": f"with w as (select doc_id, {_W} as words from documents), c as (select doc_id, words, unnest(range(0, len(words), 384)) as s from w), p as (select doc_id, s // 384 as chunk_index, words[s + 1:s + 512] as part from c) select doc_id, chunk_index, len(part) as n_words, md5(array_to_string(part, ' ')) as digest from p where len(part) >= 50",
    "greedy_line_pack": _PACK,
    "sentence_chunks": _SENTENCES,
    "chunk_strategy_route": _QUALITY + " select tier, case tier " + " ".join(f"when '{t}' then '{s}'" for t, s in chunking.STRATEGIES.items()) + " end as strategy, count(*) as n from scored group by 1, 2",
    "chunk_totals": f"with {_WINDOWS} select doc_id, count(*) as total_chunks, sum(len(part))::bigint as total_tokens from windows group by doc_id",
    "chunk_page_asof": """with c as (select doc_id, unnest(range(0, greatest(length(text) - 1, 0) + 1, 337)) as start from documents), p as (select doc_id, unnest(range(100, length(text) + 101, 1000)) as position from documents), n as (select *, (position - 100) // 1000 + 1 as page_number from p)
select c.doc_id, c.start, n.page_number from c asof left join n on c.doc_id = n.doc_id and c.start >= n.position""",
    "chunk_hierarchy_children": f"""with {_WINDOWS}, a as (select doc_id, chunk_index + 1 as chunk_index, doc_id || '_' || (chunk_index + 1) as chunk_id, doc_id || '_0' as parent_id from windows union all select doc_id, 0, doc_id || '_0', null from documents),
k as (select parent_id, string_agg(chunk_id, ',' order by chunk_index) as children from a where parent_id is not null group by 1)
select a.doc_id, a.chunk_index, a.chunk_id, a.parent_id, coalesce(k.children, '') as children_ids from a left join k on a.chunk_id = k.parent_id""",
    "document_structure": _document_structure(),
}
