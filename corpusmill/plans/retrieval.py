"""Queries of keyword, vector and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bm25, fusion, search, tenancy, vectors
from . import sql

K = 10


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _benchmark(spark, d):
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _index(spark, d):
    return bm25.build(_t(spark, d, "documents").select("doc_id", "text", F.col("source").alias("organization_id"), F.col("lang").alias("workspace_id")))


def _rounded(frame, *names, digits=6):
    return frame.withColumns({n: sql.rounded(F.col(n), digits) for n in names})


def bm25_topk_benchmark(spark, d):
    return _rounded(bm25.search(_index(spark, d), _benchmark(spark, d), K), "score")


def bm25_topk_tenant_filtered(spark, d):
    keep = tenancy.condition({"organization_id": ["src0", "src1"], "workspace_id": "en"}, ranges=False)
    return _rounded(bm25.search(_index(spark, d), _benchmark(spark, d), K, keep=keep), "score")


def bm25_corpus_stats(spark, d):
    return _rounded(bm25.corpus_stats(_index(spark, d)), "avgdl")


def term_document_frequency_top(spark, d):
    return bm25.term_stats(bm25.analysed(_t(spark, d, "documents").select("doc_id", "text"))).orderBy(F.col("df").desc(), "term").limit(100)


def _query_vectors(spark, d):
    return _t(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


def _dense(spark, d, metric, **more):
    return _rounded(vectors.nearest(_t(spark, d, "embeddings"), _query_vectors(spark, d), K, metric, **more), "score", digits=5)


def dense_cosine_topk(spark, d):
    return _dense(spark, d, "cosine")


def dense_dot_topk(spark, d):
    return _dense(spark, d, "dot")


def dense_l2_topk(spark, d):
    return _dense(spark, d, "euclid")


def dense_filtered_threshold(spark, d):
    return _dense(spark, d, "cosine", threshold=0.2, keep=tenancy.condition({"label": {"gte": 2, "lt": 7}}))


def _patches(spark, d):
    e = _t(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select((F.col("vec_id") % 100).alias("query_id"), F.col("vec_id").alias("patch_id"), F.col("embedding").alias("vec"))
    return q, e.select(F.col("label").cast("long").alias("id"), F.col("embedding").alias("vec"))


def maxsim_pages(spark, d):
    q, p = _patches(spark, d)
    return _rounded(vectors.maxsim(q, p, K), "score", digits=5)


def meanpool_vectors(spark, d):
    pooled = vectors.pooled(_t(spark, d, "embeddings").select(F.col("label").cast("long").alias("id"), F.col("embedding").alias("vec")))
    return pooled.select("id", F.posexplode("vec").alias("at", "x")).select("id", F.col("at").cast("long").alias("at"), F.round("x", 6).alias("x"))


def _dense_lists(spark, d):
    """Dense lists of the benchmark texts, for which vector n stands for document and query n."""
    e = _t(spark, d, "embeddings")
    asked = e.join(_t(spark, d, "benchmark"), F.col("vec_id") == F.col("item_id")).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return vectors.nearest(e, asked, 3 * K)


def _hybrid_lists(spark, d):
    """Keyword lists of the benchmark texts, and their dense lists."""
    return bm25.search(_index(spark, d), _benchmark(spark, d), 3 * K), _dense_lists(spark, d)


def _fused(spark, d, weights):
    words, dense = _hybrid_lists(spark, d)
    out = fusion.rrf(search.ranked(words, "bm25").unionAll(search.ranked(dense, "dense")), weights)
    return _rounded(out.select("query_id", "id", "final_score", "bm25_rank", "dense_rank", "rank"), "final_score", digits=9)


def rrf_fuse_weighted(spark, d):
    return _fused(spark, d, fusion.DEFAULT_WEIGHTS)


def rrf_fuse_equal(spark, d):
    return _fused(spark, d, {})


def hybrid_search(spark, d):
    out = search.hybrid(_benchmark(spark, d), _index(spark, d), _dense_lists(spark, d), limit=K)
    return _rounded(out.select("query_id", "id", "final_score", "bm25_rank", "dense_rank", "rank"), "final_score", digits=9)


def _pages(spark, d):
    """Pages of a vector search: vector n is page n modulo 7 of document n; chunks are vectors too."""
    at = _dense_lists(spark, d).select("query_id", "id", "score", "rank", (F.col("id") % 40).alias("document_id"), (F.col("id") % 7).alias("page_number"))
    pages = at.where("rank <= 8").groupBy("query_id", "document_id", "page_number").agg(F.max("score").alias("score"), F.min("rank").alias("rank"))
    return at, pages


def page_score_propagation(spark, d):
    at, pages = _pages(spark, d)
    out = fusion.page_propagation(at.select("query_id", "id", "document_id", "page_number", F.col("rank").alias("ord")), pages)
    return _rounded(out.drop("method"), "score", digits=5)


def doc_level_boost(spark, d):
    at, pages = _pages(spark, d)
    out = fusion.page_propagation(at.select("query_id", "id", "document_id", (F.col("page_number") + 100).alias("page_number"), F.col("rank").alias("ord")), pages)
    return _rounded(out.drop("method"), "score", digits=5)


def priority_merge(spark, d):
    words, dense = _hybrid_lists(spark, d)
    lists = words.select("query_id", "id", "rank", F.lit(0).alias("priority")).unionAll(dense.select("query_id", "id", "rank", F.lit(1)))
    return fusion.priority_merge(lists)


def failure_signals(spark, d):
    words, dense = _hybrid_lists(spark, d)
    fused = fusion.rrf(search.ranked(words, "bm25").unionAll(search.ranked(dense, "dense"))).where(f"rank <= {K}")
    out = fusion.failure_signals(fused.withColumn("document_id", F.col("id") % 40), _benchmark(spark, d))
    return out.select("query_id", "low_scores", "high_variance", "single_source", F.array_join("missing_methods", ",").alias("missing_methods"), F.round("confidence", 6).alias("confidence"), F.array_join("recommendations", ",").alias("recommendations"))


def enhanced_search(spark, d):
    """Rows only: results of the enhanced search of the first user turn of every conversation, with neighbours of a chain of documents."""
    from ..functions import terms

    turns = _t(spark, d, "conversations").where("role = 'user'")
    first = Window.partitionBy("conv_id").orderBy("turn")
    asked = turns.withColumn("n", F.row_number().over(first)).where("n = 1").select(F.col("conv_id").alias("query_id"), F.col("text").alias("query"))
    edges = _t(spark, d, "documents").select(F.col("doc_id").alias("source_id"), (F.col("doc_id") + 1).alias("target_id"), F.lit("references").alias("relation_type"), F.lit(0.7).alias("confidence"), F.col("doc_id").alias("ord"))
    return search.enhanced(asked, _index(spark, d), terms.dictionary(spark), edges=edges, limit=K)[0]


def methods_used(spark, d):
    words, dense = _hybrid_lists(spark, d)
    fused = fusion.rrf(search.ranked(words, "bm25").unionAll(search.ranked(dense, "dense"))).where(f"rank <= {K}")
    return fusion.methods_used(fused).select("query_id", F.array_join("methods", ",").alias("methods"))


QUERIES = {f.__name__: f for f in (
    bm25_topk_benchmark, bm25_topk_tenant_filtered, bm25_corpus_stats, term_document_frequency_top, dense_cosine_topk, dense_dot_topk, dense_l2_topk, dense_filtered_threshold, maxsim_pages, meanpool_vectors,
    rrf_fuse_weighted, rrf_fuse_equal, hybrid_search, page_score_propagation, doc_level_boost, priority_merge, failure_signals, enhanced_search, methods_used,
)}

_DOCS = "select doc_id as id, text, source, lang from documents"
_LISTS = "with " + sql.bm25_ctes(k=3 * K) + ", " + sql.dense_ctes(k=3 * K, queries="select e.vec_id as query_id, e.embedding as v from embeddings e join benchmark b on e.vec_id = b.item_id")
_ORDER = "case method when 'bm25' then 0 when 'dense' then 1 else 2 end"


def _rrf(weight: str, where: str = "true") -> str:
    return f"""{_LISTS}, lists as (select query_id, 'bm25' as method, id, rank from bm25 union all select query_id, 'dense', id, rank from dense),
parts as (select l.*, {weight} / ({fusion.RRF_K} + l.rank) as part, {{'m': {_ORDER}, 'r': rank}} as seen from lists l),
sums as (select query_id, id, round(sum(part), 12) as final_score, min(seen) as seen, max(case when method = 'bm25' then rank end) as bm25_rank, max(case when method = 'dense' then rank end) as dense_rank from parts group by query_id, id),
fused as (select *, row_number() over (partition by query_id order by final_score desc, seen, id) as rank from sums)"""


_FUSED = " select query_id, id, round(final_score, 9) as final_score, bm25_rank, dense_rank, rank from fused"
_WEIGHTED = "case method when 'bm25' then 0.3 when 'dense' then 0.5 else 0.2 end"
_PAGES = f"""{_LISTS}, loc as (select query_id, id, score, rank, id % 40 as document_id, id % 7 as page_number from dense),
pages as (select query_id, document_id, page_number, max(score) as score, min(rank) as rank from loc where rank <= 8 group by 1, 2, 3),
best as (select query_id, document_id, max(score) as doc_score, arg_min(rank, -score) as doc_rank from pages group by 1, 2)"""


def _propagated(page: str) -> str:
    return f"""{_PAGES}, both_ as (select a.query_id, a.id, a.rank as ord, p.score as page_score, p.rank as page_rank, b.doc_score, b.doc_rank from loc a left join pages p on a.query_id = p.query_id and a.document_id = p.document_id and {page} = p.page_number left join best b on a.query_id = b.query_id and a.document_id = b.document_id),
flagged as (select *, max((page_score is not null)::int) over (partition by query_id) as some_ from both_),
out as (select query_id, id, ord, page_score is not null as page_match, coalesce(page_score, {fusion.DOCUMENT_SHARE} * doc_score) as score, coalesce(page_rank, doc_rank) as page_rank from flagged where page_score is not null or (some_ = 0 and doc_score is not null))
select query_id, id, round(score, 5) as score, row_number() over (partition by query_id order by score desc, ord) as rank, page_rank, page_match from out"""




def _hybrid_sql() -> str:
    from .queries_sql import weights_ctes

    return _rrf("(select case l.method when 'bm25' then w.bm25 when 'dense' then w.dense else w.colpali end from weights w where w.query_id = l.query_id)").replace("with ", "with " + weights_ctes("select item_id as query_id, text as query from benchmark") + ", ", 1) + _FUSED + f" where rank <= {K}"


ORACLES = {
    "bm25_topk_benchmark": "with " + sql.bm25_ctes(k=K) + " select query_id, id, round(score, 6) as score, rank from bm25",
    "bm25_topk_tenant_filtered": "with " + sql.bm25_ctes(_DOCS, k=K, keep="source in ('src0', 'src1') and lang = 'en'") + " select query_id, id, round(score, 6) as score, rank from bm25",
    "bm25_corpus_stats": "with " + sql.bm25_ctes() + " select n_docs, round(avgdl, 6) as avgdl, (select count(*) from b_terms) as vocabulary from b_corpus",
    "term_document_frequency_top": "with " + sql.bm25_ctes() + " select term, df from b_df order by df desc, term limit 100",
    "dense_cosine_topk": "with " + sql.dense_ctes() + " select query_id, id, round(score, 5) as score, rank from dense",
    "dense_dot_topk": "with " + sql.dense_ctes("list_dot_product(q.v, e.v)") + " select query_id, id, round(score, 5) as score, rank from dense",
    "dense_l2_topk": "with " + sql.dense_ctes("-list_distance(q.v, e.v)") + " select query_id, id, round(score, 5) as score, rank from dense",
    "dense_filtered_threshold": "with " + sql.dense_ctes(keep="label >= 2 and label < 7") + " select query_id, id, round(score, 5) as score, rank from dense where score >= 0.2",
    "maxsim_pages": f"""with q as (select vec_id % 100 as query_id, vec_id as patch_id, embedding::double[] as v from embeddings where vec_id % 50 = 0), p as (select label::bigint as id, embedding::double[] as v from embeddings),
best as (select query_id, patch_id, id, max(list_dot_product(q.v, p.v)) as s from q, p group by 1, 2, 3), sums as (select query_id, id, sum(s) as score from best group by 1, 2)
select query_id, id, round(score, 5) as score, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from sums) where rank <= {K}""",
    "meanpool_vectors": """with e as (select label::bigint as id, unnest(range(0, len(embedding))) as i, unnest(embedding)::double as x from embeddings), m as (select id, i, avg(x) as x from e group by 1, 2), n as (select id, sqrt(sum(x * x)) as n from m group by id)
select m.id, m.i as "at", round(m.x / n.n, 6) as x from m join n on m.id = n.id""",
    "rrf_fuse_weighted": _rrf(_WEIGHTED) + _FUSED,
    "rrf_fuse_equal": _rrf("1.0") + _FUSED,
    "hybrid_search": None,
    "page_score_propagation": _propagated("a.page_number"),
    "doc_level_boost": _propagated("(a.page_number + 100)"),
    "priority_merge": _LISTS + ", lists as (select query_id, id, rank, 0 as priority from bm25 union all select query_id, id, rank, 1 from dense) select query_id, id, rank, priority from (select *, row_number() over (partition by query_id, id order by priority, rank) as n from lists) where n = 1",
    "failure_signals": _rrf(_WEIGHTED) + f""", r as (select *, id % 40 as document_id from fused where rank <= {K}),
s as (select query_id, count(*) as n, avg(final_score) as mean, var_pop(final_score) as variance, count(distinct document_id) as documents, count(bm25_rank) > 0 as has_bm25, count(dense_rank) > 0 as has_dense from r group by query_id),
f as (select b.item_id as query_id, s.n, coalesce(s.mean < {fusion.LOW_SCORE}, false) as low_scores, coalesce(s.n > 1 and s.variance > {fusion.HIGH_VARIANCE}, false) as high_variance, coalesce(s.documents = 1, false) as single_source, list_filter([case when not s.has_bm25 then 'bm25' end, case when not s.has_dense then 'dense' end], lambda x: x is not null) as missing from benchmark b left join s on s.query_id = b.item_id)
select query_id, low_scores, high_variance, single_source, array_to_string(missing, ',') as missing_methods, round(case when n is null then 0.0 else greatest(0.0, 1.0 - case when low_scores then 0.2 else 0 end - case when high_variance then 0.1 else 0 end - 0.1 * len(missing)) end, 6)::double as confidence,
  array_to_string(list_filter([case when n is null then 'no_results_fallback' end, case when low_scores then 'try_keyword_search' end, case when single_source then 'expand_search' end], lambda x: x is not null), ',') as recommendations from f""",
    "methods_used": _rrf(_WEIGHTED) + f", m as (select query_id, unnest(list_filter([case when bm25_rank is not null then 'bm25' end, case when dense_rank is not null then 'dense' end], lambda x: x is not null)) as m from fused where rank <= {K}) select query_id, array_to_string(list_sort(list(distinct m)), ',') as methods from m group by query_id",
}
ORACLES["hybrid_search"] = _hybrid_sql()
