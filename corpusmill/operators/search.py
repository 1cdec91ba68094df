"""Hybrid search and its enhanced form, for many queries at once, as compositions of the other operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import query_analysis as qa
from ..functions import terms
from ..sources.staging import staged
from . import bm25, fusion, graph
from .vectors import maxsim

#: How many candidates each list has for one result, what a precise hit adds, results of a precise search.
OVER_FETCH, ENHANCED_OVER_FETCH = 3, 2
PRECISE_BOOST, PRECISE_LIMIT = 0.5, 5
FALLBACK_BELOW, FALLBACK_LIMIT = 0.5, 5
REFERENCE_WORDS = {"table_reference": "Table", "section_reference": "Section", "exhibit_reference": "Exhibit"}


def ranked(found: DataFrame, method: str) -> DataFrame:
    return found.select("query_id", F.lit(method).alias("method"), "id", "score", "rank")


def hybrid(queries: DataFrame, index: bm25.Index, dense: DataFrame | None = None, pages: DataFrame | None = None, chunk_pages: DataFrame | None = None, limit: int = 10, dynamic: bool = True, weights: dict[str, float] | None = None, keep: Column | None = None) -> DataFrame:
    """The `limit` best of each query(query_id, query) by fused ranks.

    dense and pages are candidate lists that a vector search gave: dense(query_id, id, score, rank) and
    pages(query_id, document_id, page_number, score, rank); chunk_pages(id, document_id, page_number) says where
    chunks are. Page scores go to chunks that another method found. Weights: the given ones, else those of each
    query's modality if dynamic, else the defaults.
    """
    fetch = OVER_FETCH * limit
    lists = ranked(bm25.search(index, queries, fetch, keep=keep), "bm25")
    if dense is not None:
        lists = lists.unionAll(ranked(dense.where(F.col("rank") <= fetch), "dense"))
    if pages is not None and chunk_pages is not None:
        seen = lists.groupBy("query_id", "id").agg(F.min(F.struct(fusion.method_order(F.col("method")), "rank")).alias("ord"))
        placed = seen.join(chunk_pages, "id")
        lists = lists.unionAll(fusion.page_propagation(placed, pages.where(F.col("rank") <= fetch)).select("query_id", "method", "id", "score", "rank"))
    if weights is None and dynamic:
        w = queries.select("query_id", qa.weights(F.col("query")).alias("w"))
        lists = lists.join(w, "query_id").withColumn("weight", F.when(F.col("method") == "bm25", F.col("w.bm25")).when(F.col("method") == "dense", F.col("w.dense")).otherwise(F.col("w.colpali"))).drop("w")
        fused = fusion.rrf(lists, weight_col="weight")
    else:
        fused = fusion.rrf(lists, weights)
    return fused.where(F.col("rank") <= limit)


def precise(queries: DataFrame, index: bm25.Index, keep: Column | None = None) -> DataFrame:
    """Keyword results for the references that precise queries name, half a point above their score, all with rank 1. Queries without a reference have none."""
    named = queries.select("query_id", qa.precision(F.col("query")).alias("p")).where(F.col("p.reference").isNotNull())
    word = F.lit(None).cast("string")
    for kind, w in REFERENCE_WORDS.items():
        word = F.when(F.col("p.pattern_type") == kind, w).otherwise(word)
    asked = named.select("query_id", F.concat_ws(" ", word, F.col("p.reference")).alias("query"))
    found = bm25.search(index, asked, PRECISE_LIMIT, keep=keep)
    return found.select("query_id", "id", (F.col("score") + PRECISE_BOOST).alias("final_score"), F.col("score").alias("bm25_score"), F.lit(1).cast("long").alias("bm25_rank"), F.col("rank").alias("list_rank"))


def enhanced(queries: DataFrame, index: bm25.Index, dictionary: DataFrame, dense: DataFrame | None = None, edges: DataFrame | None = None, limit: int = 10, keep: Column | None = None, fallback_below: float = FALLBACK_BELOW, tenant_keep: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, analytics): queries are expanded by the dictionary, searched with twice the limit, precise hits come first, and graph neighbours last.

    A query whose confidence is under fallback_below also gets a plain keyword search of its words, and, if all of its
    results are of one document, a search without the caller's filters; at the default no query with results falls that
    low. keep: the tenant's and the caller's filter; tenant_keep: the tenant's alone, which the wider search keeps to;
    without it there is no wider search under a filter.
    """
    known = staged(terms.enhance(queries, dictionary), "queries")
    asked = known.select("query_id", F.col("expanded_query").alias("query"))
    base = hybrid(asked, index, dense, limit=ENHANCED_OVER_FETCH * limit, keep=keep)
    columns = ["query_id", "id", "final_score", "bm25_score", "bm25_rank", "dense_score", "dense_rank"]
    first = precise(queries, index, keep).select("query_id", "id", "final_score", "bm25_score", "bm25_rank", F.lit(None).cast("double").alias("dense_score"), F.lit(None).cast("long").alias("dense_rank"), F.lit(0).alias("priority"), F.col("list_rank").alias("rank"))
    merged = staged(fusion.priority_merge(first.unionAll(base.select(*columns, F.lit(1).alias("priority"), "rank"))), "merged")
    signals = fusion.failure_signals(merged.withColumn("document_id", F.col("id")), queries)
    weak = signals.where((F.col("confidence") < fallback_below) & F.array_contains("recommendations", "try_keyword_search")).select("query_id")
    plain = bm25.search(index, queries.join(weak, "query_id", "left_semi"), FALLBACK_LIMIT, keep=keep)
    more = plain.select("query_id", "id", F.col("score").alias("final_score"), F.col("score").alias("bm25_score"), F.lit(None).cast("long").alias("bm25_rank"), F.lit(None).cast("double").alias("dense_score"), F.lit(None).cast("long").alias("dense_rank"), F.lit(2).alias("priority"), "rank")
    if keep is None or tenant_keep is not None:
        narrow = signals.where((F.col("confidence") < fallback_below) & F.array_contains("recommendations", "expand_search")).select("query_id")
        wider = hybrid(queries.join(narrow, "query_id", "left_semi"), index, limit=FALLBACK_LIMIT, keep=tenant_keep)
        more = more.unionAll(wider.select("query_id", "id", "final_score", "bm25_score", "bm25_rank", "dense_score", "dense_rank", F.lit(2).alias("priority"), "rank"))
        weak = weak.unionAll(narrow).distinct()
    merged = staged(fusion.priority_merge(merged.unionAll(more)).withColumn("is_graph_augmented", F.lit(False)), "merged")
    if edges is not None:
        order = F.row_number().over(Window.partitionBy("query_id").orderBy("priority", "rank"))
        near = graph.augment(merged.select("query_id", "id", order.alias("rank")), edges)
        merged = merged.unionByName(near.select("query_id", "id", F.col("augmentation_score").alias("final_score"), F.lit(None).cast("double").alias("bm25_score"), F.lit(None).cast("long").alias("bm25_rank"), F.lit(None).cast("double").alias("dense_score"), F.lit(None).cast("long").alias("dense_rank"), F.lit(3).alias("priority"), F.col("ord").alias("rank"), F.lit(True).alias("is_graph_augmented")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("priority", "rank", "id"))
    results = staged(merged.withColumn("place", place.cast("long")).where(F.col("place") <= limit).select("place", *columns, "is_graph_augmented"), "results")
    used = fusion.methods_used(results.withColumn("colpali_rank", F.lit(None).cast("long")))
    summary = results.groupBy("query_id").agg(F.count("*").alias("total_results"), F.max_by("final_score", -F.col("place")).alias("top_result_score"))
    analytics = (
        known.select("query_id", F.col("query").alias("query_text"), qa.query_class(F.col("query")).alias("query_type"), "detected_domain", "expansions", qa.complexity(F.col("query")).level.alias("retrieval_level"), qa.precision(F.col("query")).is_precision.alias("is_precision"))
        .join(summary, "query_id", "left").join(used, "query_id", "left").join(signals.select("query_id", "confidence"), "query_id", "left")
        .join(weak.withColumn("fallback_triggered", F.lit(True)), "query_id", "left").na.fill({"total_results": 0, "fallback_triggered": False})
    )
    return results, analytics


def rerank(results: DataFrame, queries: DataFrame, texts: DataFrame, scorer: Callable, limit: int = 10) -> DataFrame:
    """results(query_id, id, ...) by scores of a model: scorer(queries: pandas.Series, texts: pandas.Series) -> pandas.Series, run as a pandas UDF over batches."""
    score = F.pandas_udf(scorer, "double")
    both = results.select("query_id", "id").join(queries.select("query_id", "query"), "query_id").join(texts.select("id", "text"), "id")
    return bm25.top(both.select("query_id", "id", score("query", "text").alias("score")), limit)


#: Element types of the table and figure searches, and how many results they give.
TABLE_TYPES, FIGURE_TYPES, ELEMENT_LIMIT = ("Table",), ("Image", "Figure"), 5


def visual_elements(query_patches: DataFrame, element_patches: DataFrame, types: tuple[str, ...] | None = None, limit: int = 10, keep: Column | None = None) -> DataFrame:
    """(query_id, id, score, rank): late interaction of queries with elements(id, element_type, vec), of some types and under a filter on their other columns."""
    own = element_patches if types is None else element_patches.where(F.col("element_type").isin(*types))
    return maxsim(query_patches, own if keep is None else own.where(keep), limit)


def table_elements(query_patches: DataFrame, element_patches: DataFrame, limit: int = ELEMENT_LIMIT, keep: Column | None = None) -> DataFrame:
    return visual_elements(query_patches, element_patches, TABLE_TYPES, limit, keep)


def figure_elements(query_patches: DataFrame, element_patches: DataFrame, limit: int = ELEMENT_LIMIT, keep: Column | None = None) -> DataFrame:
    return visual_elements(query_patches, element_patches, FIGURE_TYPES, limit, keep)


def with_elements(queries: DataFrame, element_patches: DataFrame, query_patches: DataFrame, limit: int = 10, keep: Column | None = None) -> DataFrame:
    """The second list of visual elements, of half the limit, for queries that ask for some: elements(id, element_type, vec), restricted to the types that a query names.

    Queries that name the same types are searched together; there are few sets of types.
    """
    asked = staged(queries.select("query_id", qa.visual_score(F.col("query")).alias("s"), qa.target_element_types(F.col("query")).alias("types")).where((F.col("s") >= qa.MIXED_AT) | F.col("types").isNotNull()), "asked")
    found = None
    for row in [r.types for r in asked.select("types").distinct().collect()]:  # as many as there are sets of types that queries can name
        own = query_patches.join(asked.where(F.col("types").eqNullSafe(F.lit(None) if row is None else F.array(*map(F.lit, row)))).select("query_id"), "query_id", "left_semi")
        one = visual_elements(own, element_patches, None if row is None else tuple(row), max(1, limit // 2), keep)
        found = one if found is None else found.unionAll(one)
    return maxsim(query_patches.limit(0), element_patches.limit(0), 1) if found is None else found


def search_with_elements(queries: DataFrame, index: bm25.Index, query_patches: DataFrame, element_patches: DataFrame, limit: int = 10, keep: Column | None = None, element_keep: Column | None = None, **more) -> tuple[DataFrame, DataFrame]:
    """(results, elements) of one call: the hybrid search, and beside it the elements for the queries that ask for some."""
    return hybrid(queries, index, limit=limit, keep=keep, **more), with_elements(queries, element_patches, query_patches, limit, element_keep)


def keyword_only(queries: DataFrame, index: bm25.Index, limit: int = 10, keep: Column | None = None) -> DataFrame:
    return hybrid(queries, index, limit=limit, dynamic=False, weights={"bm25": 1.0}, keep=keep)


def dense_only(dense: DataFrame, limit: int = 10) -> DataFrame:
    """A dense list alone, fused as any other."""
    return fusion.rrf(ranked(dense, "dense"), {"dense": 1.0}).where(F.col("rank") <= limit)
