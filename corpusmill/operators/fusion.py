"""Fusing ranked lists: weighted reciprocal ranks, page scores for chunks, merging by priority, signals of failure.

Ranked lists are rows of (query_id, method, id, score, rank); methods have a fixed order, which breaks ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The constant of reciprocal ranks, default weights, order of the methods, share of a page score for its document.
RRF_K = 60
DEFAULT_WEIGHTS = {"bm25": 0.3, "dense": 0.5, "colpali": 0.2}
METHODS = ("bm25", "dense", "colpali")
DOCUMENT_SHARE = 0.8
#: Fixed values of the failure signals.
LOW_SCORE, HIGH_VARIANCE = 0.3, 0.1


def method_order(method: Column) -> Column:
    out = F.lit(len(METHODS))
    for i, m in enumerate(METHODS):
        out = F.when(method == m, i).otherwise(out)
    return out


def weight_of(method: Column, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for m, w in weights.items():
        out = F.when(method == m, F.lit(float(w))).otherwise(out)
    return out


def rrf(ranked: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K, weight_col: str | None = None) -> DataFrame:
    """(query_id, id, final_score, rank, <method>_score, <method>_rank): sums of weight / (k + rank).

    Ties go to the id that a method earlier in the order ranks first. A method without a weight counts 1; an id that a
    list holds twice counts twice. weight_col: a column with the weight of each row instead.
    """
    w = F.col(weight_col) if weight_col else weight_of(F.col("method"), DEFAULT_WEIGHTS if weights is None else weights)
    own = ranked.withColumn("part", w / (k + F.col("rank"))).withColumn("seen", F.struct(method_order(F.col("method")).alias("m"), F.col("rank").alias("r")))
    by_method = [F.max(F.when(F.col("method") == m, F.col(c))).alias(f"{m}_{c}") for m in METHODS for c in ("score", "rank")]
    fused = own.groupBy("query_id", "id").agg(F.round(F.sum("part"), 12).alias("final_score"), F.min("seen").alias("seen"), *by_method)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("final_score").desc(), "seen", "id"))
    return fused.withColumn("rank", rank.cast("long")).drop("seen")


def page_propagation(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Scores of pages given to the chunks on them: candidates(query_id, id, document_id, page_number, ord), pages(query_id, document_id, page_number, score, rank).

    Chunks on a found page get its score. For a query without any such chunk, chunks of a found page's document get
    0.8 of the document's best page score. Result: (query_id, method, id, score, rank, page_rank, page_match).
    """
    on_page = candidates.join(pages.select("query_id", "document_id", "page_number", F.col("score").alias("page_score"), F.col("rank").alias("page_rank")), ["query_id", "document_id", "page_number"], "left")
    best = pages.groupBy("query_id", "document_id").agg(F.max("score").alias("doc_score"), F.min_by("rank", F.struct(-F.col("score"), F.col("rank"))).alias("doc_rank"))
    both = on_page.join(best, ["query_id", "document_id"], "left")
    some = F.max(F.col("page_score").isNotNull()).over(Window.partitionBy("query_id"))
    scored = both.withColumn("some", some).withColumn("page_match", F.col("page_score").isNotNull()).where(F.col("page_match") | (~F.col("some") & F.col("doc_score").isNotNull()))
    out = scored.select("query_id", "id", "ord", "page_match", F.when(F.col("page_match"), F.col("page_score")).otherwise(DOCUMENT_SHARE * F.col("doc_score")).alias("score"), F.coalesce("page_rank", "doc_rank").alias("page_rank"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "ord"))
    return out.withColumn("rank", rank.cast("long")).select("query_id", F.lit("colpali").alias("method"), "id", "score", "rank", "page_rank", "page_match")


def priority_merge(lists: DataFrame, key: tuple[str, ...] = ("query_id", "id"), order: tuple[str, ...] = ("priority", "rank")) -> DataFrame:
    """The first row of every key, by priority of its list and rank there."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return lists.withColumn("first", first).where("first = 1").drop("first")


def failure_signals(results: DataFrame, queries: DataFrame, least_score: float = LOW_SCORE) -> DataFrame:
    """One row a query of queries(query_id): signs that results(query_id, id, document_id, final_score, bm25_rank, dense_rank) can't be relied on.

    A query without results has confidence 0.
    """
    n, mean, variance = F.count("id"), F.avg("final_score"), F.var_pop("final_score")
    own = results.groupBy("query_id").agg(
        n.alias("n"), mean.alias("mean"), variance.alias("variance"), F.count_distinct("document_id").alias("documents"), (F.count("bm25_rank") > 0).alias("has_bm25"), (F.count("dense_rank") > 0).alias("has_dense")
    )
    out = queries.select("query_id").distinct().join(own, "query_id", "left")
    none = F.col("n").isNull()
    low, high = F.coalesce(F.col("mean") < least_score, F.lit(False)), F.coalesce((F.col("n") > 1) & (F.col("variance") > HIGH_VARIANCE), F.lit(False))
    single = F.coalesce(F.col("documents") == 1, F.lit(False))
    missing = F.when(none, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(F.when(~F.col("has_bm25"), F.lit("bm25")), F.when(~F.col("has_dense"), F.lit("dense")))))
    confidence = F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.when(low, 0.2).otherwise(0.0) - F.when(high, 0.1).otherwise(0.0) - 0.1 * F.size(missing)))
    advice = F.array_compact(F.array(F.when(none, F.lit("no_results_fallback")), F.when(low, F.lit("try_keyword_search")), F.when(single, F.lit("expand_search"))))
    return out.select("query_id", low.alias("low_scores"), high.alias("high_variance"), single.alias("single_source"), missing.alias("missing_methods"), confidence.alias("confidence"), advice.alias("recommendations"))


def methods_used(results: DataFrame) -> DataFrame:
    """(query_id, methods): the methods that ranked any result, sorted."""
    named = F.explode(F.array_compact(F.array(*[F.when(F.col(f"{m}_rank").isNotNull(), F.lit(m)) for m in METHODS if f"{m}_rank" in results.columns], *([F.when(F.col("is_graph_augmented"), F.lit("graph"))] if "is_graph_augmented" in results.columns else []))))
    return results.select("query_id", named.alias("m")).groupBy("query_id").agg(F.array_sort(F.collect_set("m")).alias("methods"))
