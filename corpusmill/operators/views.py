"""Relational views over the document tables, in shapes that don't fan out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_overview(documents: DataFrame, chunks: DataFrame, pages: DataFrame, edges: DataFrame, id_col: str = "id", chunk_fk: str = "document_id", page_fk: str = "document_id", source: str = "source_document_id", target: str = "target_document_id", edge_id: str = "id", chunk_id: str = "id", page_id: str = "id") -> DataFrame:
    """documents with the numbers of distinct chunks, pages and relations.

    Each side is counted by document before it is joined; a relation belongs to the documents at both of its ends,
    which are two rows of an equi-join instead of a disjunction.
    """
    c = chunks.groupBy(F.col(chunk_fk).alias("__cm_c")).agg(F.count_distinct(chunk_id).alias("actual_chunks"))
    p = pages.groupBy(F.col(page_fk).alias("__cm_p")).agg(F.count_distinct(page_id).alias("actual_pages"))
    r = edges.select(F.col(edge_id).alias("e"), F.explode(F.array_distinct(F.array(source, target))).alias("__cm_r")).groupBy("__cm_r").agg(F.count_distinct("e").alias("relationship_count"))
    key = F.col(id_col)
    out = documents.join(c, key == F.col("__cm_c"), "left").join(p, key == F.col("__cm_p"), "left").join(r, key == F.col("__cm_r"), "left").drop("__cm_c", "__cm_p", "__cm_r")
    return out.na.fill(0, ["actual_chunks", "actual_pages", "relationship_count"])


def organization_stats(organizations: DataFrame, documents: DataFrame, chunks: DataFrame, pages: DataFrame, workspaces: DataFrame, literal: bool = False) -> DataFrame:
    """Counts and bytes of each organization(id, name).

    literal: bytes as the sum over the joined rows (documents times chunks times pages times workspaces), which counts
    a document's bytes many times; otherwise each document's bytes once. Neither form joins those rows.
    """
    c = chunks.groupBy(F.col("document_id").alias("__cm_c")).agg(F.count("*").alias("cn"), F.count_distinct("id").alias("cd"))
    p = pages.groupBy(F.col("document_id").alias("__cm_p")).agg(F.count("*").alias("pn"), F.count_distinct("id").alias("pd"))
    per_doc = documents.join(c, F.col("id") == F.col("__cm_c"), "left").join(p, F.col("id") == F.col("__cm_p"), "left")
    rows = F.greatest(F.coalesce("cn", F.lit(1)), F.lit(1)) * F.greatest(F.coalesce("pn", F.lit(1)), F.lit(1))
    d = per_doc.groupBy(F.col("organization_id").alias("__cm_d")).agg(F.count_distinct("id").alias("document_count"), F.coalesce(F.sum("cd"), F.lit(0)).alias("chunk_count"), F.coalesce(F.sum("pd"), F.lit(0)).alias("page_count"), F.sum(F.col("file_size_bytes") * (rows if literal else F.lit(1))).alias("bytes"))
    w = workspaces.groupBy(F.col("organization_id").alias("__cm_w")).agg(F.count_distinct("id").alias("workspace_count"))
    out = organizations.join(d, F.col("id") == F.col("__cm_d"), "left").join(w, F.col("id") == F.col("__cm_w"), "left")
    times = F.greatest(F.coalesce("workspace_count", F.lit(1)), F.lit(1)) if literal else F.lit(1)
    count = lambda n: F.coalesce(n, F.lit(0)).cast("long").alias(n)
    return out.select(F.col("id").alias("organization_id"), F.col("name").alias("organization_name"), count("document_count"), count("chunk_count"), count("page_count"), (F.col("bytes") * times).alias("total_size_bytes"), count("workspace_count"))


def store_stats(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """(table, status, n): rows of each table, and by a column of it where one is named; groups without rows don't appear."""
    out = None
    for name, (frame, by) in tables.items():
        one = frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit(None).cast("string").alias("status"), "n")
        if by:
            one = one.unionAll(frame.groupBy(F.col(by).cast("string").alias("status")).agg(F.count("*").alias("n")).select(F.lit(name), "status", "n"))
        out = one if out is None else out.unionAll(one)
    return out


def batch_summary(results: DataFrame, status_col: str = "status") -> DataFrame:
    return results.agg(F.count("*").alias("total"), F.count_if(F.col(status_col) == "completed").alias("successful"), F.count_if(F.col(status_col) == "failed").alias("failed"))
