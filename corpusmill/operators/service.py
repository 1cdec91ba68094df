"""The document service: ingest a batch of files' texts into a store, search it, list, read and delete documents.

Every call is bound to a tenant; what it reads and writes is the tenant's. One ingest handles a whole batch as
DataFrames: quality, type and metadata, chunks, tables, relations, and a job row for each document.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metadata, quality
from ..functions.ids import document_id
from ..sources.staging import staged
from ..sources.store import Store, WriteConflict, page_of
from . import bm25, chunking, graph, search, tables, tenancy

#: Columns of chunks that a search may filter by.
FILTERS = ("document_id", "organization_id", "workspace_id", "access_level", "page_number", "section_title", "element_type", "chunk_index")

class DocumentService:
    def __init__(self, store: Store, context: tenancy.TenantContext):
        self.store, self.context = store, context
        self._index: tuple[int, bm25.Index] | None = None

    def _own(self, table: str) -> DataFrame:
        """The tenant's rows of a table; tables without an access level are filtered by organization alone."""
        frame = self.store.read(table)
        filters = {k: v for k, v in self.context.filters().items() if k in frame.columns}
        return frame.where(tenancy.condition(filters))

    def _stamped(self, frame: DataFrame) -> DataFrame:
        return tenancy.stamped(frame, self.context).withColumns({"created_at": F.current_timestamp().cast("timestamp_ntz"), "updated_at": F.current_timestamp().cast("timestamp_ntz")})

    def ingest(self, files: DataFrame, hint: str | None = None, skip_garbage: bool = False) -> DataFrame:
        """files(filename, text, error) into the store; (document_id, status, quality_level, total_chunks, total_tables, total_relations, error_message) of each.

        A document's id is the file's stem and a digest of its text, so the same file replaces itself. hint: the
        documents' type. skip_garbage: leave out texts of the lowest tier. A file with an error (see files.joined_texts;
        the column may be missing) fails by itself: it gets a job row and nothing else, and the others go on.
        """
        failed = None
        if "error" in files.columns:
            failed = staged(files.where("error is not null").select(document_id(F.regexp_replace("filename", r"\.[^.]+$", ""), F.lit("")).alias("doc_id"), F.col("error").alias("error_message")).dropDuplicates(["doc_id"]), "failed")
            files = files.where("error is null")
        stem = F.regexp_replace("filename", r"\.[^.]+$", "")
        docs = files.select(document_id(stem, F.coalesce("text", F.lit(""))).alias("doc_id"), "filename", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["doc_id"])
        scored = quality.with_quality(docs)
        scored = scored.where("tier <> 'garbage'") if skip_garbage else scored
        kind = metadata.route(F.col("text"), F.col("filename"), F.lit(hint).cast("string"))
        docs = staged(scored.withColumns({"document_type": kind, "title": metadata.title(F.col("text"))}), "ingest")
        chunks = staged(chunking.structured_chunks(docs, tier_col="tier"), "chunks")
        found = staged(tables.extract(docs), "tables")
        known = docs.select(F.explode(F.array_compact(F.array("title", F.regexp_replace("filename", r"\.[^.]+$", "")))).alias("identifier"), F.col("doc_id").alias("document_id")).withColumn("ord", F.xxhash64("identifier", "document_id"))
        edges = staged(graph.resolve(graph.extract(docs), known), "edges")
        count = lambda frame, name, key="doc_id": frame.groupBy(F.col(key).alias("of")).agg(F.count("*").alias(name))
        summary = docs.select("doc_id", "tier")
        for frame, name, key in ((chunks, "total_chunks", "doc_id"), (found, "total_tables", "doc_id"), (edges, "total_relations", "source_id")):
            summary = summary.join(count(frame, name, key), F.col("doc_id") == F.col("of"), "left").drop("of").na.fill(0, [name])
        summary = staged(summary, "summary")
        rows = docs.join(summary.select(F.col("doc_id").alias("of"), "total_chunks"), F.col("doc_id") == F.col("of")).join(chunking.totals(chunks).select(F.col("doc_id").alias("of2"), "total_tokens"), F.col("doc_id") == F.col("of2"), "left")
        self.store.upsert("documents", self._stamped(rows.select(
            F.col("doc_id").alias("id"), "filename", F.col("filename").alias("file_path"), F.length("text").cast("long").alias("file_size_bytes"), F.md5("text").alias("file_hash"), "document_type", F.lit("completed").alias("status"),
            F.col("tier").alias("quality_level"), (F.col("overall_score") * 100).alias("quality_score"), F.col("total_chunks").cast("int").alias("total_chunks"), F.col("total_tokens").cast("int").alias("total_tokens"), "title",
        )), ["organization_id", "id"])
        self.store.replace("chunks", self._stamped(chunks.select(
            F.col("chunk_id").alias("id"), F.col("doc_id").alias("document_id"), "text", F.col("chunk_index").cast("int").alias("chunk_index"), F.col("char_start").cast("int").alias("char_start"), F.col("char_end").cast("int").alias("char_end"),
            F.col("level").alias("chunk_level"), F.col("parent_id").alias("parent_chunk_id"), "section_title", "section_number", F.col("token_count").cast("int").alias("token_count"), F.length("text").alias("char_count"),
        )))
        self.store.replace("extracted_tables", self._stamped(found.select(
            F.col("table_id").alias("id"), F.col("doc_id").alias("document_id"), F.col("table_index").cast("int").alias("table_index"), F.to_json("raw_data").alias("structured_data"), F.col("semantic_description").alias("description"),
            F.col("num_rows").cast("int").alias("num_rows"), F.col("num_cols").cast("int").alias("num_cols"),
        )))
        self.store.replace("quality_reports", self._stamped(docs.select(
            F.col("doc_id").alias("document_id"), "overall_score", F.col("text_score").alias("text_extraction_score"), F.col("ocr_score").alias("ocr_artifact_score"), F.col("format_score").alias("formatting_score"), "coherence_score",
            F.col("tier").alias("quality_level"), F.col("issues").alias("issues_found"), F.col("warnings").alias("recommendations"), "recommended_pipeline",
        )))
        self.store.upsert("document_relationships", self._stamped(edges.select(
            F.col("source_id").alias("source_document_id"), F.col("target_id").alias("target_document_id"), "relation_type", "confidence", F.col("context").alias("evidence_text"), F.lit("pattern").alias("detected_by"),
        )), ["organization_id", "source_document_id", "target_document_id", "relation_type"])
        done = summary.select(F.col("doc_id").alias("document_id"), F.lit("completed").alias("status"), F.col("tier").alias("quality_level"), "total_chunks", "total_tables", "total_relations", F.lit(None).cast("string").alias("error_message"))
        if failed is not None:
            none = F.lit(0).cast("long")
            done = done.unionAll(failed.select("doc_id", F.lit("failed"), F.lit(None).cast("string"), none, none, none, "error_message"))
        self._jobs(done.select("document_id", "status", "error_message"))
        return done

    def _jobs(self, outcomes: DataFrame) -> None:
        """A finished job for each of outcomes(document_id, status, error_message)."""
        now = F.current_timestamp().cast("timestamp_ntz")
        number = F.xxhash64(F.lit(self.context.organization_id), "document_id", F.lit(uuid.uuid4().hex))
        self.store.append("processing_jobs", self._stamped(outcomes.select(
            number.alias("id"), "document_id", F.lit("ingest").alias("job_type"), "status", F.when(F.col("status") == "completed", 100).otherwise(0).alias("progress_percent"), "error_message", now.alias("started_at"), now.alias("completed_at"),
        )))

    def update_job(self, number: int, status: str | None = None, progress: int | None = None, step: str | None = None, error: str | None = None) -> None:
        """Change a job of the tenant: it starts at its first processing and ends at its last completed or failed. What is None or empty stays."""
        now = F.current_timestamp().cast("timestamp_ntz")
        values = {name: F.lit(x) for name, x in (("status", status), ("current_step", step), ("error_message", error)) if x}
        if progress is not None:
            values["progress_percent"] = F.lit(progress)
        if status == "processing":
            values["started_at"] = F.coalesce(F.col("started_at"), now)
        if status in ("completed", "failed"):
            values["completed_at"] = now
        self._update("processing_jobs", number, values)

    def update_document(self, key: str, **values) -> None:
        """Change columns of one of the tenant's documents; its id and tenant can't be changed."""
        fixed = {"id", *tenancy.TENANT_KEYS} & set(values)
        if fixed:
            raise PermissionError(f"{sorted(fixed)} can't be changed")
        self._update("documents", key, {k: F.lit(v) for k, v in values.items()} | {"updated_at": F.current_timestamp().cast("timestamp_ntz")})

    def _update(self, table: str, key, values: dict) -> None:
        if self._own(table).where(F.col("id") == key).isEmpty():
            raise KeyError(key)
        self.store.update(table, key, self.context.organization_id, values)

    def search(self, queries: DataFrame, limit: int = 10, filters: dict | None = None, dense: DataFrame | None = None) -> DataFrame:
        """The best paragraphs for each of queries(query_id, query), with their text and document; filters apply beside the tenant's."""
        index, texts, own, wider = self._searched(filters)
        found = search.hybrid(queries, index, dense, limit=limit, keep=own)
        return found.join(texts, "id").select("query_id", "rank", "id", "document_id", "final_score", "bm25_rank", "dense_rank", "text", "section_title")

    def _searched(self, filters: dict | None) -> tuple[bm25.Index, DataFrame, Column, Column]:
        """(index of the paragraphs of the tenant's organization, their texts, the caller's condition, the tenant's). The index is kept until chunks change."""
        every = self.store.read("chunks")
        rows = every.withColumns({c: F.lit(None).cast("string") for c in (*FILTERS, "chunk_level") if c not in every.columns}).where("chunk_level = 'paragraph'").where(F.col("organization_id") == self.context.organization_id)
        version = self.store.version("chunks")
        if self._index is None or self._index[0] != version:
            self._index = (version, bm25.build(rows.select("id", "text", *FILTERS), "id"))
        limits = lambda f: tenancy.condition({k: v for k, v in f.items() if k in FILTERS}, ranges=False)
        wanted = tenancy.merged_filters(self.context, filters)
        unknown = set(wanted) - set(FILTERS) - {"collection_id"}
        if unknown:
            raise ValueError(f"chunks can't be filtered by {sorted(unknown)}")
        return self._index[1], rows.select("id", "document_id", "text", "section_title"), limits(wanted), limits(self.context.filters())

    def enhanced_search(self, queries: DataFrame, dictionary: DataFrame, limit: int = 10, filters: dict | None = None, dense: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
        """The enhanced search of queries(query_id, query) in the tenant's paragraphs; what was asked and found is added to the log of searches."""
        index, texts, own, wider = self._searched(filters)
        results, analytics = search.enhanced(queries, index, dictionary, dense, edges, limit, keep=own, tenant_keep=wider)
        self.store.append("search_queries", self._stamped(analytics.select(
            F.xxhash64("query_text", F.lit(uuid.uuid4().hex)).alias("id"), F.lit(self.context.user_id).cast("string").alias("user_id"), "query_text", F.md5("query_text").alias("query_hash"), "query_type", "detected_domain", F.col("total_results").cast("int").alias("total_results"), "top_result_score",
            F.col("methods").alias("retrieval_methods"), F.col("expansions").alias("acronyms_expanded"), "fallback_triggered",
        )))
        return results.join(texts, "id").select(*results.columns, "document_id", "text", "section_title")

    def context_of(self, results: DataFrame, siblings: int = 1) -> DataFrame:
        """Parents and neighbours of results(query_id, id) among the tenant's chunks."""
        own = self._own("chunks").select("id", F.col("parent_chunk_id").alias("parent_id"), "chunk_index", "text")
        return chunking.with_context(results, own, siblings)

    def relations(self, key: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
        """The tenant's relations from or to a document, of some types."""
        own = self._own("document_relationships").where((F.col("source_document_id") == key) | (F.col("target_document_id") == key))
        return own.where(F.col("relation_type").isin(*kinds)) if kinds else own

    def list_documents(self, document_type: str | None = None, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        filters = {k: v for k, v in (("document_type", document_type), ("status", status)) if v}
        return page_of(self._own("documents").where(tenancy.condition(filters)), [F.col("created_at").desc(), F.col("id")], limit, offset)

    def document(self, key: str) -> DataFrame:
        return self._own("documents").where(F.col("id") == key)

    def chunks(self, key: str) -> DataFrame:
        return self._own("chunks").where(F.col("document_id") == key).orderBy("chunk_index")

    def delete(self, keys: list[str]) -> None:
        """Delete the tenant's documents of these ids with all that hangs on them; others' stay."""
        self.store.delete_documents(self._own("documents").where(F.col("id").isin(keys)).select("id", "organization_id"))

    def stats(self) -> DataFrame:
        from .views import store_stats

        return store_stats({"documents": (self._own("documents"), "document_type"), "chunks": (self._own("chunks"), "chunk_level"), "tables": (self._own("extracted_tables"), None), "relations": (self._own("document_relationships"), "relation_type"), "jobs": (self._own("processing_jobs"), "status")})

    def health(self) -> dict[str, bool]:
        """Which tables can be read."""
        out = {}
        for table in ("documents", "chunks", "document_relationships"):
            try:
                self.store.read(table).schema  # noqa: B018
                out[table] = True
            except (PySparkException, Py4JError, WriteConflict):  # Spark, the file system, or the pointer
                out[table] = False
        return out
