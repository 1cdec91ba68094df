"""Schemas of the document tables, allowed values, and the mapping between a chunk's forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the tables.
SCHEMAS = {
    "organizations": "id string, name string, settings string, created_at timestamp_ntz, updated_at timestamp_ntz, is_active boolean",
    "workspaces": "id string, organization_id string, name string, description string, settings string, created_at timestamp_ntz, updated_at timestamp_ntz, is_active boolean",
    "collections": "id string, organization_id string, workspace_id string, name string, description string, settings string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "documents": "id string, organization_id string, workspace_id string, collection_id string, access_level string, filename string, file_path string, file_size_bytes bigint, file_extension string, mime_type string, file_hash string, document_type string, document_subtype string, status string, quality_level string, quality_score double, total_chunks int, total_pages int, total_tokens int, languages array<string>, title string, summary string, owner_id string, created_by string, updated_by string, created_at timestamp_ntz, updated_at timestamp_ntz, processed_at timestamp_ntz, indexed_at timestamp_ntz, classification string, retention_policy string, retention_until date, legal_hold boolean, metadata string, source_url string, source_system string, external_id string",
    "chunks": "id string, document_id string, organization_id string, workspace_id string, access_level string, text string, chunk_index int, page_number int, char_start int, char_end int, chunk_level string, parent_chunk_id string, section_id string, section_title string, section_number string, token_count int, char_count int, word_count int, element_type string, dense_vector_id string, colpali_vector_id string, bm25_indexed boolean, is_indexed boolean, needs_reindex boolean, metadata string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "pages": "id string, document_id string, organization_id string, workspace_id string, page_number int, image_path string, width int, height int, dpi int, colpali_vector_id string, is_indexed boolean, ocr_confidence double, has_tables boolean, has_figures boolean, metadata string, created_at timestamp_ntz",
    "extracted_tables": "id string, document_id string, chunk_id string, organization_id string, page_number int, table_index int, html_content string, markdown_content string, structured_data string, description string, num_rows int, num_cols int, structured_vector_id string, semantic_vector_id string, metadata string, created_at timestamp_ntz",
    "document_relationships": "id bigint, organization_id string, source_document_id string, source_chunk_id string, target_document_id string, target_chunk_id string, relation_type string, confidence double, evidence_text string, detected_by string, metadata string, created_at timestamp_ntz",
    "acronyms": "id bigint, organization_id string, acronym string, expansion string, domain string, subdomain string, priority int, is_preferred boolean, description string, source string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "processing_jobs": "id bigint, organization_id string, document_id string, job_type string, status string, priority int, scheduled_at timestamp_ntz, started_at timestamp_ntz, completed_at timestamp_ntz, progress_percent int, current_step string, error_message string, error_details string, result_summary string, retry_count int, max_retries int, worker_id string, metadata string, created_at timestamp_ntz",
    "quality_reports": "id bigint, document_id string, organization_id string, overall_score double, text_extraction_score double, ocr_artifact_score double, formatting_score double, coherence_score double, quality_level string, issues_found array<string>, recommendations array<string>, recommended_pipeline string, created_at timestamp_ntz",
    "search_queries": "id bigint, organization_id string, workspace_id string, user_id string, query_text string, query_hash string, query_type string, detected_domain string, total_results int, top_result_score double, retrieval_methods array<string>, acronyms_expanded array<string>, processing_time_ms int, fallback_triggered boolean, user_rating int, result_clicked boolean, created_at timestamp_ntz",
}
#: Keys that make a row unique.
KEYS = {"workspaces": ("organization_id", "name"), "document_relationships": ("source_document_id", "target_document_id", "relation_type"), "acronyms": ("organization_id", "acronym", "domain", "expansion")}
#: What enumerated columns may hold.
ALLOWED = {
    "status": ("pending", "processing", "completed", "failed", "archived", "partial"),
    "chunk_level": ("document", "section", "paragraph", "sentence", "table", "figure"),
    "quality_level": ("high", "medium", "low", "garbage"),
    "job_status": ("pending", "processing", "completed", "failed", "cancelled"),
}
#: Acronyms that a new store begins with: (acronym, expansion, domain, priority, description).
SEED_ACRONYMS = (
    ("IRC", "Internal Revenue Code", "tax", 90, "US federal tax code"),
    ("IRS", "Internal Revenue Service", "tax", 90, "US tax authority"),
    ("FICA", "Federal Insurance Contributions Act", "tax", 80, "Social Security and Medicare taxes"),
    ("FUTA", "Federal Unemployment Tax Act", "tax", 70, "Federal unemployment tax"),
    ("IRC", "International Residential Code", "building", 90, "Residential building code"),
    ("IBC", "International Building Code", "building", 90, "Commercial building code"),
    ("IFC", "International Fire Code", "building", 80, "Fire safety code"),
    ("IMC", "International Mechanical Code", "building", 70, "HVAC code"),
    ("IPC", "International Plumbing Code", "building", 70, "Plumbing code"),
    ("LLC", "Limited Liability Company", "legal", 90, "Business entity type"),
    ("NDA", "Non-Disclosure Agreement", "legal", 85, "Confidentiality agreement"),
    ("MSA", "Master Services Agreement", "legal", 80, "Umbrella service contract"),
    ("SOW", "Statement of Work", "legal", 75, "Project scope document"),
    ("IP", "Intellectual Property", "legal", 85, "Patents, trademarks, copyrights"),
    ("GAAP", "Generally Accepted Accounting Principles", "financial", 90, "US accounting standards"),
    ("EBITDA", "Earnings Before Interest, Taxes, Depreciation, and Amortization", "financial", 85, "Profitability metric"),
    ("ROI", "Return on Investment", "financial", 80, "Investment return metric"),
    ("YoY", "Year over Year", "financial", 75, "Annual comparison"),
    ("QoQ", "Quarter over Quarter", "financial", 70, "Quarterly comparison"),
)


def checked(column: Column, kind: str) -> Column:
    """column, failing the query at a value that isn't allowed; nulls pass."""
    return F.when(column.isNull() | column.isin(*ALLOWED[kind]), column).otherwise(F.raise_error(F.concat(F.lit(f"not a {kind}: "), column)))


def seed_acronyms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, e, d, p, s) for a, e, d, p, s in SEED_ACRONYMS], "acronym string, expansion string, domain string, priority int, description string")


def vector_payload(chunks: DataFrame) -> DataFrame:
    """What is stored beside a chunk's vector: the first 1000 characters and the filter columns."""
    return chunks.select("id", F.substring("text", 1, 1000).alias("text"), *[c for c in ("document_id", "chunk_index", "page_number", "level", "organization_id", "workspace_id", "collection_id", "access_level", "document_type", "filename", "element_type", "section_title") if c in chunks.columns])


def keyword_document(chunks: DataFrame) -> DataFrame:
    """What keyword search holds of a chunk: whole text and every filter column."""
    return chunks.select("id", "text", *[c for c in ("document_id", "page_number", "organization_id", "workspace_id", "collection_id", "access_level", "document_type", "level") if c in chunks.columns])
