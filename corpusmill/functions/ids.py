"""Stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def document_id(stem: Column, content: Column) -> Column:
    """File stem and the first 12 digits of the content's MD5."""
    return F.concat_ws("_", stem, F.substring(F.md5(content), 1, 12))


def vector_uuid(identifier: Column) -> Column:
    """The MD5 of an identifier in UUID layout."""
    return F.regexp_replace(F.md5(identifier), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")


def chunk_id(doc_id: Column, index: Column, text: Column) -> Column:
    """The first 12 digits of the MD5 of document, index and the text's first 50 characters."""
    return F.substring(F.md5(F.concat_ws("_", doc_id.cast("string"), index.cast("string"), F.substring(text, 1, 50))), 1, 12)
