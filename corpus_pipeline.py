"""The corpus pipeline: language ID, line dedup, near-dedup and packing over the documents table, each on what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import langid, line_dedup, packing, simhash
from corpusmill.llm.common import staged, table
from corpusmill.llm.queries import WORD_BPE, tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the languages of docs, whose lang is filled in where it is null; texts that are null, have no letter or are in none of the languages go."""
    return langid.keep_known(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their source's boilerplate lines, copies of a text counted once; n_chars follows the text."""
    clean = line_dedup.drop_boilerplate(docs, once=True, counts=False)
    return clean.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of equal texts or of texts with five-word shingles 0.8 alike."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that all documents left fill."""
    return packing.pack(docs, tokenizer_path(WORD_BPE))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("simhash_near_dedup", near_dedup), ("packing", pack)]

#: Mixture inference and SimHash aren't SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, "stage")
    return docs
