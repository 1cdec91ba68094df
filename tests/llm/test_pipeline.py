import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from corpusmill.llm import langid, line_dedup, packing, simhash
from corpusmill.llm.queries import WORD_BPE, tokenizer_path

DATA = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        if name != "packing":
            assert docs.columns == columns
            counts.append(docs.count())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "packing"]
    assert counts[0] >= counts[1] == counts[2] > counts[3] > 0.5 * counts[0]


def test_run_equals_the_operators_one_by_one(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = simhash.keep_one(line_dedup.drop_boilerplate(langid.keep_known(docs)).drop("lines_kept", "lines_dropped")).select("doc_id", "text")
    total = {r.doc_id: r.doc_tokens for r in packing.tokenized(kept, tokenizer_path(WORD_BPE)).collect()}
    got = corpus_pipeline.run(spark, DATA).collect()
    sizes: dict = {}
    for r in got:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == total


@pytest.mark.parametrize("name", ["op2_line_dedup", "op4_licenses"])
def test_sql_gives_the_same(spark, name):
    base = duckdb.connect()
    base.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = base.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, DATA)
    order = lambda rows: sorted(map(repr, rows))
    assert order(tuple(r[c] for c in want.columns) for r in got.collect()) == order(want.fetchall())


def test_a_group_of_copies_keeps_its_content(spark, prose):
    """Line dedup mustn't take copies for boilerplate: near-dedup after it keeps one of them, whole."""
    own, others = "a text that occurs in many copies\nand has lines of its own", prose(60, words=20)
    rows = [(i, own if i % 3 == 0 else others[i % 60] + "\nmenu", "en", "h", 9) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clean = {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, docs, DATA).collect()}
    assert clean[0] == own and clean[1] == others[1]


def test_stages_on_odd_rows(spark, odd, none):
    """Nulls, repeated rows, very long texts, clashing column names and empty tables through all stages, each on what the one before kept."""
    from pyspark.sql import functions as F

    docs = odd.withColumns({"lines_kept": F.lit("own"), "lines_dropped": F.lit(1), "tid": F.lit(2), "group": F.lit(3)})
    for frame in (docs, docs.where(F.lit(False))):
        kept = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, DATA)
            assert kept.columns == docs.columns, name
        rows = kept.collect()
        pieces = corpus_pipeline.STAGES[-1][1](spark, kept, DATA).collect()
        assert {r.doc_id for r in rows} == {r.doc_id for r in pieces}
        if frame is docs:
            ids = [r.doc_id for r in rows]
            assert len(ids) == len(set(ids)) and {7, 8, 9, 10} <= set(ids) and not {2, 3, 4, 5} & set(ids) and len({1, 6} & set(ids)) <= 1
            assert {r.lines_kept for r in rows} == {"own"} and {r.lang for r in rows} == {"en"}
        else:
            assert not rows and not pieces


def test_run_equals_the_operators_with_copies_counted_once(spark):
    """As above, with line dedup as the pipeline asks for it: a short text that two pages hold stays."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = simhash.keep_one(line_dedup.drop_boilerplate(langid.keep_known(docs), once=True, counts=False)).select("doc_id", "text")
    total = {r.doc_id: r.doc_tokens for r in packing.tokenized(kept, tokenizer_path(WORD_BPE)).collect()}
    sizes: dict = {}
    for r in corpus_pipeline.run(spark, DATA).collect():
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == total and sizes[13] > 1 and 53 not in sizes
