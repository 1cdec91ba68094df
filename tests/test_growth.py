"""What must not grow with the square of the input, or be done more than once a text."""

import re

from pyspark.sql import functions as F

from corpusmill.operators import bm25, chunking, graph

TEXT = "ARTICLE 1: SCOPE\n" + "The provider shall amend the agreement dated Master Agreement of 2021 as set forth in Exhibit A attached. " * 3


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def docs(spark):
    return spark.createDataFrame([(i, TEXT + str(i)) for i in range(3)], "doc_id long, text string")


def test_no_row_for_a_query_and_a_document_is_shuffled(spark):
    index = bm25.build(docs(spark))
    asked = spark.createDataFrame([(0, "provider agreement"), (1, "exhibit")], "query_id long, query string")
    found = bm25.search(index, asked, 2)
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, id#", plan(found)) and "MapInArrow" in plan(found)
    assert "Exchange" not in plan(index.postings)
    want = bm25.top(bm25.scores(index, asked), 2).where("score > 0")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_search_in_small_blocks(spark, monkeypatch):
    for name, n in {"COUNTED": 2, "SCORED": 1, "ASKED": 2, "QUERY_BLOCK": 3}.items():
        monkeypatch.setattr(bm25, name, n)
    words = [f"w{i}" for i in range(12)]
    texts = [(f"d{i:02}", " ".join(words[(i * k) % 12] for k in range(1, 9)) + " common" * (i % 3)) for i in range(40)] + [("empty", ""), ("null", None)]
    index = bm25.build(spark.createDataFrame(texts, "doc_id string, text string").repartition(3))
    asked = spark.createDataFrame([(f"q{i}", f"{words[i % 12]} common {words[(5 * i) % 12]}") for i in range(9)] + [("none", "the of"), ("unknown", "zzz")], "query_id string, query string")
    rows = lambda frame: sorted((r.query_id, r["rank"], r.id, r.score) for r in frame.collect())
    got = bm25.search(index, asked, 5)
    assert rows(got) == rows(bm25.top(bm25.scores(index, asked), 5).where("score > 0")) and got.count() >= 45
    kept = F.col("id") > "d20"
    assert rows(bm25.search(index, asked, 5, keep=kept)) == rows(bm25.top(bm25.scores(index, asked, keep=kept), 5).where("score > 0"))


def test_relations_are_extracted_once(spark):
    known = spark.createDataFrame([("Master Agreement", "m", 0)], "identifier string, document_id string, ord int")
    found = graph.resolve(graph.extract(docs(spark)), known)
    assert "regexp_extract_all" not in plan(found) and {r.target_id for r in found.collect()} >= {"m"}


def test_a_tree_is_built_in_one_pass(spark):
    found = chunking.legacy_tree(docs(spark))
    assert plan(found).count("Generate") == 1 and "Union" not in plan(found)
    assert {r.level for r in found.select("level").distinct().collect()} == {"document", "section", "paragraph", "sentence"}


def test_a_batch_of_vectors_meets_queries_in_bounded_products():
    """Memory of a task doesn't follow the length of its batches, nor the number of ties."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from corpusmill.operators import vectors

    rng = np.random.default_rng(0)
    own = rng.normal(size=(20_000, 16))
    own[::3] = own[0]
    lists = lambda m: pa.array(m.tolist(), pa.list_(pa.float64()))
    asked = SimpleNamespace(value=pa.table({"query_id": pa.array(range(512)), "q": lists(own[:512])}))
    batch = pa.RecordBatch.from_arrays([pa.array(range(20_000)), lists(own)], names=["id", "v"])
    tracemalloc.start()
    out = list(vectors._nearest(asked, 5, "dot")(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    first = sorted(zip(*(out[0].column(c).to_pylist() for c in ("query_id", "id", "score")), strict=True))
    assert peak < 100e6 and {i for q, i, s in first if q == 0} == set(np.lexsort((np.arange(20_000), -np.round(own @ own[0], 9)))[:5].tolist())
