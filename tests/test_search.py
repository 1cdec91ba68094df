"""Vectors, late interaction, the keyword index and the lookups around them, against brute force and on odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import bm25, graph, search, vectors

METRICS = {"cosine": lambda q, v: q @ v / np.linalg.norm(q) / np.linalg.norm(v), "dot": lambda q, v: q @ v, "euclid": lambda q, v: -np.linalg.norm(q - v)}


@pytest.mark.parametrize("metric", list(METRICS))
def test_nearest_against_brute_force(spark, metric, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(0)
    own = [(f"v{i:03}", (rng.normal(size=8) * (1 + i % 3)).tolist()) for i in range(200)]
    own += [(f"w{i}", own[i][1]) for i in range(5)] + [("odd", [1.0, 2.0])]
    asked = [(i, own[7 * i][1] if i % 2 else rng.normal(size=8).tolist()) for i in range(25)] + [(99, [0.5, 0.1])]
    frame = spark.createDataFrame(own, "vec_id string, embedding array<double>").repartition(3)
    got: dict = {}
    for r in vectors.nearest(frame, spark.createDataFrame(asked, "query_id int, vec array<double>"), 6, metric).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    for q, x in asked:
        want = sorted(((METRICS[metric](np.array(x), np.array(v)), i) for i, v in own if len(v) == len(x)), key=lambda p: (-round(p[0], 10), p[1]))[:6]
        assert [i for i, _ in got[q]] == [i for _, i in want] and [s for _, s in got[q]] == pytest.approx([s for s, _ in want])


def test_vectors_that_take_no_part(spark):
    rows = [(1, [0.0, 0.0]), (2, None), (3, []), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 0.0])], "query_id int, vec array<double>")
    found = lambda m: {(r.query_id, r.id) for r in vectors.nearest(frame, asked, 5, m).collect()}
    assert found("cosine") == {(1, 7)} and found("dot") == {(1, 1), (1, 7), (2, 1), (2, 7)} == found("euclid")
    assert vectors.nearest(frame.limit(0), asked, 5).count() == 0 and vectors.nearest(frame, asked.limit(0), 5).count() == 0


def test_copies_of_a_vector_are_ties(spark):
    """A third of all rows repeat one vector: the smallest ids win, over batches and tasks."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(i, base.tolist() if i % 3 == 0 else rng.normal(size=16).tolist()) for i in range(3000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = vectors.nearest(frame, spark.createDataFrame([(0, base.tolist())], "query_id int, vec array<double>"), 10).orderBy("rank").collect()
    assert [r.id for r in got] == list(range(0, 30, 3)) and len({r.score for r in got}) == 1


def test_maxsim_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(1)
    q = [(i % 6, i, rng.normal(size=4)) for i in range(17)]
    p = [(f"p{i % 23}", rng.normal(size=4)) for i in range(400)]
    frame = lambda rows, kinds: spark.createDataFrame([(*r[:-1], r[-1].tolist()) for r in rows], kinds)
    got: dict = {}
    found = vectors.maxsim(frame(q, "query_id int, patch_id int, vec array<double>"), frame(p, "id string, vec array<double>").repartition(4), 5)
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    for k in range(6):
        sums = {i: sum(max(x @ v for j, v in p if j == i) for n, _, x in q if n == k) for i in {j for j, _ in p}}
        want = sorted(sums.items(), key=lambda s: (-s[1], s[0]))[:5]
        assert [i for i, _ in got[k]] == [i for i, _ in want] and [s for _, s in got[k]] == pytest.approx([s for _, s in want])
    assert vectors.maxsim(frame(q, "query_id int, patch_id int, vec array<double>").limit(0), frame(p, "id string, vec array<double>")).count() == 0


DOCS = [(1, "payment terms invoice due", "a"), (2, "invoice number and party", "b"), (3, "widgets are delivered", "a"), (4, None, "a"), (5, "payment of widgets", "b")]


def ranked(found):
    return sorted((r.query_id, r.id, r.score, r["rank"]) for r in found.collect())


def test_an_index_grows_and_is_loaded(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, team string")
    asked = spark.createDataFrame([(0, "payment invoice"), (1, "widgets"), (2, "")], "query_id long, query string")
    whole = bm25.build(docs)
    grown = bm25.added(bm25.build(docs.where("doc_id <= 2")), docs.where("doc_id > 2"))
    bm25.saved(grown, f"file://{tmp_path}/index")
    for index in (grown, bm25.loaded(spark, f"file://{tmp_path}/index")):
        assert ranked(bm25.search(index, asked)) == ranked(bm25.search(whole, asked)) and len(ranked(bm25.search(whole, asked))) == 5
    kept = bm25.search(whole, asked, keep=F.col("team") == "a")
    assert {r.id for r in kept.collect()} == {1, 3} and {(r.id, r.score) for r in kept.collect()} <= {(r.id, r.score) for r in bm25.search(whole, asked).collect()}
    plan = bm25.search(whole, asked)._jdf.queryExecution().toString()
    assert "bucket" in plan and bm25.build(docs.limit(0)).corpus.first().n_docs == 0


def test_repeated_ids_are_one_document(spark):
    docs = spark.createDataFrame([*DOCS, (1, "another text", "a"), (1, "payment terms invoice due", "a")], "doc_id long, text string, team string")
    index = bm25.build(bm25.unique(docs))
    assert index.corpus.first().n_docs == 5
    assert {r.doc_id: r.text for r in bm25.unique(docs).collect()}[1] == "another text"


def test_references_are_resolved_by_any_substring(spark):
    """Against the plain rule, with identifiers of every length and ones that stand inside words."""
    names = ["a", "ii", "Sec", "greement", "Master Agreement of 2021", "er Agree", "zzz", "2021", "", "É"]
    known = spark.createDataFrame([(n, f"d{i}", i) for i, n in enumerate(names)], "identifier string, document_id string, ord int").orderBy(F.col("ord").desc())
    refs = ["the Master Agreement of 2021", "section ii", "Xyz", "qqq", "é", "sEC 5", "agreemen"]
    rows = spark.createDataFrame([(i, "references", r, i) for i, r in enumerate(refs)], "source_id int, relation_type string, reference string, ord int")
    got = {r.reference: r.target_id for r in graph.resolve(rows, known).collect()}
    want = {r: next((f"d{i}" for i, n in enumerate(names) if n and n.lower() in r.lower()), f"unresolved:{r}") for r in refs}
    assert got == want


def test_private_marks_in_texts_shift_nothing(spark):
    from corpusmill.operators import tables

    text = "x\ue000 See Exhibit A attached. \ue000 IRC Section 7701 and more\n\ue000\nTable 1: Fees\nItem | Amount\n-----|-----\nSetup \ue000| 5\nOther | 6\n"
    docs = spark.createDataFrame([(1, text), (2, text.replace("\ue000", " "))], "doc_id long, text string")
    relations, found = {}, {}
    for r in graph.extract(docs).collect():
        relations.setdefault(r.source_id, set()).add((r.ord, r.reference, r.matched, r.context))
    for r in tables.extract(docs).collect():
        found.setdefault(r.doc_id, []).append((r.char_start, r.char_end, r.structured_text, r.title))
    assert relations[1] == relations[2] and len(relations[1]) >= 2 and found[1] == found[2] and len(found[1]) == 1


def test_elements_of_the_types_that_a_query_names(spark):
    queries = spark.createDataFrame([(0, "What does the table show?"), (1, "Find the figure of sales"), (2, "plain words")], "query_id int, query string")
    patches = spark.createDataFrame([(q, 0, [1.0, 0.0]) for q in range(3)], "query_id int, patch_id int, vec array<double>")
    elements = spark.createDataFrame([(f"{k}{i}", k, "o1" if i else "o2", [1.0 + i, 0.0]) for k in ("Table", "Image", "Figure", "Text") for i in range(3)], "id string, element_type string, organization_id string, vec array<double>")
    got: dict = {}
    for r in search.with_elements(queries, elements, patches, limit=4).collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert set(got) <= {0, 1} and all(i.startswith("Table") for i in got[0]) and len(got[0]) == 2
    assert {r.id for r in search.table_elements(patches, elements).collect()} == {"Table0", "Table1", "Table2"}
    assert {r.id[:-1] for r in search.figure_elements(patches, elements, keep=F.col("organization_id") == "o1").collect()} == {"Image", "Figure"}
    index = bm25.build(spark.createDataFrame(DOCS, "doc_id long, text string, team string"))
    results, seen = search.search_with_elements(queries, index, patches, elements)
    assert results.columns[:2] == ["query_id", "id"] and seen.count() > 0
    assert search.keyword_only(spark.createDataFrame([(0, "invoice")], "query_id int, query string"), index).count() == 2


def test_the_wider_search_stays_with_the_tenant(spark):
    """A query with results of one document alone, under a filter: with the threshold raised it also searches without the caller's filter."""
    from corpusmill.functions import terms

    docs = [(i, f"invoice widgets number {i} of the party {'alpha' if i < 3 else 'beta'} {' '.join(f'w{i}{k}' for k in range(i))}", "a" if i < 6 else "b") for i in range(9)] + [(20 + i, f"unrelated text {i}", "a") for i in range(12)]
    index = bm25.build(spark.createDataFrame(docs, "doc_id long, text string, team string"))
    asked = spark.createDataFrame([(0, "invoice widgets")], "query_id long, query string")
    tenant, mine = F.col("team") == "a", (F.col("team") == "a") & (F.col("id") == 4)
    ids = lambda **more: {r.id for r in search.enhanced(asked, index, terms.dictionary(spark), keep=mine, **more)[0].collect()}
    assert ids() == {4} and ids(fallback_below=1.1) == {4}
    wide = ids(fallback_below=1.1, tenant_keep=tenant)
    assert 4 in wide and len(wide) > 1 and wide <= set(range(6))
