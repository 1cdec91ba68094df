"""Small cases with values worked out by hand, and plans."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import metadata, quality, terms, text
from corpusmill.functions import query_analysis as qa
from corpusmill.operators import bm25, chunking, fusion, graph, search, structure, tables, tenancy
from corpusmill.sources import files, store


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first().y


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "The contract is between Party A and Party B"), (2, "Payment terms are net 30 days from invoice date"), (3, "This agreement shall commence on January 1, 2024")], "doc_id long, text string")
    got = bm25.search(bm25.build(docs), spark.createDataFrame([(0, "payment terms invoice")], "query_id long, query string")).collect()
    assert [(r.id, r.rank) for r in got] == [(2, 1)] and got[0].score == pytest.approx(1.251002, abs=1e-6)
    assert bm25.search(bm25.build(docs), spark.createDataFrame([(0, "the of")], "query_id long, query string")).count() == 0


MODALITY = [
    ("What does the table show about revenue?", 1.0, "visual", (0.136364, 0.227273, 0.636364)), ("Summarize the contract terms", 0.0, "text", (0.35, 0.55, 0.10)), ("According to Figure 3, what is the trend?", 0.3, "mixed", (0.227273, 0.318182, 0.454545)),
    ("Find the chart showing quarterly sales", 0.55, "visual", (0.136364, 0.227273, 0.636364)), ("What are the termination clauses?", 0.0, "text", (0.35, 0.55, 0.10)), ("In the diagram on page 5", 0.55, "visual", (0.136364, 0.227273, 0.636364)),
    ("Show me the data table", 0.55, "visual", (0.136364, 0.227273, 0.636364)), ("List all parties to the agreement", 0.0, "text", (0.35, 0.55, 0.10)),
]


def test_modality(spark):
    frame = spark.createDataFrame([(q,) for q, *_ in MODALITY], "q string")
    got = frame.select(qa.visual_score(F.col("q")).alias("s"), qa.modality(F.col("q")).alias("m"), qa.weights(F.col("q")).alias("w")).collect()
    for r, (_, s, m, w) in zip(got, MODALITY, strict=True):
        assert (r.s, r.m) == (pytest.approx(s), m) and tuple(r.w) == pytest.approx(w, abs=1e-6)


def test_complexity(spark):
    for q, want in (("What is this contract about?", ("paragraph", 0.7)), ("What is the exact monthly fee in Article 3?", ("sentence", 0.9)), ("Explain the scope of services", ("paragraph", 0.7))):
        assert tuple(one(spark, q, qa.complexity))[:2] == want


def test_acronyms(spark):
    frame = spark.createDataFrame([(0, "IRC section on federal tax"), (1, "IRC for a residential house"), (2, "NDA and NDA")], "query_id long, query string")
    got = {r.query_id: (r.expanded_query, r.expansions) for r in terms.expand(frame, terms.dictionary(spark)).collect()}
    assert "Internal Revenue Code" in got[0][0] and "International Residential Code" in got[1][0]
    assert got[2] == ("NDA (Non-Disclosure Agreement) (Non-Disclosure Agreement) and NDA", ["NDA → Non-Disclosure Agreement"] * 2)


def test_rrf(spark):
    ranked = spark.createDataFrame([(0, "bm25", "a", 9.0, 1), (0, "dense", "b", 0.9, 1), (0, "dense", "a", 0.8, 3)], "query_id long, method string, id string, score double, rank long")
    got = {r.id: r.final_score for r in fusion.rrf(ranked).collect()}
    assert got == {"a": pytest.approx(0.3 / 61 + 0.5 / 63, abs=1e-9), "b": pytest.approx(0.5 / 61, abs=1e-9)}
    tied = spark.createDataFrame([(0, "dense", "b", 0.9, 1), (0, "bm25", "a", 9.0, 1)], "query_id long, method string, id string, score double, rank long")
    assert [r.id for r in fusion.rrf(tied, {"bm25": 0.5, "dense": 0.5}).orderBy("rank").collect()] == ["a", "b"]


CONTRACT = "ARTICLE 1: DEFINITIONS\n1.1 \"Service\" means the services.\nARTICLE 2: SCOPE OF SERVICES\n2.1 Services Provided\nThe Provider shall provide services.\n2.2 Service Standards\nText.\nARTICLE 3: PAYMENT\n3.1 Fees\n3.2 Payment Terms\n"


def test_sections(spark):
    got = structure.sections(spark.createDataFrame([(1, CONTRACT)], "doc_id long, text string"), patterns=structure.LEGAL_CHUNKER, any_case=False).orderBy("start").collect()
    assert [r.number for r in got] == ["1", "2", "Services Provided", "Service Standards", "3", "Fees", "Payment Terms"] and [r.level for r in got] == [1, 1, 2, 2, 1, 2, 2]
    assert [CONTRACT[r.start :].startswith(r.title) for r in got] == [True] * 7 and got[-1].end == len(CONTRACT)


def test_relations(spark):
    body = "This Amendment amends the original agreement dated Master Services Agreement of 2021. IRC Section 7701 applies. See Exhibit A attached. Pursuant to Section 15 it may end."
    rows = graph.extract(spark.createDataFrame([("s", body)], "doc_id string, text string"))
    got = {(r.relation_type, r.target_id): r.confidence for r in graph.resolve(rows, spark.createDataFrame([], "identifier string, document_id string, ord int")).collect()}
    assert got[("cites", "unresolved:7701")] == 0.9 and got[("exhibits_to", "unresolved:A")] == 0.9
    context = {r.reference: r.context for r in rows.collect()}["7701"]
    at = body.index("IRC Section 7701")
    assert context == body[max(0, at - 100) : at + 16 + 100]
    assert got[("references", "unresolved:Section 15 it may end")] == pytest.approx(0.6)


TABLE = "Some words before.\n\nTable 1: Quarterly\nItem | Q1 | Q2\n-----|----|---\nSales | $1,200 | $1,300\nCosts | $300 | 5%\nDue | 01/05/2024 | yes\n\nplain words behind"


def test_tables(spark):
    got = tables.extract(spark.createDataFrame([(1, TABLE), (2, "no table"), (3, None), (4, "")], "doc_id long, text string")).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.table_id, r.num_rows, r.num_cols, r.headers, r.title) == ("1_table_0", 5, 3, ["Table 1: Quarterly"], "Table 1: Quarterly")
    assert TABLE[r.char_start : r.char_end].strip() == TABLE[TABLE.index("Table 1") : TABLE.index("\n\nplain")].strip()
    assert "Contains 4 data rows." in r.semantic_description and r.structured_text.count("Table 1") == 2
    assert [one(spark, c, tables.cell_type) for c in ("$1,200", "5%", "01/05/2024", "1,234.5", "Yes", "-16%")] == ["currency", "percentage", "date", "number", "boolean", "text"]
    assert tables.table_chunks(tables.extract(spark.createDataFrame([(1, TABLE)], "doc_id long, text string"))).count() == 2


def test_quality_guards(spark):
    rows = [(0, "short"), (1, None), (2, "aaaaaaaa bbbbbbbb cccccccc dddddddd eeeeeeee ffffffff gggg hhhh iiii")]
    got = {r.i: r for r in quality.with_quality(spark.createDataFrame(rows, "i int, text string")).collect()}
    assert [(got[i].overall_score, got[i].tier, got[i].recommended_pipeline, got[i].manual_review) for i in (0, 1)] == [(0.0, "garbage", "manual", True)] * 2
    assert got[2].text_score == 0.1 and got[0].issues == [quality.NEARLY_EMPTY]
    assert one(spark, "x" * 6 + " b" * 60, lambda c: text.count_matches(c, [r"(.)\1{4,}"])) == 1


def test_filters(spark):
    frame = spark.createDataFrame([("org_a", "public", 5), ("org_a", "confidential", 5), ("org_b", "public", 5), ("org_a", None, 5)], "organization_id string, access_level string, page_number int")
    context = tenancy.TenantContext("org_a")
    assert [tuple(r) for r in tenancy.for_tenant(frame, context).collect()] == [("org_a", "public", 5)]
    assert tenancy.for_tenant(frame, context, {"page_number": {"gte": 1, "lte": 10}}).count() == 1
    assert tenancy.for_tenant(frame, context, {"page_number": {"gte": 1, "lte": 10}}, ranges=False).count() == 0
    assert tenancy.for_tenant(frame, context, {"access_level": ["confidential"]}).count() == 0
    with pytest.raises(PermissionError):
        tenancy.for_tenant(frame, context, {"organization_id": "org_b"})
    with pytest.raises(ValueError):
        tenancy.TenantContext("a")


def test_pages_as_of(spark):
    chunks = spark.createDataFrame([("d", x) for x in (0, 99, 100, 400)] + [("e", 3)], "doc_id string, start long")
    pages = spark.createDataFrame([("d", 0, 1), ("d", 100, 2), ("d", 250, 3), ("e", 10, 1)], "doc_id string, position long, page_number long")
    assert [r.page_number for r in chunking.pages_as_of(chunks, pages).orderBy("doc_id", "start").collect()] == [1, 1, 2, 3, None]


def test_word_windows(spark):
    got = chunking.word_windows(spark.createDataFrame([(1, "a b c d e f g h i j"), (2, ""), (3, None)], "doc_id long, text string"), 4, 1).orderBy("chunk_index").collect()
    assert [(r.start_word, r.n_words) for r in got] == [(0, 4), (3, 4), (6, 4), (9, 1)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=12), st.integers(1, 12))
def test_packing_keeps_words(spark, sizes, most):
    body = "\n\n".join(" ".join(f"w{i}_{j}" for j in range(n)) for i, n in enumerate(sizes))
    got = [r.text for r in chunking.packed_chunks(spark.createDataFrame([(1, body)], "doc_id long, text string"), most).orderBy("chunk_index").collect()]
    want, now = [], []
    for i, n in enumerate(sizes):
        part = [f"w{i}_{j}" for j in range(n)]
        if now and len(now) + n > most:
            want.append(now)
            now = []
        now = now + part
    assert [g.split() for g in got] == [*want, *([now] if now else [])]


def test_structured_chunks(spark):
    body = "ARTICLE 1: SCOPE\n" + "word " * 40 + "\n\n" + "more " * 40 + "\nARTICLE 2: PAY\nshort"
    got = chunking.structured_chunks(spark.createDataFrame([("d", body)], "doc_id string, text string"), "contract", 50).orderBy("chunk_index").collect()
    assert [(r.level, r.parent_id) for r in got] == [("document", None), ("section", "d_chunk_0"), ("paragraph", "d_chunk_1"), ("paragraph", "d_chunk_1")]
    children = {r.chunk_id: r.children_ids for r in chunking.with_children(chunking.structured_chunks(spark.createDataFrame([("d", body)], "doc_id string, text string"), "contract", 50)).collect()}
    assert children["d_chunk_1"] == ["d_chunk_2", "d_chunk_3"] and children["d_chunk_2"] == []


def test_contract(spark):
    m = one(spark, "SERVICES AGREEMENT\nbetween Acme Widgets Inc and others effective as of January 5, 2023. governed by the laws of the State of New York. $1,500.00 per month", metadata.contract)
    assert (m.contract_type, m.effective_date, m.governing_law, m.title) == ("service_agreement", "January 5, 2023", "New York", "SERVICES AGREEMENT")
    assert [(x.amount, x.period) for x in m.monetary_values] == [(1500.0, "month")]


def test_store(spark, tmp_path):
    own = store.Store(spark, f"file://{tmp_path}/store")
    rows = lambda xs: spark.createDataFrame(xs, "id string, document_id string, organization_id string")
    own.append("chunks", rows([("1", "a", "org"), ("2", "a", "org"), ("3", "b", "org")]))
    own.replace("chunks", rows([("9", "a", "org")]))
    assert sorted(r.id for r in own.read("chunks").collect()) == ["3", "9"]
    own.upsert("documents", spark.createDataFrame([("a", "org"), ("b", "org")], "id string, organization_id string"), ["organization_id", "id"])
    own.delete_documents(spark.createDataFrame([("a",)], "id string"))
    assert [r.id for r in own.read("chunks").collect()] == ["3"] and [r.id for r in own.read("documents").collect()] == ["b"]
    own.bootstrap()
    own.bootstrap()
    assert own.read("acronyms").count() == 19


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "contract.txt").write_text("plain words")
    (tmp_path / "sub/page.html").write_text("<html><script>x</script><p>One &amp; two</p><div>three</div></html>")
    (tmp_path / "skip.bin").write_bytes(b"\x00")
    got = {r.filename: r for r in files.texts(files.scan(spark, str(tmp_path))).collect()}
    assert set(got) == {"contract.txt", "page.html"} and got["page.html"].text == "One & two\nthree" and got["contract.txt"].document_type == "contract"
    assert got["contract.txt"].document_id.startswith("contract_") and len(got["contract.txt"].document_id) == len("contract_") + 12
    parsed = files.parsed(files.scan(spark, str(tmp_path)), lambda content, name: [("Text", 1, content.decode())] if name.endswith("txt") else [])
    assert [tuple(r)[1:] for r in parsed.collect()] == [(0, "Text", 1, "plain words")]


def test_rerank_and_embedder(spark):
    queries = spark.createDataFrame([(0, "alpha beta")], "query_id long, query string")
    docs = spark.createDataFrame([(1, "gamma"), (2, "alpha beta"), (3, "alpha")], "id long, text string")
    results = docs.select(F.lit(0).cast("long").alias("query_id"), "id")
    overlap = lambda q, t: (q + "|" + t).map(lambda s: float(len(set(s.split("|")[0].split()) & set(s.split("|")[1].split()))))
    import pandas as pd

    def scorer(q: pd.Series, t: pd.Series) -> pd.Series:
        return overlap(q, t)

    assert [r.id for r in search.rerank(results, queries, docs, scorer).orderBy("rank").collect()] == [2, 3, 1]
    vectors = {r.id: r.vec for r in files.embedded(docs, files.hashing_embedder(16)).collect()}
    assert sum(x * x for x in vectors[2]) == pytest.approx(1.0)


def test_stream_equals_table(spark, tmp_path):
    from corpusmill.streaming import events

    path = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{path}/events.parquet")
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(path)
    query = events.windowed(stream).writeStream.format("memory").queryName("w").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(str, spark.table("w").drop("total").collect())) == sorted(map(str, events.windowed(table).drop("total").collect()))


def test_plans(spark):
    """Filters and columns reach the scan; a set of keys is a semi-join, not a product."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("organization_id", F.col("source")).withColumn("access_level", F.lit("public"))
    plan = tenancy.for_tenant(docs, tenancy.TenantContext("src0")).select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src0)" in plan and "ReadSchema: struct<doc_id:bigint,source:string>" in plan
    edges = spark.createDataFrame([("a", "b", "cites", 0.9, 0)], "source_id string, target_id string, relation_type string, confidence double, ord long")
    hops = graph.k_hop(edges, spark.createDataFrame([("a",)], "start string"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in hops and "NestedLoop" not in hops
