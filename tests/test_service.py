from pyspark.sql import functions as F

from corpusmill.operators.service import DocumentService
from corpusmill.operators.tenancy import TenantContext
from corpusmill.sources.store import Store

BODY = "SERVICES AGREEMENT\nThis contract is made between the parties. " + "The provider shall deliver the widgets on time and in good order. " * 8


def test_lifecycle(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    mine, theirs = DocumentService(store, TenantContext("acme")), DocumentService(store, TenantContext("other"))
    files = spark.createDataFrame([("master.txt", BODY), ("second.txt", BODY + "\n\nPursuant to Services Agreement master of 2021, invoices are payable quarterly."), ("empty.txt", None), *[(f"other{i}.txt", BODY + f" number {i}") for i in range(3)]], "filename string, text string")
    got = {r.document_id.split("_")[0]: r for r in mine.ingest(files).collect()}
    assert set(got) == {"master", "second", "empty", "other0", "other1", "other2"} and got["empty"].quality_level == "garbage" and got["master"].total_chunks == 1
    theirs.ingest(spark.createDataFrame([("foreign.txt", BODY + " secret zebra")], "filename string, text string"))
    assert mine.list_documents().count() == 6 and theirs.list_documents().count() == 1
    asked = spark.createDataFrame([(0, "payable invoices"), (1, "zebra")], "query_id long, query string")
    hits = mine.search(asked, 5).collect()
    assert {(r.query_id, r.document_id.split("_")[0]) for r in hits} == {(0, "second")}
    assert [r.query_id for r in theirs.search(asked, 5).collect()] == []  # the only document's terms are in all of its documents
    mine.ingest(files)
    assert mine.list_documents().count() == 6 and mine.chunks(got["master"].document_id).count() == 1
    mine.delete([r.document_id for r in theirs.list_documents().withColumnRenamed("id", "document_id").collect()])
    assert theirs.list_documents().count() == 1
    mine.delete([got["master"].document_id])
    assert mine.document(got["master"].document_id).count() == 0 and mine.chunks(got["master"].document_id).count() == 0
    assert {(r.table, r.status): r.n for r in mine.stats().collect()}[("documents", None)] == 5 and all(mine.health().values())


def names(frame, column="id"):
    return {r[column].rsplit("_", 1)[0] for r in frame.select(column).collect()}


def test_two_tenants_with_the_same_file(spark, tmp_path):
    """Equal files have equal ids; neither ingest, repeated ingest, update nor delete of one tenant touches the other's rows."""
    store = Store(spark, f"file://{tmp_path}/store", 4)
    one, two = DocumentService(store, TenantContext("acme")), DocumentService(store, TenantContext("other"))
    files = spark.createDataFrame([("master.txt", BODY), ("second.txt", BODY + "\n\nPursuant to Services Agreement master of 2021, invoices are payable.")], "filename string, text string")
    for service in (one, two, two, one):
        service.ingest(files)
    key = one.list_documents().where("filename = 'master.txt'").first().id
    every = lambda s: {t: s._own(t).count() for t in ("documents", "chunks", "quality_reports", "document_relationships")}
    assert every(one) == every(two) and every(one)["documents"] == 2 and every(one)["chunks"] >= 2 and every(one)["document_relationships"] >= 1
    two.update_document(key, title="changed")
    assert two.document(key).first().title == "changed" != one.document(key).first().title
    before = every(one)
    two.delete([key])
    assert every(one) == before and two.document(key).count() == 0 and two.chunks(key).count() == 0 and one.chunks(key).count() >= 1
    assert two._own("documents").count() == 1 and two.relations(key).count() == 0


def test_a_failed_file_doesnt_stop_the_others(spark, tmp_path):
    service = DocumentService(Store(spark, f"file://{tmp_path}/store", 4), TenantContext("acme"))
    files = spark.createDataFrame([("good.txt", BODY, None), ("bad.pdf", None, "UnsupportedFormat: no parser for .pdf files")], "filename string, text string, error string")
    got = {r.document_id.split("_")[0]: (r.status, r.error_message) for r in service.ingest(files).collect()}
    assert got == {"good": ("completed", None), "bad": ("failed", "UnsupportedFormat: no parser for .pdf files")}
    assert service.list_documents().count() == 1
    jobs = {r.status: r for r in service._own("processing_jobs").collect()}
    assert set(jobs) == {"completed", "failed"} and jobs["failed"].error_message.startswith("Unsupported")
    service.update_job(jobs["failed"].id, status="processing", step="again")
    service.update_job(jobs["failed"].id, status="completed", progress=100, error="")
    again = {r.id: r for r in service._own("processing_jobs").collect()}[jobs["failed"].id]
    assert (again.status, again.progress_percent, again.current_step) == ("completed", 100, "again") and again.error_message.startswith("Unsupported")
    assert again.started_at == jobs["failed"].started_at and again.completed_at > jobs["failed"].completed_at
    assert service._own("processing_jobs").count() == 2


def test_search_log_and_context(spark, tmp_path):
    from corpusmill.functions import terms

    store = Store(spark, f"file://{tmp_path}/store", 4)
    service = DocumentService(store, TenantContext("acme", user_id="u1"))
    body = "ARTICLE 1: DEFINITIONS\n" + "The service means the widgets. " * 8 + "\n\n" + "Second paragraph of words. " * 120 + "\n\n" + "Zebra invoices are payable quarterly. " * 120 + "\nARTICLE 2: SCOPE\n" + "The scope is wide and open to all. " * 8
    service.ingest(spark.createDataFrame([("a.txt", body), *[(f"o{i}.txt", BODY + f" number {i}") for i in range(4)]], "filename string, text string"))
    asked = spark.createDataFrame([(0, "zebra invoices"), (1, "nothing of the kind")], "query_id long, query string")
    hits = service.enhanced_search(asked, terms.dictionary(spark), limit=3)
    assert {(r.query_id, r.document_id.split("_")[0]) for r in hits.collect()} == {(0, "a")}
    log = {r.query_text: r for r in service._own("search_queries").collect()}
    assert len(log) == 2 and log["zebra invoices"].total_results >= 1 and log["zebra invoices"].user_id == "u1" and log["nothing of the kind"].total_results == 0
    around = service.context_of(hits.where("query_id = 0").select("query_id", "id")).collect()
    assert {"self", "parent"} <= {r.role for r in around} and all(abs(r.distance) == 1 for r in around if r.role == "sibling")
    version = store.version("chunks")
    service.search(asked)
    assert service._index[0] == version


def test_changes_at_the_same_time(spark, tmp_path):
    """Appends by two writers are both kept; an append rewrites nothing, a replacement only what it touches."""
    store = Store(spark, f"file://{tmp_path}/store", 4)
    rows = lambda org, n: spark.createDataFrame([(f"c{i}", f"d{i}", org, "t") for i in range(n)], "id string, document_id string, organization_id string, text string")
    store.append("chunks", rows("acme", 20))
    first = store._current("chunks")
    original, raced = store._written, []

    def written(table, frame, column=None):
        folders = original(table, frame, column)
        if not raced:  # another writer is faster
            raced.append(1)
            Store(spark, store.root, 4).append("chunks", rows("other", 5))
        return folders

    store._written = written
    store.append("chunks", rows("third", 3))
    store._written = original
    assert store.read("chunks").count() == 28 and set(first[1]["folders"]) <= set(store._current("chunks")[1]["folders"])
    before = set(store._current("chunks")[1]["folders"])
    store.replace("chunks", rows("acme", 1).withColumn("text", F.lit("new")))
    after = set(store._current("chunks")[1]["folders"])
    assert len(before - after) == 1 and store.read("chunks").where("text = 'new'").count() == 1 and store.read("chunks").count() == 28
    raced.clear()
    store._written = written
    store.upsert("chunks", rows("acme", 2), ["organization_id", "document_id"])
    store._written = original
    assert store.read("chunks").groupBy("organization_id").count().collect() and store.read("chunks").where("organization_id = 'acme'").count() == 20 and store.read("chunks").where("organization_id = 'other'").count() == 10
    assert store.vacuum("chunks") > 0 and store.read("chunks").count() == 33
    store.append("chunks", rows(None, 2).withColumn("page_number", F.lit(3)))
    assert store.read("chunks").where("organization_id is null and page_number = 3").count() == 2
    store.delete_documents(spark.createDataFrame([("d1", "acme")], "id string, organization_id string"))
    assert store.read("chunks").where("document_id = 'd1'").select("organization_id").distinct().count() == 3
