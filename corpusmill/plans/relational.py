"""Queries of the relational store, the graph and the logs, over the order, event and page tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, tenancy, views
from ..sources import files, store
from ..streaming import events as streams


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def document_overview(spark, d):
    """Orders as documents, lines as chunks, suppliers of lines as pages, and pairs of an order and its customer's number as relations."""
    orders, lines = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    chunks = lines.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("id"))
    pages = lines.select(F.col("l_orderkey").alias("document_id"), F.col("l_suppkey").alias("id"))
    edges = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("source_document_id"), F.col("o_custkey").alias("target_document_id"))
    docs = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return views.document_overview(docs, chunks, pages, edges)


def _organizations(spark, d):
    c, o, l = _t(spark, d, "customer"), _t(spark, d, "orders"), _t(spark, d, "lineitem")  # noqa: E741
    docs = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("organization_id"), F.floor("o_totalprice").cast("long").alias("file_size_bytes"))
    chunks = l.select(F.col("l_orderkey").alias("document_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"))
    pages = l.select(F.col("l_orderkey").alias("document_id"), (F.col("l_orderkey") * 10000 + F.col("l_suppkey") % 7).alias("id")).distinct()
    spaces = c.select(F.col("c_custkey").alias("organization_id"), F.concat("c_mktsegment", F.col("c_custkey").cast("string")).alias("id")).unionAll(c.where("c_acctbal > 0").select("c_custkey", F.col("c_name")))
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), docs, chunks, pages, spaces


def organization_stats_literal(spark, d):
    return views.organization_stats(*_organizations(spark, d), literal=True)


def organization_stats_corrected(spark, d):
    return views.organization_stats(*_organizations(spark, d))


def store_stats(spark, d):
    return views.store_stats({"orders": (_t(spark, d, "orders"), "o_orderstatus"), "events": (_t(spark, d, "events"), "event_type"), "documents": (_t(spark, d, "documents"), "lang"), "pages": (_t(spark, d, "pages"), None)})


def list_documents_page(spark, d):
    own = tenancy.for_tenant(_t(spark, d, "documents").withColumns({"organization_id": F.col("source"), "access_level": F.when(F.col("doc_id") % 3 == 0, "public").when(F.col("doc_id") % 3 == 1, "internal").otherwise("confidential")}), tenancy.TenantContext("src0"))
    return store.page_of(own.select("doc_id", "lang", "access_level", "n_chars"), [F.col("n_chars").desc(), F.col("doc_id")], 20, 5)


def tenant_visible_rows(spark, d):
    own = _t(spark, d, "documents").withColumns({"organization_id": F.col("source"), "workspace_id": F.col("lang"), "access_level": F.when(F.col("doc_id") % 3 == 0, "public").when(F.col("doc_id") % 3 == 1, "internal").otherwise("confidential")})
    context = tenancy.TenantContext("src3", workspace_id="en", allowed_access_levels=("public", "confidential"))
    return tenancy.for_tenant(own, context, {"n_chars": {"gte": 200, "lt": 5000}}).select("doc_id", "n_chars", "access_level")


def latest_report_per_doc(spark, d):
    own = _t(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return store.latest(own, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])


def ids_in_filter(spark, d):
    wanted = _t(spark, d, "labels").where("toxic = 1").select("doc_id")
    return _t(spark, d, "documents").join(wanted, "doc_id", "left_semi").select("doc_id", "lang", "source")


def metadata_json_contains(spark, d):
    return _t(spark, d, "events").where(tenancy.metadata_contains(F.col("props"), {"k": 7})).select("event_id", "user_id", "props")


def _old_new(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", "n_chars")
    return docs.select("doc_id", "source", "n_chars", F.lit("old").alias("version")), _t(spark, d, "labels").select("doc_id", F.lit("label").alias("source"), F.col("quality").cast("long").alias("n_chars"), F.lit("new").alias("version"))


def replace_by_document(spark, d):
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("id"), F.lit("old").alias("version"))
    new = _t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("document_id"), F.lit(1).alias("id"), F.lit("new").alias("version"))
    return store.replaced(lines, new).groupBy("version").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("documents"))


def upsert_by_id(spark, d):
    old, new = _old_new(spark, d)
    return store.upserted(old, new, ["doc_id"])


def insert_if_new(spark, d):
    old, new = _old_new(spark, d)
    return store.inserted_if_new(old.where("n_chars > 1000"), new, ["doc_id"])


def delete_cascade(spark, d):
    gone = _t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    lines = store.without(_t(spark, d, "lineitem"), gone, ("l_orderkey",))
    return lines.groupBy("l_returnflag").agg(F.count("*").alias("n"))


def job_state_latest(spark, d):
    kinds = {"view": "pending", "click": "processing", "purchase": "completed"}
    status = F.col("event_type")
    for k, v in kinds.items():
        status = F.when(F.col("event_type") == k, v).otherwise(status)
    jobs = _t(spark, d, "events").select(F.col("user_id").alias("job_id"), "ts", status.alias("status"))
    return store.job_states(jobs)


def search_log_daily(spark, d):
    return _t(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


def batch_summary(spark, d):
    own = _t(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "completed").otherwise("partial").alias("status"))
    return views.batch_summary(own)


def _edges(spark, d):
    """Customers and suppliers around nations, nations around regions."""
    n, c, s = _t(spark, d, "nation"), _t(spark, d, "customer"), _t(spark, d, "supplier")
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    rows = n.select(name("n", "n_nationkey").alias("source_id"), name("r", "n_regionkey").alias("target_id"), F.lit("references").alias("relation_type"), F.lit(0.9).alias("confidence"), F.col("n_nationkey").cast("long").alias("ord"))
    rows = rows.unionAll(s.select(name("s", "s_suppkey"), name("n", "s_nationkey"), F.lit("amends"), F.when(F.col("s_suppkey") % 2 == 0, 0.7).otherwise(0.4), F.col("s_suppkey") + 1000))
    return rows.unionAll(c.where("c_custkey <= 400").select(name("c", "c_custkey"), name("n", "c_nationkey"), F.lit("cites"), F.lit(0.6), F.col("c_custkey") + 1_000_000))


def graph_khop(spark, d):
    starts = _t(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("start"))
    out = graph.k_hop(_edges(spark, d), starts, 2)
    return out.select("start", "node", F.col("hops").cast("long").alias("hops"))


def graph_shortest_chain(spark, d):
    c, r = _t(spark, d, "supplier"), _t(spark, d, "region")
    pairs = c.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("start")).join(r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("goal")))
    return graph.shortest_chain(_edges(spark, d), pairs, 5).select("start", "goal", F.col("hops").cast("long").alias("hops"), F.array_join("path", ">").alias("path"))


def graph_stats(spark, d):
    edges = _edges(spark, d)
    nodes = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id")).distinct()
    out = graph.stats(edges, nodes)
    return out.select("total_documents", "total_relations", "unresolved_references", F.round("avg_relations", 6).alias("avg_relations"), F.array_join(F.transform("relations_by_type", lambda x: F.concat(x.relation_type, F.lit("="), x.n.cast("string"))), ";").alias("relations_by_type"))


def graph_context(spark, d):
    edges = _edges(spark, d)
    nodes = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id")).distinct()
    return graph.document_context(edges, nodes)


def graph_augment(spark, d):
    results = _t(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("query_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_nationkey").alias("k"))
    results = results.withColumn("rank", (F.floor(F.col("k") / 5) + 1).cast("long")).drop("k")
    out = graph.augment(results, _edges(spark, d))
    return out.select("query_id", "id", "source_id", F.round("augmentation_score", 6).alias("augmentation_score"), "ord")


def html_elements(spark, d):
    out = files.html_elements(_t(spark, d, "pages"))
    return out.select("page_id", F.col("element_index").cast("long").alias("element_index"), F.md5("text").alias("digest"))


def events_tumbling(spark, d):
    return streams.windowed(_t(spark, d, "events")).withColumn("total", F.round("total", 4))


def events_sliding(spark, d):
    return streams.windowed(_t(spark, d, "events"), "2 hours", "1 hour").withColumn("total", F.round("total", 4))


def events_session(spark, d):
    return streams.sessions(_t(spark, d, "events"))


QUERIES = {f.__name__: f for f in (
    document_overview, organization_stats_literal, organization_stats_corrected, store_stats, list_documents_page, tenant_visible_rows, latest_report_per_doc, ids_in_filter, metadata_json_contains, replace_by_document,
    upsert_by_id, insert_if_new, delete_cascade, job_state_latest, search_log_daily, batch_summary, graph_khop, graph_shortest_chain, graph_stats, graph_context, graph_augment, html_elements, events_tumbling, events_sliding, events_session,
)}

_LEVEL = "case doc_id % 3 when 0 then 'public' when 1 then 'internal' else 'confidential' end"
_ORGS = """with docs as (select o_orderkey as id, o_custkey as organization_id, floor(o_totalprice)::bigint as bytes from orders),
chunks as (select l_orderkey as document_id, l_orderkey * 100 + l_linenumber as id from lineitem), pages_ as (select distinct l_orderkey as document_id, l_orderkey * 10000 + l_suppkey % 7 as id from lineitem),
spaces as (select c_custkey as organization_id, c_mktsegment || c_custkey as id from customer union all select c_custkey, c_name from customer where c_acctbal > 0)"""
_STATUS = "case event_type when 'view' then 'pending' when 'click' then 'processing' when 'purchase' then 'completed' else event_type end"
_EDGES = """edges as (select 'n' || n_nationkey as s, 'r' || n_regionkey as t, 'references' as kind, 0.9::double as confidence, n_nationkey::bigint as ord from nation
union all select 's' || s_suppkey, 'n' || s_nationkey, 'amends', case when s_suppkey % 2 = 0 then 0.7 else 0.4 end, s_suppkey + 1000 from supplier union all select 'c' || c_custkey, 'n' || c_nationkey, 'cites', 0.6, c_custkey + 1000000 from customer where c_custkey <= 400),
steps as (select s as a, t as b, confidence, 0 as direction, ord from edges where confidence >= 0.5 union all select t, s, confidence, 1, ord from edges where confidence >= 0.5)"""
_HTML = "html"
for _pattern, _to in ((r"<!--(?s:.)*?-->", ""), (r"(?i)<(script|style)\b(?s:.)*?</(script|style)>", ""), (r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|title|header|footer)\b[^>]*>", "chr(10)"), (r"<[^>]*>", "")):
    _HTML = f"regexp_replace({_HTML}, '{_pattern}', {_to or repr('')}, 'g')"
for _entity, _plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_entity}', '{_plain}')"
_HTML = rf"regexp_replace(regexp_replace(regexp_replace({_HTML}, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^\s+|\s+$', '', 'g')"

ORACLES = {
    "document_overview": """with e as (select o_orderkey as id, o_orderkey as s, o_custkey as t from orders)
select d.o_orderkey as id, d.o_orderstatus as status, (select count(distinct l_linenumber) from lineitem l where l.l_orderkey = d.o_orderkey) as actual_chunks, (select count(distinct l_suppkey) from lineitem l where l.l_orderkey = d.o_orderkey) as actual_pages,
  (select count(distinct id) from (select id, s as doc from e union all select id, t from e) x where x.doc = d.o_orderkey) as relationship_count from orders d""",
    "organization_stats_literal": _ORGS + """ select o.c_custkey as organization_id, o.c_name as organization_name, count(distinct d.id) as document_count, count(distinct c.id) as chunk_count, count(distinct p.id) as page_count, sum(d.bytes)::bigint as total_size_bytes, count(distinct w.id) as workspace_count
from customer o left join docs d on o.c_custkey = d.organization_id left join chunks c on d.id = c.document_id left join pages_ p on d.id = p.document_id left join spaces w on o.c_custkey = w.organization_id group by 1, 2""",
    "organization_stats_corrected": _ORGS + """ select o.c_custkey as organization_id, o.c_name as organization_name, count(distinct d.id) as document_count, count(distinct c.id) as chunk_count, count(distinct p.id) as page_count, (select sum(bytes)::bigint from docs x where x.organization_id = o.c_custkey) as total_size_bytes, count(distinct w.id) as workspace_count
from customer o left join docs d on o.c_custkey = d.organization_id left join chunks c on d.id = c.document_id left join pages_ p on d.id = p.document_id left join spaces w on o.c_custkey = w.organization_id group by 1, 2""",
    "store_stats": "select 'orders' as \"table\", null::varchar as status, count(*) as n from orders union all select 'orders', o_orderstatus, count(*) from orders group by 2 union all select 'events', null, count(*) from events union all select 'events', event_type, count(*) from events group by 2 union all select 'documents', null, count(*) from documents union all select 'documents', lang, count(*) from documents group by 2 union all select 'pages', null, count(*) from pages",
    "list_documents_page": f"select doc_id, lang, {_LEVEL} as access_level, n_chars from documents where source = 'src0' and {_LEVEL} in ('public', 'internal') order by n_chars desc, doc_id limit 20 offset 5",
    "tenant_visible_rows": f"select doc_id, n_chars, {_LEVEL} as access_level from documents where source = 'src3' and lang = 'en' and {_LEVEL} in ('public', 'confidential') and n_chars >= 200 and n_chars < 5000",
    "latest_report_per_doc": "select user_id, event_id, ts, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1",
    "ids_in_filter": "select doc_id, lang, source from documents where doc_id in (select doc_id from labels where toxic = 1)",
    "metadata_json_contains": "select event_id, user_id, props from events where json_extract_string(props, '$.k') = '7'",
    "replace_by_document": "with n as (select o_orderkey as document_id, 'new' as version from orders where o_orderstatus = 'P'), a as (select * from n union all select l_orderkey, 'old' from lineitem where l_orderkey not in (select document_id from n)) select version, count(*) as n, count(distinct document_id) as documents from a group by 1",
    "upsert_by_id": "select doc_id, 'label' as source, quality::bigint as n_chars, 'new' as version from labels union all select doc_id, source, n_chars, 'old' from documents where doc_id not in (select doc_id from labels)",
    "insert_if_new": "select doc_id, source, n_chars, 'old' as version from documents where n_chars > 1000 union all select doc_id, 'label', quality::bigint, 'new' from (select *, row_number() over (partition by doc_id order by quality) as k from labels) where k = 1 and doc_id not in (select doc_id from documents where n_chars > 1000)",
    "delete_cascade": "select l_returnflag, count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F') group by 1",
    "job_state_latest": f"with j as (select user_id as job_id, ts, {_STATUS} as status from events) select job_id, arg_max(status, {{'t': ts, 's': status}}) as status, min(case when status = 'processing' then ts end) as started_at, max(case when status in ('completed', 'failed') then ts end) as completed_at, count(*) as transitions from j group by 1",
    "search_log_daily": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(avg(value), 6) as mean_value from events group by 1, 2",
    "batch_summary": "select count(*) as total, count(*) filter (where o_orderstatus = 'O') as successful, count(*) filter (where o_orderstatus = 'F') as failed from orders",
    "graph_khop": f"with recursive {_EDGES}, w(start, node, hops) as (select 'n' || n_nationkey, 'n' || n_nationkey, 0::bigint from nation union select w.start, s.b, w.hops + 1 from w join steps s on w.node = s.a where w.hops < 2) select start, node, min(hops) as hops from w where node <> start group by 1, 2",
    "graph_shortest_chain": f"with recursive {_EDGES}, w(start, node, hops, path) as (select 's' || s_suppkey, 's' || s_suppkey, 0::bigint, '' from supplier union all select w.start, e.t, w.hops + 1, case when w.path = '' then e.t else w.path || '>' || e.t end from w join edges e on w.node = e.s where w.hops < 5) select start, node as goal, min(hops) as hops, arg_min(path, hops) as path from w where node like 'r%' group by 1, 2",
    "graph_stats": f"with {_EDGES}, t as (select kind, count(*) as n from edges group by 1) select (select count(*) from (select s from edges union select t from edges)) as total_documents, sum(n)::bigint as total_relations, 0::bigint as unresolved_references, round(sum(n) / (select count(*) from (select s from edges union select t from edges)), 6) as avg_relations, string_agg(kind || '=' || n, ';' order by kind) as relations_by_type from t",
    "graph_context": f"with {_EDGES}, b as (select s as id, t as other, 1 as o, 0 as i from edges union all select t, s, 0, 1 from edges) select id, sum(o)::bigint as outgoing, sum(i)::bigint as incoming, count(distinct other) as related from b group by 1",
    "graph_augment": f"""with {_EDGES}, r as (select n_regionkey::bigint as query_id, 'n' || n_nationkey as id, n_nationkey // 5 + 1 as rank from nation), starts as (select distinct id as start from r where rank <= 5),
h1 as (select start, b as node, arg_min(confidence, {{'d': direction, 'o': ord}}) as c, min({{'d': direction, 'o': ord}}) as by_ from starts join steps on start = a where b <> start group by 1, 2), f1 as (select *, row_number() over (partition by start order by by_) as found from h1),
h2 as (select f.start, s.b as node, arg_min((f.c + s.confidence) / 2, {{'f': f.found, 'd': s.direction, 'o': s.ord}}) as score from f1 f join steps s on f.node = s.a where s.b <> f.start and not exists (select 1 from f1 x where x.start = f.start and x.node = s.b) group by 1, 2),
near as (select start, node, 1 as hops, c as score from f1 union all select start, node, 2, score from h2),
fresh as (select r.query_id, n.node as id, r.id as source_id, n.score, r.rank, n.hops from r join near n on r.id = n.start where r.rank <= 5 and not exists (select 1 from r x where x.query_id = r.query_id and x.id = n.node)),
cut as (select *, row_number() over (partition by query_id order by score desc, rank, hops, id) as ord from fresh), few as (select *, row_number() over (partition by query_id, id order by ord) as n from cut where ord <= 3)
select query_id, id, source_id, round(score, 6) as augmentation_score, ord from few where n = 1""",
    "html_elements": f"with l as (select page_id, list_filter(string_split({_HTML}, chr(10)), lambda x: x <> '') as parts from pages) select page_id, unnest(range(0, len(parts))) as element_index, md5(unnest(parts)) as digest from l",
    "events_tumbling": "select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "events_sliding": "with e as (select unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as window_start, event_type, value from events) select window_start, event_type, count(*) as n, round(sum(value), 4) as total from e group by 1, 2",
    "events_session": "with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from e) select user_id, min(ts) as session_start, max(ts) + interval 30 minutes as session_end, count(*) as n from s group by user_id, k",
}
