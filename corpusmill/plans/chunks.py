"""Queries of chunking by structure: over the sample texts together with all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking
from ..plans.domain import _C, _corpus, _sections
from . import sql


def structured_chunks(spark, d):
    return chunking.structured_chunks(_corpus(spark, d))


def section_chunks(spark, d):
    """Windows of 40 words inside sections, so that short texts have several."""
    out = chunking.section_windows(_corpus(spark, d), size=40, overlap=10, least=5)
    return out.withColumn("text", F.md5("text"))


def legacy_chunks(spark, d):
    """Every route: the configuration goes by the text's length, the type by its first letter."""
    config = F.when(F.length("text") % 3 == 0, "hierarchical").when(F.length("text") % 3 == 1, "simple").otherwise("standard")
    kind = F.when(F.substring("text", 1, 1) < "H", "contract").when(F.substring("text", 1, 1) < "P", "financial_report").otherwise("other")
    out = chunking.legacy_chunks(_corpus(spark, d).withColumns({"chunking_strategy": config, "document_type": kind}))
    return out.groupBy("doc_id", "route", "level").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))


def adaptive_chunks(spark, d):
    """Every strategy, by the text's length; the vector of a sentence is (its length in words, 20), so that cosines follow from lengths."""
    tier = F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "garbage", "unheard of"))), (F.length("text") % 5 + 1).cast("int"))
    embed = lambda frame: frame.withColumn("vec", F.array(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("double"), F.lit(20.0)))
    out = chunking.adaptive_chunks(_corpus(spark, d).withColumn("tier", tier), embed, threshold=0.9)
    return out.groupBy("doc_id", "chunk_strategy", "quality_level").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))


def legacy_tree(spark, d):
    return chunking.legacy_tree(_corpus(spark, d))


def context_expansion(spark, d):
    """Parents and neighbours of some windows of every document."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    name = lambda i: F.concat(F.col("doc_id").cast("string"), F.lit("_"), i.cast("string"))
    windows = chunking.word_windows(docs).select(name(F.col("chunk_index") + 1).alias("id"), name(F.lit(0)).alias("parent_id"), (F.col("chunk_index") + 1).alias("chunk_index"), "text")
    roots = docs.select(name(F.lit(0)).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).cast("long").alias("chunk_index"), "text")
    results = docs.select((F.col("doc_id") % 7).alias("query_id"), name(F.col("doc_id") % 3 + 1).alias("id"))
    out = chunking.with_context(results, roots.unionAll(windows), 2)
    return out.select("query_id", "id", "role", "context_id", F.col("distance").cast("long").alias("distance"), F.md5("text").alias("digest"))


QUERIES = {f.__name__: f for f in (structured_chunks, section_chunks, legacy_chunks, adaptive_chunks, legacy_tree, context_expansion)}

_CONFIG = "case length(text) % 3 when 0 then 'hierarchical' when 1 then 'simple' else 'standard' end"
_KIND = "case when substr(text, 1, 1) < 'H' then 'legal' when substr(text, 1, 1) < 'P' then 'financial' else 'general' end"


def _with_heads(document_type: str = "general", patterns=None, flag: str = "(?i)") -> str:
    """CTEs corpus, s(doc_id, start, end, title, number, level, line_number), known(doc_id), the documents with sections, and kept: s with body."""
    body = _sections(document_type, patterns, flag)
    at = body.index("\nselect doc_id, start, coalesce(lead")
    return body[:at] + ",\ns as (" + body[at + 1 :] + "),\nknown as (select distinct doc_id from s),\nkept as (select s.*, substr(c.text, (start + 1)::int, (\"end\" - start)::int) as body from s join corpus c on s.doc_id = c.doc_id)"


def _paragraphs(column: str) -> str:
    return rf"list_filter(list_transform(string_split_regex({column}, '\n\s*\n'), lambda x: {sql.strip('x')}), lambda x: x <> '')"


def _packed(units: str, joiner: str = "chr(10) || chr(10)", most: int = chunking.WORDS) -> str:
    """CTEs that end in packs(doc_id, u, j, text, start): parts of units(doc_id, u, begin, parts) packed."""
    return rf"""pa as ({units}),
fo(doc_id, u, begin, parts, i, first, n, out) as (select doc_id, u, begin, parts, 1, 1, 0::bigint, []::struct(a bigint, b bigint)[] from pa where len(parts) > 0
  union all select doc_id, u, begin, parts, i + 1, case when n + k > {most} and i > first then i else first end, case when n + k > {most} and i > first then k else n + k end, case when n + k > {most} and i > first then list_append(out, {{'a': first::bigint, 'b': (i - 1)::bigint}}) else out end
  from (select *, len({sql.words('parts[i]')}) as k from fo where i <= len(parts))),
te as (select doc_id, u, begin, list_transform(list_append(out, {{'a': first::bigint, 'b': len(parts)::bigint}}), lambda r: array_to_string(parts[r.a:r.b], {joiner})) as texts from fo where i = len(parts) + 1),
packs as (select doc_id, u, j, texts[j] as text, (begin + coalesce(list_sum(list_transform(texts[1:j - 1], lambda x: length(x) + length({joiner}))), 0))::bigint as start from (select *, unnest(range(1, len(texts) + 1)) as j from te))"""


def _structured(document_type: str = "general") -> str:
    """CTEs that end in chunks(doc_id, u, kind, j, level, title, number, start, text), kind 0 before 1 within u."""
    stripped = sql.strip("body")
    return rf"""{_with_heads(document_type).replace('with ', 'with recursive ', 1)},
own as (select * from kept where length({stripped}) >= {chunking.LEAST_SECTION}),
{_packed(f"select doc_id, line_number as u, start as begin, {_paragraphs('body')} as parts from own union all select doc_id, 0, 0, {_paragraphs('text')} from corpus where doc_id not in (select doc_id from known)")},
chunks as (select doc_id, -1 as u, 0 as kind, 0 as j, 'document' as level, null as title, null as number, 0 as start, case when length(text) > {chunking.DOCUMENT_CHARS} then substr(text, 1, {chunking.DOCUMENT_CHARS}) || '...' else text end as text from corpus where doc_id in (select doc_id from known)
  union all select doc_id, line_number, 0, 0, 'section', title, number, start, substr(body, 1, {chunking.SECTION_CHARS}) from own
  union all select p.doc_id, p.u, 1, p.j, 'paragraph', o.title, o.number, p.start, p.text from packs p left join own o on p.doc_id = o.doc_id and p.u = o.line_number)"""


def _sentences(column: str) -> str:
    """The stripped sentences of a text. Breaks are marked first, as the pattern language of the oracle has no look-around."""
    marked = rf"regexp_replace(regexp_replace(regexp_replace({column}, '([.!?])\s*\n([A-Z])', '\1' || chr(1) || chr(1) || '\2', 'g'), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), '\n\s*([A-Z0-9])', chr(10) || chr(1) || '\1', 'g')"
    return f"list_transform(string_split({marked}, chr(1)), lambda x: {sql.strip('x')})"


def _adaptive() -> str:
    near = lambda k: f"coalesce((n * lag(n, {k}) over o + 400) / (sqrt(n * n + 400) * sqrt(lag(n, {k}) over o * lag(n, {k}) over o + 400)) >= 0.9, false)"
    return rf"""with recursive {_C}, t as (select doc_id, text, ['high', 'medium', 'low', 'garbage', 'unheard of'][length(text) % 5 + 1] as tier from corpus),
c as (select doc_id, words, unnest(range(0, len(words), 384)) as pos from (select doc_id, {sql.words('text')} as words from t where tier = 'garbage')), tok as (select doc_id, len(words[pos + 1:pos + 512]) as n from c),
se as (select doc_id, tier, {_sentences('text')} as parts from t where tier <> 'garbage'),
pi as (select doc_id, tier, i, x, len({sql.words('x')})::double as n from (select doc_id, tier, unnest(range(0, len(parts))) as i, unnest(parts) as x from se where tier in ('high', 'medium')) where x <> ''),
ne as (select *, case when {near(1)} or (tier = 'high' and ({near(2)} or {near(3)})) then 0 else 1 end as fresh from pi window o as (partition by doc_id order by i)),
ru as (select *, sum(fresh) over (partition by doc_id order by i rows unbounded preceding) as u from ne),
{_packed("select doc_id, u::bigint as u, 0 as begin, list(x order by i) as parts from ru group by doc_id, u union all select doc_id, 0, 0, list_filter(parts, lambda x: x <> '') from se where tier in ('low', 'unheard of')", "' '")},
al as (select doc_id, n from tok where n >= 50 union all select p.doc_id, len({sql.words('p.text')}) from packs p join t on p.doc_id = t.doc_id where t.tier in ('high', 'medium') or len({sql.words('p.text')}) >= 50)
select a.doc_id, case t.tier when 'high' then 'sdpm' when 'medium' then 'semantic' when 'garbage' then 'token' else 'sentence' end as chunk_strategy, t.tier as quality_level, count(*) as n, sum(a.n)::bigint as words from al a join t on a.doc_id = t.doc_id group by 1, 2, 3"""


def _legacy() -> str:
    routed = [
        f"select doc_id, '{kind}' as route, level, count(*) as n, sum(words)::bigint as words from ({_structured(kind)} select doc_id, level, len({sql.words('text')}) as words from chunks where doc_id in (select doc_id from corpus where {_CONFIG} = 'hierarchical' and {_KIND} = '{kind}')) group by 1, 3"
        for kind in ("legal", "financial", "general")
    ]
    simple = f"select doc_id, 'simple', 'paragraph', count(*), sum(len(words[pos + 1:pos + 400]))::bigint from (select doc_id, words, unnest(range(0, len(words), 350)) as pos from (with {_C} select doc_id, {sql.words('text')} as words from corpus where {_CONFIG} = 'simple')) group by 1"
    standard = f"select doc_id, 'standard', 'paragraph', count(*), sum(len({sql.words('text')}))::bigint from (with recursive {_C}, {_packed('select doc_id, 0 as u, 0 as begin, ' + _paragraphs('text') + ' as parts from corpus where ' + _CONFIG + chr(61) + chr(39) + 'standard' + chr(39))} select doc_id, text from packs) group by 1"
    return " union all ".join([*routed, simple, standard])


def _tree() -> str:
    from ..operators.structure import STRICT_LEGAL

    last = rf"array_to_string({sql.words('cur')}[-{chunking.LEGACY_OVERLAP_WORDS}:], ' ')"
    full = f"length(cur) + length(parts[i]) > {chunking.LEGACY_CHARS} and cur <> ''"
    return rf"""{_with_heads("general", STRICT_LEGAL, "").replace('with ', 'with recursive ', 1)},
bo as (select doc_id, line_number, {sql.strip('body')} as body from kept), lb as (select * from bo where length(body) >= 100),
sec as (select doc_id, row_number() over (partition by doc_id order by line_number) - 1 as i, body from lb union all select doc_id, 0, {sql.strip('text')} from corpus where doc_id not in (select doc_id from lb)),
f(doc_id, k, parts, i, cur, out) as (select doc_id, i, {_paragraphs('body')}, 1, '', []::varchar[] from sec union all select doc_id, k, parts, i + 1, case when {full} then {last} || ' ' || parts[i] when cur = '' then parts[i] else cur || chr(10) || chr(10) || parts[i] end, case when {full} then list_append(out, cur) else out end from f where i <= len(parts)),
pars as (select doc_id, k, case when cur = '' then out else list_append(out, cur) end as texts from f where i = len(parts) + 1),
par as (select doc_id, doc_id || '_doc_sec_' || k as sec, unnest(range(0, len(texts))) as j, unnest(texts) as text from pars),
sen as (select doc_id, sec || '_para_' || j as para, unnest(range(0, len(x))) as m, unnest(x) as text from (select *, {_sentences('text')} as x from par))
select doc_id, doc_id || '_doc' as chunk_id, null as parent_id, 'document' as level, text from corpus union all select doc_id, doc_id || '_doc_sec_' || i, doc_id || '_doc', 'section', body from sec
union all select doc_id, sec || '_para_' || j, sec, 'paragraph', text from par union all select doc_id, para || '_sent_' || m, para, 'sentence', text from sen where length(text) >= {chunking.LEAST_SENTENCE}"""


_STRATEGY = chunking.STRATEGIES["medium"]
_WINDOW_WORDS = sql.words("body")

ORACLES = {
    "structured_chunks": _structured() + rf""",
n as (select *, row_number() over (partition by doc_id order by u, kind, j) - 1 as chunk_index from chunks),
p as (select *, max(case when level = 'section' then chunk_index end) over (partition by doc_id, u) as of from n)
select doc_id, chunk_index, doc_id || '_chunk_' || chunk_index as chunk_id, case when level = 'section' then doc_id || '_chunk_0' when of is not null then doc_id || '_chunk_' || of end as parent_id, level, title as section_title, number as section_number, start::bigint as char_start, (start + length(text))::bigint as char_end, text, len({sql.words('text')})::bigint as token_count, '{_STRATEGY}' as strategy from p""",
    "section_chunks": _with_heads() + rf""",
units as (select doc_id, line_number as u, start, title, number, true as sectioned, body from kept where length({sql.strip('body')}) >= {chunking.LEAST_SECTION} union all select doc_id, 0, 0, null, null, false, text from corpus where doc_id not in (select doc_id from known)),
w as (select * exclude (body), {_WINDOW_WORDS} as words from units), c as (select *, unnest(range(0, len(words), 30)) as pos from w), t as (select *, words[pos + 1:pos + 40] as part from c),
n as (select *, row_number() over (partition by doc_id order by u, pos) - 1 as chunk_index from t where len(part) >= 5)
select doc_id, chunk_index, doc_id || '_chunk_' || chunk_index as chunk_id, case when sectioned then doc_id || '_sec_' || min(chunk_index) over (partition by doc_id, u) end as parent_id, title as section_title, number as section_number, start::bigint as section_start, len(part)::bigint as n_words, md5(array_to_string(part, ' ')) as text from n""",
    "legacy_chunks": _legacy(),
    "adaptive_chunks": _adaptive(),
    "legacy_tree": _tree(),
    "context_expansion": f"""with w as (select doc_id, {sql.words('text')} as words from documents), c as (select doc_id, words, unnest(range(0, len(words), 350)) as s from w),
chunks as (select doc_id || '_' || (s // 350 + 1) as id, doc_id || '_0' as parent_id, s // 350 + 1 as chunk_index, array_to_string(words[s + 1:s + 400], ' ') as text from c union all select doc_id || '_0', null, 0, text from documents),
hits as (select distinct doc_id % 7 as query_id, doc_id || '_' || (doc_id % 3 + 1) as id from documents), f as (select h.query_id, c.* from hits h join chunks c on h.id = c.id)
select query_id, id, 'self' as role, id as context_id, 0::bigint as distance, md5(text) as digest from f union all select f.query_id, f.id, 'parent', p.id, 0, md5(p.text) from f join chunks p on f.parent_id = p.id
union all select f.query_id, f.id, 'sibling', s.id, (s.chunk_index - f.chunk_index)::bigint, md5(s.text) from f join chunks s on f.parent_id = s.parent_id and s.id <> f.id and abs(s.chunk_index - f.chunk_index) <= 2""",
}
