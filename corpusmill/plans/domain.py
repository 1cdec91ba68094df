"""Queries of query analysis, terminology, metadata, sections, tables and relations: over fixed sample texts together with all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metadata, terms
from ..functions import query_analysis as qa
from ..operators import graph, structure, tables
from . import sql
from .queries_sql import weights_ctes

#: Queries that show every rule.
SAMPLE_QUERIES = (
    "What does the table show about revenue?", "Summarize the contract terms", "According to Figure 3, what is the trend?", "Find the chart showing quarterly sales", "What are the termination clauses?", "In the diagram on page 5",
    "Show me the data table", "List all parties to the agreement", "What is this contract about?", "What is the exact monthly fee in Article 3?", "Explain the scope of services", "compare section 5.2 versus exhibit B",
    "when does the NDA with ACME LLC expire?", "IRC section 199A deduction", "IRC requirements for a dwelling house", "precise value on line 12 of paragraph 4", "clause 7.1 and the SLA uptime of the MSA", "EBITDA and ROI before the IPO",
    "figures and images of the fire sprinkler", "give an overview and summary of the main key points", "NDA and NDA again",
)
#: Texts that show every rule of the extractors.
SAMPLE_TEXTS = (
    "MASTER SERVICES AGREEMENT\nThis services agreement is made between Acme Widgets Inc and Beta Services LLC effective as of January 5, 2023. It is governed by the laws of the State of New York and expires on 12/31/2025. Fee: $1,500.00 per month, total $18,000 yearly. Indemnification, termination and arbitration apply. Confidential information stays so.",
    "Employment Agreement\nOffer letter with at-will employment. \"Jane Doe Holdings\" (the company). Parties: Jane Doe, Acme. non-compete and liability. $75,000 annually",
    "IRC Section 199A(a)(1) deduction for taxable income, see Form 1040-SR and Form 8995. Treasury regulation and revenue ruling of 2023 and 2024. gross income; capital gain; charitable credit.",
    "2021 International Building Code (2021 IBC edition). Section 1004.5 occupancy, egress and sprinkler. City of San Diego amendment. § 903.2 fire alarm, electrical wiring and plumbing fixture.",
    "Acme Holdings Inc\nForm 10-K Annual Report for the year ended December 31, 2023. Revenue was $12,300 million in FY2023 and Q4 2023. net income, ebitda, cash flow. forward-looking statements and risk factor. Earnings of $3.20",
    "ARTICLE 1: DEFINITIONS\n\"Service\" means the services described herein for all of the parties to this text.\nARTICLE 2: SCOPE\n2.1 Services\nThe Provider shall provide the services as set forth in Exhibit A attached hereto.\n2.2 Timeline\nServices commence on January 1.\nSection 3.1.2: Payment\n(a) within 30 days\nWHEREAS the parties agree\nSchedule B\nChapter 4 Design",
    "This Amendment amends the original agreement dated Master Services Agreement of 2021. It supersedes all prior understandings. See Exhibit A attached. Pursuant to Section 15 of the agreement, it may be renewed. IRC Section 7701 and 26 U.S.C. 501 and 29 CFR 1910.12 apply. Incorporated by reference the terms of the plan. See the lease contract.",
    "Table 1: Fees\nItem | Amount | Due\n-----|-----|-----\nSetup | $1,200 | 01/05/2024\nMonthly | $300 | 02/05/2024\nYearly | 5% | 03/05/2024\n\nplain words follow here",
)


def _queries(spark, d):
    """Sample queries numbered from 0, and the benchmark texts from 1000."""
    own = spark.createDataFrame(list(enumerate(SAMPLE_QUERIES)), "query_id long, query string")
    return own.unionAll(spark.read.parquet(f"{d}/benchmark.parquet").select((F.col("item_id") + 1000).alias("query_id"), F.col("text").alias("query")))


def _corpus(spark, d):
    """Sample texts numbered from -1 down, and all documents."""
    own = spark.createDataFrame([(-1 - i, t, f"file{i}.txt") for i, t in enumerate(SAMPLE_TEXTS)], "doc_id long, text string, filename string")
    return own.unionAll(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", F.concat(F.col("source"), F.lit(".txt")).alias("filename")))


def query_modality(spark, d):
    q = F.col("query")
    w = _queries(spark, d).select("query_id", qa.visual_score(q).alias("s"), qa.modality(q).alias("modality"), qa.weights(q).alias("w"))
    return w.select("query_id", F.round("s", 6).alias("visual_score"), "modality", *[F.round(f"w.{m}", 6).alias(m) for m in ("bm25", "dense", "colpali")])


def query_class(spark, d):
    return _queries(spark, d).select("query_id", qa.query_class(F.col("query")).alias("query_class"))


def query_precision(spark, d):
    return _queries(spark, d).select("query_id", qa.precision(F.col("query")).alias("p")).select("query_id", "p.*")


def query_complexity(spark, d):
    return _queries(spark, d).select("query_id", qa.complexity(F.col("query")).alias("c")).select("query_id", "c.*")


def target_element_types(spark, d):
    return _queries(spark, d).select("query_id", F.array_join(qa.target_element_types(F.col("query")), ",").alias("types"), F.array_join(qa.target_elements(F.col("query")), ",").alias("elements"))


def acronym_expand(spark, d):
    out = terms.expand(_queries(spark, d).withColumn("domain", terms.detect_domain(F.col("query"))), terms.dictionary(spark), domain_col="domain")
    return out.select("query_id", "expanded_query", F.array_join("expansions", ";").alias("expansions"))


def domain_detect(spark, d):
    return _corpus(spark, d).select("doc_id", terms.detect_domain(F.col("text")).alias("domain"))


def acronym_disambiguate(spark, d):
    found = _queries(spark, d).select("query_id", "query", F.explode(F.array_distinct(F.regexp_extract_all("query", F.lit(terms.ACRONYM), F.lit(1)))).alias("acronym"))
    return terms.lookup(found, terms.dictionary(spark), "acronym", ["query_id", "query"], "query").select("query_id", "acronym", "expansion", "domain")


def search_terms(spark, d):
    return terms.search_terms(_queries(spark, d), terms.dictionary(spark)).select("query_id", F.array_join("search_terms", ",").alias("search_terms"))


def contract_metadata(spark, d):
    out = _corpus(spark, d).select("doc_id", metadata.contract(F.col("text")).alias("m")).select("doc_id", "m.*")
    # Amounts as they are written, to the cent, which doubles don't hold; null beyond 16 digits.
    money = F.array_join(F.transform("monetary_values", lambda m: F.concat_ws("/", metadata.amount_text(m.raw).try_cast("decimal(18,2)").cast("string"), F.coalesce(m.period, F.lit("-")))), ";")
    return out.withColumns({"parties": F.array_join("parties", ";"), "legal_terms": F.array_join("legal_terms", ";"), "monetary_values": money, "confidence": sql.rounded(F.col("confidence"), 6)})


def tax_metadata(spark, d):
    out = _corpus(spark, d).select("doc_id", metadata.tax(F.col("text"), 2024).alias("m")).select("doc_id", "m.*")
    return out.withColumns({c: F.array_join(c, ";") for c in ("irc_sections", "tax_forms", "tax_categories", "tax_years")})


def building_metadata(spark, d):
    out = _corpus(spark, d).select("doc_id", metadata.building(F.col("text")).alias("m")).select("doc_id", "m.*")
    return out.withColumns({c: F.array_join(c, ";") for c in ("sections", "categories")})


def financial_metadata(spark, d):
    out = _corpus(spark, d).select("doc_id", metadata.financial(F.col("text")).alias("m")).select("doc_id", "m.*")
    amounts = F.array_join(F.transform("key_amounts", lambda a: F.concat_ws("/", a.context, a.amount, a.unit)), ";")
    return out.withColumns({"fiscal_periods": F.array_join("fiscal_periods", ";"), "metrics": F.array_join("metrics", ";"), "key_amounts": amounts})


def doc_type_route(spark, d):
    names = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("tax_"), F.col("filename"))).otherwise(F.col("filename"))
    return _corpus(spark, d).select("doc_id", metadata.route(F.col("text")).alias("by_text"), metadata.route(F.col("text"), names).alias("by_name"), metadata.file_type(names, F.col("text")).alias("file_type"))


def section_spans(spark, d):
    return structure.sections(_corpus(spark, d)).select("doc_id", "start", "end", "title", "number", F.col("level").cast("long").alias("level"), F.col("line_number").cast("long").alias("line_number"))


def table_cell_types(spark, d):
    cells = _corpus(spark, d).select("doc_id", F.explode(F.array_distinct(F.split("text", r"[\s|]+"))).alias("cell")).where("cell <> ''")
    return cells.groupBy(tables.cell_type(F.col("cell")).alias("data_type")).agg(F.count("*").alias("n"))


def table_line_columns(spark, d):
    each = _corpus(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "x")).where(tables.is_table_line(F.col("x")))
    return each.select("doc_id", F.col("line").cast("long").alias("line"), tables.count_columns(F.col("x")).cast("long").alias("columns"))


def table_extract(spark, d):
    """Tables of all texts."""
    return tables.extract(_corpus(spark, d)).select("doc_id", "table_id", "char_start", "char_end", F.round("confidence", 6).alias("confidence"), "num_rows", "num_cols", "table_type", "title", "structured_text", "semantic_description")


def table_chunks(spark, d):
    """Two chunks for each table."""
    return tables.table_chunks(tables.extract(_corpus(spark, d))).drop("headers")


def relation_extract(spark, d):
    return graph.extract(_corpus(spark, d)).select("source_id", "ord", "relation_type", "reference", "matched", F.round("confidence", 6).alias("confidence"))


def relation_resolve(spark, d):
    known = spark.createDataFrame([("Section 15", "d15", 0), ("7701", "irc7701", 1), ("master services agreement", "msa", 2), ("A", "exA", 3)], "identifier string, document_id string, ord int")
    return graph.resolve(graph.extract(_corpus(spark, d)), known).select("source_id", "relation_type", "reference", "target_id")


QUERIES = {f.__name__: f for f in (
    query_modality, query_class, query_precision, query_complexity, target_element_types, acronym_expand, domain_detect, acronym_disambiguate, search_terms, contract_metadata, tax_metadata, building_metadata,
    financial_metadata, doc_type_route, section_spans, table_cell_types, table_line_columns, table_extract, table_chunks, relation_extract, relation_resolve,
)}

_Q = "(select * from (values " + ", ".join(f"({i}::bigint, {sql.quoted(q)})" for i, q in enumerate(SAMPLE_QUERIES)) + ") v(query_id, query) union all select item_id + 1000, text from benchmark)"
_C = "corpus as (select * from (values " + ", ".join(f"({-1 - i}::bigint, {sql.quoted(t)}, 'file{i}.txt')" for i, t in enumerate(SAMPLE_TEXTS)) + ") v(doc_id, text, filename) union all select doc_id, text, source || '.txt' from documents)"


def _ordered(column: str, table, test) -> str:
    return "case " + " ".join(f"when {test(column, k)} then {sql.quoted(n)}" for n, k in table)


def _precision() -> str:
    kinds = " ".join(f"when regexp_matches(query, {sql.quoted('(?i)' + p)}) then '{n}'" for p, n, _ in qa.PRECISION)
    refs = " ".join(f"when regexp_matches(query, {sql.quoted('(?i)' + p)}) then " + (f"regexp_extract(query, {sql.quoted('(?i)' + p)}, 1)" if c else "null") for p, _, c in qa.PRECISION)
    return f"select query_id, case {kinds} end is not null as is_precision, case {kinds} end as pattern_type, nullif(case {refs} end, '') as reference from {_Q}"


def _domain(column: str) -> str:
    own = {x: list(dict.fromkeys(t.lower() for t, _, y, _, _ in terms.TERMS if y == x)) for x in terms.DOMAIN_WORDS}
    return sql.first_max([(x, f"({sql.hits(column, own[x])} + {sql.hits(column, terms.DOMAIN_WORDS[x])})") for x in terms.DOMAIN_WORDS], "general")


_DICT = "dict as (select * from (values " + ", ".join(f"({sql.quoted(k)}, {sql.quoted(t)}, {sql.quoted(e)}, {sql.quoted(x)}, {sql.listed(a) if a else '[]::varchar[]'}, {sql.listed(c)}, {o})" for k, t, e, x, a, c, o in terms.dictionary_rows()) + ") v(key, term, expansion, domain, aliases, context, ord))"


def _expand() -> str:
    return rf"""with recursive {_DICT}, q as (select *, {_domain('lower(query)')} as hint, regexp_extract_all(query, '\b([A-Z]{{2,6}})\b', 1) as found from {_Q}),
e as (select query_id, query, hint, unnest(range(1, len(found) + 1)) as i, unnest(found) as acronym from q),
n as (select e.query_id, e.i, e.acronym, arg_max(d.expansion, {{'h': (d.domain = e.hint)::int, 's': len(list_filter(d.context, lambda k: contains(lower(e.query), k))), 'o': -d.ord}}) as expansion from e join dict d on d.key = upper(e.acronym) group by 1, 2, 3),
s as (select query_id, list({{'a': acronym, 'e': expansion}} order by i) as steps from n group by 1),
r(query_id, text, steps, i) as (select q.query_id, q.query, coalesce(s.steps, []), 1 from q left join s on q.query_id = s.query_id
  union all select query_id, substr(text, 1, strpos(text, steps[i].a) - 1) || steps[i].a || ' (' || steps[i].e || ')' || substr(text, strpos(text, steps[i].a) + length(steps[i].a)), steps, i + 1 from r where i <= len(steps))
select query_id, text as expanded_query, array_to_string(list_transform(steps, lambda x: x.a || ' → ' || x.e), ';') as expansions from r where i = len(steps) + 1"""


def _types(table, column: str = "low", default: str = "unknown") -> str:
    return _ordered(column, table, sql.any_hit) + f" else {sql.quoted(default)} end"


def _cats(table) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"case when {sql.any_hit('low', k)} then {sql.quoted(n)} end" for n, k in table) + "], lambda x: x is not null), ';')"


def _capped(pattern: str, n: int) -> str:
    return f"array_to_string({sql.first_seen(f'regexp_extract_all(text, {sql.quoted(pattern)}, 1)')}[1:{n}], ';')"


def _one(pattern: str, column: str = "text") -> str:
    return f"nullif(regexp_extract({column}, {sql.quoted(pattern)}, 1), '')"


_LOW = f"with {_C}, c as (select *, lower(text) as low from corpus) "


def _contract() -> str:
    m = metadata
    scores = [(n, sql.hits("low", k)) for n, k in m.CONTRACT_TYPES]
    parties = "list_concat(" + "list_concat(" * (len(m.PARTIES) - 2) + f"regexp_extract_all(substr(text, 1, 5000), {sql.quoted(m.PARTIES[0])}, 1)" + "".join(f", regexp_extract_all(substr(text, 1, 5000), {sql.quoted(p)}, 1))" for p in m.PARTIES[1:])
    money = f"list_transform(list_zip(regexp_extract_all(text, {sql.quoted(m.MONEY)}, 1), regexp_extract_all(text, {sql.quoted(m.MONEY)}, 2), regexp_extract_all(text, {sql.quoted(m.MONEY)}, 3))[1:20], lambda x: concat_ws('/', try_cast(replace(x[1], ',', '') as decimal(18, 2))::varchar, coalesce(nullif(x[2], ''), nullif(x[3], ''), '-')))"
    return f"""{_LOW}, p as (select *, list_filter(list_transform({parties}, lambda x: {sql.strip('x')}), lambda x: length(x) > 3) as parties_, list_transform(string_split(text, chr(10))[1:20], lambda x: {sql.strip('x')}) as lines from c)
select doc_id, {sql.first_max(scores, 'other')} as contract_type, round(least(1.0, greatest({', '.join(s for _, s in scores)}) / 3), 6)::double as confidence,
  list_filter(lines, lambda x: length(x) > 10 and length(x) < 200 and (regexp_matches(x, {sql.quoted(m.CAPITALS)}) or {sql.any_hit('lower(x)', m.TITLE_WORDS)}))[1] as title, array_to_string({sql.first_seen('parties_')}[1:10], ';') as parties,
  {_one(m.EFFECTIVE)} as effective_date, {_one(m.EXPIRY)} as expiration_date, array_to_string({money}, ';') as monetary_values, array_to_string({sql.present('low', m.LEGAL_TERMS)}, ';') as legal_terms,
  nullif({sql.strip(f'regexp_extract(text, {sql.quoted(m.GOVERNING_LAW)}, 1)')}, '') as governing_law, contains(low, 'indemnification') as has_indemnification, contains(low, 'termination') as has_termination_clause, contains(low, 'confidential') as has_confidentiality,
  contains(low, 'non-compete') or contains(low, 'noncompete') as has_non_compete, contains(low, 'arbitration') as has_arbitration from p"""


def _sections(document_type: str = "general", patterns=None, flag: str = "(?i)") -> str:
    patterns = patterns or structure.patterns_for(document_type)
    which = "case " + " ".join(f"when regexp_matches(x, {sql.quoted(flag + p)}) then {k}" for k, p in enumerate(patterns)) + " end"
    title = "case p " + " ".join(f"when {k} then regexp_extract(x, {sql.quoted(flag + p)}, 0)" for k, p in enumerate(patterns)) + " end"
    number = "case p " + " ".join(f"when {k} then regexp_extract(x, {sql.quoted(flag + p)}, {min(2, structure._groups(p))})" for k, p in enumerate(patterns)) + " end"
    return rf"""with {_C}, l as (select doc_id, length(text) as n, unnest(range(0, len(string_split(text, chr(10))))) as line_number, unnest(string_split(text, chr(10))) as raw from corpus),
o as (select *, {sql.strip('raw')} as x, coalesce(sum(length(raw) + 1) over (partition by doc_id order by line_number rows between unbounded preceding and 1 preceding), 0)::bigint as start from l),
m as (select *, {which} as p from o where x <> ''), h as (select *, {title} as title, {number} as number from m where p is not null)
select doc_id, start, coalesce(lead(start) over (partition by doc_id order by line_number), n) as "end", title, number, case when length(title) - length(replace(title, '.', '')) >= 2 then 3 when length(title) - length(replace(title, '.', '')) = 1 then 2 when regexp_matches(title, '^\([a-z]\)') then 3 when regexp_matches(title, '(?i)^(Article|Chapter|Part)') then 1 else 2 end::bigint as level, line_number from h"""


def _cell_type() -> str:
    return "case " + " ".join(f"when regexp_matches(cell, {sql.quoted(p)}) then '{n}'" for n, p in tables.CELL_TYPES) + f" when lower(cell) in ({', '.join(map(sql.quoted, tables.BOOLEANS))}) then 'boolean' else 'text' end"


def _tables() -> str:
    """CTEs that end in ta(doc_id, k, start, end, confidence, rows, kind, title, structured_text, description)."""
    t = tables
    strip = sql.strip
    hints = " union all ".join(rf"select doc_id, {i} as p, string_split(regexp_replace(text, {sql.quoted('(' + p + ')' if not p.startswith('(?m)') else '(?m)(' + p[4:] + ')')}, chr(57344) || '\1', 'g'), chr(10)) as marked from corpus" for i, p in enumerate(t.INDICATORS))
    filled = r"list_filter({}, lambda y: regexp_matches(y, '\S'))"
    columns = rf"case when contains(x, '|') then len({filled.format(chr(115) + 'tring_split(x, ' + chr(39) + '|' + chr(39) + ')')}) when contains(x, chr(9)) then len({filled.format('string_split(x, chr(9))')}) else len(list_filter(string_split_regex({strip('x')}, '\s{{2,}}'), lambda y: y <> '')) end"
    is_table = rf"regexp_matches(x, '\S') and (contains(x, '|') or length(x) - length(replace(x, chr(9), '')) >= 2 or len(string_split_regex({strip('x')}, '\s{{3,}}')) >= 3 or regexp_matches(x, {sql.quoted(t.BORDER)}))"
    cell = "case " + " ".join(f"when regexp_matches(c, {sql.quoted(p)}) then '{n}'" for n, p in t.CELL_TYPES) + f" when lower(c) in ({', '.join(map(sql.quoted, t.BOOLEANS))}) then 'boolean' else 'text' end"
    count = lambda mark: f"(length(body) - length(replace(body, {mark}, '')))"
    cells = lambda split: f"list_filter(list_transform({split}, lambda y: {strip('y')}), lambda y: y <> '')"
    part = lambda *names: f"len(list_filter(kinds, lambda k: k in ({', '.join(map(sql.quoted, names))}))) / len(kinds)"
    by_header = " ".join(f"when list_has_any(list_transform(rows_[1], lambda y: lower(y)), {sql.listed(words)}) then '{n}'" for n, words in t.HEADER_TYPES)
    said = "case kind " + " ".join(f"when '{n}' then {sql.quoted(w)}" for n, w in t.DESCRIPTIONS.items()) + " end"
    quoted = "array_to_string(list_transform({}, lambda y: '\"' || y || '\"'), ',')"
    return rf"""with recursive {_C},
li as (select doc_id, len(string_split(text, chr(10))) as n, unnest(range(0, len(string_split(text, chr(10))))) as i, unnest(string_split(text, chr(10))) as x from corpus),
lk as (select *, case when {is_table} then 2 when regexp_matches(x, '\S') then 0 else 1 end as k, {columns} as cols, coalesce(sum(length(x) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as before from li),
hm as ({hints}), hl as (select doc_id, p, unnest(range(0, len(marked))) as i, unnest(marked) as x from hm), h1 as (select doc_id, i, min(p) as p from hl where contains(x, chr(57344)) group by 1, 2), ho as (select *, row_number() over (partition by doc_id order by p, i) as o from h1),
lh as (select h.doc_id, h.o, h.i as s, greatest(coalesce(max(l.i) filter (where l.k = 0 and l.i < h.i), -1), greatest(0, h.i - {t.REACH_UP})) as low, least(coalesce(min(l.i) filter (where l.k = 0 and l.i > h.i), any_value(l.n)), least(any_value(l.n), h.i + {t.REACH_DOWN})) as high from ho h join lk l on h.doc_id = l.doc_id group by 1, 2, 3),
nr as (select h.doc_id, h.o, coalesce(min(l.i) filter (where l.k = 2 and l.i > h.low and l.i < h.s), h.s) as a, coalesce(max(l.i) filter (where l.k = 2 and l.i > h.s and l.i < h.high), h.s) as b from lh h join lk l on h.doc_id = l.doc_id group by h.doc_id, h.o, h.s),
n2 as (select doc_id, a, b, row_number() over (partition by doc_id order by o) - 1 as ord from nr where b - a >= 2),
st as (select doc_id, -1 as i from corpus union all select doc_id, i from lk where k = 0 union all select distinct doc_id, n from lk), ed as (select doc_id, i as a, lead(i) over (partition by doc_id order by i) as b from st),
sp as (select e.doc_id, min(l.i) filter (where l.k = 2) as a, e.b - 1 as b, e.a as at_ from ed e join lk l on e.doc_id = l.doc_id and l.i > e.a and l.i < e.b where e.b - e.a > 3 group by e.doc_id, e.a, e.b), s2 as (select *, row_number() over (partition by doc_id order by at_) - 1 as ord from sp where a is not null),
bo as (select doc_id, a, b, ord, true as hinted from n2 union all select doc_id, a, b, ord + 1000000, false from s2),
bl as (select b.doc_id, b.ord, b.hinted, b.a, b.b, string_agg(l.x, chr(10) order by l.i) as body, min(l.before) as start, max(l.before + length(l.x) + 1) as end_, list(l.cols::double) filter (where regexp_matches(l.x, '\S')) as counts from bo b join lk l on b.doc_id = l.doc_id and l.i between b.a and b.b group by all),
bc as (select *, case when hinted then least(1.0::double, 0.5::double + least(0.2::double, len(string_split({strip('body')}, chr(10))) * 0.02::double) + case when {count("'|'")} > len(string_split({strip('body')}, chr(10))) then 0.15::double else 0 end + case when regexp_matches(body, '\$[\d,]+|\d+%|\d{{1,2}}/\d{{1,2}}/\d{{2,4}}') then 0.1::double else 0 end) else least(0.9::double, 0.5::double + len(counts) * 0.05::double) end as confidence, case when hinted then end_ else start + length(body) end as stop from bl),
ca as (select doc_id, row_number() over (partition by doc_id order by start, ord) as i, {{'start': start, 'stop': stop, 'body': body, 'confidence': confidence}} as r from bc where hinted or (len(counts) >= 3 and list_var_pop(counts) < 2)),
ke(doc_id, i, last, out) as (select doc_id, 1, r, [r] from ca where i = 1
  union all select k.doc_id, k.i + 1, case when c.r.start >= k.last.stop or c.r.confidence > k.last.confidence then c.r else k.last end, case when c.r.start >= k.last.stop then list_append(k.out, c.r) when c.r.confidence > k.last.confidence then list_append(k.out[1:len(k.out) - 1], c.r) else k.out end from ke k join ca c on k.doc_id = c.doc_id and c.i = k.i + 1),
fi as (select doc_id, list_filter(arg_max(out, i), lambda r: r.confidence >= {t.LEAST_CONFIDENCE}) as out from ke group by 1),
ex as (select doc_id, unnest(range(0, len(out))) as k, unnest(out) as r from fi), eb as (select doc_id, k, r.start as start, r.stop as "end", r.confidence as confidence, r.body as body from ex),
pr as (select *, list_filter(string_split({strip('body')}, chr(10)), lambda x: not regexp_matches(x, {sql.quoted(t.BORDER)})) as own, len(string_split({strip('body')}, chr(10))) as m from eb),
rw as (select *, list_filter(list_transform(own, lambda x: case when {count("'|'")} > m then {cells("string_split(x, '|')")} when {count('chr(9)')} > m then {cells('string_split(x, chr(9))')} else {cells("string_split_regex(x, " + chr(39) + chr(92) + "s{2,}" + chr(39) + ")")} end), lambda y: len(y) > 0) as rows_ from pr),
ty as (select *, list_transform(flatten(rows_), lambda c: {cell}) as kinds from rw),
tk as (select *, case when len(kinds) = 0 then 'data' when {part('currency', 'number')} > 0.5 then 'financial' when {part('boolean')} > 0.2 then 'compliance' when {part('date')} > 0.2 then 'schedule' {by_header} else 'data' end as kind from ty),
tp as (select *, list_transform(rows_[2], lambda y, j: case when j <= len(rows_[1]) then rows_[1][j] || ': ' || y end)[1:len(rows_[1])][1:4] as pairs from tk),
ta as (select doc_id, k, start, "end", confidence, rows_, kind, nullif(regexp_extract(substr(body, 1, 200), {sql.quoted(t.TITLE)}, 1), '') as title,
  case when len(rows_) = 0 then '' else {quoted.format('rows_[1]')} || chr(10) || array_to_string(list_transform(rows_, lambda r: {quoted.format('r')}), chr(10)) end as structured_text,
  'This is a ' || {said} || '.' || case when len(rows_[1]) > 0 then ' Columns: ' || array_to_string(rows_[1], ', ') || '.' else '' end || ' Contains ' || greatest(len(rows_) - 1, 0) || ' data rows.' || case when len(pairs) > 0 then ' Sample row: ' || array_to_string(pairs, ', ') || '.' else '' end as description from tp)"""


def _relations() -> str:
    g = graph
    parts = " union all ".join(f"select doc_id, {k} as p, '{kind}' as relation_type, unnest(range(0, len(regexp_extract_all(text, {sql.quoted('(?i)' + p)})))) as i, unnest(regexp_extract_all(text, {sql.quoted('(?i)' + p)}, 1)) as reference, unnest(regexp_extract_all(text, {sql.quoted('(?i)' + p)}, 0)) as matched from corpus" for k, (kind, p) in enumerate(g.PATTERNS))
    return f"""with {_C}, m as ({parts}), relations as (select doc_id as source_id, (p * 1000000 + i)::bigint as ord, relation_type, {sql.strip('reference')} as reference, matched,
  greatest({g.LEAST}, least({g.MOST}, case when relation_type in ('cites', 'exhibits_to') then {g.SPECIFIC} else {g.BASE} end - case when length(matched) > {g.LONG} then {g.LONG_COST} else 0 end - case when {sql.any_hit('lower(matched)', g.HEDGES)} then {g.HEDGE_COST} else 0 end))::double as confidence from m)"""


ORACLES = {
    "query_modality": f"with {weights_ctes('select * from ' + _Q)} select query_id, round(visual_score, 6)::double as visual_score, modality, round(bm25, 6) as bm25, round(dense, 6) as dense, round(colpali, 6) as colpali from weights",
    "query_class": f"select query_id, {_ordered('lower(query)', qa.CLASSES, sql.any_hit)} else 'broad' end as query_class from {_Q}",
    "query_precision": _precision(),
    "query_complexity": f"""with c as (select query_id, {sql.hits('lower(query)', qa.PRECISION_WORDS)} as a, {sql.hits('lower(query)', qa.BROAD_WORDS)} as b, len({sql.words('query')}) as words from {_Q})
select query_id, case when a > b then 'sentence' when b > a and b >= 2 then 'section' else 'paragraph' end as level, (case when a = b then 0.5 when greatest(a, b) >= 2 then 0.9 else 0.7 end)::double as confidence, words from c""",
    "target_element_types": f"""with t as (select query_id, list_filter([{', '.join(f"case when regexp_matches(lower(query), {sql.quoted(p)}) then '{n}' end" for p, n, _ in qa.VISUAL_ELEMENTS)}], lambda x: x is not null) as e, list_filter([{', '.join(f"case when regexp_matches(lower(query), {sql.quoted(p)}) then '{k}' end" for p, _, k in qa.VISUAL_ELEMENTS)}], lambda x: x is not null) as k from {_Q})
select query_id, case when len(k) > 0 then array_to_string({sql.first_seen('k')}, ',') end as types, array_to_string(e, ',') as elements from t""",
    "acronym_expand": _expand(),
    "domain_detect": f"with {_C} select doc_id, {_domain('lower(text)')} as domain from corpus",
    "acronym_disambiguate": rf"""with {_DICT}, e as (select query_id, query, unnest(list_distinct(regexp_extract_all(query, '\b([A-Z]{{2,6}})\b', 1))) as acronym from {_Q}),
n as (select e.query_id, e.acronym, arg_max({{'e': d.expansion, 'd': d.domain}}, {{'s': len(list_filter(d.context, lambda k: contains(lower(e.query), k))), 'o': -d.ord}}) as x from e join dict d on d.key = upper(e.acronym) group by 1, 2) select query_id, acronym, x.e as expansion, x.d as domain from n""",
    "search_terms": f"""with {_DICT}, e as (select query_id, unnest({sql.words('query')}) as word from {_Q}), f as (select e.query_id, e.word, arg_min(d.aliases, d.ord) as aliases from e left join dict d on d.key = upper(e.word) group by 1, 2),
a as (select query_id, lower(word) as t from f union select query_id, lower(unnest(aliases)) from f) select query_id, string_agg(t, ',' order by t) as search_terms from a group by 1""",
    "contract_metadata": _contract(),
    "tax_metadata": f"""{_LOW}, m as (select doc_id, {_capped(metadata.TAX_SECTION, 50)} as irc_sections, {_capped(metadata.TAX_FORM, 20)} as tax_forms, {_cats(metadata.TAX_CATEGORIES)} as tax_categories, array_to_string({sql.present('text', [str(y) for y in range(2004, 2029)])}, ';') as tax_years, {sql.any_hit('low', ('regulation', 'treasury'))} as is_regulation, {sql.any_hit('low', ('notice', 'revenue ruling', 'revenue procedure'))} as is_guidance from c)
select *, coalesce(nullif(string_split(tax_categories, ';')[1], ''), 'general') as document_subtype, (case when irc_sections <> '' then 0.8 else 0.5 end)::double as confidence from m""",
    "building_metadata": f"""{_LOW}, m as (select doc_id, {_types(metadata.CODE_TYPES)} as code_type, {_capped(metadata.CODE_SECTION, 50)} as sections, {_cats(metadata.BUILDING_CATEGORIES)} as categories, {_one(metadata.EDITION)} as edition, {sql.any_hit('low', ('amendment', 'revision'))} as is_amendment, {_one(metadata.JURISDICTION)} as jurisdiction from c)
select *, (case when code_type <> 'unknown' then 0.8 else 0.4 end)::double as confidence from m""",
    "financial_metadata": f"""{_LOW}, m as (select doc_id, {_types(metadata.REPORT_TYPES)} as report_type, list_concat(regexp_extract_all(text, {sql.quoted(metadata.FISCAL_PERIOD)}, 1), regexp_extract_all(text, {sql.quoted(metadata.PERIOD_ENDED)}, 1)) as periods, array_to_string({sql.present('low', metadata.FINANCIAL_METRICS)}, ';') as metrics,
  {sql.strip(f"coalesce({', '.join(_one(p, 'substr(text, 1, 3000)') for p in metadata.COMPANY)})")} as company, list_zip(regexp_extract_all(text, {sql.quoted(metadata.AMOUNT)}, 1), regexp_extract_all(text, {sql.quoted(metadata.AMOUNT)}, 2), regexp_extract_all(text, {sql.quoted(metadata.AMOUNT)}, 3))[1:10] as amounts,
  {sql.any_hit('low', ('forward-looking', 'guidance'))} as has_forward_looking, contains(low, 'risk factor') as has_risk_factors from c)
select doc_id, report_type, (case when report_type <> 'unknown' then 0.8 else 0.5 end)::double as confidence, array_to_string({sql.first_seen('periods')}, ';') as fiscal_periods, metrics, company, array_to_string(list_transform(amounts, lambda a: a[1] || '/' || a[2] || '/' || coalesce(nullif(a[3], ''), 'dollars')), ';') as key_amounts, has_forward_looking, has_risk_factors from m""",
    "doc_type_route": f"""{_LOW}, n as (select *, case when doc_id % 3 = 0 then 'tax_' || filename else filename end as name from c), s as (select *, case when greatest({', '.join(sql.hits('low', k) for _, k in metadata.ROUTE_WORDS)}) >= 2 then {sql.first_max([(x, sql.hits('low', k)) for x, k in metadata.ROUTE_WORDS], 'contract')} else 'contract' end as by_text from n)
select doc_id, by_text, {_ordered('lower(name)', metadata.ROUTE_NAMES, sql.any_hit)} else by_text end as by_name, {_ordered('lower(name)', metadata.FILE_NAMES, sql.any_hit)} when regexp_matches(lower(name), '(\\.xlsx|\\.xls)$') then 'spreadsheet' when regexp_matches(lower(name), '(\\.py|\\.js|\\.ts|\\.java|\\.cpp|\\.c)$') then 'code' {' '.join(f"when {sql.any_hit('low', k)} then '{x}'" for x, k in metadata.FILE_WORDS)} else 'document' end as file_type from s""",
    "section_spans": _sections(),
    "table_cell_types": rf"with {_C}, e as (select doc_id, unnest(list_distinct(string_split_regex(text, '[\s|]+'))) as cell from corpus) select {_cell_type()} as data_type, count(*) as n from e where cell <> '' group by 1",
    "table_line_columns": rf"""with {_C}, l as (select doc_id, unnest(range(0, len(string_split(text, chr(10))))) as line, unnest(string_split(text, chr(10))) as x from corpus)
select doc_id, line, case when contains(x, '|') then len(list_filter(string_split(x, '|'), lambda p: regexp_matches(p, '\S'))) when contains(x, chr(9)) then len(list_filter(string_split(x, chr(9)), lambda p: regexp_matches(p, '\S'))) else len(list_filter(string_split_regex({sql.strip('x')}, '\s{{2,}}'), lambda p: p <> '')) end as columns
from l where regexp_matches(x, '\S') and (contains(x, '|') or length(x) - length(replace(x, chr(9), '')) >= 2 or len(string_split_regex({sql.strip('x')}, '\s{{3,}}')) >= 3 or regexp_matches(x, '^[\s\-|+]+$'))""",
    "table_extract": _tables() + " select doc_id, doc_id || '_table_' || k as table_id, start::bigint as char_start, \"end\"::bigint as char_end, round(confidence, 6) as confidence, len(rows_)::bigint as num_rows, coalesce(list_max(list_transform(rows_, lambda r: len(r))), 0)::bigint as num_cols, kind as table_type, title, structured_text, description as semantic_description from ta",
    "table_chunks": _tables() + " select doc_id, doc_id || '_table_' || k || '_structured' as chunk_id, doc_id || '_table_' || k as table_id, 'table_structured' as type, kind as table_type, structured_text as text from ta union all select doc_id, doc_id || '_table_' || k || '_semantic', doc_id || '_table_' || k, 'table_semantic', kind, description from ta",
    "relation_extract": _relations() + " select source_id, ord, relation_type, reference, matched, round(confidence, 6) as confidence from relations",
    "relation_resolve": _relations() + """, known as (select * from (values ('Section 15', 'd15', 0), ('7701', 'irc7701', 1), ('master services agreement', 'msa', 2), ('A', 'exA', 3)) v(identifier, document_id, o)),
r as (select *, coalesce((select arg_min(document_id, o) from known k where contains(lower(reference), lower(k.identifier))), 'unresolved:' || reference) as target_id from relations)
select source_id, relation_type, reference, target_id from (select *, row_number() over (partition by source_id, target_id, relation_type order by ord) as n from r) where n = 1""",
}
