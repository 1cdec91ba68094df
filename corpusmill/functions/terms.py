"""Terminology: a dictionary of acronyms and terms, domain detection, expansion and related words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import first_max, hits, words

#: Fixed values: (term, expansion, domain, aliases, context words), by domain, in their order.
TERMS = (
    ("NDA", "Non-Disclosure Agreement", "legal", ("non-disclosure", "confidentiality agreement"), ("confidential", "proprietary", "secret")),
    ("LOI", "Letter of Intent", "legal", (), ("intent", "preliminary", "proposal")),
    ("SOW", "Statement of Work", "legal", (), ("scope", "deliverables", "services")),
    ("MSA", "Master Services Agreement", "legal", (), ("services", "master", "umbrella")),
    ("SLA", "Service Level Agreement", "legal", (), ("service", "level", "uptime", "performance")),
    ("IP", "Intellectual Property", "legal", (), ("patent", "copyright", "trademark", "trade secret")),
    ("LLC", "Limited Liability Company", "legal", (), ("company", "business", "entity")),
    ("JV", "Joint Venture", "legal", (), ("venture", "partnership", "collaboration")),
    ("M&A", "Mergers and Acquisitions", "legal", ("merger", "acquisition"), ("merger", "acquire", "takeover", "buyout")),
    ("ADR", "Alternative Dispute Resolution", "legal", (), ("arbitration", "mediation", "dispute")),
    ("IRC", "Internal Revenue Code", "tax", (), ("tax", "federal", "revenue", "section")),
    ("IRS", "Internal Revenue Service", "tax", (), ("tax", "federal", "audit", "filing")),
    ("AGI", "Adjusted Gross Income", "tax", (), ("income", "deduction", "taxable")),
    ("FICA", "Federal Insurance Contributions Act", "tax", (), ("payroll", "social security", "medicare", "withholding")),
    ("FUTA", "Federal Unemployment Tax Act", "tax", (), ("unemployment", "employer", "payroll")),
    ("AMT", "Alternative Minimum Tax", "tax", (), ("minimum", "alternative", "preference")),
    ("QBI", "Qualified Business Income", "tax", (), ("business", "deduction", "pass-through", "199A")),
    ("SALT", "State and Local Taxes", "tax", (), ("state", "local", "deduction", "property")),
    ("RMD", "Required Minimum Distribution", "tax", (), ("retirement", "distribution", "IRA", "401k")),
    ("QSBS", "Qualified Small Business Stock", "tax", (), ("stock", "capital gains", "exclusion", "1202")),
    ("IBC", "International Building Code", "building", (), ("building", "construction", "code", "occupancy")),
    ("IRC", "International Residential Code", "building", (), ("residential", "dwelling", "house", "home")),
    ("IFC", "International Fire Code", "building", (), ("fire", "safety", "sprinkler", "alarm")),
    ("ADA", "Americans with Disabilities Act", "building", (), ("accessibility", "disability", "wheelchair", "ramp")),
    ("HVAC", "Heating, Ventilation, and Air Conditioning", "building", (), ("heating", "cooling", "ventilation", "air")),
    ("MEP", "Mechanical, Electrical, and Plumbing", "building", (), ("mechanical", "electrical", "plumbing", "systems")),
    ("NFPA", "National Fire Protection Association", "building", (), ("fire", "protection", "safety", "code")),
    ("OSHA", "Occupational Safety and Health Administration", "building", (), ("safety", "workplace", "hazard", "violation")),
    ("LEED", "Leadership in Energy and Environmental Design", "building", (), ("green", "sustainable", "energy", "environmental")),
    ("R-value", "Thermal Resistance Value", "building", ("R value", "Rvalue"), ("insulation", "thermal", "energy", "efficiency")),
    ("EBITDA", "Earnings Before Interest, Taxes, Depreciation, and Amortization", "financial", (), ("earnings", "operating", "profit", "margin")),
    ("ROI", "Return on Investment", "financial", (), ("return", "investment", "profit", "ratio")),
    ("ROE", "Return on Equity", "financial", (), ("equity", "return", "shareholders", "ratio")),
    ("P/E", "Price to Earnings Ratio", "financial", ("PE", "PE ratio"), ("price", "earnings", "stock", "valuation")),
    ("EPS", "Earnings Per Share", "financial", (), ("earnings", "share", "profit", "diluted")),
    ("GAAP", "Generally Accepted Accounting Principles", "financial", (), ("accounting", "standards", "financial", "reporting")),
    ("SEC", "Securities and Exchange Commission", "financial", (), ("securities", "regulation", "filing", "disclosure")),
    ("IPO", "Initial Public Offering", "financial", (), ("public", "stock", "offering", "shares")),
    ("DCF", "Discounted Cash Flow", "financial", (), ("valuation", "cash flow", "discount", "present value")),
    ("CAGR", "Compound Annual Growth Rate", "financial", (), ("growth", "annual", "rate", "compound")),
)
#: Further words of each domain.
DOMAIN_WORDS = {
    "legal": ("agreement", "contract", "party", "whereas", "hereby"),
    "tax": ("tax", "irs", "deduction", "income", "filing"),
    "building": ("code", "construction", "building", "occupancy", "fire"),
    "financial": ("revenue", "earnings", "quarter", "fiscal", "investor"),
}
ACRONYM = r"\b([A-Z]{2,6})\b"
DICTIONARY = "key string, term string, expansion string, domain string, aliases array<string>, context array<string>, ord int"


def dictionary_rows(terms=TERMS) -> list[tuple]:
    """One row for each term and alias, under its upper-case key."""
    out = []
    for i, (term, expansion, domain, aliases, context) in enumerate(terms):
        out += [(key.upper(), term, expansion, domain, list(aliases), list(context), i) for key in (term, *aliases)]
    return out


def dictionary(spark: SparkSession, terms=TERMS) -> DataFrame:
    return spark.createDataFrame(dictionary_rows(terms), DICTIONARY)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary from a JSON file that write_dictionary wrote."""
    return spark.read.schema(DICTIONARY).json(path)


def write_dictionary(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def detect_domain(text: Column, terms=TERMS) -> Column:
    """The domain with the most terms and words in text, the first of several, general if none has any."""
    lower = F.lower(text)
    own = {d: list(dict.fromkeys(t.lower() for t, _, domain, _, _ in terms if domain == d)) for d in DOMAIN_WORDS}
    return first_max([(d, hits(lower, own[d]) + hits(lower, DOMAIN_WORDS[d])) for d in DOMAIN_WORDS], "general")


def lookup(frame: DataFrame, spark_terms: DataFrame, key_col: str, id_cols: list[str], context_col: str | None = None, hint_col: str | None = None) -> DataFrame:
    """The definition of each key: the only one, else that of the hinted domain, else that with the most context words (the first of several).

    The dictionary is a few dozen rows; Spark broadcasts it by its size.
    """
    score = F.lit(0)
    if context_col:
        lower = F.lower(F.col(context_col))
        score = F.size(F.filter("context", lambda k: F.contains(lower, k)))
    hinted = F.coalesce((F.col("domain") == F.col(hint_col)).cast("int"), F.lit(0)) if hint_col else F.lit(0)
    joined = frame.join(spark_terms.withColumnRenamed("key", "dict_key"), F.upper(F.col(key_col)) == F.col("dict_key"))
    best = F.max_by(F.struct("term", "expansion", "domain", "aliases"), F.struct(hinted, score, -F.col("ord"))).alias("definition")
    return joined.groupBy(*id_cols, key_col).agg(best).select(*id_cols, key_col, "definition.*")


def expand(queries: DataFrame, spark_terms: DataFrame, id_col: str = "query_id", query_col: str = "query", domain_col: str | None = None) -> DataFrame:
    """(id, expanded_query, expansions): every acronym gets its expansion in brackets, one replacement of the first place for each time it stands."""
    found = queries.select(F.col(id_col), F.col(query_col).alias("query"), *([F.col(domain_col).alias("hint")] if domain_col else []), F.posexplode(F.regexp_extract_all(query_col, F.lit(ACRONYM), F.lit(1))).alias("at", "acronym"))
    hint = ["hint"] if domain_col else []
    named = lookup(found, spark_terms, "acronym", [id_col, "query", "at", *hint], "query", *hint)
    steps = named.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("at", "acronym", "expansion"))).alias("steps"))

    def replace_first(text: Column, step: Column) -> Column:
        at = F.position(step.acronym, text)
        return F.concat(F.substring(text, F.lit(1), at - 1), step.acronym, F.lit(" ("), step.expansion, F.lit(")"), F.substring(text, at + F.length(step.acronym), F.length(text)))

    out = queries.join(steps, id_col, "left")
    none = F.array().cast("array<struct<at:int,acronym:string,expansion:string>>")
    own = F.coalesce(F.col("steps"), none)
    return out.select(id_col, F.aggregate(own, F.col(query_col), replace_first).alias("expanded_query"), F.transform(own, lambda s: F.concat(s.acronym, F.lit(" → "), s.expansion)).alias("expansions"))


def search_terms(queries: DataFrame, spark_terms: DataFrame, id_col: str = "query_id", query_col: str = "query") -> DataFrame:
    """(id, search_terms): the query's lower-cased words and the aliases of those that are terms, sorted."""
    each = queries.select(id_col, F.explode_outer(words(F.col(query_col))).alias("word"))
    named = each.join(spark_terms.select("key", "aliases", "ord"), F.upper("word") == F.col("key"), "left")
    first = named.groupBy(id_col, "word").agg(F.min_by("aliases", "ord").alias("aliases"))
    return first.groupBy(id_col).agg(F.array_sort(F.array_distinct(F.concat(F.collect_list(F.lower("word")), F.transform(F.flatten(F.collect_list("aliases")), F.lower)))).alias("search_terms"))


def enhance(queries: DataFrame, spark_terms: DataFrame, id_col: str = "query_id", query_col: str = "query") -> DataFrame:
    """queries with detected_domain, expanded_query, expansions and search_terms."""
    out = queries.withColumn("detected_domain", detect_domain(F.col(query_col)))
    return out.join(expand(out, spark_terms, id_col, query_col, "detected_domain"), id_col).join(search_terms(queries, spark_terms, id_col, query_col), id_col, "left")
