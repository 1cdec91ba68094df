"""Domain metadata by keywords and patterns: contracts, tax, building codes, financial reports, and document types.

Lists keep the order in which values first stand in the text, each value once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_hit, first_max, hits, let, lines, or_null, re2, strip

#: Contract types and their keywords, in the order that breaks ties.
CONTRACT_TYPES = (
    ("service_agreement", ("services agreement", "consulting agreement", "service contract", "professional services", "master services")),
    ("employment", ("employment agreement", "employment contract", "offer letter", "at-will employment", "separation agreement")),
    ("nda", ("non-disclosure", "confidentiality agreement", "nda", "confidential information", "proprietary information")),
    ("lease", ("lease agreement", "rental agreement", "lease contract", "landlord", "tenant", "premises")),
    ("license", ("license agreement", "software license", "intellectual property", "licensor", "licensee", "royalty")),
    ("purchase", ("purchase agreement", "sale agreement", "asset purchase", "stock purchase", "acquisition agreement")),
    ("partnership", ("partnership agreement", "joint venture", "operating agreement", "llc agreement", "shareholder agreement")),
    ("amendment", ("amendment", "addendum", "modification", "supplement to")),
    ("settlement", ("settlement agreement", "release", "mutual release", "dispute resolution")),
)
LEGAL_TERMS = ("indemnification", "liability", "termination", "breach", "force majeure", "governing law", "jurisdiction", "arbitration", "confidentiality", "non-compete", "warranty", "representation", "assignment", "waiver", "notice", "amendment")
#: Patterns of contract fields.
PARTIES = (r"(?i)between\s+([A-Z][A-Za-z\s,\.]+(?:LLC|Inc|Corp|Corporation|Company|Ltd))", r'(?i)"([A-Z][A-Za-z\s]+)"\s*\(', r"(?i)(?:Party|Parties):\s*([A-Z][A-Za-z\s,]+)")
DATE = r"(\w+\s+\d{1,2},?\s+\d{4}|\d{1,2}/\d{1,2}/\d{4})"
EFFECTIVE = r"(?i)effective\s+(?:as\s+of\s+)?" + DATE
EXPIRY = r"(?i)(?:expires?|terminat(?:es?|ion))\s+(?:on\s+)?" + DATE
MONEY = r"\$\s*([\d,]+(?:\.\d{2})?)\s*(?:per\s+(\w+)|(\w+))?"
GOVERNING_LAW = r"(?i)(?:governed by|governing law)[:\s]+(?:the\s+)?(?:laws?\s+of\s+)?(?:the\s+)?(?:State\s+of\s+)?(\w+(?:\s+\w+)?)"
CAPITALS = r"^[A-Z][A-Z\s]+$"
TITLE_WORDS = ("agreement", "contract", "amendment")
#: Tax fields.
TAX_SECTION = r"(?:IRC\s*)?(?:§|Section)\s*(\d+(?:\([a-z]\))?(?:\(\d+\))?)"
TAX_FORM = r"Form\s+(\d+(?:-\w+)?)"
TAX_CATEGORIES = (
    ("income_tax", ("income tax", "taxable income", "gross income", "adjusted gross")),
    ("estate_tax", ("estate tax", "gift tax", "inheritance", "decedent")),
    ("employment_tax", ("payroll tax", "fica", "medicare", "unemployment")),
    ("excise_tax", ("excise tax", "fuel tax", "tobacco", "alcohol")),
    ("corporate_tax", ("corporate tax", "c corporation", "s corporation")),
    ("capital_gains", ("capital gain", "capital loss", "basis", "depreciation")),
    ("deductions", ("deduction", "exemption", "credit", "charitable")),
)
#: Building code fields.
CODE_TYPES = (
    ("ibc", ("international building code", "ibc")),
    ("irc_building", ("international residential code",)),
    ("ifc", ("international fire code", "ifc")),
    ("imc", ("international mechanical code", "imc")),
    ("ipc", ("international plumbing code", "ipc")),
    ("iecc", ("international energy conservation code", "iecc")),
    ("nfpa", ("nfpa", "national fire protection")),
    ("ada", ("ada", "americans with disabilities", "accessibility")),
    ("local", ("municipal code", "city code", "county code")),
)
BUILDING_CATEGORIES = (
    ("structural", ("structural", "foundation", "load-bearing", "seismic")),
    ("fire_safety", ("fire", "sprinkler", "egress", "smoke", "alarm")),
    ("electrical", ("electrical", "wiring", "circuit", "voltage")),
    ("plumbing", ("plumbing", "drainage", "water supply", "fixture")),
    ("mechanical", ("hvac", "ventilation", "heating", "cooling")),
    ("accessibility", ("accessible", "ada", "wheelchair", "ramp")),
    ("energy", ("energy", "insulation", "efficiency", "thermal")),
    ("occupancy", ("occupancy", "egress", "exit", "capacity")),
)
CODE_SECTION = r"(?:Section|§)\s*(\d+(?:\.\d+)*)"
EDITION = r"(?i)(\d{4})\s*(?:edition|version|ibc|irc)"
JURISDICTION = r"(?:City|County|State)\s+of\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)"
#: Financial report fields.
REPORT_TYPES = (
    ("10-k", ("10-k", "annual report", "form 10-k")),
    ("10-q", ("10-q", "quarterly report", "form 10-q")),
    ("8-k", ("8-k", "current report", "form 8-k")),
    ("earnings", ("earnings", "earnings call", "earnings release")),
    ("budget", ("budget", "forecast", "projection")),
    ("audit", ("audit", "audited", "auditor")),
    ("investor", ("investor presentation", "investor deck")),
)
FINANCIAL_METRICS = ("revenue", "net income", "ebitda", "gross margin", "operating income", "cash flow", "assets", "liabilities", "equity", "earnings per share", "return on equity", "debt ratio", "current ratio")
FISCAL_PERIOD = r"(?i)(Q[1-4]\s*\d{4}|FY\s*\d{4}|\d{4}\s*Q[1-4])"
PERIOD_ENDED = r"(?i)(?:year|quarter)\s+ended\s+(\w+\s+\d{1,2},?\s+\d{4})"
COMPANY = (r"(?m)^([A-Z][A-Za-z\s]+(?:Inc|Corp|Corporation|Company|LLC|Ltd))", r"(?m)(?:Form 10-[KQ]|Annual Report).{0,50}([A-Z][A-Za-z\s]+(?:Inc|Corp))")
AMOUNT = r"(?i)(\w+(?:\s+\w+)?)\s*(?:of|was|were|is)?\s*\$\s*([\d,]+(?:\.\d+)?)\s*(million|billion|thousand)?"
#: AMOUNT with the same matches, for Java: begun only where a word or the text behind the last match does, so that no word is tried from each of its characters, and blanks tried once.
AMOUNT_ONCE = re2(rf"(?i)(?:(?<!\w)|\G)(\w+(?:\s++\w+)?)\s*+(?:(?:of|was|were|is)\s*+)?\$\s*+([\d,]+(?:\.\d+)?)\s*(million|billion|thousand)?")
#: One of these stands in whatever COMPANY finds.
COMPANY_ENDS = ("Inc", "Corp", "Company", "LLC", "Ltd")
#: What routes a document to an extractor, by file name and by content; each is tried in this order.
ROUTE_NAMES = (("irc_code", ("irc", "tax", "revenue")), ("building_code", ("ibc", "building", "code")), ("financial_report", ("10k", "10q", "financial", "earnings")))
ROUTE_WORDS = (
    ("contract", ("agreement", "contract", "whereas", "party", "parties")),
    ("irc_code", ("irc", "internal revenue", "tax code", "treasury regulation")),
    ("building_code", ("building code", "ibc", "fire code", "occupancy")),
    ("financial_report", ("10-k", "10-q", "earnings", "revenue", "fiscal year")),
)
#: What gives an ingested file its type.
FILE_NAMES = (
    ("contract", ("contract", "agreement", "terms")),
    ("letter", ("letter", "correspondence")),
    ("invoice", ("invoice", "bill", "receipt")),
    ("boq", ("boq", "bill of quantities", "quantity")),
    ("schedule", ("schedule", "timeline", "gantt")),
)
SHEET_ENDS, CODE_ENDS = (".xlsx", ".xls"), (".py", ".js", ".ts", ".java", ".cpp", ".c")
FILE_WORDS = (("contract", ("hereby agree", "party", "whereas", "contract")), ("letter", ("dear", "sincerely", "regards")))

#: The filters that each extractor's tags offer.
FILTER_SCHEMAS = {
    "contract": {"contract_type": "string", "has_indemnification": "boolean", "has_termination_clause": "boolean", "has_confidentiality": "boolean", "has_non_compete": "boolean", "has_arbitration": "boolean", "governing_law": "string"},
    "irc_code": {"irc_sections": "list", "tax_forms": "list", "tax_categories": "list", "tax_years": "list", "is_regulation": "boolean", "is_guidance": "boolean"},
    "building_code": {"code_type": "string", "sections": "list", "categories": "list", "edition": "string", "is_amendment": "boolean", "jurisdiction": "string"},
    "financial_report": {"report_type": "string", "fiscal_periods": "list", "metrics": "list", "company": "string", "has_forward_looking": "boolean", "has_risk_factors": "boolean"},
}


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(re2(pattern)), F.lit(group))


def _first(text: Column, pattern: str) -> Column:
    """The first group of the first match, null without one."""
    return F.nullif(F.regexp_extract(text, re2(pattern), 1), F.lit(""))


def _parts(match: Column, pattern: str, group: int) -> Column:
    """A group of a whole match; patterns without look-around match their own matches alike."""
    return F.regexp_extract(match, re2(pattern), group)


def _present(lower: Column, names) -> Column:
    return F.array_compact(F.array(*[F.when(lower.contains(n), F.lit(n)) for n in names]))


def _categories(lower: Column, table) -> Column:
    return F.array_compact(F.array(*[F.when(any_hit(lower, keywords), F.lit(name)) for name, keywords in table]))


def _first_type(lower: Column, table, default: str) -> Column:
    out = F.when(any_hit(lower, table[0][1]), table[0][0])
    for name, keywords in table[1:]:
        out = out.when(any_hit(lower, keywords), name)
    return out.otherwise(default)


def _capped(values: Column, most: int) -> Column:
    return F.slice(F.array_distinct(values), 1, most)


def title(text: Column) -> Column:
    """The first of the first 20 lines of 11 to 199 characters that is all capitals or names an agreement."""
    candidates = F.transform(F.slice(lines(text), 1, 20), strip)
    fits = lambda x: (F.length(x) > 10) & (F.length(x) < 200) & (F.rlike(x, F.lit(re2(CAPITALS))) | any_hit(F.lower(x), TITLE_WORDS))
    return F.get(F.filter(candidates, fits), F.lit(0))


def contract(text: Column) -> Column:
    """Contract metadata as a struct."""
    return let(F.lower(text), lambda lower: _contract(text, lower))


def _contract(text: Column, lower: Column) -> Column:
    names, counts = [name for name, _ in CONTRACT_TYPES], F.array(*[hits(lower, keywords) for _, keywords in CONTRACT_TYPES])
    head = F.substring(text, 1, 5000)
    parties = F.filter(F.transform(F.concat(*[_all(head, p) for p in PARTIES]), strip), lambda p: F.length(p) > 3)
    found = F.when(text.contains("$"), F.slice(_all(text, MONEY, 0), 1, 20)).when(text.isNotNull(), F.array().cast("array<string>"))
    money = F.transform(found, lambda m: F.struct(amount_text(m).try_cast("double").alias("amount"), F.coalesce(or_null(_parts(m, MONEY, 2)), or_null(_parts(m, MONEY, 3))).alias("period"), m.alias("raw")))
    return let(
        counts,
        lambda own: F.struct(
            first_max([(name, F.get(own, F.lit(i))) for i, name in enumerate(names)], "other").alias("contract_type"), F.least(F.lit(1.0), F.array_max(own) / 3).alias("confidence"), title(text).alias("title"), _capped(parties, 10).alias("parties"),
            _first(text, EFFECTIVE).alias("effective_date"), _first(text, EXPIRY).alias("expiration_date"), money.alias("monetary_values"), _present(lower, LEGAL_TERMS).alias("legal_terms"),
            or_null(strip(F.regexp_extract(text, re2(GOVERNING_LAW), 1))).alias("governing_law"), lower.contains("indemnification").alias("has_indemnification"), lower.contains("termination").alias("has_termination_clause"),
            lower.contains("confidential").alias("has_confidentiality"), (lower.contains("non-compete") | lower.contains("noncompete")).alias("has_non_compete"), lower.contains("arbitration").alias("has_arbitration"),
        ),
    )


def amount_text(match: Column) -> Column:
    """The amount in a match of MONEY, without commas."""
    return F.regexp_replace(_parts(match, MONEY, 1), ",", "")


def tax(text: Column, as_of_year: int) -> Column:
    """Tax metadata as a struct. Years from 20 before to 4 after as_of_year are looked for."""
    lower = F.lower(text)
    sections, forms, categories = _capped(_all(text, TAX_SECTION), 50), _capped(_all(text, TAX_FORM), 20), _categories(lower, TAX_CATEGORIES)
    years = _present(text, [str(y) for y in range(as_of_year - 20, as_of_year + 5)])
    return F.struct(
        sections.alias("irc_sections"), forms.alias("tax_forms"), categories.alias("tax_categories"), years.alias("tax_years"), F.coalesce(F.get(categories, F.lit(0)), F.lit("general")).alias("document_subtype"),
        F.when(F.size(sections) > 0, 0.8).otherwise(0.5).alias("confidence"), any_hit(lower, ("regulation", "treasury")).alias("is_regulation"), any_hit(lower, ("notice", "revenue ruling", "revenue procedure")).alias("is_guidance"),
    )


def building(text: Column) -> Column:
    """Building code metadata as a struct."""
    lower = F.lower(text)
    kind = _first_type(lower, CODE_TYPES, "unknown")
    return F.struct(
        kind.alias("code_type"), F.when(kind != "unknown", 0.8).otherwise(0.4).alias("confidence"), _capped(_all(text, CODE_SECTION), 50).alias("sections"), _categories(lower, BUILDING_CATEGORIES).alias("categories"),
        _first(text, EDITION).alias("edition"), any_hit(lower, ("amendment", "revision")).alias("is_amendment"), _first(text, JURISDICTION).alias("jurisdiction"),
    )


def fiscal_periods(text: Column) -> Column:
    return F.array_distinct(F.concat(_all(text, FISCAL_PERIOD), _all(text, PERIOD_ENDED)))


def financial(text: Column) -> Column:
    """Financial report metadata as a struct."""
    return let(F.lower(text), lambda lower: _financial(text, lower))


def _financial(text: Column, lower: Column) -> Column:
    found = F.when(text.contains("$"), F.slice(F.regexp_extract_all(text, F.lit(AMOUNT_ONCE), F.lit(0)), 1, 10)).when(text.isNotNull(), F.array().cast("array<string>"))
    amounts = F.transform(found, lambda m: F.struct(_parts(m, AMOUNT, 1).alias("context"), _parts(m, AMOUNT, 2).alias("amount"), F.coalesce(or_null(_parts(m, AMOUNT, 3)), F.lit("dollars")).alias("unit")))
    company = lambda head: F.when(any_hit(head, COMPANY_ENDS), strip(F.coalesce(*[_first(head, p) for p in COMPANY])))
    return let(
        _first_type(lower, REPORT_TYPES, "unknown"),
        lambda kind: F.struct(
            kind.alias("report_type"), F.when(kind != "unknown", 0.8).otherwise(0.5).alias("confidence"), fiscal_periods(text).alias("fiscal_periods"), _present(lower, FINANCIAL_METRICS).alias("metrics"),
            let(F.substring(text, 1, 3000), company).alias("company"), amounts.alias("key_amounts"), any_hit(lower, ("forward-looking", "guidance")).alias("has_forward_looking"),
            lower.contains("risk factor").alias("has_risk_factors"),
        ),
    )


def route(text: Column, filename: Column | None = None, hint: Column | None = None) -> Column:
    """The extractor of a document: the hint if it is one, else by file name, else by two content words at least, else contract."""
    lower = F.lower(text)
    scores = [(name, hits(lower, keywords)) for name, keywords in ROUTE_WORDS]
    out = F.when(F.greatest(*[s for _, s in scores]) >= 2, first_max(scores, "contract")).otherwise("contract")
    if filename is not None:
        by_name = F.lower(filename)
        for name, keywords in reversed(ROUTE_NAMES):
            out = F.when(F.coalesce(any_hit(by_name, keywords), F.lit(False)), F.lit(name)).otherwise(out)
    if hint is not None:
        out = F.when(hint.isin([name for name, _ in ROUTE_WORDS]), hint).otherwise(out)
    return out


def file_type(filename: Column, text: Column) -> Column:
    """The type of an ingested file, by its name, else by its first content."""
    name, lower = F.lower(filename), F.lower(text)
    ends = lambda suffixes: F.rlike(name, F.lit("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    out = F.when(any_hit(name, FILE_NAMES[0][1]), FILE_NAMES[0][0])
    for kind, keywords in FILE_NAMES[1:]:
        out = out.when(any_hit(name, keywords), kind)
    out = out.when(ends(SHEET_ENDS), "spreadsheet").when(ends(CODE_ENDS), "code")
    for kind, keywords in FILE_WORDS:
        out = out.when(any_hit(lower, keywords), kind)
    return out.otherwise("document")
