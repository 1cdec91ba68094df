"""Sections of documents: headings by line patterns, their spans and levels. All within a row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metadata import CAPITALS, FISCAL_PERIOD
from ..functions.text import any_hit, hits, let, lines, strip

#: Heading patterns by family.
LEGAL = (
    r"^(Article|ARTICLE)\s+([\dIVXLC]+)[:\.]?\s*(.*)",
    r"^(Section|SECTION)\s+(\d+(?:\.\d+)*)[:\.]?\s*(.*)",
    r"^(Clause|CLAUSE)\s+(\d+(?:\.\d+)*)[:\.]?\s*(.*)",
    r"^(\d+(?:\.\d+)*)\s+([A-Z][^.]+)",
    r"^\(([a-z])\)\s+(.+)",
    r"^(WHEREAS|RECITALS?|DEFINITIONS?|PREAMBLE)[:\s]*",
    r"^(Exhibit|EXHIBIT|Schedule|SCHEDULE|Annexure|ANNEXURE)\s+([A-Z0-9]+)",
)
TECHNICAL = (
    r"^(Chapter|CHAPTER)\s+(\d+)[:\.]?\s*(.*)",
    r"^(\d+(?:\.\d+)*)\s+(SCOPE|DESIGN|SPECIFICATIONS?|REQUIREMENTS?)",
    r"^(Part|PART)\s+([A-Z0-9]+)[:\.]?\s*(.*)",
    r"^(Drawing|DRAWING)\s+No\.?\s*(\S+)",
)
CODE = (r"^§\s*(\d+(?:\.\d+)*)\s+(.*)", r"^(\d+)\s+CFR\s+(\d+(?:\.\d+)*)", r"^IRC\s+(\d+(?:\.\d+)*)", r"^IBC\s+(\d+(?:\.\d+)*)", r"^IS\s+(\d+)[:\s]", r"^NBC\s+(\d+(?:\.\d+)*)")
FINANCIAL = (
    r"^(Executive Summary|Management Discussion)",
    r"^(Balance Sheet|Income Statement|Cash Flow)",
    r"^(Notes to Financial Statements)",
    r"^(Q[1-4]\s+\d{4}|FY\s*\d{4})",
    r"^(Bill of Quantities|BOQ|Schedule of Rates)",
    r"^(Item|Sl\.?\s*No\.?)\s+(\d+)",
)
#: The families of each document type; all others use the legal and technical ones.
FAMILIES = {
    **dict.fromkeys(("contract", "agreement", "tender", "amendment"), LEGAL), **dict.fromkeys(("dpr", "specification", "standard", "manual"), TECHNICAL),
    **dict.fromkeys(("irc_code", "building_code"), CODE), **dict.fromkeys(("financial_report", "boq", "estimate"), FINANCIAL),
}
#: Case-sensitive patterns of the stricter legal detector, those of codes, those of the legal chunker and of the financial detector.
STRICT_LEGAL = (
    r"^(Article|Section|ARTICLE|SECTION)\s+(\d+(?:\.\d+)*)[:\.]?\s*(.*)$",
    r"^(I{1,3}|IV|VI{0,3}|IX|X{1,3})\.\s+(.+)$",
    r"^(\d+(?:\.\d+)*)\s+([A-Z][^.]+)$",
    r"^\(([a-z])\)\s+(.+)$",
    r'^"([^"]+)"\s+means\s+',
    r"^WHEREAS[,:]?\s+",
    r"^RECITALS?:?\s*$",
    r"^§\s*(\d+(?:\.\d+)*)\s+(.+)$",
    r"^(\d+)\s+CFR\s+(\d+(?:\.\d+)*)",
    r"^IRC\s+(\d+(?:\.\d+)*)",
    r"^IBC\s+(\d+(?:\.\d+)*)",
)
LEGAL_CHUNKER = (
    r"^(Article|ARTICLE)\s+(\d+|[IVXLC]+)[:\.]?\s*(.*)",
    r"^(Section|SECTION)\s+(\d+(?:\.\d+)*)[:\.]?\s*(.*)",
    r"^(\d+(?:\.\d+)*)\s+([A-Z][^.]+)",
    r"^(WHEREAS|RECITALS?|DEFINITIONS?)[:\s]*",
    r"^(Exhibit|EXHIBIT|Schedule|SCHEDULE)\s+([A-Z0-9]+)",
)
FINANCIAL_HEADINGS = (
    r"^(Executive Summary|Management Discussion)",
    r"^(Financial Highlights|Key Metrics)",
    r"^(Balance Sheet|Income Statement|Cash Flow)",
    r"^(Notes to Financial Statements)",
    r"^(Q[1-4]\s+\d{4}|FY\s*\d{4})",
    r"^(Revenue|Expenses|Assets|Liabilities)",
    r"^(Appendix|Exhibit)\s+[A-Z0-9]+",
)
CODE_SIGNS = ("irc", "ibc", "cfr", "§", "code", "regulation")
SUBTYPES = (("irc_code", ("irc", "internal revenue")), ("building_code", ("ibc", "building code")), ("federal_regulation", ("cfr", "federal regulation")), ("contract", ("agreement", "contract")), ("legal_agreement", ("whereas",)))
REPORT_TITLES = ("annual report", "quarterly report", "financial statement", "earnings", "budget", "forecast")
TABLE_TERMS = ("$", "revenue", "total", "subtotal", "balance")


def patterns_for(document_type: str) -> tuple[str, ...]:
    return FAMILIES.get(document_type, LEGAL + TECHNICAL)


def _groups(pattern: str) -> int:
    import re

    return re.compile(pattern).groups


def level_of(header: Column) -> Column:
    """3 for two dots or (a), 2 for one dot, 1 for an article, chapter or part, else 2."""
    dots = F.length(header) - F.length(F.replace(header, F.lit("."), F.lit("")))
    return F.when(dots >= 2, 3).when(dots == 1, 2).when(F.rlike(header, F.lit(r"^\([a-z]\)")), 3).when(F.rlike(header, F.lit(r"(?i)^(Article|Chapter|Part)")), 1).otherwise(2)


def strict_level_of(header: Column) -> Column:
    dots = F.length(header) - F.length(F.replace(header, F.lit("."), F.lit("")))
    return F.when(dots >= 2, 3).when(dots == 1, 2).otherwise(1)


def headings(text: Column, patterns: tuple[str, ...], any_case: bool = True, level=level_of) -> Column:
    """Sections of a text as an array, in order: a line is a heading if a pattern matches it, the first pattern that does gives title and number."""
    flag = "(?i)" if any_case else ""

    def of(own: Column) -> Column:
        clean = F.transform(own, strip)
        rows = F.filter(F.transform(clean, lambda x, i: F.struct(i.alias("i"), x.alias("x"), _which(x, patterns, flag).alias("p"))), lambda r: r.p.isNotNull())
        sizes = F.transform(own, lambda x: F.length(x) + 1)

        def section(r: Column) -> Column:
            found, number = F.lit(None).cast("string"), F.lit(None).cast("string")
            for k, p in enumerate(patterns):
                found = F.when(r.p == k, F.regexp_extract(r.x, flag + p, 0)).otherwise(found)
                if _groups(p):
                    number = F.when(r.p == k, F.regexp_extract(r.x, flag + p, min(2, _groups(p)))).otherwise(number)
            start = F.aggregate(F.slice(sizes, 1, r.i), F.lit(0).cast("long"), lambda s, x: s + x)
            return F.struct(start.alias("start"), found.alias("title"), number.alias("number"), r.i.alias("line_number"))

        heads = F.transform(rows, section)
        return let(heads, lambda h: F.transform(h, lambda s, i: F.struct(
            s.start.alias("start"), F.coalesce(F.get(h, i + 1).start, F.length(text).cast("long")).alias("end"), s.title.alias("title"), s.number.alias("number"), level(s.title).alias("level"), s.line_number.alias("line_number"))))

    return F.when(text.isNotNull(), let(lines(text), of))


def _which(line: Column, patterns: tuple[str, ...], flag: str) -> Column:
    return F.when(line != "", F.coalesce(*[F.when(F.rlike(line, F.lit(flag + p)), F.lit(k)) for k, p in enumerate(patterns)]))


def sections(docs: DataFrame, document_type: str = "general", id_col: str = "doc_id", text_col: str = "text", patterns: tuple[str, ...] | None = None, any_case: bool = True, level=level_of) -> DataFrame:
    """One row a section: id, start, end (characters of the text), title, number, level, line_number. Null texts have none."""
    found = headings(F.col(text_col), patterns or patterns_for(document_type), any_case, level)
    return docs.select(F.col(id_col), F.explode(found).alias("s")).select(id_col, "s.*")


def legal_title(text: Column) -> Column:
    """The first of the first ten lines that is all capitals or begins with a kind of agreement."""
    own = F.transform(F.slice(lines(text), 1, 10), strip)
    return F.get(F.filter(own, lambda x: F.rlike(x, F.lit(CAPITALS)) | F.rlike(x, F.lit(r"(?i)^(Agreement|Contract|Amendment|Exhibit)"))), F.lit(0))


def financial_title(text: Column) -> Column:
    """The first of the first 15 lines that names a kind of report."""
    own = F.transform(F.slice(lines(text), 1, 15), strip)
    return F.get(F.filter(own, lambda x: any_hit(F.lower(x), REPORT_TITLES)), F.lit(0))


def is_code(text: Column) -> Column:
    return hits(F.lower(text), CODE_SIGNS) >= 2


def legal_subtype(text: Column) -> Column:
    lower = F.lower(text)
    out = F.when(any_hit(lower, SUBTYPES[0][1]), SUBTYPES[0][0])
    for name, keywords in SUBTYPES[1:]:
        out = out.when(any_hit(lower, keywords), name)
    return out.otherwise("general_legal")


def has_financial_tables(text: Column) -> Column:
    return hits(F.lower(text), TABLE_TERMS) >= 3


def fiscal_periods(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(FISCAL_PERIOD), F.lit(1)))


def structure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Title, subtype and signs of each document by the legal and financial detectors."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(id_col, legal_title(text).alias("legal_title"), legal_subtype(text).alias("legal_subtype"), is_code(text).alias("is_code"), financial_title(text).alias("financial_title"), fiscal_periods(text).alias("fiscal_periods"), has_financial_tables(text).alias("has_tables"))
