"""What a search query asks for: modality and weights, class, precision reference, complexity, target elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_hit, hits, let, or_null, word_count

#: Patterns that name a visual element, the element, and the parser's type for it.
VISUAL_ELEMENTS = (
    (r"\b(table|tables)\b", "table", "Table"),
    (r"\b(figure|figures|fig\.?)\b", "figure", "Image"),
    (r"\b(chart|charts)\b", "chart", "Image"),
    (r"\b(diagram|diagrams)\b", "diagram", "Image"),
    (r"\b(image|images|picture|pictures|photo|photos)\b", "image", "Image"),
    (r"\b(graph|graphs)\b", "graph", "Image"),
    (r"\b(formula|formulas|equation|equations)\b", "formula", "Formula"),
)
#: Patterns of the wish to see something.
VISUAL_INTENTS = (
    r"what\s+does\s+the\s+(table|figure|chart|diagram)\s+show",
    r"according\s+to\s+the\s+(table|figure|chart)",
    r"in\s+the\s+(table|figure|chart|diagram)",
    r"from\s+the\s+(table|figure|chart)",
    r"(show|display|visualize|illustrate)",
    r"(look\s+at|see|view)\s+the\s+(table|figure|chart)",
    r"(data|values|numbers)\s+in\s+the\s+table",
    r"table\s+(shows?|displays?|contains?|lists?)",
    r"figure\s+(shows?|displays?|illustrates?)",
)
#: Weights of keyword, dense and page search by modality.
WEIGHTS = {"text": (0.35, 0.55, 0.10), "visual": (0.15, 0.25, 0.60), "mixed": (0.25, 0.35, 0.40)}
VISUAL_AT, MIXED_AT = 0.5, 0.3
#: Words of the query classes, in the order in which they are tried.
CLASSES = (
    ("comparative", ("compare", "difference", "vs", "versus", "between")),
    ("temporal", ("when", "date", "before", "after", "during")),
    ("reference", ("table", "figure", "section", "article", "exhibit")),
    ("precise", ("exact", "specific", "precise", "what is the")),
)
#: Patterns of precise references, in the order in which they are tried, and whether they capture one.
PRECISION = (
    (r"(?:in\s+)?table\s+(\d+|[A-Z])", "table_reference", True),
    (r"(?:in\s+)?figure\s+(\d+|[A-Z])", "figure_reference", True),
    (r"(?:in\s+)?exhibit\s+([A-Z]|\d+)", "exhibit_reference", True),
    (r"(?:in\s+)?section\s+(\d+(?:\.\d+)*)", "section_reference", True),
    (r"(?:in\s+)?article\s+(\d+|[IVXLC]+)", "article_reference", True),
    (r"(?:in\s+)?clause\s+(\d+(?:\.\d+)*)", "clause_reference", True),
    (r"(?:exact|specific|precise)\s+(?:amount|value|number|date)", "exact_value", False),
    (r"what\s+(?:is|was|are|were)\s+the\s+(?:exact|specific)", "exact_value", False),
    (r"(?:on\s+)?line\s+(\d+)", "line_reference", True),
    (r"(?:in\s+)?paragraph\s+(\d+)", "paragraph_reference", True),
)
#: Words that ask for detail, and words that ask for breadth.
PRECISION_WORDS = ("exact", "specific", "precisely", "exactly", "table", "figure", "section", "article", "clause", "number", "amount", "value", "date", "deadline", "line", "paragraph", "sentence", "what is the", "what was the")
BROAD_WORDS = ("overview", "summary", "about", "describe", "explain", "what does", "how does", "why does", "generally", "overall", "main", "key points")


def _count(query: Column, patterns) -> Column:
    found = [F.rlike(query, F.lit(p)).cast("int") for p in patterns]
    return sum(found[1:], found[0])


def visual_score(query: Column) -> Column:
    lower = F.lower(query)
    return F.least(F.lit(1.0), 0.3 * _count(lower, [p for p, _, _ in VISUAL_ELEMENTS]) + 0.25 * _count(lower, VISUAL_INTENTS))


def modality(query: Column) -> Column:
    s = visual_score(query)
    return F.when(s >= VISUAL_AT, "visual").when(s >= MIXED_AT, "mixed").otherwise("text")


def target_elements(query: Column) -> Column:
    """The visual elements that the query names, in their fixed order."""
    lower = F.lower(query)
    return F.array_compact(F.array(*[F.when(F.rlike(lower, F.lit(p)), F.lit(name)) for p, name, _ in VISUAL_ELEMENTS]))


def target_element_types(query: Column) -> Column:
    """The parser's types of those elements, each once; null if there are none."""
    lower = F.lower(query)
    found = F.array_distinct(F.array_compact(F.array(*[F.when(F.rlike(lower, F.lit(p)), F.lit(kind)) for p, _, kind in VISUAL_ELEMENTS])))
    return F.when(F.size(found) > 0, found)


def weights(query: Column) -> Column:
    """Struct of the weights bm25, dense and colpali; named elements raise the last one, then all are scaled to 1."""

    def of(base: Column) -> Column:
        n = F.size(target_elements(query))
        page = F.when(n > 0, F.least(base[2] + F.least(0.1 * n, F.lit(0.15)), F.lit(0.7))).otherwise(base[2])
        total = F.when(n > 0, base[0] + base[1] + page).otherwise(F.lit(1.0))
        return F.struct((base[0] / total).alias("bm25"), (base[1] / total).alias("dense"), (page / total).alias("colpali"))

    kind = modality(query)
    row = {k: F.array(*[F.lit(x) for x in v]) for k, v in WEIGHTS.items()}
    return let(F.when(kind == "visual", row["visual"]).when(kind == "mixed", row["mixed"]).otherwise(row["text"]), of)


def query_class(query: Column) -> Column:
    lower = F.lower(query)
    out = F.when(any_hit(lower, CLASSES[0][1]), CLASSES[0][0])
    for name, keywords in CLASSES[1:]:
        out = out.when(any_hit(lower, keywords), name)
    return out.otherwise("broad")


def precision(query: Column) -> Column:
    """Struct of is_precision, pattern_type and reference; the first pattern that matches gives them."""
    kind, reference = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, name, captures in reversed(PRECISION):
        found = F.rlike(query, F.lit(f"(?i){pattern}"))
        kind = F.when(found, F.lit(name)).otherwise(kind)
        reference = F.when(found, F.regexp_extract(query, f"(?i){pattern}", 1) if captures else F.lit(None).cast("string")).otherwise(reference)
    return F.struct(kind.isNotNull().alias("is_precision"), kind.alias("pattern_type"), or_null(reference).alias("reference"))


def complexity(query: Column) -> Column:
    """Struct of the chunk level that suits the query, and the confidence."""
    lower = F.lower(query)
    detail, breadth = hits(lower, PRECISION_WORDS), hits(lower, BROAD_WORDS)
    level = F.when(detail > breadth, "sentence").when((breadth > detail) & (breadth >= 2), "section").otherwise("paragraph")
    confidence = F.when(F.greatest(detail, breadth) == F.least(detail, breadth), 0.5).when(F.greatest(detail, breadth) >= 2, 0.9).otherwise(0.7)
    return F.struct(level.alias("level"), confidence.alias("confidence"), word_count(query).alias("words"))
