"""Tables in plain text: detection, parsing, typing and rendering. Detection and parsing stay within a document's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, lines, or_null, strip

#: What hints at a table, and how far a region reaches from the line of a hint.
INDICATORS = (r"\|\s*\w+\s*\|", r"\t{2,}", r"\s{4,}\S+\s{4,}", r"Table\s+\d+", r"(?m)^\s*[-|+]+\s*$")
REACH_UP, REACH_DOWN = 20, 50
LEAST_CONFIDENCE = 0.5
BORDER = r"^[\s\-|+]+$"
#: Cell types by pattern, in the order in which they are tried, and words that are booleans.
CELL_TYPES = (("currency", r"^\$[\d,]+(?:\.\d{2})?$"), ("percentage", r"^[\d,]+(?:\.\d+)?%$"), ("date", r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$"), ("number", r"^[\d,]+(?:\.\d+)?$"))
BOOLEANS = ("yes", "no", "true", "false", "✓", "✗", "x")
#: Header words of the table types, in order, and the descriptions of the types.
HEADER_TYPES = (("financial", ("amount", "revenue", "cost", "price", "total")), ("schedule", ("date", "deadline", "due", "schedule")), ("compliance", ("status", "complete", "approved")))
DESCRIPTIONS = {
    "financial": "financial data table with monetary values",
    "compliance": "compliance or status tracking table",
    "schedule": "schedule or timeline table with dates",
    "reference": "reference table with codes or identifiers",
    "comparison": "comparison table",
    "data": "data table",
}
TITLE = r"(?i)(Table\s+\d+[:.]\s*[^\n]+)"
_MARK = "\ue000"


def is_table_line(line: Column) -> Column:
    tabs = F.length(line) - F.length(F.replace(line, F.lit("\t"), F.lit("")))
    spaced = F.size(F.split(strip(line), r"\s{3,}")) >= 3
    return F.rlike(line, F.lit(r"\S")) & (line.contains("|") | (tabs >= 2) | spaced | F.rlike(line, F.lit(BORDER)))


def count_columns(line: Column) -> Column:
    full = lambda parts: F.size(F.filter(parts, lambda p: F.rlike(p, F.lit(r"\S"))))
    return F.when(line.contains("|"), full(F.split(line, r"\|"))).when(line.contains("\t"), full(F.split(line, "\t"))).otherwise(F.size(F.filter(F.split(strip(line), r"\s{2,}"), lambda p: p != "")))


def cell_type(value: Column) -> Column:
    own = strip(value)
    out = F.when(F.rlike(own, F.lit(CELL_TYPES[0][1])), CELL_TYPES[0][0])
    for name, pattern in CELL_TYPES[1:]:
        out = out.when(F.rlike(own, F.lit(pattern)), name)
    return out.when(F.lower(own).isin(*BOOLEANS), "boolean").otherwise("text")


def region_confidence(body: Column) -> Column:
    """Confidence that a region found by a hint is a table: rows, pipes and figures raise it."""
    n = F.size(lines(strip(body)))
    pipes = F.length(body) - F.length(F.replace(body, F.lit("|"), F.lit("")))
    figures = F.rlike(body, F.lit(r"\$[\d,]+|\d+%|\d{1,2}/\d{1,2}/\d{2,4}"))
    return F.least(F.lit(1.0), 0.5 + F.least(F.lit(0.2), n * 0.02) + F.when(pipes > n, 0.15).otherwise(0.0) + F.when(figures, 0.1).otherwise(0.0))


REGION = "struct<start:bigint,ord:int,end:bigint,first:int,last:int,text:string,confidence:double>"


def regions(text: Column) -> Column:
    """Table regions of a text: array of (start, end, text, confidence, ...), in order, without overlaps.

    Regions around hints and runs of lines with steady columns are taken together, in the order of their starts; of
    overlapping neighbours the one with the higher confidence stays, the earlier one if they are equal. The private
    character U+E000 counts as a space.
    """
    text = F.translate(text, _MARK, " ")

    def of(own: Column) -> Column:
        n = F.size(own)
        kinds = F.transform(own, lambda x: F.when(is_table_line(x), 2).when(F.rlike(x, F.lit(r"\S")), 0).otherwise(1))
        numbers = F.sequence(F.lit(0), n - 1)
        begins = F.transform(own, lambda x: F.length(x) + 1)
        before = lambda i: F.aggregate(F.slice(begins, 1, i), F.lit(0).cast("long"), lambda s, x: s + x)
        hint_lines = F.array_distinct(F.concat(*[F.filter(F.transform(F.split(F.regexp_replace(text, p, _MARK + "$0"), "\n"), lambda x, i: F.when(x.contains(_MARK), i)), lambda i: i.isNotNull()) for p in INDICATORS]))

        def with_kinds(k: Column) -> Column:
            stops = F.filter(numbers, lambda i: k[i] == 0)

            def around(s: Column) -> Column:
                low = F.greatest(F.coalesce(F.array_max(F.filter(stops, lambda j: j < s)), F.lit(-1)), F.greatest(F.lit(0), s - REACH_UP))
                high = F.least(F.coalesce(F.array_min(F.filter(stops, lambda j: j > s)), n), F.least(n, s + REACH_DOWN))
                first = F.coalesce(F.array_min(F.filter(numbers, lambda j: (j > low) & (j < s) & (k[j] == 2))), s)
                last = F.coalesce(F.array_max(F.filter(numbers, lambda j: (j > s) & (j < high) & (k[j] == 2))), s)
                return F.struct(first.alias("first"), last.alias("last"))

            def hinted(r: Column, i: Column) -> Column:
                body = F.array_join(F.slice(own, r["first"] + 1, r["last"] - r["first"] + 1), "\n")
                return F.struct(before(r["first"]).alias("start"), i.alias("ord"), before(r["last"] + 1).alias("end"), r["first"].alias("first"), r["last"].alias("last"), body.alias("text"), region_confidence(body).alias("confidence")).cast(REGION)

            near = F.transform(F.filter(F.transform(hint_lines, around), lambda r: r["last"] - r["first"] >= 2), hinted)
            # A run begins at the first table line behind a stop, and ends before the next stop.
            edges = F.concat(F.array(F.lit(-1)), stops, F.array(n))
            spans = F.transform(F.filter(F.transform(edges, lambda e, i: F.struct(e.alias("a"), F.get(edges, i + 1).alias("b"))), lambda r: r.b - r.a > 3), lambda r: F.struct(F.array_min(F.filter(F.sequence(r.a + 1, r.b - 1), lambda j: k[j] == 2)).alias("first"), (r.b - 1).alias("last")))

            def steady(r: Column, i: Column) -> Column:
                full = F.slice(own, r["first"] + 1, r["last"] - r["first"] + 1)
                counts = F.transform(F.filter(full, lambda x: F.rlike(x, F.lit(r"\S"))), lambda x: count_columns(x).cast("double"))
                mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
                variance = let(counts, lambda c: let(mean(c), lambda m: mean(F.transform(c, lambda x: (x - m) * (x - m)))))
                body = F.array_join(full, "\n")
                row = F.struct(before(r["first"]).alias("start"), (i + 1_000_000).alias("ord"), (before(r["first"]) + F.length(body)).alias("end"), r["first"].alias("first"), r["last"].alias("last"), body.alias("text"), F.least(F.lit(0.9), 0.5 + F.size(counts) * 0.05).alias("confidence")).cast(REGION)
                return F.when((F.size(counts) >= 3) & (variance < 2), row)

            runs = F.filter(F.transform(F.filter(spans, lambda r: r["first"].isNotNull()), steady), lambda r: r.isNotNull())
            none = F.array().cast(f"array<{REGION}>")

            def keep(out: Column, r: Column) -> Column:
                last = F.element_at(out, -1)
                apart = F.when(F.size(out) == 0, F.lit(True)).otherwise(r.start >= last.end)
                return F.when(apart, F.concat(out, F.array(r))).when(r.confidence > last.confidence, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(r))).otherwise(out)

            return F.aggregate(F.array_sort(F.concat(near, runs)), none, keep)

        return let(kinds, with_kinds)

    return F.when(text.isNotNull(), let(lines(text), of))


def delimiter(body: Column) -> Column:
    n = F.size(lines(strip(body)))
    count = lambda c: F.length(body) - F.length(F.replace(body, F.lit(c), F.lit("")))
    return F.when(count("|") > n, "|").when(count("\t") > n, "\t").otherwise("spaces")


ROW = "array<array<string>>"


def parse_rows(body: Column) -> Column:
    """Rows of cells; border lines and blank rows are left out."""
    own = F.filter(lines(strip(body)), lambda x: ~F.rlike(x, F.lit(BORDER)))
    mark = delimiter(body)
    cells = lambda x: F.filter(F.transform(F.when(mark == "|", F.split(x, r"\|")).when(mark == "\t", F.split(x, "\t")).otherwise(F.split(x, r"\s{2,}")), strip), lambda c: c != "")
    return F.filter(F.transform(own, cells), lambda r: F.size(r) > 0)


def table_type(rows: Column) -> Column:
    """By the shares of cell types, else by words of the header."""
    kinds = F.transform(F.flatten(rows), cell_type)
    n = F.size(kinds)
    part = lambda *names: F.size(F.filter(kinds, lambda k: k.isin(*names))) / n
    header = F.transform(F.get(rows, F.lit(0)), F.lower)
    out = F.when(n == 0, "data").when(part("currency", "number") > 0.5, "financial").when(part("boolean") > 0.2, "compliance").when(part("date") > 0.2, "schedule")
    for name, keywords in HEADER_TYPES:
        out = out.when(F.arrays_overlap(header, F.array(*[F.lit(w) for w in keywords])), name)
    return out.otherwise("data")


def structured_text(rows: Column) -> Column:
    """The header, then every row (the header again first), cells in quotes and joined by commas."""
    line = lambda r: F.array_join(F.transform(r, lambda c: F.concat(F.lit('"'), c, F.lit('"'))), ",")
    return F.array_join(F.concat(F.transform(F.slice(rows, 1, 1), line), F.transform(rows, line)), "\n")


def description(rows: Column, kind: Column) -> Column:
    """The table in words: type, columns, number of rows, a sample row of at most four cells."""
    said = F.lit(DESCRIPTIONS["data"])
    for name, words in DESCRIPTIONS.items():
        said = F.when(kind == name, words).otherwise(said)
    header, sample = F.get(rows, F.lit(0)), F.get(rows, F.lit(1))
    pairs = F.slice(F.filter(F.transform(sample, lambda c, i: F.when(i < F.size(header), F.concat(F.get(header, i), F.lit(": "), c))), lambda x: x.isNotNull()), 1, 4)
    parts = F.array(
        F.concat(F.lit("This is a "), said, F.lit(".")), F.when(F.size(header) > 0, F.concat(F.lit("Columns: "), F.array_join(header, ", "), F.lit("."))),
        F.concat(F.lit("Contains "), F.greatest(F.size(rows) - 1, F.lit(0)).cast("string"), F.lit(" data rows.")), F.when(F.size(pairs) > 0, F.concat(F.lit("Sample row: "), F.array_join(pairs, ", "), F.lit("."))),
    )
    return F.array_join(F.array_compact(parts), " ")


def raw_data(rows: Column) -> Column:
    """The rows behind the header as arrays of (key, value, type); columns beyond the header are col_<number>."""
    header = F.get(rows, F.lit(0))
    cell = lambda c, i: F.struct(F.coalesce(F.get(header, i), F.concat(F.lit("col_"), i.cast("string"))).alias("key"), c.alias("value"), cell_type(c).alias("type"))
    return F.transform(F.slice(rows, 2, F.size(rows)), lambda r: F.transform(r, cell))


def extract(docs: DataFrame, least: float = LEAST_CONFIDENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a table: ids, place, rows, headers, type, title, the two renderings and raw data. Tables count from 0 behind the confidence filter."""
    found = F.filter(regions(F.col(text_col)), lambda r: r.confidence >= least)
    each = docs.select(F.col(id_col), F.posexplode(found).alias("table_index", "r"))
    parsed = each.select(id_col, "table_index", "r", parse_rows(F.col("r.text")).alias("rows")).withColumn("table_type", table_type(F.col("rows")))
    table_id = F.concat(F.col(id_col).cast("string"), F.lit("_table_"), F.col("table_index").cast("string"))
    return parsed.select(
        id_col, table_id.alias("table_id"), F.col("table_index").cast("long").alias("table_index"), F.col("r.start").alias("char_start"), F.col("r.end").alias("char_end"), F.col("r.confidence").alias("confidence"),
        F.size("rows").cast("long").alias("num_rows"), F.coalesce(F.array_max(F.transform("rows", F.size)), F.lit(0)).cast("long").alias("num_cols"), F.get("rows", F.lit(0)).alias("headers"), "table_type",
        or_null(F.regexp_extract(F.substring("r.text", 1, 200), TITLE, 1)).alias("title"), "rows", structured_text(F.col("rows")).alias("structured_text"), description(F.col("rows"), F.col("table_type")).alias("semantic_description"), raw_data(F.col("rows")).alias("raw_data"),
    )


def table_chunks(tables: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Two chunks a table: its text for precise queries, its description for conceptual ones."""
    pair = F.array(F.struct(F.lit("structured").alias("kind"), F.col("structured_text").alias("text")), F.struct(F.lit("semantic").alias("kind"), F.col("semantic_description").alias("text")))
    each = tables.select(id_col, "table_id", "table_type", "headers", F.explode(pair).alias("c"))
    return each.select(id_col, F.concat("table_id", F.lit("_"), F.col("c.kind")).alias("chunk_id"), "table_id", F.concat(F.lit("table_"), F.col("c.kind")).alias("type"), "table_type", "headers", "c.text")
