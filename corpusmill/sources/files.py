"""Files as documents: folders of text, HTML and other files, HTML to elements and text, visual elements, embedders as plug-ins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import document_id
from ..functions.metadata import file_type
from ..functions.text import strip

#: Extensions that a folder scan takes.
EXTENSIONS = (".pdf", ".docx", ".doc", ".txt", ".md", ".html", ".pptx", ".xlsx")
TEXT_EXTENSIONS = (".txt", ".md", ".html", ".htm")
ERROR = "Error"
#: Fixed value: the longer side of a page image at most.
IMAGE_SIDE = 1024
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def scan(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS, any_case: bool = False) -> DataFrame:
    """(document_id, filename, extension, size, content) of every file below path with one of the extensions."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    wanted = (F.lower(extension) if any_case else extension).isin(*extensions)
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    return files.where(wanted).select(document_id(stem, F.col("content")).alias("document_id"), name.alias("filename"), extension.alias("extension"), F.col("length").alias("size"), "content")


def texts(files: DataFrame) -> DataFrame:
    """files with text, for the formats that hold text as it is or in HTML; document_type by name and content. Other formats need a parser: see parsed()."""
    raw = F.decode("content", "utf-8")
    body = F.when(F.lower("extension").isin(".html", ".htm"), html_text(raw)).otherwise(raw)
    own = files.where(F.lower("extension").isin(*TEXT_EXTENSIONS)).withColumn("text", body)
    return own.withColumn("document_type", file_type(F.col("filename"), F.substring("text", 1, 5000)))


def parsed(files: DataFrame, parser: Callable[[bytes, str], list[tuple[str, int, str]]] | None = None) -> DataFrame:
    """(document_id, element_index, element_type, page_number, text) by a parser: parser(content, filename) -> [(type, page, text)]; without one by `parsers.parse`.

    The parser runs on the executors, over batches; optional libraries are its own. A file that it fails on gives one row
    of type "Error" with index -1 and what went wrong as text, and the other files go on.
    """
    from .parsers import parse

    own = parser or parse

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for key, name, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    rows = [(key, i, *element) for i, element in enumerate(own(content, name))]
                except Exception as error:  # whatever a broken file leads to; it is in the row
                    rows = [(key, -1, ERROR, None, f"{type(error).__name__}: {error}")]
                for row in rows:
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["document_id", "element_index", "element_type", "page_number", "text"])

    return files.select("document_id", "filename", "content").mapInArrow(run, "document_id string, element_index long, element_type string, page_number long, text string")


def joined_texts(files: DataFrame, elements: DataFrame) -> DataFrame:
    """(document_id, filename, text, error) of every file: its elements joined by blank lines, or why it has none."""
    row = F.struct("element_index", "text")
    good = F.transform(F.array_sort(F.collect_list(F.when(F.col("element_type") != ERROR, row))), lambda e: e.text)
    by_file = elements.groupBy(F.col("document_id").alias("of")).agg(F.array_join(good, "\n\n").alias("text"), F.max(F.when(F.col("element_type") == ERROR, F.col("text"))).alias("error"))
    return files.select("document_id", "filename").join(by_file, F.col("document_id") == F.col("of"), "left").select("document_id", "filename", F.when(F.col("error").isNull(), F.coalesce("text", F.lit(""))).alias("text"), "error")


def page_boundaries(elements: DataFrame) -> DataFrame:
    """(document_id, position, page_number): where each element begins in the joined text, for the page of a chunk."""
    order = Window.partitionBy("document_id").orderBy("element_index")
    before = F.coalesce(F.sum(F.length("text") + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return elements.where(F.col("element_type") != ERROR).select("document_id", before.cast("long").alias("position"), "page_number")


def fitted(width: Column, height: Column, most: int = IMAGE_SIDE) -> Column:
    """Width and height of a page image scaled down, never up, until its longer side is at most `most`."""
    share = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    side = lambda x: F.greatest(F.lit(1), F.round(x * share).cast("int"))
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def page_images(files: DataFrame, renderer: Callable[[bytes, str], list[tuple[int, int, int, bytes]]]) -> DataFrame:
    """(document_id, page_number, width, height, image, target) by a renderer: renderer(content, filename) -> [(page, width, height, image bytes)].

    Rendering needs a library of the caller's; target is the size that the visual embedder takes. Files that the
    renderer fails on have no pages.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for key, name, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    rows = [(key, *page) for page in renderer(content, name)]
                except Exception:  # as documented: no pages
                    rows = []
                for row in rows:
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["document_id", "page_number", "width", "height", "image"])

    pages = files.select("document_id", "filename", "content").mapInArrow(run, "document_id string, page_number long, width long, height long, image binary")
    return pages.withColumn("target", fitted(F.col("width"), F.col("height")))


def html_text(html: Column) -> Column:
    """Text of HTML: comments, scripts and styles go, blocks end lines, other tags go, the common entities are decoded."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?is)<(script|style)\b.*?</(script|style)>", "")
    out = F.regexp_replace(out, r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|title|header|footer)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return strip(F.regexp_replace(out, r" ?\n[ \n]*", "\n"))


def html_elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, element_index, text): the lines of the text of each page."""
    return pages.select(F.col(id_col), F.posexplode(F.filter(F.split(html_text(F.col(html_col)), "\n"), lambda x: x != "")).alias("element_index", "text"))


def bounding_box(points: Column) -> Column:
    """The box around an array of (x, y) arrays."""
    axis = lambda i: F.transform(points, lambda p: p[i])
    return F.struct(F.array_min(axis(0)).alias("x1"), F.array_min(axis(1)).alias("y1"), F.array_max(axis(0)).alias("x2"), F.array_max(axis(1)).alias("y2"))


def visual_elements(elements: DataFrame, kinds: tuple[str, ...] = ("Image", "Table")) -> DataFrame:
    """elements(document_id, element_type, page_number, points, image_base64) of these kinds, with box, bytes and number on their document."""
    return elements.where(F.col("element_type").isin(*kinds)).select("document_id", "element_type", "page_number", bounding_box(F.col("points")).alias("bbox"), F.unbase64("image_base64").alias("image"))


def embedded(frame: DataFrame, embedder: Callable, text_col: str = "text", out_col: str = "vec", is_query: bool = False) -> DataFrame:
    """frame with vectors of a model: embedder() -> function of a list of texts to a list of vectors; made once for each worker, run over batches."""
    import pandas as pd

    def run(batches):
        model = embedder()
        for texts_ in batches:
            yield pd.Series([list(map(float, v)) for v in model([(QUERY_PREFIX + t if is_query else t) for t in texts_.fillna("")])])

    from collections.abc import Iterator

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return frame.withColumn(out_col, F.pandas_udf(run, "array<double>")(text_col))


def hashing_embedder(dim: int = 64) -> Callable:
    """A deterministic embedder without a model: words hashed to signed positions, scaled to length 1."""

    def make():
        import hashlib

        import numpy as np

        def embed(batch: list[str]) -> list:
            out = []
            for text in batch:
                v = np.zeros(dim)
                for w in text.lower().split():
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                    v[h % dim] += 1 if h >> 63 else -1
                n = np.linalg.norm(v)
                out.append(v / n if n else v)
            return out

        return embed

    return make
