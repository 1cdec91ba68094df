"""Chunking: fixed word windows, greedy packing of paragraphs, sentences, sections with paragraphs inside, hierarchies.

Every document is chunked within its row; nothing is shuffled. Chunks of a document come in order with their index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, strip, word_count, words
from .structure import headings, patterns_for

#: Sizes in words (packing, library chunkers), characters (legacy packing) and their least sizes.
WORDS, OVERLAP, LEAST_WORDS = 512, 128, 50
LEGACY_CHARS, LEGACY_OVERLAP_WORDS = 400, 50
SIMPLE_WORDS, SIMPLE_OVERLAP = 400, 50
LEAST_SECTION, LEAST_SENTENCE, DOCUMENT_CHARS, SECTION_CHARS = 50, 20, 2000, 2000
PARAGRAPH_BREAK = r"\n\s*\n"
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z])|(?<=\n)\s*(?=[A-Z0-9])"
#: The strategy of each quality tier.
STRATEGIES = {"high": "sdpm", "medium": "semantic", "low": "sentence", "garbage": "token"}

PACKED = "array<struct<text:string,start:bigint>>"


def strategy(tier: Column) -> Column:
    """The chunking strategy of a quality tier; unknown tiers count as medium."""
    out = F.lit(STRATEGIES["medium"])
    for name, s in STRATEGIES.items():
        out = F.when(F.lower(tier) == name, s).otherwise(out)
    return out


def paragraphs(text: Column, pattern: str = PARAGRAPH_BREAK) -> Column:
    """Stripped paragraphs that aren't blank."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), pattern), strip), lambda p: p != "")


def packed(parts: Column, most: int = WORDS, joiner: str = "\n\n", offset: Column | int = 0) -> Column:
    """Paragraphs packed while a chunk stays within `most` words: array of (text, start).

    A paragraph over the limit is a chunk of its own. Starts assume that paragraphs are joined by the joiner. The fold
    keeps the numbers of the first and last paragraph of each chunk; texts are joined once at the end.
    """

    def of(own: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("first"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))

        def fold(counts: Column) -> Column:
            def step(s: Column, i: Column) -> Column:
                full = (s.n + counts[i] > most) & (i > s.first)
                return F.struct(F.when(full, counts[i]).otherwise(s.n + counts[i]).alias("n"), F.when(full, i).otherwise(s.first).alias("first"), F.when(full, F.concat(s.out, F.array(F.struct(s.first.alias("a"), i.alias("b"))))).otherwise(s.out).alias("out"))

            return F.aggregate(F.sequence(F.lit(0), F.size(own) - 1), zero, step, lambda s: F.concat(s.out, F.array(F.struct(s.first.alias("a"), F.size(own).alias("b")))))

        folded = let(F.transform(own, lambda p: F.size(words(p))), fold)  # counted once, not at every step
        texts = F.transform(folded, lambda r: F.array_join(F.slice(own, r.a + 1, r.b - r.a), joiner))
        gap = len(joiner)
        begin = F.lit(offset) if isinstance(offset, int) else offset
        placed = let(texts, lambda t: F.transform(t, lambda x, i: F.struct(x.alias("text"), (begin + F.aggregate(F.slice(t, 1, i), F.lit(0).cast("long"), lambda s, y: s + F.length(y) + gap)).cast("long").alias("start"))))
        return F.when(F.size(own) > 0, placed).otherwise(F.array().cast(PACKED))

    return let(parts, of)


def packed_by_chars(parts: Column, most: int = LEGACY_CHARS, overlap: int = LEGACY_OVERLAP_WORDS) -> Column:
    """Paragraphs packed within `most` characters, each chunk after the first beginning with the last words of the one before."""
    zero = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        full = (F.length(s.cur) + F.length(p) > most) & (s.cur != "")
        own = words(s.cur)
        last = F.slice(own, F.greatest(F.size(own) - overlap, F.lit(0)) + 1, overlap)
        again = F.concat(F.array_join(last, " "), F.lit(" "), p) if overlap else p
        return F.struct(F.when(full, again).when(s.cur == "", p).otherwise(F.concat(s.cur, F.lit("\n\n"), p)).alias("cur"), F.when(full, F.concat(s.out, F.array(s.cur))).otherwise(s.out).alias("out"))

    return F.aggregate(parts, zero, step, lambda s: F.when(s.cur == "", s.out).otherwise(F.concat(s.out, F.array(s.cur))))


def word_windows(docs: DataFrame, size: int = 400, overlap: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, start_word, n_words, text): windows of `size` words every size - overlap words, while they begin inside the text."""
    step = size - overlap

    def of(own: Column) -> Column:
        starts = F.when(F.size(own) > 0, F.sequence(F.lit(0), F.size(own) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("start_word"), F.slice(own, i + 1, size).alias("w")))

    each = docs.select(id_col, F.posexplode(let(words(F.col(text_col)), of)).alias("chunk_index", "c"))
    return each.select(id_col, F.col("chunk_index").cast("long").alias("chunk_index"), F.col("c.start_word").cast("long").alias("start_word"), F.size("c.w").cast("long").alias("n_words"), F.array_join("c.w", " ").alias("text"))


def token_chunks(docs: DataFrame, size: int = WORDS, overlap: int = OVERLAP, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The token strategy over white-space tokens: word windows without those under `least` words."""
    return word_windows(docs, size, overlap, id_col, text_col).where(F.col("n_words") >= least)


def sentences(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_BREAK), strip)


def sentence_chunks(docs: DataFrame, least: int = LEAST_SENTENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sentence_index, text, n_words): sentences of `least` characters or more, under their number among all."""
    each = docs.select(id_col, F.posexplode(sentences(F.col(text_col))).alias("sentence_index", "text")).where(F.length("text") >= least)
    return each.select(id_col, F.col("sentence_index").cast("long").alias("sentence_index"), "text", word_count(F.col("text")).alias("n_words"))


def sentence_packed(docs: DataFrame, size: int = WORDS, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sentence strategy over white-space tokens: whole sentences packed into chunks of at most `size` words."""
    parts = F.filter(sentences(F.col(text_col)), lambda s: s != "")
    each = docs.select(id_col, F.posexplode(packed(parts, size, " ")).alias("chunk_index", "c"))
    return each.select(id_col, F.col("chunk_index").cast("long").alias("chunk_index"), F.col("c.text").alias("text"), word_count(F.col("c.text")).alias("n_words")).where(F.col("n_words") >= least)


def semantic_chunks(pieces: DataFrame, threshold: float = 0.5, size: int = WORDS, skip: int = 0, id_col: str = "doc_id") -> DataFrame:
    """The semantic strategy over supplied vectors: pieces(id, piece_index, text, vec) of a document are joined while neighbours' cosine reaches the threshold.

    skip: also join over up to that many pieces that don't fit, if the piece behind them does. Chunks hold whole
    pieces and at most `size` words unless one piece is longer. Result: (id, chunk_index, text, n_words).
    """
    from .vectors import as_double, dot, norm

    order = Window.partitionBy(id_col).orderBy("piece_index")
    own = pieces.withColumn("v", as_double(F.col("vec"))).withColumn("n", word_count(F.col("text")))
    near = F.lit(False)
    for k in range(1, skip + 2):
        before = F.lag("v", k).over(order)
        near = near | F.coalesce(F.try_divide(dot(F.col("v"), before), norm(F.col("v")) * norm(before)) >= threshold, F.lit(False))
    fresh = own.withColumn("near", near).withColumn("run", F.sum((~F.col("near")).cast("int")).over(order))
    runs = fresh.groupBy(id_col, "run").agg(F.array_sort(F.collect_list(F.struct("piece_index", "text"))).alias("parts"))
    each = runs.select(id_col, "run", F.posexplode(packed(F.transform("parts", lambda p: p.text), size, " ")).alias("k", "c"))
    index = F.row_number().over(Window.partitionBy(id_col).orderBy("run", "k")) - 1
    return each.select(id_col, index.cast("long").alias("chunk_index"), F.col("c.text").alias("text"), word_count(F.col("c.text")).alias("n_words"))


def packed_chunks(docs: DataFrame, most: int = WORDS, pattern: str = PARAGRAPH_BREAK, joiner: str = "\n\n", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, start, text, n_words): paragraphs of each text packed; no sections."""
    each = docs.select(id_col, F.posexplode(packed(paragraphs(F.col(text_col), pattern), most, joiner)).alias("chunk_index", "c"))
    return each.select(id_col, F.col("chunk_index").cast("long").alias("chunk_index"), F.col("c.start").alias("start"), F.col("c.text").alias("text"), word_count(F.col("c.text")).alias("n_words"))


CHUNK = "struct<level:string,text:string,char_start:bigint,char_end:bigint,parent:int,section_title:string,section_number:string>"


def structured_chunks(docs: DataFrame, document_type: str = "general", most: int = WORDS, id_col: str = "doc_id", text_col: str = "text", tier_col: str | None = None) -> DataFrame:
    """A document's chunks: the document itself, its sections, and packed paragraphs inside each; without sections, paragraphs alone.

    Text before the first section isn't chunked and sections under 50 characters are left out. One running index; the
    id is <document>_chunk_<index>, the parent's id that of the document or section above. Result: (id, chunk_index,
    chunk_id, parent_id, level, section_title, section_number, char_start, char_end, text, token_count, strategy).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def chunk(level: str, body: Column, start: Column, parent: Column, title: Column, number: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), body.alias("text"), start.cast("long").alias("char_start"), (start + F.length(body)).cast("long").alias("char_end"), parent.cast("int").alias("parent"), title.alias("section_title"), number.alias("section_number")).cast(CHUNK)

    none = F.lit(None).cast("string")
    flat = F.transform(packed(paragraphs(text), most), lambda p: chunk("paragraph", p.text, p.start, F.lit(-1), none, none))

    def sectioned(found: Column) -> Column:
        kept = F.filter(found, lambda s: F.length(strip(F.substring(text, (s.start + 1).cast("int"), (s.end - s.start).cast("int")))) >= LEAST_SECTION)

        def of(s: Column) -> Column:
            body = F.substring(text, (s.start + 1).cast("int"), (s.end - s.start).cast("int"))
            inner = F.transform(packed(paragraphs(body), most, offset=s.start), lambda p: chunk("paragraph", p.text, p.start, F.lit(1), s.title, s.number))
            return F.concat(F.array(chunk("section", F.substring(body, 1, SECTION_CHARS), s.start, F.lit(0), s.title, s.number)), inner)

        head = F.when(F.length(text) > DOCUMENT_CHARS, F.concat(F.substring(text, 1, DOCUMENT_CHARS), F.lit("..."))).otherwise(text)
        return F.concat(F.array(chunk("document", head, F.lit(0), F.lit(-1), none, none)), F.flatten(F.transform(kept, of)))

    chunks = let(headings(text, patterns_for(document_type)), lambda h: F.when(F.size(h) > 0, sectioned(h)).otherwise(flat))
    tier = F.col(tier_col) if tier_col else F.lit("medium")
    each = docs.select(F.col(id_col), strategy(tier).alias("strategy"), F.posexplode(chunks).alias("chunk_index", "c"))
    section_index = F.last(F.when(F.col("c.level") == "section", F.col("chunk_index")), ignorenulls=True).over(Window.partitionBy(id_col).orderBy("chunk_index"))
    name = lambda i: F.concat(F.col(id_col).cast("string"), F.lit("_chunk_"), i.cast("string"))
    parent = F.when(F.col("c.parent") == 0, name(F.lit(0))).when(F.col("c.parent") == 1, name(section_index))
    return each.select(
        id_col, F.col("chunk_index").cast("long").alias("chunk_index"), name(F.col("chunk_index")).alias("chunk_id"), parent.alias("parent_id"), "c.level", "c.section_title", "c.section_number",
        "c.char_start", "c.char_end", "c.text", word_count(F.col("c.text")).alias("token_count"), "strategy",
    )


def section_windows(docs: DataFrame, document_type: str = "general", size: int = WORDS, overlap: int = OVERLAP, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token windows inside each section; a text without sections is cut as a whole. Other columns aren't kept.

    Sections under 50 characters, and windows under `least` words, are left out. Chunks are numbered through the
    document; the parent's id is <document>_sec_<number of the document's chunks before the section>. Result: (id,
    chunk_index, chunk_id, parent_id, section_title, section_number, section_start, n_words, text).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.lit(None).cast("string")
    body = lambda s: F.substring(text, (s.start + 1).cast("int"), (s.end - s.start).cast("int"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), text.alias("body"), none.alias("title"), none.alias("number"), F.lit(False).alias("sectioned")))

    def cut(found: Column) -> Column:
        kept = F.filter(found, lambda s: F.length(strip(body(s))) >= LEAST_SECTION)
        return F.when(F.size(found) > 0, F.transform(kept, lambda s: F.struct(s.start.alias("start"), body(s).alias("body"), s.title.alias("title"), s.number.alias("number"), F.lit(True).alias("sectioned")))).otherwise(whole)

    each = docs.select(F.col(id_col), F.posexplode(let(headings(text, patterns_for(document_type)), cut)).alias("section", "s")).select(id_col, "section", "s.*")
    cuts = each.withColumn("key", F.struct(F.col(id_col).alias("own"), "section", "start", "title", "number", "sectioned"))
    windows = word_windows(cuts, size, overlap, "key", "body").where(F.col("n_words") >= least).select("key.*", F.col("chunk_index").alias("k"), "n_words", "text")
    order = Window.partitionBy("own").orderBy("section", "k")
    numbered = windows.withColumn("chunk_index", (F.row_number().over(order) - 1).cast("long"))
    before = F.min("chunk_index").over(Window.partitionBy("own", "section"))
    name = lambda part, i: F.concat(F.col("own").cast("string"), F.lit(part), i.cast("string"))
    return numbered.withColumn("before", before).select(
        F.col("own").alias(id_col), "chunk_index", name("_chunk_", F.col("chunk_index")).alias("chunk_id"), F.when(F.col("sectioned"), name("_sec_", F.col("before"))).alias("parent_id"),
        F.col("title").alias("section_title"), F.col("number").alias("section_number"), F.col("start").alias("section_start"), "n_words", "text",
    )


def adaptive_chunks(docs: DataFrame, embed: Callable[[DataFrame], DataFrame], tier_col: str = "tier", threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document cut by the strategy of its quality tier, unknown tiers by sentences: (id, chunk_index, text, n_words, chunk_strategy, quality_level).

    embed gives frames with a column text the column vec; only sentences of tiers that need vectors come to it. The
    skipping strategy joins over up to two pieces that don't fit.
    """
    tier = F.lower(F.coalesce(F.col(tier_col), F.lit("")))
    own = docs.select(F.col(id_col), F.col(text_col), F.col(tier_col).alias("quality_level"), F.when(tier.isin(*STRATEGIES), strategy(tier)).otherwise("sentence").alias("chunk_strategy"))
    of = lambda s: own.where(F.col("chunk_strategy") == s)
    pieces = lambda s: embed(sentence_chunks(of(s), 1, id_col, text_col).select(id_col, F.col("sentence_index").alias("piece_index"), "text"))
    columns = [id_col, "chunk_index", "text", "n_words"]
    parts = [
        token_chunks(of("token"), id_col=id_col, text_col=text_col).select(*columns), sentence_packed(of("sentence"), id_col=id_col, text_col=text_col).select(*columns),
        semantic_chunks(pieces("semantic"), threshold, id_col=id_col).select(*columns), semantic_chunks(pieces("sdpm"), threshold, skip=2, id_col=id_col).select(*columns),
    ]
    out = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
    known = own.select(F.col(id_col).alias("__cm_of"), "chunk_strategy", "quality_level").dropDuplicates(["__cm_of"])
    return out.join(known, F.col(id_col) == F.col("__cm_of")).drop("__cm_of")


#: The families of patterns by document type where structure is looked for.
LEGAL_TYPES, FINANCIAL_TYPES = ("contract", "irc_code", "building_code"), ("financial_report",)


def legacy_route(config_strategy: Column, document_type: Column) -> Column:
    """How the legacy pipeline cuts a document: by legal, financial or general sections, in simple windows, or in packed paragraphs."""
    by_type = F.when(document_type.isin(*LEGAL_TYPES), "legal").when(document_type.isin(*FINANCIAL_TYPES), "financial").otherwise("general")
    return F.when(config_strategy == "hierarchical", by_type).when(config_strategy == "simple", "simple").otherwise("standard")


def legacy_chunks(docs: DataFrame, config_col: str = "chunking_strategy", type_col: str = "document_type", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents cut as the legacy pipeline routes them: (id, chunk_index, level, text, n_words, route)."""
    own = docs.select(F.col(id_col), F.col(text_col), legacy_route(F.col(config_col), F.col(type_col)).alias("route"))
    of = lambda r: own.where(F.col("route") == r)
    out = None
    for route in ("legal", "financial", "general"):
        part = structured_chunks(of(route), route, id_col=id_col, text_col=text_col).select(id_col, "chunk_index", "level", "text", F.col("token_count").alias("n_words"), F.lit(route).alias("route"))
        out = part if out is None else out.unionAll(part)
    flat = F.lit("paragraph").alias("level")
    simple = word_windows(of("simple"), SIMPLE_WORDS, SIMPLE_OVERLAP, id_col, text_col).select(id_col, "chunk_index", flat, "text", "n_words", F.lit("simple").alias("route"))
    standard = packed_chunks(of("standard"), id_col=id_col, text_col=text_col).select(id_col, "chunk_index", flat, "text", "n_words", F.lit("standard").alias("route"))
    return out.unionAll(simple).unionAll(standard)


def with_context(results: DataFrame, chunks: DataFrame, siblings: int = 1) -> DataFrame:
    """What stands around each result(query_id, id): (query_id, id, role, context_id, distance, text) with role parent, sibling or self.

    chunks(id, parent_id, chunk_index, text). Siblings are the chunks of the same parent up to `siblings` places before
    and behind, in the order of chunk_index; a chunk without a parent has none. Results that aren't chunks give nothing.
    """
    place = F.row_number().over(Window.partitionBy("parent_id").orderBy("chunk_index", "id"))
    own = chunks.select("id", "parent_id", "chunk_index", "text")
    placed = own.where("parent_id is not null").withColumn("place", place).select(F.col("id").alias("c"), F.col("parent_id").alias("p"), "place", F.col("text").alias("t"))
    hits = results.select("query_id", "id").distinct()
    found = hits.join(own, "id")
    parents = found.join(own.select(F.col("id").alias("c"), F.col("text").alias("t")), F.col("parent_id") == F.col("c")).select("query_id", "id", F.lit("parent").alias("role"), F.col("c").alias("context_id"), F.lit(0).alias("distance"), F.col("t").alias("text"))
    at = hits.join(placed.select("c", "p", "place"), F.col("id") == F.col("c")).select("query_id", "id", F.col("p").alias("of"), F.explode(F.filter(F.sequence(F.lit(-siblings), F.lit(siblings)), lambda d: d != 0)).alias("distance"), "place")
    wanted = at.withColumn("target", F.col("place") + F.col("distance")).drop("place")
    near = wanted.join(placed, (F.col("of") == F.col("p")) & (F.col("target") == F.col("place"))).select("query_id", "id", F.lit("sibling").alias("role"), F.col("c").alias("context_id"), "distance", F.col("t").alias("text"))
    return found.select("query_id", "id", F.lit("self").alias("role"), F.col("id").alias("context_id"), F.lit(0).alias("distance"), "text").unionAll(parents).unionAll(near)


def with_children(chunks: DataFrame) -> DataFrame:
    """chunks with children_ids: the ids of the chunks whose parent each is, in order."""
    children = chunks.where("parent_id is not null").groupBy(F.col("parent_id").alias("of")).agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda c: c.chunk_id).alias("children_ids"))
    return chunks.join(children, F.col("chunk_id") == F.col("of"), "left").drop("of").withColumn("children_ids", F.coalesce("children_ids", F.array().cast("array<string>")))


def legacy_tree(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Four levels: document, sections (by the strict legal patterns), paragraphs packed by characters, sentences: (id, chunk_id, parent_id, level, text)."""
    from .structure import STRICT_LEGAL, strict_level_of

    text = F.coalesce(F.col(text_col), F.lit(""))
    root, none = F.concat(F.col(id_col).cast("string"), F.lit("_doc")), F.lit(None).cast("string")
    chunk = lambda name, parent, level, own: F.struct(name.alias("chunk_id"), parent.alias("parent_id"), F.lit(level).alias("level"), own.alias("text"))
    numbered = lambda parent, kind, i: F.concat(parent, F.lit(f"_{kind}_"), i.cast("string"))

    def below_paragraph(name: Column, parent: Column, own: Column) -> Column:
        each = F.transform(sentences(own), lambda x, i: chunk(numbered(name, "sent", i), name, "sentence", x))
        return F.concat(F.array(chunk(name, parent, "paragraph", own)), F.filter(each, lambda c: F.length(c.text) >= LEAST_SENTENCE))

    def below_section(name: Column, parent: Column, body: Column) -> Column:
        each = F.flatten(F.transform(packed_by_chars(paragraphs(body)), lambda p, i: let(numbered(name, "para", i), lambda para: below_paragraph(para, name, p))))
        return F.concat(F.array(chunk(name, parent, "section", body)), each)

    def tree(bodies: Column) -> Column:
        """All chunks of a document; its text is walked once."""
        own = F.when(F.size(bodies) > 0, bodies).otherwise(F.array(strip(text)))
        each = F.flatten(F.transform(own, lambda body, i: let(numbered(F.col("root"), "sec", i), lambda sec: below_section(sec, F.col("root"), body))))
        return F.concat(F.array(chunk(F.col("root"), none, "document", text)), each)

    found = headings(text, STRICT_LEGAL, any_case=False, level=strict_level_of)
    bodies = F.filter(F.transform(found, lambda s: strip(F.substring(text, (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), lambda body: F.length(body) >= 100)
    return docs.select(F.col(id_col), F.col(text_col), root.alias("root")).select(id_col, F.explode(let(bodies, tree)).alias("c")).select(id_col, "c.*")


def pages_as_of(chunks: DataFrame, boundaries: DataFrame, id_col: str = "doc_id", start_col: str = "start") -> DataFrame:
    """chunks with page_number: that of the last boundary(id, position, page_number) at or before a chunk's start; of equal positions the last page.

    One sort of both sides by document and position; no range join.
    """
    own = chunks.columns
    left = chunks.select(F.col(id_col).alias("__cm_id"), F.col(start_col).cast("long").alias("__cm_at"), F.lit(1).alias("__cm_kind"), F.lit(None).cast("long").alias("__cm_page"), F.struct(*own).alias("__cm_row"))
    right = boundaries.select(F.col(id_col), F.col("position").cast("long"), F.lit(0), F.col("page_number").cast("long"), F.lit(None).cast(left.schema["__cm_row"].dataType))
    order = Window.partitionBy("__cm_id").orderBy("__cm_at", "__cm_kind", "__cm_page").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionAll(right).withColumn("page_number", F.last("__cm_page", ignorenulls=True).over(order))
    return both.where("__cm_kind = 1").select("__cm_row.*", "page_number")


def totals(chunks: DataFrame, id_col: str = "doc_id", tokens_col: str = "token_count") -> DataFrame:
    return chunks.groupBy(id_col).agg(F.count("*").alias("total_chunks"), F.sum(tokens_col).alias("total_tokens"))
