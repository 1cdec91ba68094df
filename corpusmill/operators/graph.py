"""Relations between documents: extraction from text, resolution, neighbours within a few hops, shortest chains, augmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_hit, let, strip
from ..sources.staging import staged

#: Patterns of each relation, in their order; the first group is what is referred to.
PATTERNS = (
    ("amends", r"amend(?:s|ed|ment to)?\s+(?:the\s+)?(?:original\s+)?(?:agreement|contract)?\s*(?:dated\s+)?([A-Z][^.]+?(?:\d{4}|agreement|contract))"),
    ("amends", r"(?:first|second|third|\d+(?:st|nd|rd|th))\s+amendment\s+to\s+([^.]+)"),
    ("supersedes", r"supersedes?\s+(?:and replaces?\s+)?(?:all\s+)?(?:prior\s+)?([^.]+)"),
    ("supersedes", r"replaces?\s+(?:in\s+its\s+entirety\s+)?([^.]+)"),
    ("exhibits_to", r"exhibit\s+([A-Z]|\d+)\s+(?:to|attached)"),
    ("exhibits_to", r"(?:see|refer to)\s+exhibit\s+([A-Z]|\d+)"),
    ("references", r"(?:pursuant to|in accordance with|as defined in|as set forth in)\s+([^.]+)"),
    ("references", r"(?:see|refer to|reference to)\s+([^.]+?(?:agreement|contract|document|section|article))"),
    ("cites", r"(?:IRC|I\.R\.C\.)\s*(?:§|Section)\s*(\d+(?:\([a-z]\))?(?:\(\d+\))?)"),
    ("cites", r"(\d+)\s*(?:U\.S\.C\.|USC)\s*(?:§|Section)?\s*(\d+)"),
    ("cites", r"(\d+)\s*(?:C\.F\.R\.|CFR)\s*(?:§|Section)?\s*(\d+(?:\.\d+)?)"),
    ("incorporates", r"incorporat(?:es?|ed|ing)\s+(?:herein\s+)?by\s+reference\s+([^.]+)"),
    ("incorporates", r"deemed\s+(?:to\s+be\s+)?incorporated\s+([^.]+)"),
)
#: One of these stands, in any case, in whatever the pattern at the same place finds.
SIGNS = (
    ("amend",), ("amendment",), ("supersede",), ("replace",), ("exhibit",), ("exhibit",), ("pursuant to", "in accordance with", "as defined in", "as set forth in"), ("see", "refer to", "reference to"),
    ("irc", "i.r.c."), ("u.s.c.", "usc"), ("c.f.r.", "cfr"), ("incorporat",), ("incorporated",),
)
#: All relation types that edges may have, from both models.
RELATION_TYPES = ("amends", "supersedes", "exhibits_to", "supplement_to", "references", "cites", "incorporates", "related_to", "contradicts", "clarifies", "precedes", "follows", "implements", "complies_with", "exhibit_of", "annexure_to", "version_of", "translation_of")
#: Fixed values of the confidence.
BASE, SPECIFIC, LONG, LONG_COST, HEDGE_COST, LEAST, MOST = 0.7, 0.9, 200, 0.2, 0.1, 0.3, 1.0
SPECIFIC_TYPES, HEDGES = ("cites", "exhibits_to"), ("may", "might", "similar")
CONTEXT = 100
UNRESOLVED = "unresolved:"
LEAST_CONFIDENCE = 0.5
#: Characters of a run by which identifiers are looked up.
GRAM = 3
_MARK = "\ue000"


def confidence(relation: Column, matched: Column) -> Column:
    lower = F.lower(matched)
    hedged = lower.contains(HEDGES[0]) | lower.contains(HEDGES[1]) | lower.contains(HEDGES[2])
    raw = F.when(relation.isin(*SPECIFIC_TYPES), SPECIFIC).otherwise(BASE) - F.when(F.length(matched) > LONG, LONG_COST).otherwise(0.0) - F.when(hedged, HEDGE_COST).otherwise(0.0)
    return F.greatest(F.lit(LEAST), F.least(F.lit(MOST), raw))


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every match of every pattern: (source_id, relation_type, reference, matched, context, confidence, ord), within each document's row.

    context: the match with up to 100 characters before and behind it. The private character U+E000 counts as a space.
    """
    text, none = F.translate(F.col(text_col), _MARK, " "), F.array().cast("array<struct<ord:bigint,relation_type:string,reference:string,matched:string,context:string>>")

    def matches(text: Column, lower: Column, number: int, kind: str, pattern: str) -> Column:
        """A text without the pattern's signs, or without a match, goes no further than that."""
        p = f"(?i){pattern}"
        found = F.when(any_hit(lower, SIGNS[number]), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>"))
        return let(found, lambda whole: F.when(F.size(whole) > 0, placed(text, whole, number, kind, p)).otherwise(none))

    def placed(text: Column, whole: Column, number: int, kind: str, p: str) -> Column:
        groups = F.regexp_extract_all(text, F.lit(p), F.lit(1))
        marked = F.split(F.regexp_replace(text, p, _MARK + "$0" + _MARK), _MARK)
        # Pieces alternate: text between matches, match, text, ...; the ends of both neighbours give the context.
        around = lambda pieces, i: F.concat(F.substring(F.get(pieces, 2 * i), -CONTEXT, CONTEXT), F.get(pieces, 2 * i + 1), F.substring(F.get(pieces, 2 * i + 2), 1, CONTEXT))
        row = lambda group, pieces, m, i: F.struct((F.lit(number) * 1_000_000 + i).cast("long").alias("ord"), F.lit(kind).alias("relation_type"), strip(F.get(group, i)).alias("reference"), m.alias("matched"), around(pieces, i).alias("context"))
        return let(groups, lambda group: let(marked, lambda pieces: F.transform(whole, lambda m, i: row(group, pieces, m, i))))

    found = let(text, lambda own: let(F.lower(own), lambda lower: F.concat(*[matches(own, lower, i, kind, p) for i, (kind, p) in enumerate(PATTERNS)])))
    each = docs.select(F.col(id_col).alias("source_id"), F.explode(found).alias("m")).select("source_id", "m.*")
    return each.withColumn("confidence", confidence(F.col("relation_type"), F.col("matched")))


def _grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))


def resolve(relations: DataFrame, known: DataFrame) -> DataFrame:
    """relations with target_id, first of each (source, target, type): known(identifier, document_id, ord) is looked up in the lower-cased reference.

    The identifier registered first wins; what matches none is unresolved:<reference>; empty identifiers match none. The
    lookup is a join on runs of GRAM characters: a reference has all of its runs, an identifier only that of its own that
    the fewest identifiers hold (a shorter identifier is one run), and what meets is verified.
    """
    relations = staged(relations, "relations")  # texts are read once
    refs = relations.select("reference").distinct().withColumn("lower", F.lower("reference"))
    held = refs.select("reference", "lower", F.explode(F.concat(*[_grams(F.col("lower"), n) for n in range(1, GRAM + 1)])).alias("gram"))
    names = staged(known.withColumn("name", F.lower("identifier")).where("name <> ''").groupBy("name").agg(F.min_by("document_id", "ord").alias("document_id"), F.min("ord").alias("ord")), "names")
    own = F.when(F.length("name") >= GRAM, _grams(F.col("name"), GRAM)).otherwise(F.array("name"))
    grams = names.select("name", F.explode(own).alias("gram"))
    counts = grams.groupBy(F.col("gram").alias("of")).agg(F.count("*").alias("n"))
    rarest = grams.join(counts, F.col("gram") == F.col("of")).groupBy(F.col("name").alias("of_name")).agg(F.min_by("gram", F.struct("n", "gram")).alias("key"))
    keyed = names.join(rarest, F.col("name") == F.col("of_name"))
    hit = held.join(keyed, F.col("gram") == F.col("key")).where(F.contains("lower", "name"))
    best = hit.groupBy("reference").agg(F.min_by("document_id", "ord").alias("document_id"))
    out = relations.join(best, "reference", "left").withColumn("target_id", F.coalesce(F.col("document_id").cast("string"), F.concat(F.lit(UNRESOLVED), "reference")))
    first = F.row_number().over(Window.partitionBy("source_id", "target_id", "relation_type").orderBy("ord"))
    return out.withColumn("first", first).where("first = 1").drop("first", "document_id")


def resolve_pending(edges: DataFrame, registered: DataFrame) -> DataFrame:
    """Edges whose reference is exactly an identifier that was registered(identifier, document_id) later get its document and 0.1 more confidence."""
    pending = edges.where(F.col("target_id").startswith(UNRESOLVED)).join(registered.groupBy("identifier").agg(F.min("document_id").alias("document_id")), F.col("reference") == F.col("identifier"), "left")
    done = pending.select(*[F.coalesce(F.col("document_id").cast("string"), F.col("target_id")).alias("target_id") if c == "target_id" else F.when(F.col("document_id").isNotNull(), F.least(F.lit(1.0), F.col("confidence") + 0.1)).otherwise(F.col("confidence")).alias("confidence") if c == "confidence" else F.col(c) for c in edges.columns])
    return edges.where(~F.col("target_id").startswith(UNRESOLVED)).unionAll(done)


def _steps(edges: DataFrame, least: float, kinds: tuple[str, ...] | None) -> DataFrame:
    """(a, b, confidence, direction, ord): every edge both ways, outgoing first."""
    own = edges.where(F.col("confidence") >= least).where(~F.col("target_id").cast("string").startswith(UNRESOLVED))
    own = own.where(F.col("relation_type").isin(*kinds)) if kinds else own
    out = own.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "confidence", F.lit(0).alias("direction"), "ord")
    return out.unionAll(own.select(F.col("target_id"), F.col("source_id"), "confidence", F.lit(1), "ord"))


def k_hop(edges: DataFrame, starts: DataFrame, depth: int = 1, least: float = LEAST_CONFIDENCE, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(start, node, hops, path, confidences): every node within `depth` hops of a start, by its first path breadth-first.

    edges(source_id, target_id, relation_type, confidence, ord); starts(start). Lower hops first, then the order in
    which parents were found, outgoing before incoming edges, then the order of the edges.
    """
    steps = _steps(edges, least, kinds)
    seen = starts.select(F.col("start"), F.col("start").alias("node"), F.lit(0).alias("hops"), F.array().cast("array<string>").alias("path"), F.array().cast("array<double>").alias("confidences"), F.lit(0).cast("long").alias("found"))
    frontier, all_found = seen, seen
    for hop in range(1, depth + 1):
        reached = frontier.join(steps, F.col("node") == F.col("a")).select("start", F.col("b").alias("node"), F.lit(hop).alias("hops"), F.concat("path", F.array(F.col("b").cast("string"))).alias("path"), F.concat("confidences", F.array("confidence")).alias("confidences"), F.struct("found", "direction", "ord").alias("by"))
        fresh = reached.join(all_found.select(F.col("start").alias("s"), F.col("node").alias("n")), (F.col("start") == F.col("s")) & (F.col("node") == F.col("n")), "left_anti")
        first = fresh.groupBy("start", "node").agg(F.min_by(F.struct("hops", "path", "confidences"), "by").alias("x"), F.min("by").alias("by"))
        # Written at every hop, so that no plan holds the hops before it.
        frontier = staged(first.select("start", "node", "x.*", (F.row_number().over(Window.partitionBy("start").orderBy("by"))).cast("long").alias("found")), "hop")
        all_found = all_found.unionAll(frontier)
    return all_found.where("hops > 0").drop("found")


def shortest_chain(edges: DataFrame, pairs: DataFrame, depth: int = 5) -> DataFrame:
    """(start, goal, hops, path) along outgoing edges for pairs(start, goal) that at most `depth` edges connect; 0 hops where both are the same."""
    steps = edges.where(~F.col("target_id").cast("string").startswith(UNRESOLVED)).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "ord")
    seen = pairs.select("start").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("hops"), F.array().cast("array<string>").alias("path"))
    frontier, all_found = seen, seen
    for hop in range(1, depth + 1):
        reached = frontier.join(steps, F.col("node") == F.col("a")).select("start", F.col("b").alias("node"), F.lit(hop).alias("hops"), F.concat("path", F.array(F.col("b").cast("string"))).alias("path"), "ord")
        fresh = reached.join(all_found.select(F.col("start").alias("s"), F.col("node").alias("n")), (F.col("start") == F.col("s")) & (F.col("node") == F.col("n")), "left_anti")
        frontier = staged(fresh.groupBy("start", "node").agg(F.min("hops").alias("hops"), F.min_by("path", F.struct("path", "ord")).alias("path")), "hop")
        all_found = all_found.unionAll(frontier)
    return pairs.join(all_found, "start").where(F.col("node") == F.col("goal")).select("start", "goal", "hops", "path")


def stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: documents, relations, unresolved references, mean relations a document, counts by type."""
    by_type = edges.groupBy("relation_type").agg(F.count("*").alias("n"), F.count_if(F.col("target_id").cast("string").startswith(UNRESOLVED)).alias("open"))
    total = by_type.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_relations"), F.coalesce(F.sum("open"), F.lit(0)).alias("unresolved_references"), F.array_sort(F.collect_list(F.struct("relation_type", "n"))).alias("relations_by_type"))
    return nodes.agg(F.count("*").alias("total_documents")).join(F.broadcast(total)).withColumn("avg_relations", F.when(F.col("total_documents") > 0, F.col("total_relations") / F.col("total_documents")).otherwise(0.0))  # one row each


def document_context(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, outgoing, incoming, related): numbers of edges each way and of distinct documents at their other ends."""
    out = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    both = out.unionAll(edges.select(F.col("target_id"), F.col("source_id"), F.lit(0), F.lit(1)))
    own = both.groupBy("id").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"), F.count_distinct("other").alias("related"))
    return nodes.select("id").join(own, "id", "left").na.fill(0)


def augment(results: DataFrame, edges: DataFrame, top: int = 5, most: int = 3, depth: int = 2) -> DataFrame:
    """For results(query_id, id, rank): up to `most` documents near the `top` first, by the mean confidence of their path, that the query hasn't found: (query_id, id, source_id, augmentation_score, ord)."""
    heads = results.where(F.col("rank") <= top).select("query_id", F.col("id").alias("start"), "rank")
    near = k_hop(edges, heads.select("start").distinct(), depth)
    score = F.aggregate("confidences", F.lit(0.0), lambda s, x: s + x) / F.size("confidences")
    found = heads.join(near.withColumn("score", score), "start")
    fresh = found.join(results.select(F.col("query_id").alias("q"), F.col("id").alias("i")), (F.col("query_id") == F.col("q")) & (F.col("node") == F.col("i")), "left_anti")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rank", "hops", "node")
    cut = fresh.withColumn("ord", F.row_number().over(best)).where(F.col("ord") <= most)
    first = F.row_number().over(Window.partitionBy("query_id", "node").orderBy("ord"))
    return cut.withColumn("first", first).where("first = 1").select("query_id", F.col("node").alias("id"), F.col("start").alias("source_id"), F.col("score").alias("augmentation_score"), F.col("ord").cast("long").alias("ord"))
