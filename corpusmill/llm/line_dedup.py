"""Line deduplication by site-relative frequency, in DataFrame functions only.

For every host, the share of its pages that contain a line (trimmed; blank lines never count) is the number of pages
with the line over the number of the host's pages. Lines that repeat, which one page alone can't tell, and whose share
exceeds `ratio` are boilerplate of that host and are dropped from its pages. The counts are over all pages: each page
gives each of its distinct lines once, as two hashes of the trimmed line (96 bits), and counts are summed before the
shuffle.

A host has at most (its mean number of distinct lines a page) / ratio boilerplate lines, so a host's lines fit in one
small array; pages get their host's array by a join that broadcasts only if the written table is small, and is a
sort-merge join that adaptive execution may split at hot hosts otherwise.

Null hosts are a host of their own. A null text stays null and counts as a page without lines. Line ends are "\\n".
With `once`, pages of a host with the same text count as one page, so copies don't make their own lines boilerplate.
A page that consists of boilerplate alone stays, with an empty text. All columns stay, extra columns too; columns of
docs named like the two counts give way to them where counts are asked for. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

RATIO = 0.05
COUNTS = ("lines_kept", "lines_dropped")


def _trimmed(line: Column) -> Column:
    return F.trim(line)


def _hashes(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def boilerplate(docs: DataFrame, ratio: float = RATIO, host_col: str = "source", text_col: str = "text", once: bool = False) -> DataFrame:
    """(host, lines): the hashes of every host's boilerplate lines; hosts without any are left out."""
    pages = docs.select(F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    # Strings are told apart by a hash set, structs would be pair by pair.
    lines = F.transform(F.array_distinct(F.filter(F.transform(F.split("text", "\n"), _trimmed), lambda x: x != "")), _hashes)
    if once:
        pages = pages.select("host", F.md5("text").alias("digest"), lines.alias("own")).dropDuplicates(["host", "digest"])
        lines = F.col("own")
    # One row a page without line hashes counts the page itself, so pages and lines are counted by one aggregation.
    rows = pages.select("host", F.explode(F.concat(F.array(F.lit(None).cast("struct<a:bigint,b:int>")), F.coalesce(lines, F.array().cast("array<struct<a:bigint,b:int>>")))).alias("line"))
    counts = rows.groupBy("host", "line.a", "line.b").agg(F.count("*").alias("n")).where("a is null or n > 1")
    counts = staged(counts, "lines")
    totals = counts.where("a is null").select(F.col("host").alias("of"), F.col("n").alias("pages"))
    found = counts.where("a is not null").join(totals, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > ratio * F.col("pages"))
    return found.groupBy("host").agg(F.collect_set(F.struct("a", "b")).alias("lines"))


def drop_boilerplate(docs: DataFrame, ratio: float = RATIO, host_col: str = "source", text_col: str = "text", once: bool = False, counts: bool = True) -> DataFrame:
    """docs with boilerplate lines taken out of the text, and with counts the columns lines_kept and lines_dropped behind the others."""
    named = staged(boilerplate(docs, ratio, host_col, text_col, once), "boilerplate").select(F.col("host").alias("__cm_host"), F.col("lines").alias("__cm_lines"))
    text = F.col(text_col)
    joined = docs.join(named, F.col(host_col).cast("string").eqNullSafe(F.col("__cm_host")), "left")
    split = F.split(text, "\n")
    kept = F.filter(split, lambda x: ~F.array_contains(F.col("__cm_lines"), _hashes(_trimmed(x))))
    joined = joined.withColumn("__cm_kept", F.when(F.col("__cm_lines").isNotNull() & text.isNotNull(), kept))
    n, dropped = F.coalesce(F.size(split), F.lit(0)), F.coalesce(F.size(split) - F.size("__cm_kept"), F.lit(0))
    n = F.when(text.isNull(), 0).otherwise(n)
    dropped = F.when(F.col("__cm_kept").isNull(), 0).otherwise(dropped)
    own = [c for c in docs.columns if not counts or c not in COUNTS]
    return joined.select(
        *[F.when(F.col("__cm_kept").isNull(), text).otherwise(F.array_join("__cm_kept", "\n")).alias(text_col) if c == text_col else F.col(c) for c in own],
        *([(n - dropped).cast("long").alias(COUNTS[0]), dropped.cast("long").alias(COUNTS[1])] if counts else []),
    )
