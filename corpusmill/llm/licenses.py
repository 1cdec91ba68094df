"""License scans by diagonal voting, in DataFrame functions only.

A-Z become a-z; words are the runs of digits, lower-case letters and non-ASCII characters. Every rolling k-gram
of words is hashed; k-grams whose hash may be one of a template's (a bit table of 65,536 places as a first sieve) are
joined with the positions of the templates' k-grams, a table of a few hundred fixed rows. Each match votes for the
diagonal (place in the text minus place in the template). Neighbouring diagonals of a text and template, at most `gap`
words apart, are merged, so that inserted or missing words don't split a license; a merged span is verified by the
share of the template's k-grams that it holds and by its length. All work on a text is keyed by that text, so matches
of one text, however many, are the largest group.

Besides, the base phrases are counted at every place where their words stand consecutively.

A null text counts as empty: no words, no labels, score 0. Rows with equal or null doc_id are scanned each by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
GAP = 4
#: Share of a template's k-grams that a span must hold, and how much longer than the template it may be.
COVERAGE = 0.7
STRETCH = 1.6
SIEVE_BITS = 16
#: The one other character whose lower case is one of a-z alone.
KELVIN = "\u212a"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The phrases that give base labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Passages of public licenses and notices, and the label that each gives.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache-text", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for each row."""
    return F.transform(F.array(value), use)[0]


def _hash_word_grams(words: list[str], k: int) -> list[int]:
    """What Spark's xxhash64 gives for k string columns, for every k-gram."""
    from xxhash import xxh64_intdigest

    out = []
    for i in range(len(words) - k + 1):
        h = 42
        for w in words[i : i + k]:
            h = xxh64_intdigest(w.encode(), h)
        out.append(h - (1 << 64) if h >> 63 else h)
    return out


def template_rows(templates=TEMPLATES, k: int = K) -> list[tuple[int, str, int, int, int, int]]:
    """(template, label, words, k-grams, position, hash) of every template's k-grams."""
    out = []
    for t, (label, text) in enumerate(templates):
        words = text.split()
        grams = _hash_word_grams(words, k)
        out += [(t, label, len(words), len(set(grams)), i, h) for i, h in enumerate(grams)]
    return out


def _sieve(hashes: list[int]) -> Callable[[Column], Column]:
    table = [0] * (1 << SIEVE_BITS - 6)
    for h in hashes:
        at = h & (1 << SIEVE_BITS) - 1
        table[at >> 6] |= 1 << (at & 63)
    longs = F.array(*[F.lit(x - (1 << 64) if x >> 63 else x).cast("long") for x in table])

    def passes(h: Column) -> Column:
        at = h.bitwiseAND(F.lit((1 << SIEVE_BITS) - 1).cast("long"))
        return F.getbit(F.element_at(longs, F.shiftright(at, 6).cast("int") + 1), at.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1

    return passes


def _gram(words: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*[words[i + j] if j else words[i] for j in range(k)])


def _base_places(words: Column, phrase: str) -> Column:
    """Starts of the phrase in words."""
    own = phrase.split()
    last = F.size(words) - len(own)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def here(i: Column) -> Column:
        found = words[i] == own[0]
        for j, w in enumerate(own[1:], 1):
            found = found & (words[i + j] == w)
        return found

    return F.filter(starts, here)


def _scan_row(text: Column, k: int, sieve: Callable[[Column], Column], base) -> Column:
    # What other letters become is left open, as no phrase or template holds any, but no other may become one of a-z.
    lower = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit("\ufffd")))

    def use(words: Column) -> Column:
        n = F.size(words)
        none = F.array().cast("array<int>")
        starts = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(none)
        hits = F.transform(F.filter(starts, lambda i: sieve(_gram(words, i, k))), lambda i: F.struct(i.alias("pos"), _gram(words, i, k).alias("hash")))
        # Only texts that hold a phrase's last word at all are searched for it.
        places = [F.when(F.array_contains(words, p.split()[-1]), _base_places(words, p)).otherwise(none).alias(f"p{i}") for i, (p, _) in enumerate(base)]
        return F.struct(n.cast("long").alias("n_words"), hits.alias("hits"), *places)

    return let(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)), use)


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE, k: int = K, gap: int = GAP, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: base counts and labels, the labels of verified spans, the best share of a template found.

    spans lists every verified span: template label, first word, words, share. The score is 1 where a base phrase
    stands, else the largest share of a template's k-grams in a verified span, 0 without one.
    """
    spark: SparkSession = docs.sparkSession
    rows = template_rows(templates, k)
    known = spark.createDataFrame(rows, "template int, label string, t_words int, t_grams int, t_pos int, t_hash long")
    # The row's number keeps rows apart that share an id; it is made once, in the scan, and only carried from there.
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), _scan_row(F.col(text_col).cast("string"), k, _sieve([r[-1] for r in rows]), base).alias("s"))
    counts = [F.size(F.col(f"s.p{i}")) for i in range(len(base))]
    all_places = F.concat(*[F.col(f"s.p{i}") for i in range(len(base))])
    labels = F.array_compact(F.array(*[F.when(F.size(F.col(f"s.p{i}")) > 0, F.lit(label)) for i, (_, label) in enumerate(base)]))
    stats = narrow.select(
        "row", "doc_id", F.col("s.n_words").alias("n_words"), sum(counts[1:], counts[0]).cast("long").alias("n_base"), F.array_min(all_places).cast("long").alias("first_word"),
        F.array_max(all_places).cast("long").alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("base"), F.explode_outer("s.hits").alias("hit"),
    )
    own = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base"]
    votes = stats.select(*own, F.col("hit.pos").alias("pos"), F.col("hit.hash").alias("hash")).join(F.broadcast(known), F.col("hash") == F.col("t_hash"), "left")
    diagonals = votes.repartition("row").groupBy(*own, "template", "label", "t_words", "t_grams", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.collect_set("t_hash").alias("grams"), F.min("pos").alias("a"), F.max("pos").alias("b")
    )
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    fresh = F.when(F.col("diagonal") - F.lag("diagonal").over(line) <= gap, 0).otherwise(1)
    merged = diagonals.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(line))
    spans = merged.groupBy(*own, "template", "label", "t_words", "t_grams", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("grams")))).alias("found"), F.min("a").alias("a"), F.max("b").alias("b")
    )
    share = F.col("found") / F.col("t_grams")
    length = F.col("b") - F.col("a") + k
    verified = F.when((share >= coverage) & (length <= STRETCH * F.col("t_words")), F.struct(F.col("a").cast("long").alias("first"), length.cast("long").alias("words"), "label", share.alias("share")))
    out = spans.groupBy(*own).agg(F.array_sort(F.collect_list(verified)).alias("spans"))
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s.share)), F.lit(0.0))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.transform("spans", lambda s: s.label)))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"), "spans",
    )
