"""Document quality: five scores, their weighted sum, tier, findings, metrics and routing, as expressions over one text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import BLANK, count_matches, let, lines, re2, share, strip, words

#: Patterns of recognition errors, of structure (line by line) and of gibberish (any case).
OCR_PATTERNS = (r"[Il1]{3,}", r"[O0]{3,}", r"[^\x00-\x7F]{5,}", r"\b[a-z]+[A-Z]+[a-z]+\b", r"[.,]{3,}", r"\s{5,}", r"[|]{2,}", r"[_]{5,}", r"\b\w{20,}\b")
STRUCTURE_PATTERNS = (r"^#{1,6}\s+\w+", r"^\d+\.\s+\w+", r"^[A-Z][A-Z\s]+:", r"^\s*•\s+\w+", r"^(Section|Article|Chapter)\s+\d+", r"^Table\s+\d+", r"^Figure\s+\d+")
GIBBERISH_PATTERNS = (r"[bcdfghjklmnpqrstvwxz]{5,}", r"[aeiou]{5,}", r"(.)\1{4,}")
COMMON_WORDS = ("the", "a", "an", "is", "are", "was", "were", "of", "to", "and", "in", "for", "on", "with")

#: Weights, tier thresholds, and what each tier asks for.
WEIGHTS = {"text": 0.25, "ocr": 0.30, "format": 0.15, "structure": 0.15, "coherence": 0.15}
TIERS = (("high", 0.8), ("medium", 0.5), ("low", 0.2))
PIPELINES = {"high": ("hierarchical", False), "medium": ("standard", False), "low": ("simple", True), "garbage": ("manual", True)}
CONFIGS = {
    "high": {"chunking_strategy": "hierarchical", "chunk_sizes": {"section": 2000, "paragraph": 400, "sentence": 100}, "enable_table_extraction": True, "enable_metadata_extraction": True, "enable_structure_detection": True, "cleanup_level": "minimal"},
    "medium": {"chunking_strategy": "standard", "chunk_sizes": {"paragraph": 500}, "enable_table_extraction": True, "enable_metadata_extraction": True, "enable_structure_detection": False, "cleanup_level": "moderate", "ocr_cleanup": True},
    "low": {"chunking_strategy": "simple", "chunk_sizes": {"fixed": 400}, "chunk_overlap": 50, "enable_table_extraction": False, "enable_metadata_extraction": False, "enable_structure_detection": False, "cleanup_level": "aggressive", "ocr_cleanup": True, "flag_for_review": True},
    "garbage": {"chunking_strategy": "minimal", "chunk_sizes": {"fixed": 300}, "enable_table_extraction": False, "enable_metadata_extraction": False, "cleanup_level": "aggressive", "flag_for_review": True, "skip_embedding": True},
}
#: Fixed values: (score, below, finding).
ISSUES = (("text", 0.5, "Poor text extraction quality"), ("ocr", 0.5, "Significant OCR artifacts detected"), ("format", 0.5, "Document formatting is inconsistent"), ("coherence", 0.5, "Text coherence is poor - possible garbage content"))
WARNINGS = (("text", 0.7, "Text extraction has some issues"), ("ocr", 0.7, "Some OCR artifacts present"), ("format", 0.7, "Minor formatting inconsistencies"), ("structure", 0.4, "Limited document structure detected"), ("coherence", 0.7, "Some coherence issues detected"))
NEARLY_EMPTY = "Text extraction failed or document is nearly empty"


def _ladder(value: Column, steps: tuple[tuple[float, float], ...]) -> Column:
    """The penalty of the first step that value exceeds, else 0."""
    out = F.when(value > steps[0][0], steps[0][1])
    for above, penalty in steps[1:]:
        out = out.when(value > above, penalty)
    return out.otherwise(0.0)


def text_score(text: Column) -> Column:
    n = F.length(text)
    alpha = let(share(text, r"\p{L}"), lambda a: F.when(a < 0.3, 0.3).when(a < 0.5, 0.1).otherwise(0.0))
    control = let(F.length(F.regexp_replace(text, r"[^\x00-\x08\x0B\x0C\x0E-\x1F]", "")), lambda c: F.when(c > 0, F.least(F.lit(0.3), c / n * 10)).otherwise(0.0))

    def score(n_words: Column) -> Column:
        own = F.lit(1.0) - F.when(n_words < 50, 0.3).otherwise(0.0) - alpha - control
        return F.when(n_words < 10, 0.1).otherwise(F.greatest(F.lit(0.0), own))

    return let(F.size(words(text)), score)


def ocr_score(text: Column) -> Column:
    per_thousand = F.length(text) / 1000
    errors = count_matches(text, OCR_PATTERNS) / per_thousand
    # A repeated character is one in any case, beyond ASCII too.
    runs = [p for p in GIBBERISH_PATTERNS if r"\1" in p]
    gibberish = (count_matches(text, [f"(?i){p}" for p in GIBBERISH_PATTERNS if p not in runs]) + count_matches(F.lower(text), runs)) / per_thousand
    penalty = let(errors, lambda e: _ladder(e, ((10, 0.5), (5, 0.3), (2, 0.1))))
    return F.greatest(F.lit(0.0), 1.0 - penalty - let(gibberish, lambda g: _ladder(g, ((5, 0.3), (2, 0.15)))))


def _variance(values: Column) -> Column:
    """Population variance by running means, in the steps of the SQL's, so that both stand on one side of a threshold."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def step(s: Column, x: Column) -> Column:
        mean = s["mean"] + (x - s["mean"]) / (s["n"] + 1.0)
        return F.struct((s["n"] + 1.0).alias("n"), mean.alias("mean"), (s["squares"] + (x - mean) * (x - s["mean"])).alias("squares"))

    return F.aggregate(values, start, step, lambda s: F.when(s["n"] > 0, s["squares"] / s["n"]))


def format_score(text: Column) -> Column:
    def score(own: Column) -> Column:
        full = F.filter(own, lambda x: F.rlike(x, F.lit(f"[^{BLANK}]")))
        lengths = F.transform(full, lambda x: F.length(x).cast("double"))
        variance = _variance(lengths)
        indents = F.array_distinct(F.transform(full, lambda x: F.length(x) - F.length(F.regexp_replace(x, re2(r"^\s+"), ""))))
        some = F.size(full) > 0
        out = 1.0 - F.when(some & (variance > 10000), 0.2).otherwise(0.0)
        out = out - F.when((F.size(own) - F.size(full)) / F.size(own) > 0.5, 0.2).otherwise(0.0)
        return F.greatest(F.lit(0.0), out - F.when(some & (F.size(indents) > 20), 0.1).otherwise(0.0))

    return let(lines(text), score)


def structure_score(text: Column) -> Column:
    n = count_matches(text, [f"(?m){p}" for p in STRUCTURE_PATTERNS])
    return let(n, lambda k: F.when(k > 20, 1.0).when(k > 10, 0.85).when(k > 5, 0.7).when(k > 0, 0.6).otherwise(0.5))


def coherence_score(text: Column) -> Column:
    common = F.array(*[F.lit(w) for w in COMMON_WORDS])

    def score(own: Column) -> Column:
        n = F.size(own)
        mean = F.aggregate(own, F.lit(0).cast("long"), lambda s, w: s + F.length(w)) / n
        unique = F.size(F.array_distinct(own)) / n
        out = 1.0 - let(mean, lambda m: F.when((m < 2) | (m > 12), 0.3).when((m < 3) | (m > 8), 0.1).otherwise(0.0))
        out = out - let(unique, lambda u: F.when(u < 0.1, 0.3).when((u > 0.95) & (n > 500), 0.1).otherwise(0.0))
        out = out - F.when(F.size(F.filter(own, lambda w: F.array_contains(common, w))) / n < 0.01, 0.2).otherwise(0.0)
        return F.when(n < 20, 0.5).otherwise(F.greatest(F.lit(0.0), out))

    return let(words(F.lower(text)), score)


def metrics(text: Column) -> Column:
    """Counts and ratios of a text as a struct."""

    def of(own: Column) -> Column:
        n = F.size(own)
        letters = F.regexp_replace(text, r"[^\p{L}]", "")
        lower = F.transform(own, F.lower)
        mean = F.when(n > 0, F.aggregate(own, F.lit(0).cast("long"), lambda s, w: s + F.length(w)) / n).otherwise(0.0)
        upper = F.when(F.length(letters) > 0, F.length(F.regexp_replace(letters, r"[^\p{Lu}]", "")) / F.length(letters)).otherwise(0.0)
        special = F.when(F.length(text) > 0, F.length(F.regexp_replace(text, re2(r"[\p{L}\p{N}\s]"), "")) / F.length(text)).otherwise(0.0)
        return F.struct(
            F.length(text).cast("long").alias("char_count"), n.cast("long").alias("word_count"), F.size(lines(text)).cast("long").alias("line_count"), mean.alias("avg_word_length"),
            F.when(n > 0, F.size(F.array_distinct(lower)) / n).otherwise(0.0).alias("unique_word_ratio"), upper.alias("uppercase_ratio"),
            share(text, r"\p{Nd}").alias("digit_ratio"), special.alias("special_char_ratio"),
        )

    return let(words(text), of)


def with_quality(frame: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """frame with the five scores, overall score, tier, issues, warnings, pipeline and review flag; narrow, no shuffle.

    Texts of under 50 characters between blanks (null ones too) score 0 and are garbage. The tier comes from the
    unrounded score.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    empty = F.length(strip(text)) < 50
    scores = {"text": text_score, "ocr": ocr_score, "format": format_score, "structure": structure_score, "coherence": coherence_score}
    own = {k: f"{prefix}{k}_score" for k in scores}
    out = frame.select("*", *[F.when(empty, 0.0).otherwise(f(text)).alias(own[k]) for k, f in scores.items()], empty.alias("__cm_empty"))
    total = sum((F.lit(w) * F.col(own[k]) for k, w in list(WEIGHTS.items())[1:]), F.lit(WEIGHTS["text"]) * F.col(own["text"]))
    out = out.withColumn(f"{prefix}overall_score", total)
    tier = F.when(F.col(f"{prefix}overall_score") >= TIERS[0][1], TIERS[0][0])
    for name, least in TIERS[1:]:
        tier = tier.when(F.col(f"{prefix}overall_score") >= least, name)
    out = out.withColumn(f"{prefix}tier", tier.otherwise("garbage"))
    issues = F.when(F.col("__cm_empty"), F.array(F.lit(NEARLY_EMPTY))).otherwise(F.array_compact(F.array(*[F.when(F.col(own[k]) < t, F.lit(m)) for k, t, m in ISSUES])))
    serious = {k: t for k, t, _ in ISSUES}
    warnings = F.array_compact(F.array(*[F.when((F.col(own[k]) < t) & (F.col(own[k]) >= serious.get(k, -1.0)), F.lit(m)) for k, t, m in WARNINGS]))
    pipeline, review = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for name, (p, r) in PIPELINES.items():
        pipeline, review = F.when(F.col(f"{prefix}tier") == name, p).otherwise(pipeline), F.when(F.col(f"{prefix}tier") == name, F.lit(r)).otherwise(review)
    return out.select(
        *[c for c in out.columns if c != "__cm_empty"], issues.alias(f"{prefix}issues"), F.when(F.col("__cm_empty"), F.array().cast("array<string>")).otherwise(warnings).alias(f"{prefix}warnings"),
        pipeline.alias(f"{prefix}recommended_pipeline"), review.alias(f"{prefix}manual_review"),
    )


def router_config(tier: Column) -> Column:
    """The processing configuration of a tier, as JSON."""
    import json

    out = F.lit(None).cast("string")
    for name, config in CONFIGS.items():
        out = F.when(tier == name, F.lit(json.dumps(config, sort_keys=True))).otherwise(out)
    return out
