"""One query for each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, langid, licenses, line_dedup, lm, media, packing, simhash, warc
from .common import table

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary file is; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("source")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(table(spark, sf_dir, "pages"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), public_tokenizers.PATTERN)


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.valid_vectors(table(spark, sf_dir, "embeddings"))
    return ann.nearest(vectors, vectors.where(F.col("id") % 50 == 0))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).drop("langs", "shares")


def queries() -> dict:
    own = (op1_packing, op2_line_dedup, op3_simhash, op4_licenses, op5_lm_scores, op6_warc, op7_byte_bpe, op8_hnsw, op9_media, op10_langid)
    return {f.__name__: f for f in own}


def _line_dedup_sql(ratio: float = line_dedup.RATIO) -> str:
    return f"""
with pages as (select doc_id, source, text, row_number() over () as r, case when text is null then [] else string_split(text, chr(10)) end as lines from documents),
totals as (select source, count(*) as pages from pages group by source),
each as (select source, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x)), lambda x: x <> ''))) as line from pages),
bad as (select e.source, e.line from each e join totals t on e.source is not distinct from t.source group by e.source, e.line, t.pages having count(*) > 1 and count(*) > {ratio} * t.pages),
sets as (select source, list(line) as bad from bad group by source),
kept as (select p.doc_id, p.text, p.lines, case when s.bad is null then p.lines else list_filter(p.lines, lambda x: not list_contains(s.bad, trim(x))) end as left_lines from pages p left join sets s on p.source is not distinct from s.source)
select doc_id, case when len(left_lines) = len(lines) then text else array_to_string(left_lines, chr(10)) end as text, cast(len(left_lines) as bigint) as lines_kept, cast(len(lines) - len(left_lines) as bigint) as lines_dropped from kept"""


def _licenses_sql() -> str:
    k = licenses.K
    rows = ", ".join(f"({t}, '{label}', '{text}')" for t, (label, text) in enumerate(licenses.TEMPLATES))
    gram = " || ' ' || ".join(f"words[i + {j}]" for j in range(k))
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in licenses.BASE)
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
with docs as (select row_number() over () as r, doc_id, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
templates as (select t, label, words, len(words) as t_words from (select t, label, string_split(text, ' ') as words from (values {rows}) v(t, label, text))),
tgrams as (select t, label, t_words, i, {gram} as gram from (select *, unnest(range(1, t_words - {k} + 2)) as i from templates)),
sizes as (select t, count(distinct gram) as t_grams from tgrams group by t),
grams as (select r, i, {gram} as gram from (select *, unnest(range(1, len(words) - {k} + 2)) as i from docs)),
votes as (select g.r, t.t, t.label, t.t_words, g.i as pos, g.i - t.i as diagonal, g.gram from grams g join tgrams t on g.gram = t.gram),
diagonals as (select r, t, label, t_words, diagonal, min(pos) as a, max(pos) as b from votes group by all),
fresh as (select *, case when diagonal - lag(diagonal) over (partition by r, t order by diagonal) <= {licenses.GAP} then 0 else 1 end as f from diagonals),
islands as (select *, sum(f) over (partition by r, t order by diagonal) as span from fresh),
spans as (select i.r, i.t, i.label, i.t_words, i.span, min(i.a) as a, max(i.b) as b, count(distinct v.gram) as found from islands i join votes v on v.r = i.r and v.t = i.t and v.diagonal = i.diagonal group by i.r, i.t, i.label, i.t_words, i.span),
good as (select s.r, s.label, s.found / z.t_grams as share from spans s join sizes z on s.t = z.t where s.found / z.t_grams >= {licenses.COVERAGE} and s.b - s.a + {k} <= {licenses.STRETCH} * s.t_words),
found as (select r, list(distinct label) as labels, max(share) as share from good group by r),
phrases as (select * from (values {phrases}) p(phrase, label, n)),
places as (select d.r, p.label, unnest(list_filter(range(1, len(d.words) - p.n + 2), lambda i: array_to_string(d.words[i:i + p.n - 1], ' ') = p.phrase)) - 1 as place from docs d, phrases p where list_contains(d.words, 'license')),
base as (select r, count(*) as n_base, min(place) as first_word, max(place) as last_word, list(distinct label) as labels from places group by r)
select d.doc_id, cast(len(d.words) as bigint) as n_words, cast(coalesce(b.n_base, 0) as bigint) as n_base, cast(b.first_word as bigint) as first_word, cast(b.last_word as bigint) as last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') as base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ','), '') as labels,
  case when coalesce(b.n_base, 0) > 0 then 1.0::double else coalesce(f.share, 0)::double end as score
from docs d left join base b on d.r = b.r left join found f on d.r = f.r"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": _line_dedup_sql(), "op4_licenses": _licenses_sql()}
