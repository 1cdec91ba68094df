"""Language identification by inference of a multilingual mixture.

Learning counts hashed byte n-grams (2 to 4 bytes of the lower-cased text, a power of two of buckets) for every
language over all labelled training rows; counts are summed in Spark and only the table of languages x buckets comes
to the driver, whose size doesn't depend on the corpus. With additive smoothing it gives p(n-gram | language).

A document is a mixture: each of its n-grams comes from language l with proportion w_l. Expectation-maximisation
estimates the proportions over its whole text. The set of languages is chosen by penalised likelihood: starting from
the best single language, the language with the largest proportion in the full mixture that isn't in the set is added
as long as the log-likelihood of the refitted mixture rises by more than `penalty` * log(number of n-grams) for it.
The prediction is the language of the set with the largest proportion, the score that proportion.

A filter (`keep_known`) asks besides whether the languages explain a text at all: the likelihood of its set is held
against that of noise, which gives every n-gram bucket the same probability. A text whose n-grams noise makes more
probable by a factor of e^NOISE on average, as those of an alphabet that no label has, is in none of the languages.

Null texts and texts without a letter are "und" with score 0. Without any labelled row every text is "und". Rows
with null lang aren't learned from; rows with null ids are (they are in no fold). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal

BUCKETS = 1 << 15
ROUNDS = 8
PENALTY = 12.0
SMOOTH = 0.05
NOISE = 3.5
UNKNOWN = "und"
#: Bytes of text whose n-grams one step holds.
SPAN = 1 << 20
#: Rows that the filter holds a copy of.
ROWS_AT_ONCE = 2048

PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, langs array<string>, shares array<double>"


def ngrams(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of all 2- to 4-grams of the bytes of the whole text, lower-cased."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)
    total = np.zeros(buckets, np.int64)
    for at in range(0, len(raw), SPAN):
        x = raw[at : at + SPAN + 3].astype(np.uint32)
        two = x[:-1] << np.uint32(8) | x[1:]
        three = two[:-1] << np.uint32(8) | x[2:]
        four = three[:-1] << np.uint32(8) | x[3:]
        for n, g in ((2, two), (3, three), (4, four)):
            hashed = ((g + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - buckets.bit_length() + 1)
            total += np.bincount(hashed[:SPAN], minlength=buckets)
    found = np.flatnonzero(total)
    return found, total[found]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def held_out(id_col: Column) -> Column:
    """The rows that are never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def _count(buckets: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at, n = ngrams(text.as_py(), buckets)
                seen.setdefault(lang, np.zeros(buckets, np.int64))[at] += n
        for lang, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])

    return run


class Model:
    """Languages in the order of their names and log p(n-gram | language), buckets by languages."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        raised = counts.astype(np.float64) + SMOOTH
        self.p = (raised / raised.sum(0)).astype(np.float64)
        self.log_p = np.log(self.p)

    def mixture(self, p: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
        """Proportions by expectation-maximisation, and the log-likelihood."""
        w = np.full(p.shape[1], 1 / p.shape[1])
        total = n.sum()
        for _ in range(rounds):
            w = w * ((n / (p @ w)) @ p) / total
        return w, float(n @ np.log(p @ w))

    def infer(self, text: str) -> tuple[list[int], np.ndarray, float, float, float]:
        """(languages of the set, their proportions, score of the best, log-likelihood of the set, number of n-grams)."""
        at, n = ngrams(text, len(self.p))
        n = n.astype(np.float64)
        total = float(n.sum())
        single = n @ self.log_p[at]
        best = int(single.argmax())
        chosen, weights, likelihood, score = [best], np.ones(1), float(single[best]), 1.0
        if len(self.langs) > 1:
            p = self.p[at]
            full, most = self.mixture(p, n)
            cost = PENALTY * np.log(total)
            if most - likelihood > cost:
                for k in np.argsort(-full, kind="stable").tolist():
                    if k in chosen:
                        continue
                    w, now = self.mixture(p[:, [*chosen, k]], n)
                    if now - likelihood <= cost:
                        break
                    chosen, weights, likelihood = [*chosen, k], w, now
            score = float(full[chosen[int(weights.argmax())]]) if len(chosen) == 1 else float(weights.max())
        return chosen, weights, min(1.0, max(0.0, score)), likelihood, total

    def predict(self, text: str | None) -> tuple[str, float, list[str], list[float]]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, [], []
        chosen, weights, score, _, _ = self.infer(text)
        order = np.argsort(-weights, kind="stable").tolist()
        return self.langs[chosen[order[0]]], score, [self.langs[chosen[i]] for i in order], [float(weights[i]) for i in order]

    def explained(self, text: str | None, margin: float = NOISE) -> str | None:
        """The best language of a text unless noise explains each of its n-grams better by margin, on average; then None, as without a letter."""
        if not self.langs or not has_letter(text):
            return None
        chosen, weights, _, likelihood, total = self.infer(text)
        return self.langs[chosen[int(weights.argmax())]] if likelihood >= -total * (np.log(len(self.p)) + margin) else None


def train(docs: DataFrame, buckets: int = BUCKETS, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Learn from every row of docs with a language and a text."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    summed = rows.mapInArrow(_count(buckets), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = summed.toArrow()  # at most languages x buckets rows
    langs = sorted(set(found.column("lang").to_pylist()))
    counts = np.zeros((buckets, len(langs)), np.int64)
    index = {x: i for i, x in enumerate(langs)}
    counts[found.column("bucket").to_numpy(), [index[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    return Model(langs, counts)


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            rows = list(zip(*[own.predict(t.as_py()) for t in batch.column(2)], strict=True)) or [()] * 4
            kinds = (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]], names=["doc_id", "held_out", "lang_pred", "score", "langs", "shares"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """One row a document; learns from the rows of docs that aren't held out, predicts all."""
    model = train(docs.where(~held_out(F.col(id_col))), lang_col=lang_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predict(shared), PREDICTED)


def _keep(model, text_at: int, lang_at: int, margin: float):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            found = pa.array([own.explained(t.as_py(), margin) if own.langs else UNKNOWN if has_letter(t.as_py()) else None for t in batch.column(text_at)], pa.string())
            if own.langs:
                column = batch.column(lang_at)
                batch = batch.set_column(lang_at, batch.schema.field(lang_at), pc.coalesce(column, found.cast(column.type)))
            yield batch.filter(pc.is_valid(found))

    return run


def keep_known(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", margin: float = NOISE) -> DataFrame:
    """The rows of docs whose text is in the languages of docs; where lang is null it becomes the inferred one, all else stays.

    Learns from all rows with a language. Rows go whose text is null, has no letter, or is explained by noise far
    better than by any mixture of the languages (see `Model.explained`). With nothing to learn from, texts with a letter stay.
    """
    model = train(docs, lang_col=lang_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keep(shared, docs.columns.index(text_col), docs.columns.index(lang_col), margin), docs.schema)
