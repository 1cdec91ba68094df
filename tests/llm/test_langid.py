import random
import zlib

import numpy as np
import pytest

from corpusmill.llm import langid

SYLLABLES = {"aa": ("th", "ing", "er", "on", "and"), "bb": ("sch", "ung", "ei", "ver", "ich"), "cc": ("eau", "oux", "que", "ment", "lle")}


def made(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(spark, n=600):
    rng = random.Random(0)
    langs = [rng.choice(list(SYLLABLES)) for _ in range(n)]
    return spark.createDataFrame([(i, made(x, rng.randint(3, 80), rng), x, "s", 1) for i, x in enumerate(langs)], "doc_id long, text string, lang string, source string, length int")


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 600 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert 100 < len(held) < 200 and sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_is_learned_from_held_out_rows(spark):
    docs = corpus(spark).collect()
    swapped = spark.createDataFrame([(r.doc_id, r.text, "zz" if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 else r.lang) for r in docs], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(swapped).collect()} == set(SYLLABLES)


def test_mixtures(spark):
    rng = random.Random(1)
    model = langid.train(corpus(spark))
    lang, score, langs, shares = model.predict(made("aa", 300, rng) + " " + made("cc", 150, rng))
    assert (lang, langs) == ("aa", ["aa", "cc"]) and 0.5 < score < 0.85 and abs(sum(shares) - 1) < 1e-6
    assert model.predict(made("bb", 200, rng))[2] == ["bb"]


def test_likelihood_never_falls(spark):
    import numpy as np

    model = langid.train(corpus(spark))
    at, n = langid.ngrams(made("aa", 50, random.Random(2)) + made("bb", 50, random.Random(3)))
    values = [model.mixture(model.p[at], n.astype(float), r)[1] for r in range(12)]
    assert all(b >= a - 1e-6 for a, b in zip(values, values[1:], strict=False)) and np.isclose(model.mixture(model.p[at], n.astype(float))[0].sum(), 1)


def test_odd_rows(odd, none):
    got = {r.doc_id: r for r in langid.identify(odd).collect()}
    assert [got[i].lang_pred for i in (2, 3, 4, 5)] == ["und"] * 4 and got[2].score == 0.0
    assert got[1].lang_pred == "en" and got[None].held_out is False
    assert langid.identify(none).count() == 0
    kept = langid.keep_known(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 6, 6, 7, 8, 9, 10]
    assert langid.keep_known(none).count() == 0


def test_without_labels_everything_is_unknown(spark):
    docs = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(docs).collect()] == ["und"]


def test_ngrams_over_spans(monkeypatch):
    text = "some words of every kind " * 20
    whole = [x.tolist() for x in langid.ngrams(text)]
    monkeypatch.setattr(langid, "SPAN", 37)
    assert [x.tolist() for x in langid.ngrams(text)] == whole


def test_without_labels_texts_with_letters_are_kept(spark):
    docs = spark.createDataFrame([(1, "words", None), (2, "...", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in langid.keep_known(docs).collect()] == [1]


def test_texts_in_no_learned_language_go(spark):
    """Noise, and an alphabet that no label has, are rejected; languages and their mixtures stay, at any length."""
    rng = random.Random(4)
    noise = lambda n: "".join(chr(rng.choice((rng.randrange(0x4E00, 0x9F00), rng.randrange(0x400, 0x4FF)))) for _ in range(n))
    known = corpus(spark)
    rows = [(1000, noise(400), None), (1001, noise(4000), None), (1002, made("aa", 40, rng) + " " + made("cc", 40, rng), None), (1003, made("bb", 1, rng), None), (1004, made("cc", 3000, rng), None)]
    kept = langid.keep_known(known.select("doc_id", "text", "lang").unionAll(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).collect()
    langs = {r.doc_id: r.lang for r in kept}
    assert set(range(600)) <= set(langs) and set(langs) - set(range(600)) == {1002, 1003, 1004}
    assert langs[1002] in ("aa", "cc") and langs[1003] == "bb" and langs[1004] == "cc"
    assert all(langs[r.doc_id] == r.lang for r in known.collect())


def plain_mixture(model, text, rounds):
    """Expectation-maximisation over single n-grams, one after the other."""
    raw = (" " + text.lower() + " ").encode()
    grams = []
    for n in (2, 3, 4):
        for i in range(len(raw) - n + 1):
            value = (int.from_bytes(raw[i : i + n], "big") + n) * 2654435761 % 2**32
            grams.append(value >> (32 - langid.BUCKETS.bit_length() + 1))
    w = [1 / len(model.langs)] * len(model.langs)
    for _ in range(rounds):
        shares = [0.0] * len(w)
        for g in grams:
            parts = [a * b for a, b in zip(w, model.p[g], strict=True)]
            shares = [s + x / sum(parts) for s, x in zip(shares, parts, strict=True)]
        w = [s / len(grams) for s in shares]
    return w, grams


def test_against_a_plain_mixture(spark):
    """Proportions and the penalised set against a plain implementation that tries the sets in the same order."""
    import math

    import numpy as np

    rng = random.Random(6)
    model = langid.train(corpus(spark))
    for text in (made("aa", 30, rng), made("aa", 60, rng) + " " + made("bb", 40, rng), made("bb", 5, rng) + " " + made("cc", 50, rng) + " " + made("aa", 45, rng), made("cc", 2, rng)):
        full, grams = plain_mixture(model, text, langid.ROUNDS)
        at, n = langid.ngrams(text)
        assert np.allclose(model.mixture(model.p[at], n.astype(float))[0], full, atol=1e-9)

        def fitted(langs):
            part = langid.Model([model.langs[i] for i in langs], np.zeros((langid.BUCKETS, len(langs))))
            part.p = model.p[:, langs]
            w, _ = plain_mixture(part, text, langid.ROUNDS) if len(langs) > 1 else ([1.0], None)
            return sum(math.log(sum(a * b for a, b in zip(w, part.p[g], strict=True))) for g in grams), w

        singles = [fitted([i])[0] for i in range(3)]
        chosen = [int(np.argmax(singles))]
        held, weights = fitted(chosen)
        for i in sorted(range(3), key=lambda i: -full[i]):
            if i not in chosen:
                now, w = fitted([*chosen, i])
                if now - held <= langid.PENALTY * math.log(len(grams)):
                    break
                chosen, held, weights = [*chosen, i], now, w
        lang, _, langs, shares = model.predict(text)
        assert lang == model.langs[chosen[int(np.argmax(weights))]] and set(langs) == {model.langs[i] for i in chosen}
        assert sorted(shares) == pytest.approx(sorted(weights), abs=1e-9)


def test_a_very_long_text(spark):
    rng = random.Random(8)
    model = langid.train(corpus(spark))
    text = made("bb", 120_000, rng) * 3
    assert len(text) > 2 * langid.SPAN and model.predict(text)[0] == "bb" and model.explained(text) == "bb"


def test_the_filter_holds_few_rows_at_a_time(prose):
    """It gives the rows of a large batch in smaller ones, in their order."""
    from types import SimpleNamespace

    import pyarrow as pa

    texts = [None if i % 5 == 0 else t for i, t in enumerate(prose(50, words=6) * 100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(texts), pa.nulls(5000, pa.string())], names=["doc_id", "text", "lang"])
    for langs in ([], ["a"]):
        model = SimpleNamespace(value=langid.Model(langs, np.ones((langid.BUCKETS, len(langs)), np.int64)))
        got = list(langid._keep(model, 1, 2, langid.NOISE)([batch, batch.slice(0, 0)]))
        assert max(b.num_rows for b in got) <= langid.ROWS_AT_ONCE
        assert [x for b in got for x in b.column(0).to_pylist()] == [i for i in range(5000) if i % 5]
        assert {x for b in got for x in b.column(2).to_pylist()} == {langs[0] if langs else None}
