from corpusmill.llm import licenses
from corpusmill.llm.licenses import TEMPLATES


def scan(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: r for r in rows}


def test_base_counts(spark):
    got = scan(spark, ["Under the MIT License. the mit\nlicense! MITLicense", "General Public License, general public license; Apache-License", None, "license mit", "mit license " * 3])
    assert [(got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) for i in range(5)] == [(8, 2, 2, 5, "mit"), (8, 3, 0, 6, "apache,gpl"), (0, 0, None, None, ""), (2, 0, None, None, ""), (6, 3, 0, 4, "mit")]


def test_templates_are_found_whole_and_changed(spark):
    words = dict((label, text.split()) for label, text in TEMPLATES)["mit-text"]
    changed = words[:10] + ["some", "inserted", "words"] + words[10:30] + words[32:]
    got = scan(spark, ["before " + " ".join(words) + " behind", " ".join(changed), " ".join(reversed(words)), " ".join(words[:12])])
    assert got[0].labels == "mit-text" and got[0].score == 1.0 and (got[0].spans[0]["first"], got[0].spans[0]["words"]) == (1, len(words))
    assert got[1].labels == "mit-text" and 0.7 <= got[1].score < 1.0
    assert got[2].labels == "" and got[2].score == 0.0
    assert got[3].labels == "" and got[3].score == 0.0


def test_every_template_finds_itself(spark):
    got = scan(spark, [t for _, t in TEMPLATES])
    for i, (label, _) in enumerate(TEMPLATES):
        assert label in got[i].labels.split(",")


def test_odd_rows_and_plan(odd, none):
    out = licenses.scan(odd)
    assert out.count() == odd.count() and licenses.scan(none).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))


def test_only_ascii_letters_are_lowered(spark):
    """No other letter becomes one of a-z: words that only look alike aren't the phrase's."""
    got = scan(spark, ["MIT LICENSE", "MİT License", "KMIT License", "Apache Licenſe", "É é K k K"])
    assert [got[i].n_base for i in range(5)] == [1, 0, 0, 0, 0] and got[4].n_words == 5
