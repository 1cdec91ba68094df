from collections import Counter

from corpusmill.llm.line_dedup import drop_boilerplate


def brute(rows, ratio):
    pages, lines = Counter(), Counter()
    for host, text in rows:
        pages[host] += 1
        lines.update({(host, x.strip(" ")) for x in (text or "").split("\n")} - {(host, "")})
    bad = {k for k, n in lines.items() if n > 1 and n > ratio * pages[k[0]]}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" ")) not in bad) for h, t in rows]


def test_brute_force(spark, prose):
    rows = [(f"h{i % 3}" if i % 7 else None, f"{t}\n  Home | About \nrare {i // 2}\n\n© all pages") if i % 11 else ("h0", None) for i, t in enumerate(prose(120, words=10))]
    docs = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(rows)], "doc_id long, source string, text string")
    for ratio in (0.02, 0.05, 0.3):
        got = [r.text for r in drop_boilerplate(docs, ratio).orderBy("doc_id").collect()]
        assert got == brute(rows, ratio)
        assert any("Home" not in (a or "Home") for a in got)


def test_odd_rows(odd, none):
    out = drop_boilerplate(odd)
    assert out.columns == [*odd.columns, "lines_kept", "lines_dropped"]
    rows = [(r.source, r.text) for r in odd.collect()]
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted((r.doc_id or 0, t or "") for r, t in zip(odd.collect(), brute(rows, 0.05), strict=True))
    assert drop_boilerplate(none).count() == 0


def test_boilerplate_alone_leaves_an_empty_text(spark):
    docs = spark.createDataFrame([(i, "h", "menu") for i in range(9)], "doc_id long, source string, text string")
    assert {(r.text, r.lines_kept, r.lines_dropped) for r in drop_boilerplate(docs).collect()} == {("", 0, 1)}


def test_no_python_in_the_plan(odd):
    plan = drop_boilerplate(odd)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_small_hosts_are_cleaned_by_their_ratio_alone(spark):
    docs = spark.createDataFrame([(1, "h", "menu\none"), (2, "h", "menu\ntwo"), (3, "g", "menu\nthree")], "doc_id long, source string, text string")
    assert {r.doc_id: r.text for r in drop_boilerplate(docs).collect()} == {1: "one", 2: "two", 3: "menu\nthree"}
    assert {r.doc_id: r.text for r in drop_boilerplate(docs, 1.0).collect()} == {1: "menu\none", 2: "menu\ntwo", 3: "menu\nthree"}


def test_columns_named_like_the_counts(spark):
    docs = spark.createDataFrame([(i, "h", "menu", "own", 7) for i in range(3)], "doc_id long, source string, text string, lines_kept string, lines_dropped int")
    assert {(r.lines_kept, r.lines_dropped) for r in drop_boilerplate(docs).collect()} == {(0, 1)}
    assert {tuple(r) for r in drop_boilerplate(docs, counts=False).collect()} == {(i, "h", "", "own", 7) for i in range(3)}


def test_very_long_texts(spark):
    long = "\n".join(f"line {i % 70_000}" for i in range(100_000))
    docs = spark.createDataFrame([(1, "h", long), (2, "h", "line 5\nother"), (3, "i", long)], "doc_id long, source string, text string")
    got = {r.doc_id: r for r in drop_boilerplate(docs).collect()}
    assert got[2].text == "other" and got[1].lines_dropped == 2 and got[3].text == long
