import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import ann


def truth(vectors, queries, k=5):
    ids = [i for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    own = {i: np.array(v, float) for i, v in vectors if i in ids}
    out = {}
    for q in queries:
        if q in own:
            found = sorted((-(own[q] @ v) / np.linalg.norm(own[q]) / np.linalg.norm(v), i) for i, v in own.items() if i != q and len(v) == len(own[q]))
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


def run(spark, vectors, **more):
    frame = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in vectors], "vec_id long, embedding array<double>")
    own = ann.valid_vectors(frame)
    got: dict = {}
    for r in ann.nearest(own, own.where(F.col("id") % 50 == 0), **more).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


@pytest.mark.parametrize("shard_rows", [100_000, 400])
def test_recall(spark, shard_rows):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(10, 32))
    vectors = [(i, (centres[i % 10] + rng.normal(size=32)).tolist()) for i in range(3000)]
    want, got = truth(vectors, range(0, 3000, 50)), run(spark, vectors, shard_rows=shard_rows)
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.95
    assert all(s == pytest.approx(dict((i, x) for i, x in truth(vectors, [q], 3000)[q])[i], abs=1e-12) for q in list(want)[:3] for i, s in got[q])


def test_ties_nulls_and_repeats(spark):
    base = [1.0, 2.0, 3.0]
    vectors = [(i, base) for i in range(0, 60)] + [(100, [0.0, 0.0, 0.0]), (101, None), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 1.0]), (104, []), (150, [3.0, 2.0, 1.0]), (150, [3.0, 2.0, 1.0]), (None, base), (200, [1.0, 1.0])]
    got = run(spark, vectors)
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[50]] == [0, 1, 2, 3, 4]
    assert [i for i, _ in got[150]] == [0, 1, 2, 3, 4] and set(got) == {0, 50, 150}
    assert run(spark, []) == {}


def test_fewer_candidates_than_asked_for(spark):
    assert [i for i, _ in run(spark, [(50, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])])[50]] == [1, 2]


def test_equal_in_single_precision(spark):
    """More vectors than a few that only double precision tells apart: the nearest and the smallest ids of ties are found."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=16)
    vectors = [(0, base.tolist())] + [(i, (base + rng.normal(size=16) * 1e-5 * (61 - i)).tolist()) for i in range(1, 61) if i != 50]
    assert [i for i, _ in run(spark, vectors)[0]] == [i for i, _ in truth(vectors, [0])[0]]


def test_parallel_vectors_are_ties(spark):
    """More parallel vectors than the beam holds: all cosines are equal, so the smallest ids win."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=8)
    vectors = [(i, (base * (1 + i % 7) * (i + 1)).tolist()) for i in range(400)] + [(1000 + i, rng.normal(size=8).tolist()) for i in range(300)]
    got = run(spark, vectors)
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[350]] == [0, 1, 2, 3, 4]


def test_almost_equal_and_long_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=3000)
    vectors = [(i, (base + rng.normal(size=3000) * 1e-9).tolist()) for i in range(0, 120)]
    want, got = truth(vectors, [0, 50, 100]), run(spark, vectors)
    assert all(s == pytest.approx(dict(truth(vectors, [q], 200)[q])[i], abs=1e-12) for q in want for i, s in got[q])
    assert all(min(s for _, s in got[q]) >= want[q][-1][1] - 1e-12 for q in want)


def test_other_columns_may_have_any_name(spark):
    frame = spark.createDataFrame([(i, [float(i), 1.0], 1, 2, 3) for i in range(60)], "vec_id long, embedding array<double>, dim int, shard int, id long")
    own = ann.valid_vectors(frame)
    assert ann.nearest(own, own.where(F.col("id") % 50 == 0)).count() == 10


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_embeddings(spark, sf):
    """All queries of the table against brute force."""
    own = ann.valid_vectors(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet"))
    rows = own.collect()
    ids, x = np.array([r.id for r in rows]), np.array([r.vec for r in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    got: dict = {}
    for r in ann.nearest(own, own.where(F.col("id") % 50 == 0)).collect():
        got.setdefault(r.query_id, []).append(r.score)
    hits = 0
    for q in got:
        sims = x @ x[np.flatnonzero(ids == q)[0]]
        best = np.sort(sims[ids != q])[::-1][:5]
        hits += sum(s >= best[-1] - 1e-9 for s in got[q])
    assert len(got) == (ids % 50 == 0).sum() and hits / (5 * len(got)) >= 0.97
