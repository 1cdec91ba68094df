import random

import numpy as np
import pytest

from corpusmill.llm import lm


def plain_log_p(net, around, identity):
    """The decisions on the way from the root to the identity's leaf, one after the other."""
    hidden = np.tanh(sum(net.embed[x].astype(float) * net.place[p] for p, x in enumerate(around)))
    node, total = 1, 0.0
    for level in range(lm.BITS):
        right = identity >> (lm.BITS - 1 - level) & 1
        logit = float(net.node[node] @ hidden + net.bias[node])
        total -= np.log1p(np.exp(-logit if right else logit))
        node = 2 * node + right
    assert node == lm.BUCKETS + identity
    return total


def trained_a_little(seed=0):
    rng = np.random.default_rng(seed)
    net = lm.Network()
    around, ids = rng.integers(0, 50, (400, 4)).astype(np.int32), rng.integers(0, 50, 400).astype(np.int32) * 600
    for _ in range(5):
        net.learn(around, ids)
    return net, around, ids


def test_gradient_is_the_derivative():
    net, around, ids = trained_a_little()
    arrays = (net.embed, net.place, net.node, net.bias)
    for own, (rows, change) in zip(arrays, net.gradients(around, ids), strict=True):
        assert len(set(rows.tolist())) == len(rows)
        flat = change.reshape(len(rows), -1)
        for k in np.argsort(-np.abs(flat).ravel())[:4].tolist():
            at = (rows[k // flat.shape[1]], *([k % flat.shape[1]] if own.ndim > 1 else []))
            held, moved = own[at], []
            for h in (-1e-2, 1e-2):
                own[at] = held + h
                moved.append(-net.log_p(around, ids).sum())
            own[at] = held
            assert (moved[1] - moved[0]) / 2e-2 == pytest.approx(flat.ravel()[k], rel=0.05, abs=1e-3)


def test_score_is_the_sum_over_places():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    texts = [" ".join(f"W{i}" for i in rng.integers(0, 60, n)) for n in (40, 1, 2, 0, 25)] + [None, "  padded text \n"]
    model = lm.Model(trained_a_little()[0].flat())
    counts, sums = model.scores(pa.array(texts))
    for text, n, got in zip(texts, counts, sums, strict=True):
        ids = lm.identities(pa.array([" ".join((text or "").lower().split())]))[0].tolist()
        want = sum(plain_log_p(model.net, [ids[i + p] if 0 <= i + p < len(ids) else lm.BUCKETS for p in lm.PLACES], x) for i, x in enumerate(ids))
        assert n == len(ids) == len((text or "").split()) and got == pytest.approx(want, rel=1e-5)


def test_probabilities_of_all_identities_sum_to_one():
    net, around, _ = trained_a_little()
    every = np.arange(lm.BUCKETS, dtype=np.int32)
    assert np.exp(net.log_p(np.repeat(around[:1], lm.BUCKETS, 0), every)).sum() == pytest.approx(1, rel=1e-4)


def test_context_changes_the_word_within_any_group():
    """Both sides of a place matter to every bit of a prediction: two contexts tell any two identities apart after training."""
    net = lm.Network()
    around = np.array([[1, 2, 3, 4], [5, 6, 7, 8]] * 50, np.int32)
    ids = np.array([0b000000000000010, 0b000000000000011] * 50, np.int32)  # they part at the last level
    for _ in range(60):
        net.learn(around, ids)
    a, b = (net.log_p(around[:2], ids[k : k + 1].repeat(2)) for k in (0, 1))
    assert a[0] > a[1] + 1 and b[1] > b[0] + 1


def test_equal_texts_have_equal_scores_and_the_model_ignores_storage(spark, prose):
    texts = prose(60, seed=3)
    docs = [(i, t) for i, t in enumerate([*texts, *texts[:20]])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    one, two = (lm.train(frame.repartition(n)).net.flat() for n in (1, 5))
    assert (one == two).all()
    got = {r.doc_id: r.score for r in lm.score(frame.repartition(7)).collect()}
    assert all(got[i] == got[60 + i] for i in range(20)) and len(set(got.values())) == 60


def test_several_splits(spark, prose, monkeypatch):
    monkeypatch.setattr(lm, "SPLIT_CHARACTERS", 3000)
    monkeypatch.setattr(lm, "TOGETHER", 2)
    docs = spark.createDataFrame(list(enumerate(prose(40, seed=8))), "doc_id long, text string")
    one, two = (lm.train(docs.repartition(n)).net.flat() for n in (1, 4))
    assert (one == two).all() and not (one == lm.Network().flat()).all()


def test_held_out_documents_score_above_their_words_shuffled(spark):
    import pyarrow as pa

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null")
    model = lm.train(docs.where("doc_id % 5 <> 0"))
    rng, held = random.Random(0), [r.text.split() for r in docs.where("doc_id % 5 = 0").collect()]
    held = [w for w in held if len(w) >= 50]
    _, ordered = model.scores(pa.array([" ".join(w) for w in held]))
    _, shuffled = model.scores(pa.array([" ".join(rng.sample(w, len(w))) for w in held]))
    assert len(held) > 100 and (ordered > shuffled).mean() > 0.5 and (ordered - shuffled).sum() > 0


def test_parts_hold_every_text_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lm, "CHARACTERS_AT_ONCE", 10)
    texts = pa.array(["a" * n if n % 4 else None for n in (3, 9, 30, 4, 0, 8, 7, 1, 2, 3, 50)])
    got = list(lm.parts(texts))
    assert [x for p in got for x in p.to_pylist()] == texts.to_pylist() and len(got) > 4


def test_ordered_text_scores_above_shuffled(spark):
    """Held out: the model learns that some words follow others, and prefers new texts of that kind."""
    rng, words = random.Random(2), [f"w{i}" for i in range(60)]

    def chain(n):
        out = [rng.randrange(60)]
        while len(out) < n:
            out.append((out[-1] * 7 + rng.choice((1, 2))) % 60)
        return [words[i] for i in out]

    model = lm.train(spark.createDataFrame([(" ".join(chain(300)),) for _ in range(400)], "text string").repartition(3))
    import pyarrow as pa

    pairs = [(own, rng.sample(own, len(own))) for own in (chain(100) for _ in range(40))]
    _, ordered = model.scores(pa.array([" ".join(a) for a, _ in pairs]))
    _, shuffled = model.scores(pa.array([" ".join(b) for _, b in pairs]))
    assert (ordered > shuffled).sum() >= 38


def test_odd_rows(odd, none):
    got = {r.doc_id: r for r in lm.score(odd).collect()}
    assert [got[i].n_tokens for i in (2, 3, 4)] == [0, 0, 0] and got[2].score == 0.0 and got[8].n_tokens == 30_000
    assert got[1].score == got[6].score < 0
    assert lm.score(none).count() == 0


def test_words_of_one_identity_have_their_own_share(spark):
    """A word that never recurs scores below a frequent one, though the network takes both for the same."""
    import pyarrow as pa

    same: dict = {}
    for w in (f"w{i}" for i in range(10**6)):
        x = int(lm.identities(pa.array([w]))[0][0])
        if x in same:
            break
        same[x] = w
    docs = [(i, same[x]) for i in range(50)] + [(100, w)]
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert len(got) == 51 and got[0] == pytest.approx(got[49]) and got[0] - got[100] == pytest.approx(np.log(50.5 / 1.5), rel=1e-6)


def test_packed_numbers():
    for x in ([], [0], [5, 70_000, 3, 2**31 - 1, 0]):
        assert lm.unpacked(lm.packed(np.array(x, np.int32))).tolist() == x


def test_the_words_of_the_corpus_are_shuffled_once(spark):
    """Shares by brute force, from one exchange of the words and none of anything else."""
    rng = random.Random(4)
    names = [rng.randrange(-(2**63), 2**63) for _ in range(40)]
    names += [x ^ k for x in names for k in (1, 2)]  # three words to an identity
    rows = [(block, at, x, rng.randint(1, 9)) for block in range(7) for at, x in enumerate(rng.sample(names, 60))]
    shares = lm.word_shares(spark.createDataFrame(rows, "block long, at int, word long, n long"))
    assert shares._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    total, whole = dict.fromkeys({r[2] for r in rows}, 0), {}
    for _, _, x, n in rows:
        total[x] += n
    identity = lambda x: x % 2**64 >> 64 - lm.BITS
    for x, n in total.items():
        whole[identity(x)] = whole.get(identity(x), 0) + n + 0.5
    got = {(r.block, r["at"]): (r.id, r.share) for r in shares.collect()}
    assert len(got) == len(rows)
    for block, at, x, _ in rows:
        assert got[block, at] == (identity(x), pytest.approx(np.log((total[x] + 0.5) / whole[identity(x)]), rel=1e-12))
