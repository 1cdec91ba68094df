import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import simhash


def plain_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="AbÉ \t\n\x0b\x1c x", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text, 3) == plain_fingerprint(text, 3)


def test_fingerprint_of_a_long_text_in_pieces(monkeypatch):
    text = " ".join(f"w{i * 7 % 101}" for i in range(3000))
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert simhash.fingerprint(text, 3) == plain_fingerprint(text, 3)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**12 - 1), max_size=60), st.integers(0, 4))
def test_forest_connects_what_is_near(members, radius):
    own = sorted(members)
    links = simhash.forest(own, radius)
    near = [(i, j) for i in range(len(own)) for j in range(i) if (own[i] ^ own[j]).bit_count() <= radius]
    assert all((own[i] ^ own[j]).bit_count() <= radius for i, j in links)
    assert classes(links, range(len(own))) == classes(near, range(len(own)))
    assert len(links) == len(own) - len(set(classes(near, range(len(own))).values()))


def test_forest_over_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(1)
    own = sorted({rng.getrandbits(11) for _ in range(150)})
    near = [(i, j) for i in range(len(own)) for j in range(i) if (own[i] ^ own[j]).bit_count() <= 1]
    monkeypatch.setattr(simhash.Planes.__init__, "__defaults__", (16,))
    assert classes(simhash.forest(own, 1), range(len(own))) == classes(near, range(len(own)))


def test_group_equals_brute_force(spark, prose):
    rng, texts = random.Random(3), prose(60, words=200)
    for t in list(texts):
        words = t.split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    docs = list(enumerate([*texts, None, "", "  ", texts[0], texts[0]]))
    got = simhash.group(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    prints = {i: plain_fingerprint(t, 3) for i, t in docs}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    want = classes(near, prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    assert len(set(want.values())) < len(want) - 10


def test_odd_rows(odd, none):
    got = simhash.group(odd).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.doc_id in (2, 3, 4)} == {2} and {r.component_id for r in got if r.doc_id in (1, 6)} == {1}
    assert simhash.group(none).count() == 0


def jaccard(a, b, k=5):
    x, y = ({" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if (w := t.lower().split()) else set() for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 0.0


def test_near_groups_against_brute_force(spark, prose):
    """Texts with single words changed, from nearly equal to less alike than asked for."""
    rng, texts = random.Random(5), prose(40, seed=9, words=250)
    for t in list(texts):
        for n in (1, 2, 4, 8, 12):
            words = t.split()
            for i in rng.sample(range(len(words)), n):
                words[i] = f"new{i}"
            texts.append(" ".join(words))
    docs = list(enumerate(texts))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    near = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8]
    want = set(classes(near, range(len(texts))).values())
    assert len(kept ^ want) <= 2, (kept - want, want - kept)


def test_keep_one_of_odd_rows(odd, none):
    got = simhash.keep_one(odd)
    assert got.columns == odd.columns
    ids = sorted((r.doc_id or 0) for r in got.collect())
    assert ids == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10]
    assert simhash.keep_one(none).count() == 0


def test_a_large_group_is_dealt_into_cells(spark, monkeypatch, prose):
    monkeypatch.setattr(simhash, "CELL", 8)
    base = prose(1, words=300)[0].split()
    texts = [" ".join([*base[:i], f"other{i}", *base[i + 1 :]]) for i in range(60)]
    assert simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == 1


def test_a_rejected_link_is_replaced(spark, prose):
    """A family of many variants whose similarities lie on both sides of 0.8, where forests of distances hold links that are rejected."""
    rng, base = random.Random(7), prose(1, seed=4, words=600)[0].split()[:300]
    texts = []
    for _ in range(100):
        words = list(base)
        for i in rng.sample(range(len(words)), rng.randint(3, 5)):
            words[i] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    near = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8]
    want = set(classes(near, range(len(texts))).values())
    assert 1 < len(want) < len(texts)
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == want


def test_small_sets_are_not_given_up_by_distance():
    """A text of 8 words and the same text with one more are 0.8 alike, whatever their distance."""
    import numpy as np

    rng, (near, far) = np.random.default_rng(0), simhash.radii(0.8)
    for _ in range(300):
        text = " ".join(f"w{i}" for i in rng.integers(0, 10**6, 8))
        batch = next(simhash._features(5)(iter([simhash.pa.RecordBatch.from_arrays([simhash.pa.array([b"a", b"b"]), simhash.pa.array([text, text + " more"])], names=["tid", "text"])])))
        prints, sizes = simhash._members(*(np.array(batch.column(i).to_pylist(), object) for i in (0, 1)))
        assert sizes.tolist() == [4, 5] and len(simhash.spanning_links(prints, sizes, far, 0.8)) == 1


def kept_of(spark, texts):
    return {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def wanted(texts):
    near = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8]
    return set(classes(near, range(len(texts))).values())


def variants(rng, base, n, least, most):
    out = []
    for _ in range(n):
        words = list(base)
        for i in rng.sample(range(len(words)), rng.randint(least, most)):
            words[i] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_a_star_is_one_group(spark):
    """Texts that are near one text and not near each other, more than a small group."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)] + [" ".join([*base[: 30 + 2 * i], *[f"x{i}_{k}" for k in range(9)], *base[39 + 2 * i :]]) for i in range(60)]
    assert min(jaccard(texts[0], t) for t in texts) >= 0.8 and any(jaccard(a, b) < 0.8 for a in texts[1:] for b in texts[1:20])
    rng.shuffle(texts)
    assert kept_of(spark, texts) == wanted(texts) == {0}


def test_groups_of_any_size_equal_brute_force(spark, prose):
    rng, texts = random.Random(13), []
    for i, n in enumerate((2, 3, 13, 33, 60)):
        texts += variants(rng, prose(1, seed=20 + i, words=600)[0].split()[:300], n, 4, 6)
    rng.shuffle(texts)
    assert kept_of(spark, texts) == wanted(texts)


def test_blocks_of_a_group_equal_brute_force(spark, monkeypatch, prose):
    """A group that is dealt into many blocks, with members that only few others are near to."""
    monkeypatch.setattr(simhash, "CELL", 8)
    rng = random.Random(17)
    base = prose(1, seed=31, words=600)[0].split()[:300]
    texts = variants(rng, base, 60, 1, 3) + variants(rng, base, 40, 5, 7)
    rng.shuffle(texts)
    want = wanted(texts)
    assert 3 < len(want) < 40
    for deals in (1, 3):
        monkeypatch.setattr(simhash, "DEALS", deals)
        assert kept_of(spark, texts) == want


def test_five_thousand_near_copies(spark, prose):
    """Every text is near the first; none is lost."""
    base = prose(1, seed=41, words=200)[0].split()[:90]
    texts = [" ".join(base)] + [" ".join([*base[: i % 86], f"n{i}", *base[i % 86 + 1 :]]) for i in range(5000)]
    assert kept_of(spark, [t for t in texts if jaccard(texts[0], t) >= 0.8]) == {0}


def test_verified_links_decide_every_pair():
    import numpy as np

    rng = np.random.default_rng(5)
    sets = []
    for _ in range(70):
        base = np.unique(rng.integers(0, 1 << 63, 100).astype(np.uint64))
        for _ in range(rng.integers(1, 4)):
            own = base.copy()
            own[rng.integers(0, len(own), rng.integers(0, 14))] = rng.integers(0, 1 << 63, 1).astype(np.uint64)
            sets.append(np.unique(own))
    share = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    near = [(i, j) for i in range(len(sets)) for j in range(i) if share(sets[i], sets[j]) >= 0.8]
    got = simhash.verified_links(sets, np.arange(len(sets)), simhash.radii(0.8)[1], 0.8)
    assert all(share(sets[i], sets[j]) >= 0.8 for i, j in got) and classes(got, range(len(sets))) == classes(near, range(len(sets)))
