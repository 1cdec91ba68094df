import pytest

#: Texts with every odd case: null, empty, blank, marks alone, repeats, other scripts, long.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog, again and again.\nSecond line."), (2, None), (3, ""), (4, "   \n\t "), (5, "!!! ... ???"), (6, "The quick brown fox jumps over the lazy dog, again and again.\nSecond line."),
    (6, "The quick brown fox jumps over the lazy dog, again and again.\nSecond line."), (None, "row without an id, but with words in it"), (7, "naïve café — 日本語 テキスト 😀 x²"), (8, "word " * 30_000), (9, "a"), (10, "x" * 70_000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of every odd case, with columns whose names operators might use themselves."""
    rows = [(i, t, "en" if t else None, "host" if (i or 0) % 2 else None, len(t) if t is not None else None, 0, "row", 1.0) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, length int, row string, hash double")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def prose():
    """A function that makes n different documents of made-up words."""
    import random

    def make(n: int, seed: int = 0, words: int = 120):
        rng = random.Random(seed)
        known = ["".join(rng.choice(("ka", "lo", "mi", "ren", "tus", "var", "eth", "on")) for _ in range(rng.randint(1, 4))) for _ in range(900)]
        return [" ".join(rng.choice(known) for _ in range(rng.randint(words // 2, 2 * words))) for _ in range(n)]

    return make
