import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import bpe
from corpusmill.llm.queries import BYTE_BPE, tokenizer_path


@pytest.fixture(scope="module")
def made():
    import public_tokenizers

    return tokenizer_path(BYTE_BPE), public_tokenizers.PATTERN


def test_parts_are_exact(made):
    text = "Some words, 12 345 'quoted' it's\n\n   spaced   out\t　日本 語 é😀 x " * 400
    whole = bpe.encoding(*made).encode_ordinary(text)
    for stretch in (1, 7, 100):
        parts = list(bpe.safe_parts(text, stretch))
        assert "".join(parts) == text and len(parts) > 10
        assert [i for p in parts for i in bpe.encoding(*made).encode_ordinary(p)] == whole


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aé1 '\n\t\x1c　.s日", max_size=40), st.integers(1, 5))
def test_any_cut_is_safe(text, stretch):
    import public_tokenizers

    made = tokenizer_path(BYTE_BPE), public_tokenizers.PATTERN
    own = bpe.encoding(*made)
    assert [i for p in bpe.safe_parts(text, stretch) for i in own.encode_ordinary(p)] == own.encode_ordinary(text)


def test_against_the_library(spark, odd, made, none):
    own = bpe.encoding(*made)
    got = bpe.round_trip(odd, *made).collect()
    assert len(got) == odd.count()
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in got:
        ids = own.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert bpe.round_trip(none, *made).count() == 0


def test_rows_round_trip(spark, odd, made):
    ids = bpe.encode_texts(odd, *made)
    back = {r.doc_id: bytes(r["bytes"]) for r in bpe.decode_ids(ids, *made).collect()}
    assert all(back[r.doc_id] == (r.text or "").encode() for r in odd.collect())


def test_long_runs(made):
    for text in (" " * 300_000 + "x", "\n" * 100_000, "ab" * 200_000):
        ids = bpe.encode(text, *made)
        assert bpe.decode(ids, *made).decode() == text


@pytest.mark.parametrize(("unit", "tail", "n"), [(" ", "x", 10**7), ("\n", "", 10**7), *[(u, t, 10**6) for u in (" ", "\n", "\t", "\u3000") for t in ("", "x", "!")], *[(u, "x", 3 * 10**5) for u in ("a", "é", "1", "!", "\u0301")]])
def test_long_runs_of_one_character(made, unit, tail, n):
    """White space: all of the run but its last character is one piece if anything follows, else all. Other runs, with a space before them, are one piece up to what is of another kind."""
    own = bpe.encoding(*made)
    ids = bpe.encode("x" + unit * n + tail if unit.isspace() else "# " + unit * n + "\n" + tail, *made)
    if unit.isspace():
        want = own.encode_ordinary("x") + own._encode_single_piece(unit * (n - 1 if tail else n)) + own.encode_ordinary((unit if tail else "") + tail)
    else:
        want = own.encode_ordinary("#") + own._encode_single_piece(" " + unit * n) + own.encode_ordinary("\n" + tail)
    assert ids == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aé1 '\n\t\x1c\x85　\u2028.s", max_size=60))
def test_long_white_space_is_one_match(text):
    """With the least run that goes to the merges directly set low, every kind of neighbourhood occurs."""
    import public_tokenizers

    made = tokenizer_path(BYTE_BPE), public_tokenizers.PATTERN
    own, held = bpe.encoding(*made), bpe.LONG_RUN
    bpe.LONG_RUN = bpe.re.compile(f"[{bpe.WHITE}]{{2,}}")
    try:
        assert bpe.encode(text, *made) == own.encode_ordinary(text)
    finally:
        bpe.LONG_RUN = held
