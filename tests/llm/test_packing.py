import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm.packing import CAPACITY, Plan, WordEncoder, binary_parts, pack
from corpusmill.llm.queries import WORD_BPE, tokenizer_path


@pytest.fixture(scope="module")
def path():
    return tokenizer_path(WORD_BPE)


def whole_ids(path, text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return [*tok.encode(text or "", add_special_tokens=False).ids, 2]


def hold(rows, docs, path):
    """Every id lies in one piece, checksums fit, sequences have no gaps and no overlaps."""
    ids = defaultdict(list)
    for i, t in docs:
        ids[i].append(whole_ids(path, t))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        want = sorted(len(x) for x in ids[i])
        assert sum(r.length for r in own) == sum(want)
        if len(want) == 1:
            at = 0
            for r in sorted(own, key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == want[0]
                assert r.ids_crc32 == zlib.crc32(np.array(ids[i][0][at : at + r.length], "<u4").tobytes())
                at += r.length
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= CAPACITY
        padding += 0 if at & (at - 1) == 0 else CAPACITY - at
    return padding, sum(len(x) for own in ids.values() for x in own)


def test_odd_rows(spark, odd, path):
    padding, total = hold(pack(odd, path).collect(), [(r.doc_id, r.text) for r in odd.collect()], path)
    assert padding <= 0.01 * total


def test_many(spark, prose, path):
    docs = list(enumerate(prose(400)))
    padding, total = hold(pack(spark.createDataFrame(docs, "doc_id long, text string"), path).collect(), docs, path)
    assert padding <= 0.01 * total


def test_empty(none, path):
    assert pack(none, path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 40), max_size=20))
def test_plan_is_a_partition(counts):
    plan = Plan(counts, 64, 0)
    windows, placed = defaultdict(list), defaultdict(int)
    for kind, part, a, b, window, each, slot, offset, size, start in plan.rows:
        for r in range(a, b):
            item = slot + r - a
            windows[window + item // each].append((offset + item % each * size, size))
            placed[kind, r] += size
            assert part == 0 and (start, size) == (0, kind) or (start, size) == binary_parts(kind)[part - 1]
    assert placed == {(n, r): n for n, c in counts.items() for r in range(c)}
    for own in windows.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= 64 and (at == 64 or at & (at - 1) == 0)


def test_encoder_equals_the_tokenizer(path):
    texts = ["It's we'll 'tis don't. x's,y. (a.). b_. c. İstanbul K, ſ. ﬁ, é. Σας. A1. 2. x² . ½, a.\tb,\r\nc", "<|endoftext|> <|startoftext|>", "a\x1cb c\x1fd. e", "x y.　z, ", "😀😀 a.. b,, c.,d ", "a" * 3000, "\x01. x", "ª. º, ß. ÿ. µ, ÷. ×, ²."]
    encoder = WordEncoder(path)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [whole_ids(path, t)[:-1] for t in texts]


def test_memory_is_given_back_after_every_part(monkeypatch, prose, path):
    """A task has many parts, and what they leave behind must not add up."""
    from types import SimpleNamespace

    import pyarrow as pa

    from corpusmill.llm import packing

    given, docs = [], prose(25, words=5)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(packing, "TEXTS_AT_ONCE", 10)
    monkeypatch.setattr(packing, "give_back", lambda: given.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array(range(25)), pa.array(docs)], names=["doc_id", "text"])
    got = [r for b in packing._tokenize(path, CAPACITY, 2)([batch]) for r in b.to_pylist()]
    assert len(given) == 3 and [(r["doc_id"], r["doc_tokens"]) for r in got] == [(i, len(whole_ids(path, t))) for i, t in enumerate(docs)]
