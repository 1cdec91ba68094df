"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before encoding, at places where the splitting pattern surely starts a new match whatever stands
around them: before a single space between a character that isn't white space and a letter, digit or other mark. No
match of the pattern crosses such a place, so the ids of the parts, one after the other, are those of the whole text.
Only stretches without any such place stay whole. A long run of white space is one match of the pattern but for its
last character if anything follows (`\\s+(?!\\S)`), and the regex engine would keep a way back for each character of
it; such a run goes to the merges directly. Both hold for patterns that split like the public ones of this kind, with
words that take one space before them. Decoding gives raw bytes, so ids that stop inside a character decode.

A null text counts as empty: no ids, the digest of nothing. Lone surrogates can't occur in Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text that one call encodes at least.
STRETCH = 1 << 16
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: White space as the encoding's regex engine has it, and a run that isn't left to that engine.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = re.compile(f"[{WHITE}]{{1000,}}")
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

_ENCODINGS: dict = {}


def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file, made once for each worker."""
    import tiktoken

    if (path, pattern) not in _ENCODINGS:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _ENCODINGS[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path, pattern]


def safe_parts(text: str, stretch: int = STRETCH) -> Iterator[str]:
    """text in parts of about `stretch` characters, cut at safe places only."""
    begin = 0
    while begin + stretch < len(text):
        found = SAFE.search(text, begin + stretch)
        if not found:
            break
        yield text[begin : found.start()]
        begin = found.start()
    if begin < len(text):
        yield text[begin:]


def encoded_parts(text: str, own) -> Iterator[list[int]]:
    """The ids of text, part by part."""
    begin = 0
    for run in LONG_RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield from map(own.encode_ordinary, safe_parts(text[begin : run.start()]))
        yield own._encode_single_piece(text[run.start() : end])
        begin = end
    yield from map(own.encode_ordinary, safe_parts(text[begin:]))


def encode(text: str | None, path: str, pattern: str) -> list[int]:
    """The ids of a whole text."""
    return [i for ids in encoded_parts(text or "", encoding(path, pattern)) for i in ids]


def decode(ids: list[int], path: str, pattern: str) -> bytes:
    """The bytes of ids."""
    return encoding(path, pattern).decode_bytes(ids)


def _digests(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(path, pattern)
        for batch in batches:
            counts, ids_sha, bytes_sha = [], [], []
            for text in batch.column(1):
                n, said, back = 0, hashlib.sha256(), hashlib.sha256()
                for ids in filter(None, encoded_parts(text.as_py() or "", own)):
                    said.update((("," if n else "") + ",".join(map(str, ids))).encode())
                    back.update(own.decode_bytes(ids))
                    n += len(ids)
                counts.append(n)
                ids_sha.append(said.hexdigest())
                bytes_sha.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(bytes_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encode_rows(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encode(t.as_py(), path, pattern) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _decode_rows(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [None if x.as_py() is None else decode(x.as_py(), path, pattern) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "bytes"])

    return run


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every whole text."""
    return _narrow(docs, id_col, text_col).mapInArrow(_encode_rows(path, pattern), "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes) of every list of ids; null ids give null bytes."""
    narrow = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return narrow.mapInArrow(_decode_rows(path, pattern), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: number of ids, digest of the decimal ids joined by commas, digest of what they decode to."""
    return _narrow(docs, id_col, text_col).mapInArrow(_digests(path, pattern), DIGEST)
