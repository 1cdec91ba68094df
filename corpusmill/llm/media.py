"""Media columns: payloads as 8-bit PCM sound in content-addressed chunks.

A payload (the UTF-8 text with zero bytes up to a positive multiple of 64) becomes a WAVE file of 8-bit mono samples,
header and samples byte for byte. Files are cut by content: a rolling gear hash over the last bytes cuts where its low
bits are zero, between a least and a greatest chunk size, so equal passages give equal chunks wherever they stand.
Every task appends its new chunks, compressed, to a pack file of its own in the shared folder and returns only rows of
(file, ordinal, digest, pack, offset, length). A groupBy and a join on the digest pick one place for each distinct
chunk; the ordered chunk lists then point at those places only. Reading fetches the listed ranges, checks every chunk
against its digest and the whole against the digest of the stored file, and computes the features from what was read.
No payload bytes are ever shuffled. A chunk that several tasks meet is written by each of them and read from one place.

Pack names are unique to the attempt that wrote them and the rows are written out before they are used, so a lost
executor costs at most some unused packs. A null text is an empty one: 64 zero bytes. Equal texts have equal values.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, staged

LEAST, MEAN_BITS, MOST = 512, 11, 8192
UNIT = 64
RATE = 8000
HEADER = 44
#: Bytes between two ranges of a pack that are fetched with them rather than apart.
GAP = 1 << 16
FETCH = 1 << 24

MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
CHUNKS = "file long, doc_id long, n_bytes long, media_bytes long, media_sha256 string, task int, chunks array<struct<digest:binary,size:int>>, places array<struct<pack:string,at:long,len:int>>"


def gear_table() -> np.ndarray:
    """256 pseudo-random numbers by a fixed rule."""
    return np.frombuffer(b"".join(hashlib.sha256(b"gear %d" % i).digest()[:4] for i in range(256)), "<u4").astype(np.uint32)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload and the number of bytes before padding."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


def wave(samples: bytes) -> bytes:
    """A WAVE file of unsigned 8-bit mono samples. Its sizes hold 32 bits, so of 4 GiB or more other readers see the rest of a division."""
    return b"RIFF" + struct.pack("<I", 36 + len(samples) & 0xFFFFFFFF) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(samples) & 0xFFFFFFFF) + samples


def samples_of(media: bytes) -> bytes:
    """The samples of such a file."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not a WAVE file of this kind")
    return media[HEADER:]


def cut_points(data: bytes, gear: np.ndarray, least: int = LEAST, bits: int = MEAN_BITS, most: int = MOST) -> list[int]:
    """Ends of the chunks of data, the last one len(data)."""
    g = gear[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8):  # hash of the last 16 bytes: the byte j places back counts shifted left by j
        old = g.copy()
        g[k:] += old[:-k] << np.uint32(k)
    found = np.flatnonzero((g >> np.uint32(32 - 16) & np.uint32((1 << bits) - 1)) == 0) + 1
    ends, begin = [], 0
    while len(data) - begin > least:
        i = int(np.searchsorted(found, begin + least))
        end = min(int(found[i]) if i < len(found) else len(data), begin + most, len(data))
        ends.append(end)
        begin = end
    if begin < len(data) or not ends:
        ends.append(len(data))
    return ends


def feature_of(samples: bytes) -> str:
    """Mean, root mean square about the zero level, zero crossings, range and the eight-band energy of the samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    signs = x >= 0
    bands = [int(np.abs(part).sum()) for part in x[: len(x) - len(x) % 8].reshape(8, -1)]
    return f"n={len(x)};sum={int(x.sum())};energy={int((x * x).sum())};crossings={int((signs[1:] != signs[:-1]).sum())};low={int(x.min())};high={int(x.max())};bands={','.join(map(str, bands))}"


def _store(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        gear, press, task = gear_table(), zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId()
        system, folder = pa.fs.FileSystem.from_uri(root)
        system.create_dir(folder)
        pack = f"{uuid.uuid4().hex}.pack"
        seen: dict[bytes, tuple[int, int]] = {}
        n = at = 0
        with system.open_output_stream(f"{folder}/{pack}") as out:
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    payload, n_bytes = payload_of(text.as_py())
                    media, begin, chunks, places = wave(payload), 0, [], []
                    for end in cut_points(media, gear):
                        chunk = media[begin:end]
                        digest = hashlib.sha256(chunk).digest()
                        if digest not in seen:
                            raw = press.compress(chunk)
                            out.write(raw)
                            if len(seen) >= 200_000:
                                seen.clear()
                            seen[digest] = (at, len(raw))
                            at += len(raw)
                        chunks.append({"digest": digest, "size": end - begin})
                        places.append({"pack": pack, "at": seen[digest][0], "len": seen[digest][1]})
                        begin = end
                    rows.append({"file": (task << 33) + n, "doc_id": doc_id, "n_bytes": n_bytes, "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "task": task, "chunks": chunks, "places": places})
                    n += 1
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return run


_SCHEMA = pa.schema(
    [
        ("file", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("task", pa.int32()),
        ("chunks", pa.list_(pa.struct([("digest", pa.binary()), ("size", pa.int32())]))), ("places", pa.list_(pa.struct([("pack", pa.string()), ("at", pa.int64()), ("len", pa.int32())]))),
    ]
)


class Packs:
    """Ranges of pack files; the last stretch that was fetched of the pack in use is kept."""

    def __init__(self, root: str):
        self.system, self.folder = pa.fs.FileSystem.from_uri(root)
        self.name, self.file, self.begin, self.held = "", None, 0, b""

    def get(self, name: str, at: int, size: int) -> bytes:
        if name != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file, self.begin, self.held = name, self.system.open_input_file(f"{self.folder}/{name}"), 0, b""
        if not self.begin <= at <= at + size <= self.begin + len(self.held):
            ahead = self.begin <= at <= self.begin + len(self.held) + GAP
            self.file.seek(at)
            self.begin, self.held = at, self.file.read(max(size, FETCH // 16 if ahead else size))
        return self.held[at - self.begin : at - self.begin + size]


def _read(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        own, far, press = Packs(root), Packs(root), zstandard.ZstdDecompressor()
        names = [x.split()[0] for x in MEDIA.split(", ")]
        for batch in batches:
            d = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            out: list[list] = [[] for _ in names]
            for i in range(batch.num_rows):
                parts = []
                for place in sorted(d["list"][i], key=lambda p: p["ord"]):
                    source = own if place["pack"] == d["pack"][i] else far
                    chunk = press.decompress(source.get(place["pack"], place["at"], place["len"]), max_output_size=MOST)
                    if hashlib.sha256(chunk).digest() != place["digest"]:
                        raise ValueError(f"chunk {place} of document {d['doc_id'][i]} isn't what was stored")
                    parts.append(chunk)
                media = b"".join(parts)
                digest = hashlib.sha256(media).hexdigest()
                if digest != d["media_sha256"][i]:
                    raise ValueError(f"media of document {d['doc_id'][i]} isn't what was stored")
                samples = samples_of(media)
                row = (d["doc_id"][i], d["n_bytes"][i], len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), digest, feature_of(samples))
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return run


def store(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every text's media as chunks below root: one row a file, with its chunk list and where this task put each."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return staged(rows.mapInArrow(_store(root), CHUNKS), "files")


def deduplicated(files: DataFrame) -> DataFrame:
    """(file, list): for every file its chunks in order, each at the one place that all equal chunks share.

    Packs first give each of their digests once, so a chunk that a third of all files hold has as many rows as there
    are packs when the packs agree on a place; the files then learn of it by pack and digest.
    """
    each = files.select("file", F.posexplode(F.arrays_zip("chunks", "places")).alias("ord", "x")).select("file", "ord", F.col("x.chunks.digest").alias("digest"), F.col("x.places").alias("place"), F.col("x.places.pack").alias("pack"))
    local = staged(each.groupBy("pack", "digest").agg(F.min("place").alias("place")), "local")
    common = local.groupBy(F.col("digest").alias("of")).agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("of", "first")
    moved = local.join(common, F.col("digest") == F.col("of")).where("first <> place").select(F.col("pack").alias("from"), "of", "first")
    lists = each.join(moved, (F.col("pack") == F.col("from")) & (F.col("digest") == F.col("of")), "left").select("file", F.struct("ord", "digest", F.coalesce("first", "place").alias("p")).alias("c"))
    return lists.groupBy("file").agg(F.array_sort(F.collect_list("c")).alias("list")).select(F.col("file").alias("of_file"), F.transform("list", lambda c: F.struct(c.ord.alias("ord"), c.digest.alias("digest"), c.p.pack.alias("pack"), c.p.at.alias("at"), c.p.len.alias("len"))).alias("list"))


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as sound in chunks, read it back through the deduplicated lists, and describe what was read."""
    root = new_path(docs.sparkSession, "packs")
    files = store(docs, root, id_col, text_col)
    heads = files.select("file", "doc_id", "n_bytes", "media_sha256", F.element_at("places.pack", 1).alias("pack"))
    joined = heads.join(deduplicated(files), F.col("file") == F.col("of_file"))
    # A task's files lie in the order of its pack.
    dealt = joined.select("file", "doc_id", "n_bytes", "media_sha256", "pack", "list").sortWithinPartitions("pack", "file")
    return dealt.mapInArrow(_read(root), MEDIA)
