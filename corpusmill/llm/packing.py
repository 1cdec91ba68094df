"""Sequence packing by minimum bin slack.

A document is its token ids followed by an end id. It is cut at every multiple of the capacity; the full cuts are
sequences of their own. What remains of each document (1 to capacity - 1 ids) goes through the minimum-bin-slack
planner, which only needs the histogram of the remaining lengths: at most capacity - 1 rows at any corpus size.
The planner seeds a window with the longest remaining length, fills it by a bitset subset-sum over the other lengths
(each with its count), backtracks how many of each length the best sum takes, and repeats that multiset for as long
as the counts allow. Where the best sum leaves more than `slack` ids empty, the longest whole remainder is cut into
its binary parts (powers of two), which are then available as fillers; windows of such parts alone that still can't
be filled become sequences of a power of two each, which need no padding.

Every row gets a rank within its length from per-task counters and a prefix sum over tasks, so that the plan (ranges
of ranks) tells each row its window and its offset there without bringing a length's rows together.

Null texts count as empty: one piece that holds the end id alone. Rows with equal or null doc_id are packed each by
itself. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, give_back, staged

CAPACITY = 4096
END_ID = 2
#: A window may stay this many ids short of the capacity before a document is cut to fill it.
SLACK = 4
#: Words held by one generation of a worker's cache.
CACHE_WORDS = 250_000
TEXTS_AT_ONCE = 2048
CHARACTERS_AT_ONCE = 4_000_000
ENCODED_AT_ONCE = 500
#: A stop or comma that the tokenizer would join with the mark before it.
MARKS = re.compile(r"[.,]\s(?<=[^\w\s]..|_..)")
_ENCODERS: dict = {}

TOKENIZED = "doc_id long, doc_tokens long, task int, length int, rank long, full_from long, full_crcs array<long>, crc long, part_crcs array<long>"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, is_cut boolean"


def _latin(text: str) -> bool:
    """No character of text is above U+00FF."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordEncoder:
    """Token ids of whole texts as little-endian uint32 bytes, from a word-level tokenizer file.

    The tokenizer drops white space and never joins what stands on both sides of it, so a text's ids are those of its
    white-space separated words one after the other. Many texts are split at once and their words numbered by Arrow;
    each different word is encoded once, kept in a bounded cache, and put in its places by array indexing.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and each thread keeps memory of its own
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        #: For lower-case letters that the normalizer leaves alone: white space alone parts words.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.is_end[i] = token.endswith("</w>")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def simpler(text: str) -> str:
        """A text with the same ids and fewer different words: where that can't change the ids, in lower case and with stops and commas apart from the word before."""
        if text.isascii() or _latin(text):  # letters whose lower case is one letter, and no others
            text = text.lower()
            if not MARKS.search(text):
                text = text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " . ").replace(",\n", " , ")
        return text

    def _learn(self, words: list[str]) -> None:
        """Words of letters up to U+00FF are one word to the tokenizer, so many can be encoded at once and told apart by their ends."""
        names = [w for w in words if w.isalpha() and w.islower() and (w.isascii() or _latin(w))]
        rest = list(set(words).difference(names))
        for i in range(0, len(names), ENCODED_AT_ONCE):
            part = names[i : i + ENCODED_AT_ONCE]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) != len(part):  # some word isn't one word to this tokenizer
                rest += part
                continue
            raw, begin = ids.tobytes(), 0
            for name, end in zip(part, (4 * ends).tolist(), strict=True):
                self.young[name] = raw[begin:end]
                begin = end
        for i in range(0, len(rest), 20_000):
            part = rest[i : i + 20_000]
            self.young.update(zip(part, (np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of each of these different words."""
        if len(self.young) + len(words) > CACHE_WORDS and self.young:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = [w for w in words if w not in young]
        found = [w for w in missing if w in old]
        young.update(zip(found, map(old.__getitem__, found), strict=True))
        if len(found) < len(missing):
            self._learn([w for w in missing if w not in young])
        return list(map(young.__getitem__, words))

    def _part(self, texts: list[str]) -> Iterator[bytes]:
        split = pc.ascii_split_whitespace(pa.array([self.simpler(t) for t in texts], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        words, borders = coded.indices.to_numpy(), split.offsets.to_numpy()
        known = self._known(coded.dictionary.to_pylist())
        # A text has fewer than 2^31 bytes, so 32 bits hold every place.
        sizes = np.fromiter(map(len, known), np.int32, len(known)) // 4
        starts, ids = np.cumsum(sizes, dtype=np.int32) - sizes, np.frombuffer(b"".join(known), "<u4")
        counts = sizes[words]
        ends = np.cumsum(counts, dtype=np.int32)
        places = np.repeat(starts[words] - (ends - counts), counts)
        places += np.arange(len(places), dtype=np.int32)
        own = ids[places]
        edges = np.concatenate([[0], ends])[borders].tolist()
        for a, b in zip(edges, edges[1:], strict=False):
            yield own[a:b].tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        begin = size = 0
        for i, text in enumerate(texts):
            if size and size + len(text) > CHARACTERS_AT_ONCE:
                yield from self._part(texts[begin:i])
                begin, size = i, 0
            size += len(text)
        if begin < len(texts):
            yield from self._part(texts[begin:])


def binary_parts(length: int) -> list[tuple[int, int]]:
    """(start, size) of the powers of two that make up length, largest first."""
    out, start = [], 0
    for bit in range(length.bit_length() - 1, -1, -1):
        if length >> bit & 1:
            out.append((start, 1 << bit))
            start += 1 << bit
    return out


def _tokenize(path: str, capacity: int, end_id: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = _ENCODERS.setdefault(path, None) or WordEncoder(path), TaskContext.get().partitionId()
        _ENCODERS[path] = encoder  # words stay known to the tasks that follow in this worker
        tail, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        seen: dict[int, int] = {}
        full_seen = 0
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                rows: list[list] = [[] for _ in range(9)]
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += tail
                    n, view = len(ids) // 4, memoryview(ids)
                    full = n // capacity
                    length = n - full * capacity
                    rest = view[full * step :]
                    rank = seen.get(length, 0)
                    seen[length] = rank + 1
                    row = (doc_id, n, task, length, rank, full_seen, [zlib.crc32(view[i * step : (i + 1) * step]) for i in range(full)], zlib.crc32(rest), [zlib.crc32(rest[4 * s : 4 * (s + k)]) for s, k in binary_parts(length)])
                    full_seen += full
                    for column, x in zip(rows, row, strict=True):
                        column.append(x)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=[x.split()[0] for x in TOKENIZED.split(", ")])
                give_back()

    return run


class Plan:
    """Where the items of each length go: rows of (class, part, first rank, last rank + 1, first window, items a window, first slot, offset in the window, size, start)."""

    def __init__(self, counts: dict[int, int], capacity: int, slack: int):
        self.capacity, self.slack, self.windows = capacity, slack, 0
        #: By size, the segments of items that are still to place: (class, part, from rank, to rank, start in the remainder).
        self.pool: dict[int, deque] = {n: deque([(n, 0, 0, c, 0)]) for n, c in counts.items() if c}
        self.count: dict[int, int] = {n: c for n, c in counts.items() if c}
        self.whole = dict(self.count)
        self.rows: list[tuple] = []
        self._run()

    def best(self, room: int, taken: int) -> dict[int, int]:
        """The multiset of sizes whose sum is nearest to room from below; one item of size taken is already used."""
        reach, stages = 1, []
        mask, goal = (1 << (room + 1)) - 1, 1 << room
        for size in sorted((s for s in self.count if s <= room), reverse=True):
            left = min(self.count[size] - (size == taken), room // size)
            before, k = reach, 1
            while left > 0:
                use = min(k, left)
                reach |= reach << (use * size) & mask
                left, k = left - use, 2 * k
            if reach != before:
                stages.append((size, before))
            if reach & goal:
                break
        at, out = reach.bit_length() - 1, {}
        for size, before in reversed(stages):
            while not before >> at & 1:
                at -= size
                out[size] = out.get(size, 0) + 1
        return out

    def _take(self, size: int, n: int) -> list[tuple]:
        out, line = [], self.pool[size]
        if not self.count[size] - n:
            del self.count[size]
        else:
            self.count[size] -= n
        while n:
            kind, part, a, b, start = line.popleft()
            use = min(n, b - a)
            out.append((kind, part, a, a + use, start))
            if a + use < b:
                line.appendleft((kind, part, a + use, b, start))
            n -= use
        return out

    def _put(self, size: int, segment: tuple) -> None:
        self.pool.setdefault(size, deque()).append(segment)
        self.count[size] = self.count.get(size, 0) + segment[3] - segment[2]

    def _place(self, pattern: dict[int, int], times: int) -> None:
        offset = 0
        for size, each in sorted(pattern.items(), reverse=True):
            slot = 0
            for kind, part, a, b, start in self._take(size, each * times):
                if not part:
                    self.whole[kind] -= b - a
                self.rows.append((kind, part, a, b, self.windows, each, slot, offset, size, start))
                slot += b - a
            offset += size * each
        self.windows += times

    def _cut(self, size: int, n: int) -> None:
        """Cut n whole remainders of this size, which isn't a power of two, into their binary parts."""
        for kind, _, a, b, _ in self._take(size, n):
            self.whole[kind] -= b - a
            for i, (at, k) in enumerate(binary_parts(size), 1):
                self._put(k, (kind, i, a, b, at))

    def _run(self) -> None:
        while self.count:
            seed = max(self.count)
            pattern = self.best(self.capacity - seed, seed)
            pattern[seed] = pattern.get(seed, 0) + 1
            total = sum(s * n for s, n in pattern.items())
            times = min(self.count[s] // n for s, n in pattern.items())
            if self.capacity - total <= self.slack:
                self._place(pattern, times)
                continue
            #: Whole remainders that cutting changes; a power of two is its own only part.
            whole = [s for s in self.whole if self.whole[s] and s & (s - 1)]
            if whole:
                size = max(whole)
                self._cut(size, min(self.whole[size], times))
                continue
            self._place({seed: 1}, self.count[seed])  # less than a window of powers of two is left

    def arrays(self) -> dict[tuple[int, int], np.ndarray]:
        """By (class, part): the rows in the order of their ranks."""
        out: dict[tuple[int, int], list] = {}
        for kind, part, *row in self.rows:
            out.setdefault((kind, part), []).append(row)
        return {k: np.array(sorted(v), np.int64) for k, v in out.items()}


def _assign(plan: dict, windows: int, capacity: int):
    def place(key: tuple[int, int], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rows = plan.get(key)
        if rows is None:
            none = np.zeros(len(ranks), np.int64)
            return none.astype(bool), none, none, none, none
        at = np.maximum(np.searchsorted(rows[:, 0], ranks, "right") - 1, 0)
        first, last, window, each, slot, offset, size, start = rows[at].T
        item = slot + ranks - first
        return (ranks >= first) & (ranks < last), window + item // each, offset + item % each * size, size, start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            out: list[list] = [[] for _ in range(8)]
            ids, tokens, lengths, ranks = d["doc_id"].to_pylist(), d["doc_tokens"].to_pylist(), d["length"].to_numpy(), d["rank"].to_numpy()
            full_crcs, crcs, part_crcs = d["full_crcs"].to_pylist(), d["crc"].to_pylist(), d["part_crcs"].to_pylist()
            full_from, tasks = d["full_from"].to_pylist(), d["task"].to_pylist()

            def add(*row, out=out):
                for column, x in zip(out, row, strict=True):
                    column.append(x)

            for i, crc_list in enumerate(full_crcs):
                for j, crc in enumerate(crc_list):
                    add(ids[i], j * capacity, capacity, crc, tokens[i], (tasks[i] + 1 << 33) + full_from[i] + j, 0, False)
            for length in np.unique(lengths):
                if not length:
                    continue
                rows = np.flatnonzero(lengths == length)
                for part in range(len(binary_parts(int(length))) + 1):
                    found, window, offset, size, start = place((int(length), part), ranks[rows])
                    for i, w, o, n, s in zip(rows[found].tolist(), window[found].tolist(), offset[found].tolist(), size[found].tolist(), start[found].tolist(), strict=True):
                        add(ids[i], tokens[i] - int(length) + s, n, part_crcs[i][part - 1] if part else crcs[i], tokens[i], w, o, part > 0)
            kinds = [pa.int64()] * 7 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def tokenized(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its number of ids, the rank of its remainder within its length and task, checksums of its pieces."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_tokenize(tokenizer_path, capacity, end_id), TOKENIZED)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most capacity ids; one row a piece.

    sequence_id is unique for each sequence, not dense: windows of the planner count from 0, and the full cuts of a
    task have the task's number in the bits above 33. is_cut tells the pieces of a remainder that the planner cut.
    """
    rows = staged(tokenized(docs, tokenizer_path, capacity, end_id, id_col, text_col), "tokens")
    per_task = rows.where("length > 0").groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per_task.select(F.col("length").alias("o_length"), F.col("task").alias("o_task"), before.alias("before"))
    counts = {r["length"]: r["n"] for r in rows.where("length > 0").groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity - 1 rows
    plan = Plan(counts, capacity, slack)
    ranked = rows.join(offsets, (F.col("length") == F.col("o_length")) & (F.col("task") == F.col("o_task")), "left").select(
        "doc_id", "doc_tokens", "task", "length", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("rank"), "full_from", "full_crcs", "crc", "part_crcs"
    )
    return ranked.mapInArrow(_assign(plan.arrays(), plan.windows, capacity), PIECES)
