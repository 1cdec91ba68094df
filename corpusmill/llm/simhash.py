"""SimHash near-duplicates with bit-sliced comparison.

Words are the runs of bytes other than ASCII white space, after A-Z become a-z; each shingle of `shingle` words
(space-joined, repeats included; a text of fewer words is one shingle) is hashed with XXH64, seed 42, and a bit of the
fingerprint is set if it is set in over half the hashes. A null, empty or blank text has fingerprint zero.

Only distinct fingerprints are compared. Two that differ in at most `radius` bits share at least `blocks - radius` of
the `blocks` equal parts of the fingerprint, so every choice of that many parts is a key, and only fingerprints with
an equal key meet. With 8 parts of 8 bits and radius 2 a key fixes 48 bits: at most 2^16 distinct fingerprints can
share it, whatever the corpus holds. Within a key, members are kept as bit planes (bit i of plane b is bit b of member
i), in blocks; the distances of one member to all of a block are counted by carry-save addition of plane after plane,
and a block is given up as soon as all of its counters are beyond the radius. Instead of all near pairs a spanning
forest is emitted: a member that was reached isn't reached again. Components of those links give the classes.

The similarity mode (`near_groups`) is for stages that ask for a share of common shingles: see there.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, staged
from .components import components

SEED = 42
BLOCK = 4096
CHUNK = 1 << 22
WIDE_WORDS = 8
#: The odd constant of a multiply-xorshift mixer.
MIXER = 0x9E3779B97F4A7C15


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """The XXH64 of every shingle of a whole text, in order, in arrays of bounded size."""
    from xxhash import xxh64_intdigest

    raw, carry, at = (text or "").encode("utf-8", "surrogatepass").lower(), [], 0
    some = False
    while at < len(raw):
        end = at + CHUNK
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        words = carry + raw[at:end].split()
        at = end
        if len(words) >= shingle:
            some = True
            slices = [words[i:] for i in range(shingle)]
            yield np.fromiter((xxh64_intdigest(x, SEED) for x in map(b" ".join, zip(*slices, strict=False))), np.uint64, len(words) - shingle + 1)
            carry = words[len(words) - shingle + 1 :] if shingle > 1 else []
        else:
            carry = words
    if not some and carry:
        yield np.array([xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, bit 0 first; for each column if there are several."""
    lanes, total = np.uint64(0x0101010101010101), np.zeros((*hashes.shape[1:], 8, 8), np.int64)
    starts = np.arange(0, len(hashes), 255)  # a byte counts up to 255
    for k in range(8 if len(hashes) else 0):
        counts = np.add.reduceat(hashes >> np.uint64(k) & lanes, starts, axis=0)
        total[..., k] = counts.view(np.uint8).reshape(*counts.shape, 8).sum(0, dtype=np.int64)
    return total.reshape(*hashes.shape[1:], 64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int) -> int:
    """The unsigned 64-bit SimHash of a whole text."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, shingle):
        ones += _ones(h)
        n += len(h)
    return _majority(ones, n) if n else 0


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, for every row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


class Planes:
    """Members' fingerprints as bit planes, in blocks."""

    def __init__(self, members: list[int] | np.ndarray, bits: int, block: int = BLOCK):
        """members: numbers, or rows of 64-bit words."""
        width = (bits + 7) // 8
        self.planes, self.full = [], []
        for at in range(0, len(members), block):
            part = members[at : at + block]
            raw = part.tobytes() if isinstance(part, np.ndarray) else b"".join(m.to_bytes(width, "little") for m in part)
            raw = np.frombuffer(raw, np.uint8).reshape(len(part), width)
            rows = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
            self.planes.append([int.from_bytes(r.tobytes(), "little") for r in rows[:bits]])
            self.full.append((1 << len(part)) - 1)

    def near(self, query: int, radius: int, wanted: list[int], order: list[int]) -> list[int]:
        """For each block, the mask of the wanted members within the radius of query. order: the planes, the most telling first."""
        digits = max(1, radius.bit_length())
        spare = (1 << digits) - 1 - radius
        out = []
        for planes, alive in zip(self.planes, wanted, strict=True):
            if alive:
                # Counters start at the difference between radius and the largest count they hold, so overflow means too far.
                counter = [self.full_of(alive) if spare >> d & 1 else 0 for d in range(digits)]
                for b in order:
                    carry = planes[b] ^ (-1 if query >> b & 1 else 0)
                    carry &= alive
                    for d in range(digits):
                        counter[d], carry = counter[d] ^ carry, counter[d] & carry
                        if not carry:
                            break
                    else:
                        alive &= ~carry
                        if not alive:
                            break
            out.append(alive)
        return out

    @staticmethod
    def full_of(alive: int) -> int:
        return (1 << alive.bit_length()) - 1


def _bits(mask: int) -> list[int]:
    out = []
    while mask:
        low = mask & -mask
        out.append(low.bit_length() - 1)
        mask ^= low
    return out


def forest(members: list[int], radius: int, bits: int = 64, order: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (positions) of a spanning forest of the graph that joins members within the radius."""
    planes = Planes(members, bits)
    order = list(range(bits)) if order is None else order
    wanted, links = list(planes.full), []
    for root in range(len(members)):
        if not wanted[root // BLOCK] >> root % BLOCK & 1:
            continue
        wanted[root // BLOCK] &= ~(1 << root % BLOCK)
        queue = [root]
        while queue:
            now = queue.pop()
            for k, mask in enumerate(planes.near(members[now], radius, wanted, order)):
                wanted[k] &= ~mask
                found = [k * BLOCK + i for i in _bits(mask)]
                links += [(now, x) for x in found]
                queue += found
    return links


def _runs(columns: list[str]):
    """Equal neighbours in a sorted stream of batches, over batch borders: yields arrays of one run or many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            now = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns)))
            if not len(now[0]):
                continue
            if held and now[0][0] == held[-1][0][-1] and now[0][-1] == now[0][0]:
                held.append(now)
                continue
            joined = tuple(np.concatenate(x) for x in zip(*held, now, strict=True))
            cut = int(np.searchsorted(joined[0], joined[0][-1], "left"))
            if cut:
                yield tuple(x[:cut] for x in joined)
            held = [tuple(x[cut:] for x in joined)]
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

    return run


def _links(radius: int, blocks: int, choices: list[tuple[int, ...]]):
    step = 64 // blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, prints in _runs(["key", "fp"])(batches):
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
            left, right = [], []
            for i in np.flatnonzero(np.diff(starts) > 1).tolist():
                a, b = int(starts[i]), int(starts[i + 1])
                signed = prints[a:b]
                chosen = choices[int(keys[a]) >> 48]
                order = [x * step + j for x in range(blocks) if x not in chosen for j in range(step)]
                for x, y in forest(signed.view(np.uint64).tolist(), radius, 64, order):
                    left.append(int(signed[x]))
                    right.append(int(signed[y]))
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["u", "v"])

    return run


def _block_key(fp: F.Column, chosen: tuple[int, ...], index: int, step: int) -> F.Column:
    key = F.lit(index)
    for x in chosen:
        key = F.shiftleft(key.cast("long"), step).bitwiseOR(F.shiftrightunsigned(fp, x * step).bitwiseAND(F.lit((1 << step) - 1)))
    return key.cast("long")


def links(prints: DataFrame, radius: int = 2, blocks: int = 8) -> DataFrame:
    """Distinct fingerprints (fp) to the links (u, v) of a spanning forest for every key."""
    step = 64 // blocks
    choices = list(itertools.combinations(range(blocks), blocks - radius))
    if 64 % blocks or step * (blocks - radius) != 48 or len(choices) > 128:
        raise ValueError("a key must hold 48 bits of the fingerprint")
    keyed = prints.select(F.explode(F.array(*[_block_key(F.col("fp"), c, i, step) for i, c in enumerate(choices)])).alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links(radius, blocks, choices), "u long, v long")


def group(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable), n_docs of it.

    Rows with a null doc_id take part; a component of such rows alone has component_id null.
    """
    rows = staged(fingerprints(docs, shingle, id_col, text_col), "prints")
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    classes = rooted.groupBy(F.col("root").alias("class")).agg(F.min("least").alias("component_id"), F.sum("n").alias("n_docs"))
    named = staged(rooted.join(classes, F.col("root") == F.col("class")).select(F.col("fp").alias("of"), "component_id", "n_docs"), "classes")
    out = rows.join(named, F.col("fp") == F.col("of"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_docs")


# Similarity mode: a share of common shingles instead of a number of bits.

#: Bits of the wide fingerprint, bands of anchor keys, least hashes in a band.
WIDE, BANDS, ROWS = 64 * WIDE_WORDS, 16, 4
#: Members of a key or of a candidate group that one task compares, and distinct shingles of them; larger ones are dealt into blocks.
CELL, UNIT_SHINGLES = 4096, 1 << 22
#: Times that a candidate group of several blocks is dealt anew before what is still parted meets across blocks.
DEALS = 3
#: Groups of up to so many members are compared pair by pair, many groups at once: a lane of the planes is a pair.
LANES, LANE_BLOCK = 32, 1 << 15
#: Of sets with fewer shingles the distance says little: all pairs that their sizes allow are candidates.
SMALL = 64
#: Standard deviations that a pair at the similarity asked for may lie beyond its expected distance (3 in a million do).
DEVIATIONS = 4.5
#: Texts that a task remembers as done.
REMEMBERED = 50_000


def _spread(hashes: np.ndarray, odd) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = hashes * odd
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingle hashes of a whole text, sorted; none for a text without words."""
    parts = [np.unique(h) for h in shingle_hashes(text, shingle)]
    if len(parts) == 1:
        return parts[0]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _multipliers(n: int, seed: int) -> np.ndarray:
    """Odd numbers by a fixed rule."""
    return np.random.default_rng(seed).integers(1, 1 << 63, n).astype(np.uint64) | np.uint64(1)


def wide_print(own: np.ndarray) -> np.ndarray:
    """WIDE_WORDS words: the SimHash of a set of hashes, and of as many mixtures of them."""
    odds, ones = _multipliers(WIDE_WORDS - 1, SEED + 1), np.zeros((WIDE_WORDS, 64), np.int64)
    for i in range(0, len(own), 1 << 14):
        part = own[i : i + (1 << 14), None]
        ones += _ones(np.concatenate([part, _spread(part, odds)], axis=1))
    return np.packbits(2 * ones > len(own), axis=1, bitorder="little").view("<u8").ravel()


def anchors(own: np.ndarray) -> np.ndarray:
    """A key for each band: its number and the least values of its mixtures of the set's hashes."""
    odds, least = _multipliers(BANDS * ROWS, SEED)[:, None], np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 1 << 12):
        least = np.minimum(least, _spread(own[i : i + (1 << 12)], odds).min(1))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for own_least in least.reshape(BANDS, ROWS).T:
        keys = _spread(keys ^ own_least, np.uint64(MIXER))
    return keys.view(np.int64)


def _features(shingle: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for tid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if tid in seen:  # a copy; what is left over several tasks goes when the rows meet
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(tid)
                own = shingle_set(text.as_py(), shingle)
                if len(own):
                    row = (tid, wide_print(own).tobytes() + len(own).to_bytes(8, "little"), anchors(own), len(own))
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            kinds = (pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["tid", "fp", "keys", "size"])

    return run


def flip_share(similarity: float) -> float:
    """Share of fingerprint bits in which two sets of equal size and this Jaccard similarity are expected to differ."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def radii(similarity: float, bits: int = WIDE) -> tuple[int, int]:
    """(expected, farthest) distance of a pair at the similarity; beyond the farthest a pair surely doesn't reach it."""
    p = flip_share(similarity)
    return int(bits * p), min(bits - 1, int(bits * p + DEVIATIONS * (bits * p * (1 - p)) ** 0.5) + 1)


def _even(left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """The sizes allow the similarity."""
    return np.minimum(left, right) * (1 + 1e-9) >= similarity * np.maximum(left, right)


def _flags(masks: list[int], sizes: list[int]) -> np.ndarray:
    """Masks of blocks as one array of truth values."""
    raw = [np.unpackbits(np.frombuffer(m.to_bytes((n + 7) // 8, "little"), np.uint8), count=n, bitorder="little") for m, n in zip(masks, sizes, strict=True)]
    return np.concatenate(raw).astype(bool)


def _mask(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def pairs_within(prints: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, far: int, similarity: float) -> np.ndarray:
    """Which pairs of positions are candidates, compared bit-sliced: a lane of the planes is a pair's differing bits."""
    out, order = _even(sizes[left], sizes[right], similarity), list(range(WIDE))
    doubt = np.flatnonzero(out & (np.minimum(sizes[left], sizes[right]) >= SMALL))
    for at in range(0, len(doubt), LANE_BLOCK):
        part = doubt[at : at + LANE_BLOCK]
        planes = Planes(prints[left[part]] ^ prints[right[part]], WIDE, LANE_BLOCK)
        out[part] = _flags(planes.near(0, far, planes.full, order), [len(part)])
    return out


class _Reach:
    """Candidates of one member among many: the bit planes of all, and those whose sets are small."""

    def __init__(self, prints: np.ndarray, sizes: np.ndarray, far: int, similarity: float):
        self.prints, self.sizes, self.far, self.similarity = prints, sizes, far, similarity
        self.planes, self.order = Planes(prints, WIDE), list(range(WIDE))
        self.counts = [min(BLOCK, len(prints) - at) for at in range(0, len(prints), BLOCK)]
        self.small = sizes < SMALL

    def of(self, now: int, wanted: np.ndarray) -> np.ndarray:
        """Positions of the candidates of member now where wanted is true."""
        wanted = wanted & _even(self.sizes, self.sizes[now], self.similarity)
        if not self.small[now] and wanted.any():
            asked = wanted & ~self.small
            masks = [_mask(asked[at : at + BLOCK]) for at in range(0, len(asked), BLOCK)]
            query = int.from_bytes(self.prints[now].tobytes(), "little")
            wanted = wanted & self.small | _flags(self.planes.near(query, self.far, masks, self.order), self.counts)
        return np.flatnonzero(wanted)


def _small_forest(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """The pairs that a union-find needs."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    out = []
    for x, y in zip(left.tolist(), right.tolist(), strict=True):
        a, b = root(x), root(y)
        if a != b:
            parent[b] = a
            out.append((x, y))
    return out


def spanning_links(prints: np.ndarray, sizes: np.ndarray, far: int, similarity: float) -> list[tuple[int, int]]:
    """Links (positions) of a spanning forest of the candidate pairs."""
    n = len(prints)
    if n <= LANES:
        left, right = np.triu_indices(n, 1)
        found = pairs_within(prints, sizes, left, right, far, similarity)
        return _small_forest(left[found], right[found])
    reach, rest, links = _Reach(prints, sizes, far, similarity), np.ones(n, bool), []
    for first in range(n):
        queue = [first] if rest[first] else []
        rest[first] = False
        while queue:
            now = queue.pop()
            found = reach.of(now, rest)
            rest[found] = False
            links += [(now, x) for x in found.tolist()]
            queue += found.tolist()
    return links


def _members(tids: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(fps), "<u8").reshape(len(tids), WIDE_WORDS + 1)
    return raw[:, :-1], raw[:, -1].astype(np.int64)


def _cell_links(far: int, similarity: float):
    """(u, v) of the cells in a stream that is sorted by cell and text; the cells of few members are compared together."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, tids, fps in _runs(["cell", "tid", "fp"])(batches):
            new = np.r_[True, (keys[1:] != keys[:-1]) | (tids[1:] != tids[:-1])]  # two bands may give one key
            keys, tids, fps = keys[new], tids[new], fps[new]
            prints, sizes = _members(tids, fps)
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            counts = np.diff(np.r_[starts, len(keys)])
            links, lefts, rights = [], [], []
            for n in np.unique(counts).tolist():
                own = starts[counts == n]
                if 1 < n <= LANES:
                    x, y = np.triu_indices(n, 1)
                    lefts.append((own[:, None] + x).ravel())
                    rights.append((own[:, None] + y).ravel())
                elif n > LANES:
                    for at in own.tolist():
                        links += [(at + x, at + y) for x, y in spanning_links(prints[at : at + n], sizes[at : at + n], far, similarity)]
            if lefts:
                left, right = np.concatenate(lefts), np.concatenate(rights)
                found = pairs_within(prints, sizes, left, right, far, similarity)
                links += _small_forest(left[found], right[found])
            if links:
                x, y = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(tids[x].tolist(), pa.binary()), pa.array(tids[y].tolist(), pa.binary())], names=["u", "v"])

    return run


def verified_links(sets: list[np.ndarray], classes: np.ndarray, far: int, similarity: float) -> list[tuple[int, int]]:
    """Links (positions) that join the classes, numbers, of all members whose sets have the similarity: every pair of two classes is decided, by its sets where bits and sizes don't."""
    n, sizes, classes = len(sets), np.array([len(s) for s in sets]), classes.copy()
    reach = _Reach(np.array([wide_print(s) for s in sets]), sizes, far, similarity) if n > LANES else None
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    parts, marked, links = np.split(codes, ends[:-1]), np.zeros(len(names), bool), []
    for now in range(n - 1):
        rest = classes != classes[now]
        rest[: now + 1] = False
        found = np.flatnonzero(rest & _even(sizes, sizes[now], similarity)) if reach is None else reach.of(now, rest)
        if len(found):
            marked[parts[now]] = True
            hits = marked[np.concatenate([parts[i] for i in found.tolist()])]
            marked[parts[now]] = False
            common = np.add.reduceat(hits, np.cumsum(sizes[found]) - sizes[found], dtype=np.int64)
            for other in found[common / (sizes[found] + sizes[now] - common) >= similarity].tolist():
                if classes[other] != classes[now]:
                    links.append((now, other))
                    classes[classes == classes[other]] = classes[now]
    return links


def _unit_links(shingle: int, far: int, similarity: float):
    """(u, v) of the units in a stream of (unit, tid, root, text) that is sorted by unit and tid; only the hashes of one unit's texts are held."""

    def links(tids: list[bytes], roots: list[bytes], sets: list[np.ndarray]) -> pa.RecordBatch:
        found = verified_links(sets, np.unique(np.array(roots, object), return_inverse=True)[1], far, similarity) if len(tids) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([tids[i[k]] for i in found], pa.binary()) for k in (0, 1)], names=["u", "v"])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, ([], [], [])
        for batch in batches:
            for unit, tid, root, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if unit != held:
                    yield links(*own)
                    held, own = unit, ([], [], [])
                if not own[0] or own[0][-1] != tid:
                    for column, x in zip(own, (tid, root, shingle_set(text.as_py(), shingle)), strict=True):
                        column.append(x)
        yield links(*own)

    return run


def _text_id(text_col: str) -> F.Column:
    return F.unhex(F.md5(F.col(text_col).cast("string")))


def first_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(tid, id): the MD5 of every different text and the smallest id of its rows; null if none has one."""
    return docs.select(_text_id(text_col).alias("tid"), F.col(id_col).alias("id")).where("tid is not null").groupBy("tid").agg(F.min("id").alias("id"))


def candidate_links(feats: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) of a spanning forest of each key's candidates, from the features (tid, fp, keys)."""
    keyed = feats.select(F.explode("keys").alias("key"), "tid")
    common = keyed.groupBy(F.col("key").alias("of")).agg(F.count("*").alias("n")).where("n > 1").select("of", F.ceil(F.col("n") / CELL).cast("int").alias("k"))
    shared = keyed.join(common.hint("merge"), F.col("key") == F.col("of")).select("key", "k", F.col("tid").alias("t"))
    dealt = shared.join(feats.select("tid", "fp").hint("merge"), F.col("t") == F.col("tid")).withColumn("own", F.pmod(F.hash("tid"), F.col("k")))
    cell = F.when(F.col("k") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(cell.alias("cell"), "tid", "fp")
    return cells.repartition("cell").sortWithinPartitions("cell", "tid").mapInArrow(_cell_links(radii(similarity)[1], similarity), "u binary, v binary")


def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, text_col: str = "text", id_col: str = "doc_id", firsts: DataFrame | None = None) -> DataFrame:
    """(tid, root) for texts that are linked to a different text: tid is the text's MD5, root the group's smallest.

    Two different texts are linked if their sets of word shingles have a Jaccard similarity of `similarity` or more. Texts
    meet if they agree in a band of least hashes (with probability 1 - (1 - s^4)^16, 0.9998 at 0.8), and are candidates if
    the bit-sliced distance of their wide SimHashes doesn't rule the similarity out. The components of the candidates
    are groups, and within a group every pair of texts is decided by its shingle sets unless other links already join
    them, so no link depends on a group's size. A group too large for a task is dealt into blocks, several times anew;
    then the texts outside its largest class, in blocks, meet all of its blocks. Texts without words are linked to nothing.
    """
    firsts = staged(first_rows(docs, id_col, text_col), "firsts") if firsts is None else firsts
    texts = docs.select(_text_id(text_col).alias("tid"), F.col(text_col).cast("string").alias("text"), _id_key(F.col(id_col)).alias("id")).where("tid is not null")
    feats = staged(texts.select("tid", "text").mapInArrow(_features(shingle), "tid binary, fp binary, keys array<long>, size long").dropDuplicates(["tid"]), "features")
    groups = components(candidate_links(feats, similarity))
    sized = groups.join(feats.select("tid", "size"), F.col("node") == F.col("tid")).select("tid", "size", F.col("root").alias("group"))
    weights = sized.groupBy(F.col("group").alias("of")).agg(F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("size") / UNIT_SHINGLES)).cast("int").alias("k"))
    keys = firsts.select(F.col("tid").alias("first"), _id_key(F.col("id")).alias("first_id"))
    members = staged(sized.join(weights, F.col("group") == F.col("of")).join(keys, F.col("tid") == F.col("first")).select("first", "first_id", "size", "group", "k"), "members")
    # A row of each text alone: copies of a text, however many, lie apart by their ids.
    own = texts.join(members.hint("merge"), (F.col("tid") == F.col("first")) & (F.col("id") == F.col("first_id"))).select("tid", "text", "size", "group", "k")
    whole = staged(own, "whole")
    deals = F.explode(F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    block = lambda deal: F.pmod(F.xxhash64("tid", deal), F.col("k")).cast("int")
    units = whole.withColumn("deal", deals).select(F.xxhash64("group", "deal", block(F.col("deal"))).alias("unit"), "tid", F.col("tid").alias("root"), "text")

    def verified(units: DataFrame) -> DataFrame:
        sorted_units = units.repartition("unit").sortWithinPartitions("unit", "tid")
        return sorted_units.mapInArrow(_unit_links(shingle, radii(similarity)[1], similarity), "u binary, v binary")

    labels = components(verified(units))
    parted = whole.where("k > 1").join(labels.withColumnRenamed("root", "class"), F.col("tid") == F.col("node"), "left").select("tid", "size", "group", "k", F.coalesce("class", "tid").alias("root"))
    parted = staged(parted, "parted")
    if not parted.isEmpty():
        # A class may be nearly all of a group: counts are summed before they meet.
        counts = parted.groupBy("group", "root").agg(F.count("*").alias("n"))
        largest = counts.groupBy(F.col("group").alias("of")).agg(F.max(F.struct("n", "root")).alias("top")).select("of", F.col("top.root").alias("top"))
        outside = parted.join(largest, F.col("group") == F.col("of")).where("root <> top")
        rows = outside.groupBy(F.col("group").alias("open")).agg(F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("size") / UNIT_SHINGLES)).cast("int").alias("m"))
        tops = largest.join(rows, F.col("of") == F.col("open")).select("of", "top", "m")
        asked = parted.join(tops, F.col("group") == F.col("of")).select(F.col("tid").alias("t"), "root", (F.col("root") != F.col("top")).alias("out"), "m")
        met = whole.join(asked.hint("merge"), F.col("tid") == F.col("t"))
        cross = lambda row, column: F.xxhash64("group", row, column).alias("unit")
        every = met.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select(cross("row", block(F.lit(0))), "tid", "root", "text")
        few = met.where("out").withColumn("column", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(cross(F.pmod(F.xxhash64("tid", F.lit(-1)), F.col("m")).cast("int"), "column"), "tid", "root", "text")
        more = staged(verified(every.unionAll(few)), "more")
        labels = components(labels.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(more))
    return labels.select(F.col("node").alias("tid"), "root")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, one for each group of equal or near-duplicate texts: that with the smallest id, nulls last.

    All columns stay. Rows with a null text are groups of their own. A row whose text has no words stands for its equals.
    """
    firsts = staged(first_rows(docs, id_col, text_col), "firsts")
    roots = near_groups(docs, shingle, similarity, text_col, id_col, firsts).select(F.col("tid").alias("node"), "root")
    grouped = firsts.join(roots, F.col("tid") == F.col("node"), "left").groupBy(F.coalesce("root", "tid").alias("group"))
    best = grouped.agg(F.min(F.struct(F.col("id").isNull(), "id", "tid")).alias("b"))
    keepers = staged(best.select(F.col("b.tid").alias("__cm_t"), _id_key(F.col("b.id")).alias("__cm_i")), "keepers")
    # Texts are shuffled once, in the same way at every size; equal texts are told apart by their ids, so a large group of copies is spread.
    own = docs.where(F.col(text_col).isNotNull()).withColumns({"__cm_tid": _text_id(text_col), "__cm_id": _id_key(F.col(id_col))})
    found = own.join(keepers.hint("merge"), (F.col("__cm_tid") == F.col("__cm_t")) & (F.col("__cm_id") == F.col("__cm_i")), "left_semi")
    one = F.row_number().over(Window.partitionBy("__cm_tid", "__cm_id").orderBy("__cm_tid"))  # rows that repeat an id and a text
    return found.withColumn("__cm_n", one).where("__cm_n = 1").select(*docs.columns).unionAll(docs.where(F.col(text_col).isNull()))


def _id_key(column: F.Column) -> F.Column:
    return F.coalesce(column.cast("string"), F.lit("null"))
