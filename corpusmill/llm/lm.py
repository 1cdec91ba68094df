"""Document scores by masked pseudo-likelihood of a bidirectional window network.

Tokens are the lower-cased words between ASCII white space, hashed to BUCKETS identities. A network looks at the two
tokens before and the two behind a place (positions beyond the text are a blank of their own): the embeddings of the
four identities, each weighted by its place, add up to a hidden layer, and this decides at every node of a binary tree
over all identities which way the token's identity lies, so every bit of the prediction depends on the tokens on both
sides. Within an identity a word has its share of the corpus, from a table of all words of the corpus (64-bit names)
that is joined to the words of each block of texts. The sum of log p(token | both sides) over all places of a whole
text is its pseudo-log-likelihood.

Training is data-parallel over the whole corpus: texts are dealt to splits of about SPLIT_CHARACTERS by a hash of text
and id and put in the order of that hash; every split is trained in plain numpy gradient steps over all of its texts,
from the same start; the mean of the parameters, weighted by tokens and summed in the order of the splits, is the
model. So it doesn't depend on how the table is stored. The table of words grows with the corpus and stays in Spark;
what comes to the driver and goes out again is the network alone, whose size is fixed.

A null, empty or blank text has 0 tokens and score 0. With no tokens at all the network is the untrained start. Equal
texts have equal scores. Rows with equal or null ids are texts of their own. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

BITS = 15
BUCKETS = 1 << BITS
#: Levels of the tree whose nodes are so few that training takes them all together.
UPPER = 7
WIDTH = 16
PLACES = (-2, -1, 1, 2)
STEP = 4096
CHARACTERS_AT_ONCE = 16_000_000
SPLIT_CHARACTERS = 16_000_000
RATE = 0.1
SEED = 7
#: Parameters in a row that Spark sums, and splits that are summed before all are.
PART, TOGETHER = 1 << 11, 256

SCORED = "doc_id long, n_tokens long, score double, mean_score double"


def identities(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, borders): identities of the words of all texts, one after the other, and where each text begins and ends."""
    ids, _, borders = named(texts)
    return ids, borders


def named(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, words, borders): identities and names (XXH64) of the words of all texts, and where each text begins and ends."""
    known, codes, borders = coded(texts)
    return identity(known)[codes], known[codes], borders


def identity(words: np.ndarray) -> np.ndarray:
    return (words.view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int32)


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, codes, borders): names of the different words, the number of each place's word among them, where each text begins and ends."""
    from xxhash import xxh64_intdigest

    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    split = pc.ascii_split_whitespace(lower)
    numbered = split.flatten().dictionary_encode()
    names = numbered.dictionary.cast(pa.large_binary()).to_pylist()
    words = np.fromiter((xxh64_intdigest(w, SEED) for w in names), np.uint64, len(names)).view(np.int64)
    at, borders = numbered.indices.to_numpy(), split.offsets.to_numpy()
    if b"" in names:  # white space at an end gives an empty word
        blank = names.index(b"")
        full = at != blank
        words, at, borders = np.delete(words, blank), at[full] - (at[full] > blank), np.concatenate([[0], np.cumsum(full)])[borders]
    return words, at.astype(np.int32), borders


def windows(ids: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """(tokens, 4): the identities at the four places around each token; BUCKETS beyond its text."""
    text = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    places = np.arange(len(ids)) + 2 * (text + 1)  # two blanks part neighbouring texts
    line = np.full(len(ids) + 2 * len(borders), BUCKETS, np.int32)
    line[places] = ids
    return np.stack([line[places + p] for p in PLACES], 1)


def parts(batch: pa.Array) -> Iterator[pa.Array]:
    """Stretches of a column of texts of bounded size; one long text is a stretch of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(batch):
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + CHARACTERS_AT_ONCE, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def packed(codes: np.ndarray) -> bytes:
    """Numbers, compressed: their lowest bytes first."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def route(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, turns), one column a level: the nodes of the tree from the root, 1, to the identity's leaf, and 1 where the way turns right."""
    levels = np.arange(BITS, dtype=np.int32)
    return (ids[:, None] + BUCKETS) >> (BITS - levels), (ids[:, None] >> (BITS - 1 - levels) & 1).astype(np.float32)


def _summed(rows: np.ndarray, columns: Iterator[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, sums of its values) for each different row; the values come column after column."""
    some = np.flatnonzero(np.bincount(rows, minlength=size))
    number = np.empty(size, np.int64)
    number[some] = np.arange(len(some))
    codes = number[rows]  # the sums stay together
    return some, np.stack([np.bincount(codes, x, len(some)) for x in columns], 1).astype(np.float32)


class Network:
    """Embeddings of identities and the blank, weights of places, vectors and biases of the tree's nodes; all float32."""

    SHAPES = ((BUCKETS + 1, WIDTH), (len(PLACES), WIDTH), (BUCKETS, WIDTH), (BUCKETS,))

    def __init__(self, flat: np.ndarray | None = None):
        sizes = [int(np.prod(s)) for s in self.SHAPES]
        if flat is None:
            rng = np.random.default_rng(SEED)
            flat = np.concatenate([rng.normal(0, 0.4, sizes[0]), rng.normal(1, 0.3, sizes[1]), np.zeros(sizes[2] + sizes[3])])
        cuts = np.cumsum(sizes)[:-1]
        self.embed, self.place, self.node, self.bias = (x.reshape(s).copy() for x, s in zip(np.split(flat.astype(np.float32), cuts), self.SHAPES, strict=True))
        #: Sums of squared gradients by row, which the steps are divided by.
        self.past = [np.full(n, 1e-6, np.float32) for n in (BUCKETS + 1, len(PLACES), BUCKETS, BUCKETS)]

    def flat(self) -> np.ndarray:
        return np.concatenate([self.embed.ravel(), self.place.ravel(), self.node.ravel(), self.bias])

    def log_p(self, around: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log p(identity | around), for every row; a row's value doesn't depend on the others."""
        nodes, turns = route(ids)
        near, vectors = np.take(self.embed, around, 0, mode="clip"), np.take(self.node, nodes, 0, mode="clip")  # all are valid; to clip is quicker
        hidden = np.tanh(np.einsum("npw,pw->nw", near, self.place))
        logits = np.einsum("nkw,nw->nk", vectors, hidden) + np.take(self.bias, nodes)
        against = 1 + np.exp(np.clip((1 - 2 * turns) * logits, -20, 20))
        return -np.log(np.multiply.reduce(against, axis=1, dtype=np.float64))

    def gradients(self, around: np.ndarray, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of the sum of -log p: (rows, derivatives) of each of the four arrays, for the rows that have any.

        The few nodes of the upper levels are handled as one matrix.
        """
        nodes, turns = route(ids)
        upper, lower = nodes[:, :UPPER], nodes[:, UPPER:]
        near, vectors, top = np.take(self.embed, around, 0, mode="clip"), np.take(self.node, lower, 0, mode="clip"), self.node[: 1 << UPPER]
        hidden = np.tanh(np.einsum("npw,pw->nw", near, self.place))
        logits = np.empty(nodes.shape, np.float32)
        cells = upper + np.arange(len(ids))[:, None] * len(top)
        logits[:, :UPPER] = np.take(hidden @ top.T, cells)
        np.einsum("nkw,nw->nk", vectors, hidden, out=logits[:, UPPER:])
        logits += np.take(self.bias, nodes)
        wrong = np.negative(np.clip(logits, -20, 20, out=logits), out=logits)
        wrong = np.exp(wrong, out=wrong)
        wrong += 1
        wrong = np.subtract(np.reciprocal(wrong, out=wrong), turns, out=wrong)
        above, below = np.zeros((len(ids), len(top)), np.float32), wrong[:, UPPER:]
        above.ravel()[cells] = wrong[:, :UPPER]
        back = (above @ top + np.einsum("nk,nkw->nw", below, vectors)) * (1 - hidden * hidden)
        with_one = np.concatenate([hidden, np.ones((len(ids), 1), np.float32)], 1)
        # Level by level and place by place, so that the products run along the tokens.
        by_level, by_width = np.ascontiguousarray(below.T), np.ascontiguousarray(back.T)
        rows, low = _summed(lower.T.astype(np.int64).ravel(), ((by_level * x).ravel() for x in np.ascontiguousarray(with_one.T)), BUCKETS)
        rows, of_node = np.concatenate([np.arange(1 << UPPER), rows]), np.concatenate([above.T @ with_one, low])
        words, of_embed = _summed(around.T.astype(np.int64).ravel(), ((weight[:, None] * x).ravel() for x, weight in zip(by_width, self.place.T, strict=True)), BUCKETS + 1)
        return [(words, of_embed), (np.arange(len(PLACES)), np.einsum("nw,npw->pw", back, near)), (rows, of_node[:, :WIDTH]), (rows, of_node[:, WIDTH])]

    def learn(self, around: np.ndarray, ids: np.ndarray) -> None:
        """One step, each row's divided by the root of its squared gradients so far."""
        for own, past, (rows, change) in zip((self.embed, self.place, self.node, self.bias), self.past, self.gradients(around, ids), strict=True):
            now = np.take(past, rows) + np.einsum("ij,ij->i", *[change.reshape(len(rows), -1)] * 2) / (change.size / len(rows))
            past[rows] = now
            own[rows] = np.take(own, rows, 0) - change * (RATE / np.sqrt(now)).reshape(-1, *[1] * (change.ndim - 1))


#: What training a split gives: its parameters in parts, and its texts in blocks, as numbers of their words.
TRAINED = "split int, part int, tokens long, values binary, block long, doc_ids array<long>, counts array<long>, codes binary, words array<long>, times array<int>"
NAMES = [x.split()[0] for x in TRAINED.split(", ")]
KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]


def _train(batches: Iterator[pa.RecordBatch], learn: bool = True) -> Iterator[pa.RecordBatch]:
    """Batches (split, doc_id, text), sorted by split, to rows of TRAINED; without parameters if there is nothing to learn."""
    net, split, seen, block = Network(), None, 0, 0

    def rows(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), k) for c, k in zip(NAMES, KINDS, strict=True)], names=NAMES)

    def result() -> pa.RecordBatch:
        flat = net.flat()
        raw = [flat[i : i + PART].tobytes() for i in range(0, len(flat), PART)] if seen and learn else []
        return rows({"split": [split] * len(raw), "part": range(len(raw)), "tokens": [seen] * len(raw), "values": raw}, len(raw))

    for batch in batches:
        splits = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(splits[1:] != splits[:-1]) + 1).tolist(), len(splits)] if len(splits) else []
        for a, b in zip(edges, edges[1:], strict=False):
            if splits[a] != split:
                yield result()
                net, split, seen, block = Network(), int(splits[a]), 0, 0
            at = a
            for part in parts(batch.column(2).slice(a, b - a)):
                words, codes, borders = coded(part)
                ids = identity(words)[codes]
                around = windows(ids, borders)
                seen += len(ids)
                for i in range(0, len(ids) if learn else 0, STEP):
                    net.learn(around[i : i + STEP], ids[i : i + STEP])
                times = np.bincount(codes, minlength=len(words))
                order = np.argsort(-times, kind="stable")  # frequent words have small numbers, which take little room
                rank = np.empty(len(order), np.int32)
                rank[order] = np.arange(len(order))
                own = {
                    "block": [(split << 24) + block], "doc_ids": [batch.column(1).slice(at, len(part)).to_pylist()], "counts": [np.diff(borders)], "codes": [packed(rank[codes])],
                    "words": [words[order]], "times": [times[order]],
                }
                yield rows(own, 1)
                at, block = at + len(part), block + 1
    yield result()


def _add(first: bool):
    """Sums of the parameters of rows that are sorted by (part, group, ...): of float32 means times their tokens first, of float64 sums then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, tokens = None, None, 0

        def row() -> pa.RecordBatch:
            some = key is not None
            return pa.RecordBatch.from_arrays([pa.array([key[1]] * some, pa.int32()), pa.array([key[0]] * some, pa.int32()), pa.array([tokens] * some, pa.int64()), pa.array([total.tobytes()] * some, pa.binary())] if some else [pa.array([], k) for k in (pa.int32(), pa.int32(), pa.int64(), pa.binary())], names=["split", "part", "tokens", "values"])

        for batch in batches:
            for group, part, n, raw in zip(*(batch.column(c).to_pylist() for c in ("group", "part", "tokens", "values")), strict=True):
                own = np.frombuffer(raw, "<f4").astype(np.float64) * n if first else np.frombuffer(raw, "<f8")
                if key == (part, group):
                    total, tokens = total + own, tokens + n
                else:
                    yield row()
                    key, total, tokens = (part, group), own, n
        yield row()

    return run


class Model:
    """The mean network."""

    def __init__(self, flat: np.ndarray | None):
        self.net = Network(flat)

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For every text its tokens, and the sum of log p(identity | both sides) over all of its places."""
        ids, borders = identities(texts)
        return np.diff(borders), self.sums(ids, borders)

    def sums(self, ids: np.ndarray, borders: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
        """The sum over each text's tokens of their log p, and of what more gives for each."""
        around, each, counts = windows(ids, borders), np.zeros(len(ids)), np.diff(borders)
        for at in range(0, len(ids), STEP):
            each[at : at + STEP] = self.net.log_p(around[at : at + STEP], ids[at : at + STEP])
        if more is not None:
            each += more
        sums = np.zeros(len(counts))
        if len(ids):  # each text's tokens by themselves
            sums[counts > 0] = np.add.reduceat(each, borders[:-1][counts > 0])
        return sums


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn: bool = True) -> DataFrame:
    """Rows of TRAINED of all of docs, written: every text in one block."""
    text, name = F.col(text_col).cast("string"), F.col(id_col).cast("long") if id_col in docs.columns else F.lit(None).cast("long")
    size = docs.agg(F.sum(F.length(text))).first()[0] or 0
    n = max(1, -(-size // SPLIT_CHARACTERS))
    keyed = docs.select(F.xxhash64(text, name).alias("key"), name.alias("doc_id"), text.alias("text"))
    dealt = keyed.select(F.pmod("key", F.lit(n)).cast("int").alias("split"), "key", "doc_id", "text").repartitionById(n, F.col("split"))
    return staged(dealt.sortWithinPartitions("split", "key", "doc_id", "text").select("split", "doc_id", "text").mapInArrow(partial(_train, learn=learn), TRAINED), "trained")


def model_of(rows: DataFrame) -> Model:
    """The mean of the splits' parameters."""
    rows = rows.where("part is not null").select("split", "part", "tokens", "values")
    for first in (True, False):
        grouped = rows.withColumn("group", F.floor(F.col("split") / TOGETHER).cast("int") if first else F.lit(0))
        rows = grouped.repartition("part", "group").sortWithinPartitions("part", "group", "split").mapInArrow(_add(first), "split int, part int, tokens long, values binary")
    found = sorted(rows.toArrow().to_pylist(), key=lambda r: r["part"])  # the network once
    return Model(np.concatenate([np.frombuffer(r["values"], "<f8") / r["tokens"] for r in found]) if found else None)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of all texts of docs."""
    return model_of(trained(docs, id_col, text_col))


def word_shares(words: DataFrame) -> DataFrame:
    """(block, at, id, share) for words(block, at, word, n): the log of each word's share of its identity over all blocks, half a token added to each word.

    The corpus's words meet once, by identity, of which a word has one; a word has as many rows as there are blocks that hold it.
    """
    met = words.withColumn("id", F.shiftrightunsigned("word", 64 - BITS).cast("int")).repartition("id")
    same, own = Window.partitionBy("word", "id"), Window.partitionBy("id")  # sorted by the word first, which tells more
    table = met.withColumns({"total": F.sum("n").over(same), "blocks": F.count("*").over(same)})
    # Each word gives its half token once: what its rows give adds up to a whole number.
    whole = F.sum("n").over(own) + 0.5 * F.round(F.sum(1 / F.col("blocks")).over(own))
    return table.select("block", "at", "id", F.log((F.col("total") + 0.5) / whole).alias("share"))


def _score(model):
    def run(blocks: pa.Table, words: pa.Table) -> pa.Table:
        own, at = model.value, words.column("at").to_numpy()
        ids, shares = np.empty(len(at), np.int32), np.empty(len(at))
        ids[at], shares[at] = words.column("id").to_numpy(), words.column("share").to_numpy()
        docs, counts, sums = [], [np.zeros(0, np.int64)], [np.zeros(0)]
        for row in blocks.to_pylist():  # one
            codes = unpacked(row["codes"])
            docs += row["doc_ids"]
            counts.append(np.array(row["counts"], np.int64))
            sums.append(own.sums(ids[codes], np.concatenate([[0], np.cumsum(counts[-1])]), shares[codes]))
        counts, sums = np.concatenate(counts), np.concatenate(sums)
        means = np.divide(sums, counts, out=np.zeros(len(sums)), where=counts > 0)
        return pa.table([pa.array(docs, pa.int64()), pa.array(counts), pa.array(sums), pa.array(means)], names=["doc_id", "n_tokens", "score", "mean_score"])

    return run


def score(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its tokens, the sum of their conditional log-probabilities, and their mean. Without a model that of docs."""
    rows = trained(docs, id_col, text_col, learn=model is None)
    shared = docs.sparkSession.sparkContext.broadcast(model or model_of(rows))
    blocks = rows.where("block is not null")
    each = F.posexplode(F.arrays_zip("words", "times")).alias("at", "w")
    words = blocks.select("block", each).select("block", "at", F.col("w.words").alias("word"), F.col("w.times").cast("long").alias("n"))
    own = blocks.select(F.col("block").alias("of_block"), "doc_ids", "counts", "codes")
    return own.groupBy("of_block").cogroup(word_shares(words).groupBy("block")).applyInArrow(_score(shared), SCORED)
