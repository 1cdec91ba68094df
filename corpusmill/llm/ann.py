"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph for each shard.

Equal vectors are indexed once, with the smallest ids that any answer can need (k + 1 of them), so a vector that a
third of all rows repeat is one node. Distinct vectors are dealt to shards by a hash, of at most about `shard_rows`, and
of fewer while that gives every core a shard of LEAST_ROWS or more. A shard's graph is a list of layers, each a flat array of neighbours (members x degree, -1 where there are fewer) over the first
members of the shard, the highest layer over the fewest; members are added in blocks by a beam search for a whole
block at once, with neighbours picked for diversity. The graphs are written to the shared folder.

Queries go to every shard of their dimension; a task reads a shard's graph once and lets the queries pass by, each shard
answers with its best, and the answers of all shards are merged. Scores are cosines of the original vectors in double
precision. Of what the beam finds, everything as near as the k-th best, but for float32 rounding, is scored so; where
that is all that the beam holds, as with many parallel vectors, the query is held against the whole shard. Scores that
agree in DIGITS decimals are ties, which go to the smaller id.

Vectors that are null, empty or zero, or hold nulls or non-finite components, and rows with a null id take no part.
Rows that repeat an id are one candidate if their vectors are equal, else candidates with the same id; none is a
candidate for the query with that id. Vectors of other lengths than the query's are no candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

K = 5
SHARD_ROWS, LEAST_ROWS = 1 << 16, 4096
DEGREE = 12
BEAM_BUILD = 40
BEAM = 96
BLOCK = 256
QUERIES_AT_ONCE = 512
#: Queries that one task lets pass by a shard, about.
QUERY_BLOCK = 1 << 20
#: Tasks of a stage over shards at most; each then works on several shards one after the other.
MOST_TASKS = 20_000
#: How far float32 similarities may be off, and decimals of a score in which ties agree.
NEAR, DIGITS = 2e-6, 12

FOUND = "query_id long, vec_id long, score double"
GRAPH = "n int, ids binary, id_counts binary, vectors binary, sizes array<int>, links binary"
INDEX = f"dim int, shard int, {GRAPH}"


def _beam(unit: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (-1 where there are fewer) and similarities, best first, for all queries in step. entry: (queries, some) nodes."""
    q, degree = len(queries), links.shape[1]
    rows = np.arange(q)[:, None]
    ids = np.full((q, beam), -1, np.int32)
    sims = np.full((q, beam), -np.inf, np.float32)
    width = min(entry.shape[1], beam)
    ids[:, :width] = entry[:, :width]
    sims[:, :width] = np.where(ids[:, :width] >= 0, np.einsum("qmd,qd->qm", unit[ids[:, :width]], queries), -np.inf)
    seen = np.zeros((q, len(links) + 1), bool)
    seen[rows, ids[:, :width]] = True
    seen[:, -1] = True
    done = ids < 0
    live = np.arange(q)
    while len(live):
        open_sims = np.where(done[live], -np.inf, sims[live])
        at = open_sims.argmax(1)
        going = open_sims[np.arange(len(live)), at] > -np.inf
        live, at = live[going], at[going]
        if not len(live):
            break
        done[live, at] = True
        near = links[ids[live, at]]
        fresh = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        near_sims = np.where(fresh, np.einsum("qmd,qd->qm", unit[near], queries[live]), -np.inf).astype(np.float32)
        all_sims = np.concatenate([sims[live], near_sims], 1)
        best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, near, -1)], 1), best, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], 1), best, 1)
        sims[live] = np.take_along_axis(all_sims, best, 1)
    ids[~np.isfinite(sims)] = -1
    return ids, sims


def _diverse(unit: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """At most degree of each row's candidates (best first): those nearer to the row's point than to any picked before, then the nearest."""
    between = np.einsum("bid,bjd->bij", unit[ids], unit[ids])
    picked = np.zeros(ids.shape, bool)
    nearest = np.full(ids.shape, -np.inf, np.float32)
    for j in range(ids.shape[1]):
        take = (ids[:, j] >= 0) & (picked.sum(1) < degree) & (sims[:, j] > nearest[:, j])
        picked[:, j] = take
        nearest = np.where(take[:, None], np.maximum(nearest, between[:, j]), nearest)
    order = np.argsort(np.where(ids < 0, 2, ~picked), axis=1, kind="stable")[:, :degree]
    return np.take_along_axis(ids, order, 1)


def _add_back(unit: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Links from chosen neighbours back to the new nodes, thinned out where a node has too many."""
    source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
    source, target = source[target >= 0], target[target >= 0]
    if not len(target):
        return
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, starts = np.unique(target, return_index=True)
    degree = links.shape[1]
    for node, more in zip(nodes.tolist(), np.split(source, starts[1:]), strict=True):
        now = links[node]
        everyone = np.unique(np.concatenate([now[now >= 0], more]))
        if len(everyone) > degree:
            sims = unit[everyone] @ unit[node]
            best = np.argsort(-sims, kind="stable")[: 2 * degree]
            everyone = _diverse(unit, everyone[best][None], sims[best][None], degree)[0]
            everyone = everyone[everyone >= 0]
        links[node, : len(everyone)] = everyone
        links[node, len(everyone) :] = -1


def build(vectors: np.ndarray, degree: int = DEGREE, seed: int = 0) -> list[np.ndarray]:
    """Layers of a graph over vectors (double, not zero), highest first; the last one holds all."""
    n = len(vectors)
    unit = units(vectors)
    sizes = [n]
    while sizes[-1] > 2 * degree:
        sizes.append(sizes[-1] // degree)
    layers: list[np.ndarray] = []
    for size in reversed(sizes):
        width = 2 * degree if size == n else degree
        links = np.full((size, width), -1, np.int32)
        for at in range(0, size, BLOCK):
            new = np.arange(at, min(size, at + BLOCK), dtype=np.int32)
            own = unit[new] @ unit[new].T
            np.fill_diagonal(own, -np.inf)
            near = np.argsort(-own, axis=1, kind="stable")[:, : min(len(new) - 1, BEAM_BUILD)].astype(np.int32)
            ids, sims = new[near] if len(new) > 1 else np.full((len(new), 1), -1, np.int32), np.take_along_axis(own, near, 1) if len(new) > 1 else np.full((len(new), 1), -np.inf, np.float32)
            if at:
                old, old_sims = _beam(unit, links, unit[new], _entries(unit, layers, unit[new], at), BEAM_BUILD)
                ids, sims = np.concatenate([old, ids], 1), np.concatenate([old_sims, sims], 1)
                best = np.argsort(-sims, axis=1, kind="stable")[:, :BEAM_BUILD]
                ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            chosen = _diverse(unit, ids, sims, width // 2 if size == n else width)
            links[new, : chosen.shape[1]] = chosen
            _add_back(unit, links, new, chosen)
        _reach_all(links)
        layers.append(links)
    return layers


def _reach_all(links: np.ndarray) -> None:
    """Give every member that thinning left without an incoming link one from a neighbour of its own, in place of a link to a member with several."""
    incoming = np.bincount(links[links >= 0], minlength=len(links))
    for node in np.flatnonzero(incoming == 0).tolist():
        for near in links[node][links[node] >= 0].tolist():
            row = links[near]
            free = np.flatnonzero(row < 0)
            spare = free if len(free) else np.flatnonzero(incoming[row] > 1)
            if len(spare):
                at = spare[-1] if not len(free) else free[0]
                if row[at] >= 0:
                    incoming[row[at]] -= 1
                row[at] = node
                incoming[node] += 1
                break


def _entries(unit: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, below: int) -> np.ndarray:
    """Where to start in the next layer: what a narrow search of the layers above finds."""
    entry = np.zeros((len(queries), 1), np.int32)
    for links in layers:
        entry, _ = _beam(unit, links, queries, entry, 4)
        entry = np.where(entry < below, entry, -1)
        entry[:, 0] = np.where((entry < 0).all(1), 0, entry[:, 0])
        order = np.argsort(entry < 0, axis=1, kind="stable")
        entry = np.take_along_axis(entry, order, 1)
    return entry


def units(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def search(vectors: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Nodes nearest to each query, best first, -1 where there are fewer."""
    return np.concatenate([np.zeros((0, beam), np.int32), *[ids for ids, _ in _found(units(vectors), layers, units(queries), beam)]])


def _found(unit: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes and similarities for a stretch of queries after the other."""
    for at in range(0, len(queries), QUERIES_AT_ONCE):
        part = queries[at : at + QUERIES_AT_ONCE]
        yield _beam(unit, layers[-1], part, _entries(unit, layers[:-1], part, len(unit)), beam)


def near_nodes(unit: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, k: int, beam: int) -> Iterator[np.ndarray]:
    """For each query all nodes that may be among its k + 1 nearest, as far as the beam finds them."""
    at = 0
    for ids, sims in _found(unit, layers, queries, max(beam, k + 2)):
        for nodes, own in zip(ids, sims, strict=True):
            full = nodes[-1] >= 0
            nodes, own = nodes[nodes >= 0], own[nodes >= 0]
            near = own >= own[min(k, len(own) - 1)] - NEAR
            if full and near.all():  # ties may go on outside the beam
                whole = unit @ queries[at]
                nodes = np.flatnonzero(whole >= np.partition(whole, len(whole) - k - 1)[len(whole) - k - 1] - NEAR)
            else:
                nodes = nodes[near]
            at += 1
            yield nodes


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; equal vectors give equal values whatever stands beside them."""
    dot, left, right = (np.add.reduce(x, axis=-1) for x in (a * b, a * a, b * b))
    return dot / (np.sqrt(left) * np.sqrt(right))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), np.float64).reshape(-1, dim)


def _build_shard(table: pa.Table) -> pa.Table:
    dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
    ids = table.column("ids").to_pylist()
    # The order of arrival isn't fixed: a shuffle of the sorted members by the shard's number makes the layers.
    order = np.random.default_rng(shard).permutation(np.argsort([x[0] for x in ids], kind="stable"))
    vectors = _matrix(table.column("vec"), dim)[order]
    layers = build(vectors)
    lists = [ids[i] for i in order.tolist()]
    row = {
        "dim": dim, "shard": shard, "n": len(lists), "ids": np.concatenate([np.array(x, "<i8") for x in lists]).tobytes(), "id_counts": np.array([len(x) for x in lists], "<i4").tobytes(),
        "vectors": vectors.astype("<f8").tobytes(), "sizes": [n for links in layers for n in links.shape], "links": b"".join(links.astype("<i4").tobytes() for links in layers),
    }
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.binary()]
    return pa.table({k: pa.array([v], t) for (k, v), t in zip(row.items(), kinds, strict=True)})


def _build_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The graphs of a stream that is sorted by dim and shard; one shard's members are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "shard")], 1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)] if len(keys) else []
        for a, b in zip(edges, edges[1:], strict=False):
            if held and any(held[0].column(c)[0] != batch.column(c)[a] for c in ("dim", "shard")):
                yield from _build_shard(pa.Table.from_batches(held)).to_batches()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield from _build_shard(pa.Table.from_batches(held)).to_batches()


class _Shard:
    """A shard's graph, from its row."""

    def __init__(self, row: dict):
        self.vectors = np.frombuffer(row["vectors"], "<f8").reshape(row["n"], row["dim"])
        self.unit, self.layers, at = units(self.vectors), [], 0
        for n, degree in zip(row["sizes"][::2], row["sizes"][1::2], strict=True):
            self.layers.append(np.frombuffer(row["links"], "<i4", n * degree, at).reshape(n, degree))
            at += 4 * n * degree
        self.ids, self.counts = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["id_counts"], "<i4").astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts

    def answers(self, ids: list[int], queries: np.ndarray, k: int, beam: int) -> pa.RecordBatch:
        out: tuple[list, list, list] = ([], [], [])
        for i, nodes in enumerate(near_nodes(self.unit, self.layers, units(queries), k, beam)):
            counts = self.counts[nodes]
            scores = np.repeat(cosine(self.vectors[nodes], queries[i][None]), counts)
            found = self.ids[np.repeat(self.starts[nodes] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
            others = found != ids[i]
            found, scores = found[others], scores[others]
            best = np.lexsort((found, -np.round(scores, DIGITS)))[:k]
            for column, x in zip(out, ([ids[i]] * len(best), found[best].tolist(), scores[best].tolist()), strict=True):
                column += x
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])


def _search_shards(k: int, beam: int):
    """A stream in which the queries (is_query 1) of a shard follow its graph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            begin = 0
            for at in [*np.flatnonzero(batch.column("is_query").to_numpy() == 0).tolist(), batch.num_rows]:
                asked = batch.slice(begin, at - begin)
                if asked.num_rows:
                    yield shard.answers(asked.column("query_id").to_pylist(), _matrix(asked.column("vec"), shard.vectors.shape[1]), k, beam)
                if at < batch.num_rows:
                    shard = _Shard({c: batch.column(c)[at].as_py() for c in batch.schema.names})
                begin = at + 1

    return run


def valid_vectors(frame: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vec, dim) of the rows that take part."""
    vec = F.col(vec_col).cast("array<double>")
    rows = frame.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0)).withColumn("dim", F.size("vec"))


def _task(dim: str, number: Column | str, tasks: int) -> Column:
    """Tasks in turn for the numbers of a dimension."""
    return F.pmod(F.hash(dim).cast("long") + (F.col(number) if isinstance(number, str) else number), F.lit(tasks)).cast("int")


def nearest(candidates: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> DataFrame:
    """candidates and queries as valid_vectors() gives them: (query_id, rank, vec_id, score), the k nearest found."""
    first = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    distinct = candidates.distinct().withColumn("first", first).where(F.col("first") <= k + 1).groupBy("vec", "dim").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    distinct = staged(distinct, "vectors")
    cores = candidates.sparkSession.sparkContext.defaultParallelism
    shards_of = F.greatest(F.ceil(F.count("*") / shard_rows), F.least(F.ceil(F.count("*") / LEAST_ROWS), F.lit(cores)))
    dims = distinct.groupBy("dim").agg(shards_of.cast("int").alias("shards")).select(F.col("dim").alias("of_dim"), "shards")
    dealt = distinct.join(dims, F.col("dim") == F.col("of_dim")).withColumn("shard", F.pmod(F.xxhash64("vec"), F.col("shards")).cast("int"))
    # Shards are few bytes and much work: a task each, which adaptive execution doesn't merge.
    total = dims.agg(F.coalesce(F.sum("shards"), F.lit(1))).first()[0]
    tasks = min(total, MOST_TASKS)
    own = dealt.select("dim", "shard", "vec", "ids").repartitionById(tasks, _task("dim", "shard", tasks))
    index = staged(own.sortWithinPartitions("dim", "shard").mapInArrow(_build_shards, INDEX), "graphs")
    asked = staged(queries.select(F.col("id").alias("query_id"), "vec", "dim").distinct(), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    shards = index.select(F.col("dim").alias("i_dim"), F.col("shard").alias("i_shard"))
    sent = asked.join(shards, F.col("dim") == F.col("i_dim")).select("dim", F.col("i_shard").alias("shard"), F.pmod(F.hash("query_id"), F.lit(blocks)).alias("qb"), F.lit(1).alias("is_query"), "query_id", "vec")
    graphs = index.withColumns({"qb": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "is_query": F.lit(0)})
    keys = ["dim", "shard", "qb"]
    tasks = min(total * blocks, MOST_TASKS)
    task = _task("dim", F.col("shard") * blocks + F.col("qb"), tasks)
    stream = graphs.unionByName(sent, allowMissingColumns=True).repartitionById(tasks, task).sortWithinPartitions(*keys, "is_query")
    found = stream.mapInArrow(_search_shards(k, beam), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", DIGITS).desc(), "vec_id"))
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
