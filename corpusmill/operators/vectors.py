"""Dense vectors and multi-vectors: similarities as expressions, exact top-k for a set of queries, late interaction, pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .bm25 import top


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


#: Queries, or patches of queries, that one pass over the vectors answers; their matrix goes to every task.
QUERY_BLOCK = 4096
#: Vectors that meet 512 queries in one product, whatever the batches; pairs that are scored row by row at once.
VECTOR_BLOCK, EXACT_BLOCK = 1024, 32768
METRICS = ("cosine", "dot", "euclid")
#: What rounding may add to a matrix product, for each unit of the vectors' lengths.
ROUNDING = 1e-12


def _matrices(column, positions) -> dict:
    """By length: (positions, matrix) of the vectors in an Arrow list column; those that are empty or hold nulls or non-finite values are left out."""
    import numpy as np
    import pyarrow.compute as pc

    sizes, out = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        values = column.take(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)  # nulls become NaN
        good = np.isfinite(values).all(1)
        if good.any():
            out[size] = (positions[at[good]], values[good])
    return out


def _exact(metric: str, q, v):
    """Row by row; equal vectors have equal values whatever stands beside them. Larger is nearer."""
    import numpy as np

    if metric == "euclid":
        return -np.sqrt(np.add.reduce((q - v) ** 2, axis=1))
    products = np.add.reduce(q * v, axis=1)
    return products if metric == "dot" else products / (np.sqrt(np.add.reduce(q * q, axis=1)) * np.sqrt(np.add.reduce(v * v, axis=1)))


class _Best:
    """The k best of each of n queries among (query, id, score) seen so far, ties by the smaller id."""

    def __init__(self, n: int, k: int):
        import numpy as np

        self.n, self.k, self.limit = n, k, np.full(n, -np.inf)
        self.query, self.ids, self.score = np.zeros(0, np.int64), None, np.zeros(0)

    def add(self, query, ids, score) -> None:
        import numpy as np

        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        ids = ids if self.ids is None else np.concatenate([self.ids, ids])
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], -score, query))
        query, ids, score = query[order], ids[order], score[order]
        first = np.searchsorted(query, query, "left")
        rank = np.arange(len(query)) - first
        last = rank == self.k - 1
        self.limit[query[last]] = score[last]
        self.query, self.ids, self.score = query[rank < self.k], ids[rank < self.k], score[rank < self.k]


def _nearest(queries, k: int, metric: str):
    """Arrow batches (id, v) to the k best of this task: (query_id, id, score)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        asked, best, kind = queries.value, None, None
        names = asked.column("query_id").combine_chunks()
        blocks = _matrices(asked.column("q").combine_chunks(), np.arange(len(names)))
        if metric == "cosine":
            blocks = {size: (at[keep], q[keep]) for size, (at, q) in blocks.items() for keep in [np.any(q != 0, axis=1)]}
        for batch in batches:
            ids, kind = batch.column(0).to_numpy(zero_copy_only=False), batch.schema.field(0).type
            best = best or _Best(len(names), k)
            for size, (rows, v) in (own for begin in range(0, batch.num_rows, VECTOR_BLOCK) for own in _matrices(batch.column(1).slice(begin, VECTOR_BLOCK), np.arange(begin, min(begin + VECTOR_BLOCK, batch.num_rows))).items()):
                if metric == "cosine":
                    some = np.any(v != 0, axis=1)
                    rows, v = rows[some], v[some]
                at, q = blocks.get(size, (np.zeros(0, np.int64), np.zeros((0, size))))
                for begin in range(0, len(at), 512):
                    own, part = at[begin : begin + 512], q[begin : begin + 512]
                    near, qn, vn = part @ v.T, np.linalg.norm(part, axis=1)[:, None], np.linalg.norm(v, axis=1)[None]
                    limit, slack = best.limit[own][:, None], ROUNDING * size * qn * vn
                    if metric == "cosine":
                        near, slack = near / (qn * vn), ROUNDING * size
                    elif metric == "euclid":  # squares of distances, so that the limit must be one too
                        near, limit, slack = 2 * near - qn * qn - vn * vn, np.where(np.isfinite(limit), -limit * limit, limit), ROUNDING * size * (qn + vn) ** 2
                    if near.shape[1] > k:  # of this batch only what can be among its own k best, and better than the limit
                        kth = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k][:, None]
                        limit = np.maximum(limit, kth)
                    x, y = np.nonzero(near >= limit - slack)
                    for at_once in range(0, len(x), EXACT_BLOCK):  # ties may be many
                        i, j = x[at_once : at_once + EXACT_BLOCK], y[at_once : at_once + EXACT_BLOCK]
                        best.add(own[i], ids[rows[j]], _exact(metric, part[i], v[j]))
        if best is not None and best.ids is not None:
            yield pa.RecordBatch.from_arrays([names.take(pa.array(best.query)), pa.array(best.ids, kind), pa.array(best.score)], names=["query_id", "id", "score"])

    return run


def _blocks(asked: DataFrame, key: str) -> list:
    """The rows of asked, as Arrow tables of about QUERY_BLOCK rows with whole keys; one at a time comes to the driver."""
    n = asked.count()
    count = max(1, -(-n // QUERY_BLOCK))
    return [asked.where(F.pmod(F.hash(key), F.lit(count)) == i) for i in range(count)]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", query_id: str = "query_id", query_vec: str = "vec", threshold: float | None = None, keep: Column | None = None) -> DataFrame:
    """(query_id, id, score, rank): exact search of a stated set of queries in all vectors, each query's k best, ties by the smaller id.

    Queries go to the tasks in blocks of bounded size; a block meets every batch of vectors in a matrix product, what
    may be among the best is scored row by row, and a task gives only its k best of a query to the shuffle. Vectors and
    queries that are null or empty, hold nulls or non-finite values, or, for the cosine, are zero take no part, nor do
    vectors of another length than the query's. For larger sets of queries see the graph index.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    own = (vectors if keep is None else vectors.where(keep)).select(F.col(id_col).alias("id"), as_double(F.col(vec_col)).alias("v")).where("id is not null and v is not null")
    asked = staged(queries.select(F.col(query_id).alias("query_id"), as_double(F.col(query_vec)).alias("q")).where("query_id is not null and q is not null"), "queries")
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {own.schema['id'].dataType.simpleString()}, score double"
    found = None
    for block in _blocks(asked, "query_id"):
        one = own.mapInArrow(_nearest(own.sparkSession.sparkContext.broadcast(block.toArrow()), k, metric), kinds)
        found = one if found is None else found.unionAll(one)
    return top(found if threshold is None else found.where(F.col("score") >= threshold), k)


def _maxsim(queries, k: int):
    """Arrow batches (id, p), sorted by id, to the k best pages of this task."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        asked = queries.value.sort_by("query_id")
        names = asked.column("query_id").combine_chunks()
        blocks = _matrices(asked.column("q").combine_chunks(), np.arange(len(names)))
        coded = names.dictionary_encode()
        owner = coded.indices.to_numpy()
        best, kind = _Best(len(coded.dictionary), k), None
        page, held = None, np.zeros(0)

        def done() -> None:
            met = np.isfinite(held)
            if page is not None and met.any():
                sums = np.bincount(owner[met], held[met], len(coded.dictionary))
                some = np.flatnonzero(np.bincount(owner[met], minlength=len(coded.dictionary)))
                some = some[sums[some] >= best.limit[some]]
                if len(some):
                    best.add(some, np.full(len(some), page, ids.dtype), sums[some])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, kind = batch.column(0).to_numpy(zero_copy_only=False), batch.schema.field(0).type
            starts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for a, b in zip(starts, starts[1:], strict=False):
                if page is None or ids[a] != page:
                    done()
                    page, held = ids[a], np.full(len(names), -np.inf)
                for size, (_, p) in _matrices(batch.column(1).slice(a, b - a), np.arange(b - a)).items():
                    if size in blocks:
                        at, q = blocks[size]
                        held[at] = np.maximum(held[at], (q @ p.T).max(1))
        done()
        if best.ids is not None:
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(best.query)), pa.array(best.ids, kind), pa.array(best.score)], names=["query_id", "id", "score"])

    return run


def maxsim(query_patches: DataFrame, page_patches: DataFrame, k: int = 10) -> DataFrame:
    """Late interaction: query_patches(query_id, patch_id, vec) against page_patches(id, vec): the sum over a query's patches of the best dot product in a page.

    A page's patches, about a thousand, come to one task in sorted order; it keeps the best product of each query patch
    while they pass by, and only its k best pages of a query go to the shuffle. Queries go to the tasks in blocks of
    bounded size. Patches take no part if nearest() leaves such vectors out; zero ones do.
    """
    q = staged(query_patches.select("query_id", as_double(F.col("vec")).alias("q")).where("query_id is not null and q is not null"), "patches")
    p = page_patches.select("id", as_double(F.col("vec")).alias("p")).where("id is not null and p is not null").repartition("id").sortWithinPartitions("id")
    kinds = f"query_id {q.schema['query_id'].dataType.simpleString()}, id {p.schema['id'].dataType.simpleString()}, score double"
    found = None
    for block in _blocks(q, "query_id"):
        one = p.mapInArrow(_maxsim(p.sparkSession.sparkContext.broadcast(block.toArrow()), k), kinds)
        found = one if found is None else found.unionAll(one)
    return top(found, k)


def pooled(patches: DataFrame, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(id, vec): the element-wise mean of each id's vectors, scaled to length 1 (left as it is if it is zero)."""
    each = patches.select(F.col(id_col).alias("id"), F.posexplode(as_double(F.col(vec_col))).alias("at", "x"))
    means = each.groupBy("id", "at").agg(F.avg("x").alias("x"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s.x)
    return means.groupBy("id").agg(vec.alias("m")).select("id", F.when(norm(F.col("m")) > 0, F.transform("m", lambda x: x / norm(F.col("m")))).otherwise(F.col("m")).alias("vec"))
