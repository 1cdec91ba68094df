"""An external search engine as another keyword index: rows as bulk actions, queries as request bodies; the client is a plug-in.

The request forms are those of engines that take JSON bulk actions and boolean queries. No client library is bundled: a
client is a function that is made once for each task.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BULK = 500


def actions(frame: DataFrame, index: str, id_col: str = "id") -> DataFrame:
    """(id, action): what indexes each row under its id, two lines of JSON."""
    head = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), F.col(id_col).cast("string").alias("_id")).alias("index")))
    return frame.select(F.col(id_col).cast("string").alias("id"), F.concat(head, F.lit("\n"), F.to_json(F.struct("*")), F.lit("\n")).alias("action"))


def bulk_index(frame: DataFrame, index: str, client: Callable[[], Callable[[list[str]], list[bool]]], id_col: str = "id", bulk: int = BULK) -> DataFrame:
    """(id, indexed) of every row, sent in bulks: client() makes a function from a list of actions to whether each was taken."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        send = client()
        for batch in batches:
            ids, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            taken = [x for i in range(0, len(own), bulk) for x in send(own[i : i + bulk])]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(taken, pa.bool_())], names=["id", "indexed"])

    return actions(frame, index, id_col).mapInArrow(run, "id string, indexed boolean")


def request(query: str, limit: int = 10, filters: dict | None = None) -> str:
    """A search for the query's words in the text; a list among the filters means any of its values, a null a missing value."""
    clauses = [{"bool": {"must_not": {"exists": {"field": k}}}} if v is None else {"terms": {k: list(v)}} if isinstance(v, list | tuple) else {"term": {k: v}} for k, v in (filters or {}).items()]
    return json.dumps({"query": {"bool": {"must": [{"match": {"text": query}}]} | ({"filter": clauses} if clauses else {})} , "size": limit}, sort_keys=True)


def deletion(document_id: str) -> str:
    return json.dumps({"query": {"term": {"document_id": document_id}}})


def search(queries: DataFrame, client: Callable[[], Callable[[str], list[tuple[str, float]]]], limit: int = 10, filters: dict | None = None) -> DataFrame:
    """(query_id, id, score, rank) for queries(query_id, query): client() makes a function from a request to (id, score) hits, best first."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ask = client()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for key, query in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for rank, (name, score) in enumerate(ask(request(query or "", limit, filters)), 1):
                    for column, x in zip(out, (key, name, score, rank), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.int64())], names=["query_id", "id", "score", "rank"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "query").mapInArrow(run, f"query_id {kind}, id string, score double, rank long")
