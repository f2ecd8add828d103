"""Exact top-k retrieval over vectors, and what is shown for a hit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chunkloom.config import Settings
from chunkloom.shared import written

#: Bytes of query vectors that are collected and broadcast for one pass over the rows; more queries take more passes.
QUERY_BYTES = 64 << 20
#: Scores held at once in a task.
SCORES = 1 << 22
#: Hits, which a query set bounds, are broadcast to fetch their texts up to so many rows.
BROADCAST_HITS = 500_000


def top_k(queries: DataFrame, rows: DataFrame, k: int = Settings().top_k, digits: int = 6, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """queries (query_id, vector) against rows (row_id, vector): query_id, rank from 1, row_id, score.

    Cosine similarity rounded to some digits; ties go to the lesser row_id; null vectors, zero vectors and
    vectors of another length than the queries' match nothing. Queries are a stated set.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("row_id"))
    found = candidates(queries, rows, k, digits, query_bytes)
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "row_id", "score")


def candidates(queries: DataFrame, rows: DataFrame, k: int, digits: int = 6, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, row_id, score): the k best rows of each task for each query.

    Queries are broadcast as one matrix. A task multiplies Arrow batches of rows with it, block by block,
    keeps the best k a query, and passes them on at its end: what is shuffled is tasks times queries times
    k, however many rows a task reads. Rows are read once for each query_bytes of queries.
    """
    wanted = queries.where("query_id IS NOT NULL AND vector IS NOT NULL").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    schema = f"query_id {wanted.schema['query_id'].dataType.simpleString()}, row_id {rows.schema['row_id'].dataType.simpleString()}, score double"
    kinds = [to_arrow_type(df.schema[name].dataType) for df, name in ((wanted, "query_id"), (rows, "row_id"))]
    size = wanted.agg(F.sum(F.size("vector") * 8 + 64)).first()[0] or 0
    passes = max(1, -(-size // query_bytes))
    narrow = rows.select("row_id", F.col("vector").cast("array<double>").alias("vector"))
    found = None
    for p in range(passes):
        part = wanted if passes == 1 else wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p)
        table = part.toArrow()
        shared = rows.sparkSession.sparkContext.broadcast((table.column(0).to_pylist(), [np.array(v, float) for v in table.column(1).to_pylist()]))
        scored = narrow.mapInArrow(_scorer(shared, kinds, k, digits), schema)
        found = scored if found is None else found.unionByName(scored)
    return found


class _Best:
    """The best k (query, row id, score) so far."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.line = k, np.full(queries, -np.inf)  # a query's k-th best score
        self.q, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0), []

    def add(self, q: np.ndarray, score: np.ndarray, ids: list) -> None:
        q, score, ids = np.concatenate([self.q, q]), np.concatenate([self.score, score]), self.ids + ids
        if not ids:
            return
        _, by_id = np.unique(np.array(ids), return_inverse=True)
        order = np.lexsort((by_id, -score, q))
        at = np.arange(len(order)) - np.searchsorted(q[order], q[order])
        self.line[q[order[at == self.k - 1]]] = score[order[at == self.k - 1]]
        order = order[at < self.k]
        self.q, self.score, self.ids = q[order], score[order], [ids[i] for i in order.tolist()]


def _scorer(shared, kinds: list[pa.DataType], k: int, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors = shared.value
        groups = []  # queries of one length each
        for size in sorted({len(v) for v in vectors}):
            own = [i for i, v in enumerate(vectors) if len(v) == size]
            matrix = np.array([vectors[i] for i in own]).reshape(len(own), size)
            groups.append((size, np.array(own), matrix, np.sqrt((matrix * matrix).sum(1))))
        best = _Best(len(query_ids), k)
        for batch in batches:
            batch = batch.filter(pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()))
            for size, own, queries, lengths in groups:
                part = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), size))
                if not part.num_rows or not size:
                    continue
                rows = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                sizes = np.sqrt((rows * rows).sum(1))
                step = max(1, SCORES // len(rows))
                for a in range(0, len(own), step):
                    with np.errstate(invalid="ignore", divide="ignore"):
                        scores = np.round((queries[a : a + step] @ rows.T) / (lengths[a : a + step, None] * sizes[None, :]), digits)
                    scores[~np.isfinite(scores)] = -np.inf
                    line = best.line[own[a : a + step]]
                    if len(rows) > k:
                        line = np.maximum(line, np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k])
                    q, j = np.nonzero((scores >= line[:, None]) & np.isfinite(scores))
                    best.add(own[a + q], scores[q, j], part.column(0).take(pa.array(j)).to_pylist())
        if best.ids:
            yield pa.RecordBatch.from_arrays([pa.array([query_ids[i] for i in best.q.tolist()], kinds[0]), pa.array(best.ids, kinds[1]), pa.array(best.score)], names=["query_id", "row_id", "score"])

    return run


def shown_text(text: Column, window: Column) -> Column:
    """What replaces a hit's text: its window where it has one."""
    return F.coalesce(window, text)


def with_nodes(hits: DataFrame, nodes: DataFrame, broadcast_hits: int = BROADCAST_HITS) -> DataFrame:
    """hits (row_id, ...) with the other columns of their nodes (row_id, ...); where these have a window, it is the text shown.

    Hits number at most k for each query: while they are few they are broadcast, and no text is shuffled.
    """
    if "window" in nodes.columns:
        nodes = nodes.withColumn("text", shown_text(F.col("text"), F.col("window"))).drop("window")
    hits = written(hits, "hits")
    return nodes.join(F.broadcast(hits) if hits.count() <= broadcast_hits else hits, "row_id")
