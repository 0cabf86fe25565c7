"""Exact search for the highest inner products by columnar branch and bound.

Tasks hold candidates in vertical layout, one array per dimension.  Inner products are accumulated block by block of
dimensions; what the remaining dimensions can still add lies within the product of the remaining masses (norms) of query and
candidate.  A candidate whose upper bound is under the query's k-th best lower bound is dropped, the survivors are compacted
before the next block of dimensions.  Dimensions of large mass come first.

Queries are sent to the tasks in blocks of bounded size, each against all rows; a task keeps the k best per query over all
its candidates, and the k best of all tasks follow from a ranking per query.

Components become floor(scale * x).  Vectors that are null, or hold a null or a value that is not finite, take no part;
vectors of different length are not compared.  Rows with the query's own id are no candidates of it.  A repeated query row
(same id and vector) is asked once; repeated candidate rows are ranked as often as they occur.  Rows without vec_id are no
queries, and as candidates they come after equal scores with an id.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierbook.llm.common import stored

SCALE = 256
DIMENSIONS = 16
QUERY_BLOCK = 4096
CANDIDATES = 2048
#: Whole numbers are exact in floating point below this; beyond it, integers are used.
EXACT = float(1 << 53)
NO_ID = np.iinfo(np.int64).max


def whole(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """id and v, arrays of whole numbers; only vectors that take part."""
    values = F.col(vector_col).cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(values.isNotNull()).where(fine)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(values, lambda x: F.floor(x * scale)).alias("v"))


class Best:
    """The k best (score, then smaller id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.score = k, np.full((queries, k), np.iinfo(np.int64).min, np.int64)
        self.id = np.full((queries, k), NO_ID, np.int64)
        self.full = np.zeros((queries, k), bool)

    def floor(self) -> np.ndarray:
        """The k-th best score, or the least number where there are fewer."""
        return np.where(self.full[:, -1], self.score[:, -1], np.iinfo(np.int64).min)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        begin = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, int)
        place = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
        query, ids, score, place = (x[place < self.k] for x in (query, ids, score, place))
        touched, row = np.unique(query, return_inverse=True)
        size = (len(touched), self.k)
        new_s, new_i, new_f = np.full(size, np.iinfo(np.int64).min), np.full(size, NO_ID), np.zeros(size, bool)
        new_s[row, place], new_i[row, place], new_f[row, place] = score, ids, True
        s, i, f = (np.concatenate([old[touched], new], axis=1) for old, new in ((self.score, new_s), (self.id, new_i), (self.full, new_f)))
        best = np.lexsort((i, -s, ~f), axis=1)[:, : self.k]
        self.score[touched], self.id[touched], self.full[touched] = (np.take_along_axis(x, best, 1) for x in (s, i, f))


def search_block(queries: np.ndarray, query_ids: np.ndarray, columns: np.ndarray, ids: np.ndarray, best: Best, block: int) -> None:
    """One block of candidates, columns (dimension, candidate), against all queries of one length."""
    dims = columns.shape[0]
    largest = max(1.0, float(np.abs(queries).max(initial=0))) * max(1.0, float(np.abs(columns).max(initial=0))) * max(1, dims)
    if largest >= EXACT:  # no bounds beyond exact floating point
        scores = queries.astype(np.int64) @ columns.astype(np.int64)
        q, c = np.nonzero(query_ids[:, None] != ids[None, :])
        best.add(q, ids[c], scores[q, c])
        return
    order = np.argsort(-np.square(queries).sum(axis=0), kind="stable")
    queries, columns = queries[:, order], columns[order]
    ahead = np.arange(block, dims + block, block)

    def rest(matrix: np.ndarray, axis: int) -> np.ndarray:
        squares = np.square(matrix).sum(axis=axis)
        return np.sqrt(np.maximum(squares, 0))

    floor = best.floor().astype(np.float64)
    partial = queries[:, :block] @ columns[:block]
    q_rest, c_rest = rest(queries[:, block:], 1), rest(columns[block:], 0)
    slack = q_rest[:, None] * c_rest[None, :] * (1 + 1e-9)
    own = query_ids[:, None] == ids[None, :]
    lower = np.where(own, -np.inf, partial - slack)
    if lower.shape[1] >= best.k:
        floor = np.maximum(floor, np.partition(lower, -best.k, axis=1)[:, -best.k])
    q, c = np.nonzero((partial + slack >= floor[:, None]) & ~own)
    score = partial[q, c]
    for end in ahead[:-1]:
        part = slice(end, min(dims, end + block))
        for s in range(0, len(q), 1 << 18):
            e = slice(s, s + (1 << 18))
            score[e] += np.einsum("ij,ij->i", queries[q[e], part], columns.T[c[e], part])
        if part.stop < dims:
            q_rest, c_rest = rest(queries[:, part.stop :], 1), rest(columns[part.stop :], 0)
            upper = score + q_rest[q] * c_rest[c] * (1 + 1e-9)
            kept = upper >= floor[q]
            q, c, score = q[kept], c[kept], score[kept]
    kept = score >= floor[q]
    best.add(q[kept], ids[c[kept]], np.rint(score[kept]).astype(np.int64))


def _search(shared, k: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = shared.value
        best = {n: Best(len(ids), k) for n, (ids, _) in by_length.items()}

        def flush(n: int, rows: list[np.ndarray], names: list[int]) -> None:
            ids, queries = by_length[n]
            columns = np.ascontiguousarray(np.array(rows, np.float64).reshape(len(rows), n).T)
            found = np.array(names, np.int64)
            for s in range(0, len(ids), 1024):  # bounds the matrix of queries and candidates
                part = Best(0, k)
                part.score, part.id, part.full = best[n].score[s : s + 1024], best[n].id[s : s + 1024], best[n].full[s : s + 1024]
                search_block(queries[s : s + 1024], ids[s : s + 1024], columns, found, part, block)

        held: dict[int, tuple[list, list]] = {n: ([], []) for n in by_length}
        for batch in batches:
            for name, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(v) in held:
                    rows, names = held[len(v)]
                    rows.append(v)
                    names.append(NO_ID if name is None else name)
                    if len(rows) == CANDIDATES:
                        flush(len(v), rows, names)
                        rows.clear()
                        names.clear()
        for n, (rows, names) in held.items():
            if rows:
                flush(n, rows, names)
            q, place = np.nonzero(best[n].full)
            ids = best[n].id[q, place]
            yield pa.record_batch(
                [pa.array(by_length[n][0][q]), pa.array(ids, mask=ids == NO_ID), pa.array(best[n].score[q, place])], ["query_id", "vec_id", "score"]
            )

    return run


def search(vectors: DataFrame, is_query, k: int = 5, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding",
           block: int = DIMENSIONS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row that is_query (a column of ``id``) picks."""
    spark = vectors.sparkSession
    rows = stored(whole(vectors, scale, id_col, vector_col), "vectors")
    queries = rows.where(is_query(F.col("id"))).distinct()
    blocks = max(1, math.ceil(queries.count() / query_block))
    queries = stored(queries.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks))), "queries")
    out = None
    for b in range(blocks):
        by_length: dict[int, tuple[list, list]] = {}
        for name, v in queries.where(F.col("block") == b).select("id", "v").collect():  # about query_block rows
            ids, values = by_length.setdefault(len(v), ([], []))
            ids.append(name)
            values.append(v)
        shared = spark.sparkContext.broadcast(
            {n: (np.array(i, np.int64), np.array(v, np.float64).reshape(len(i), n)) for n, (i, v) in by_length.items()}
        )
        found = rows.mapInArrow(_search(shared, k, block), "query_id long, vec_id long, score long")
        found = stored(found, "best") if blocks > 1 else found
        out = found if out is None else out.union(found)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return out.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
