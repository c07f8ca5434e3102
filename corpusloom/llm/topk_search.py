"""Exact top-k by integer inner product with Fagin's threshold algorithm.

Rows are dealt into blocks by a hash of the id, queries likewise; one task has one block of rows and one
block of queries, both of bounded size. Per block every dimension has its rows sorted by value, once for all
queries of the task. A query reads its lists from the end that its sign prefers, at each step further in those
whose next values lower its bound most; every row met is scored in full. The values at the depths reached bound
the score of any row not met, so a query stops when that bound is below its k-th score (a bound equal to it
might still hide a smaller id), or below the k-th score among the first ``seed_rows`` rows of the block, found before.
The k best of the blocks are then merged per query.

Vectors are quantised to floor(scale * x). Defined results: vectors that are null or empty, hold a null or
non-finite component, have a null id, or have another length than the query take no part; ties go to the
smaller id; of repeated rows each is a candidate; a query's own id is none. Rows that share a query id are one
query, by the smallest of their vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCALE = 256


def quantised(df: DataFrame, vector: str = "embedding", key: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """key as vec_id and q (array<bigint>) of the rows whose vectors are whole."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    good = df.where(F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad)
    return good.select(F.col(key).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("q"))


class SortedLists:
    """The rows of a block with one list per dimension, sorted by value."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.order = np.argsort(self.rows, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(self.rows, self.order, 0)
        self.floats, self.most = self.rows.astype(np.float64), int(np.abs(self.rows).max(initial=0))
        self.asked = self.met = 0  # rows that queries could meet, and those they met

    def score(self, places: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Inner products; in floating point where all sums are whole numbers that it holds exactly."""
        if self.most * int(np.abs(q).max(initial=0)) * len(q) < 1 << 53:
            return (self.floats[places] @ q.astype(np.float64)).astype(np.int64)
        return self.rows[places] @ q

    def top(self, query_id: int, q: np.ndarray, k: int, step: int = 16, least: int | None = None) -> list[tuple[int, int]]:
        """(score, id) of the k best rows: best score first, then smaller id; rows that score below ``least`` may be missing."""
        n = len(self.ids)
        dims = np.flatnonzero(q)
        met = self.ids == query_id
        best_s, best_i = np.empty(0, np.int64), np.empty(0, np.int64)
        w, down = q[dims], q[dims] > 0
        depth = np.zeros(len(dims), np.int64)

        def value(at: np.ndarray) -> np.ndarray:
            """What the dimensions add to a score at those depths."""
            return self.values[np.where(down, n - 1 - at, at), dims] * w

        while len(dims) and not met.all():
            # Twice as far in the half of the lists that fall fastest.
            ahead = np.minimum(depth + step, n - 1)
            fall = value(np.minimum(depth, n - 1)) - value(ahead)
            stop = np.minimum(depth + np.where(fall >= np.median(fall), 2 * step, step), n)
            reach = int((stop - depth).max())
            at = np.minimum(depth[None, :] + np.arange(reach)[:, None], stop[None, :] - 1)
            seen = self.order[np.where(down[None, :], n - 1 - at, at), dims[None, :]].ravel()
            fresh = np.zeros(n, bool)
            fresh[seen] = True
            new = np.flatnonzero(fresh & ~met)
            if len(new):
                met[new] = True
                s = np.concatenate([best_s, self.score(new, q)])
                i = np.concatenate([best_i, self.ids[new]])
                keep = np.lexsort((i, -s))[:k]
                best_s, best_i = s[keep], i[keep]
            depth, step = stop, step * 2
            bound = int(value(depth - 1).sum())
            # Below the k-th score so far, or below what others are known to reach.
            if (len(best_s) == k and bound < best_s[-1]) or (least is not None and bound < least):
                break
        self.asked, self.met = self.asked + n, self.met + int(met.sum())
        if not len(dims):  # every score is zero
            i = self.ids[~met][:k]
            return [(0, int(x)) for x in i]
        return [(int(s), int(i)) for s, i in zip(best_s, best_i, strict=True)]


def _array(column: pa.ChunkedArray, length: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, length)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = 16384, block_queries: int = 8192, seed_rows: int = 2048) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of ``rows`` for each of ``queries`` (both vec_id, q)."""
    queries = queries.groupBy("vec_id").agg(F.min("q").alias("q"))
    n_rows, n_queries = rows.count(), queries.count()
    row_blocks, query_blocks = max(1, math.ceil(n_rows / block_rows)), max(1, math.ceil(n_queries / block_queries))
    block = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    r = rows.select("vec_id", "q", block(row_blocks, 1).alias("rb"), every(query_blocks).alias("qb"))
    q = queries.select("vec_id", "q", block(query_blocks, 2).alias("qb")).select("vec_id", "q", every(row_blocks).alias("rb"), "qb")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        sizes = pc.list_value_length(left.column("q")), pc.list_value_length(right.column("q"))
        for n in pc.unique(sizes[1]).to_pylist():
            mine, asked = (t.filter(pc.equal(size, n)) for t, size in zip((left, right), sizes, strict=True))
            if not mine.num_rows:
                continue
            ids, vectors = mine.column("vec_id").to_numpy(), _array(mine.column("q"), n)
            lists = SortedLists(ids, vectors)
            seed = np.arange(min(seed_rows, len(ids)))
            for i, q in zip(asked.column("vec_id").to_pylist(), _array(asked.column("q"), n), strict=True):
                known = lists.score(seed, q)[lists.ids[seed] != i]
                least = int(np.partition(known, len(known) - k)[len(known) - k]) if len(known) >= k else None
                out += [(i, x, s) for s, x in lists.top(i, q, k, least=least)]
        columns = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pa.array(list(c), pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    found = r.groupBy("rb", "qb").cogroup(q.groupBy("rb", "qb")).applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
