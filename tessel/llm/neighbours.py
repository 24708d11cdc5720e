"""Approximate nearest neighbours by collision counting.

Each of M random projections keeps the vectors in the order of their projections. A query opens a window around its own
projection in each order, and widens all windows by virtual rehashing (a wider bucket of the same
hash, centred at the query). A vector collides with the query in each projection whose window it lies in; vectors with at
least THRESHOLD collisions are verified by their exact inner product. Nearness by inner product becomes nearness by distance when each vector
gets one more coordinate that brings it to the greatest length.

A vector at distance d lies in a window of half width w with the chance that a normal number is at most w / d in size. From w = REACH * d on it is verified
with a chance of 0.956 (a binomial tail of M and THRESHOLD). So a query first opens windows that few vectors at the mean distance pass (some three in a thousand), and
is done when its windows are REACH times as wide as the k-th nearest verified vector is far; until then they grow towards that width, by GROWTH at most.
How many are verified follows from the data: near neighbours that stand out need few, of random vectors of 64 dimensions it is four in ten.

Vectors are packed into blocks as they are read; the stated queries go against all blocks, and a query's best k of each
block are merged. Equal vectors of a block are one and are all returned, so a vector that a third of rows hold costs
nothing and hides nothing.

Edge cases: a null id, and vectors that are null, zero, of another dimension than most, or hold null or non-finite components take no
part; a query's own id is no candidate; repeated rows are candidates of their own, but one query; ties go to the
smaller id; with fewer candidates than k, all are returned; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.llm.common import staged

M = 64
THRESHOLD = 50
REACH = 1.44
BLOCK, QUERY_BLOCK = 16384, 1024
#: Half width of a query's first windows, in root mean square distances from it; how they grow while too few vectors are verified.
FIRST, GROWTH = 0.9, 1.3


@cache
def projections(dimension: int, m: int = M) -> np.ndarray:
    return np.random.default_rng(7).normal(size=(m, dimension))


def usable(column: str) -> Column:
    """Whether a vector is whole, finite and not zero."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _pack(size: int):
    """Rows (id, vector) of a part as blocks of at most `size`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, n = [], [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(ids)], pa.binary()), pa.array([b"".join(vectors)], pa.binary())], names=["ids", "vectors"])

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, min(size, batch.num_rows - at))
                if n and n + part.num_rows > size:
                    yield block()
                    ids, vectors, n = [], [], 0
                ids.append(part.column("id").to_numpy().astype("<i8").tobytes())
                vectors.append(part.column("vector").flatten().to_numpy().astype("<f8").tobytes())
                n += part.num_rows
        if n:
            yield block()

    return run


def norms(vectors: np.ndarray) -> np.ndarray:
    """Lengths of vectors that aren't zero, however large or small their components."""
    top = np.abs(vectors).max(1)
    return top * np.sqrt(((vectors / top[:, None]) ** 2).sum(1))


class Block:
    """The distinct vectors of a block, in the order of each projection."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float) -> None:
        rows = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8)))[:, 0]
        _, first, of = np.unique(rows, return_index=True, return_inverse=True)
        order = np.lexsort((ids, of))
        self.ids, self.starts = ids[order], np.searchsorted(of[order], np.arange(len(first) + 1))
        self.vectors, self.longest = vectors[first], longest
        scaled = self.vectors / longest
        extra = np.sqrt(np.maximum(1 - (scaled**2).sum(1), 0))
        placed = np.concatenate([scaled, extra[:, None]], 1) @ projections(vectors.shape[1] + 1).T
        order = np.argsort(placed, axis=0, kind="stable")
        self.sorted = np.take_along_axis(placed, order, 0).T.copy()
        self.rank = np.empty((len(self.sorted), len(first)), np.uint16)  # of each vector in each sorted array
        np.put_along_axis(self.rank, order.T, np.arange(len(first), dtype=np.uint16)[None], 1)
        self.mean = scaled.mean(0)
        self.coarse = (self.vectors / longest).astype(np.float32)  # of any magnitude, as only their order counts

    def colliding(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Vectors in enough of the windows, which are given by the places where they begin and end."""
        inside = self.rank - lo.astype(np.uint16)[:, None] < (hi - lo).astype(np.uint16)[:, None]
        return np.flatnonzero((inside.sum(0, dtype=np.uint8) >= THRESHOLD))

    def nearest(self, own: np.ndarray, queries: np.ndarray, k: int) -> tuple[list[list[tuple[int, float]]], np.ndarray]:
        """Of each query (id, inner product) of the k nearest of the verified vectors, and how many those are."""
        n, dimension = self.vectors.shape
        scaled, lengths = queries / self.longest, norms(queries)
        at = scaled @ projections(dimension + 1)[:, :dimension].T
        size = (scaled**2).sum(1)
        half = FIRST * np.sqrt(np.maximum(size + 1 - 2 * scaled @ self.mean, 1e-12))
        out, verified, left = [[] for _ in queries], np.zeros(len(queries), np.int64), np.arange(len(queries))
        while len(left):
            lo, hi = (np.stack([np.searchsorted(s, at[left, j] + sign * half[left], side=side) for j, s in enumerate(self.sorted)], 1) for sign, side in ((-1, "left"), (1, "right")))
            more = []
            for i, q in enumerate(left.tolist()):
                whole = (lo[i] == 0).all() and (hi[i] == n).all()
                found = np.arange(n) if whole else self.colliding(lo[i], hi[i])
                if len(found) <= k and not whole:  # one may be the query itself
                    half[q] *= GROWTH
                    more.append(q)
                    continue
                near = self.coarse[found] @ (queries[q] / lengths[q]).astype(np.float32)
                least = np.partition(near, len(near) - k - 1)[len(near) - k - 1] if len(near) > k else -np.inf
                far = np.sqrt(max(0.0, size[q] + 1 - 2 * float(least) * lengths[q] / self.longest)) if len(near) > k else 0.0
                if half[q] < REACH * far and not whole:
                    half[q] = max(min(REACH * far, half[q] * GROWTH), half[q] * 1.01)
                    more.append(q)
                    continue
                verified[q] = len(found)
                found = found[near >= least - 1e-5]  # the slack is beyond what single precision loses
                out[q] = self._exact(int(own[q]), queries[q], found, k)
            left = np.array(more, np.int64)
        return out, verified

    def _exact(self, own: int, query: np.ndarray, found: np.ndarray, k: int) -> list[tuple[int, float]]:
        rows = []
        for s, i in zip((self.vectors[found] * query).sum(1).tolist(), found.tolist(), strict=True):
            same = self.ids[self.starts[i] : self.starts[i + 1]]
            rows += [(-s, int(x)) for x in same[same != own][:k]]
        return [(x, -s) for s, x in sorted(rows)[:k]]


def _search(dimension: int, longest: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                ids, vectors, q_ids, queries = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("ids", "<i8"), ("vectors", "<f8"), ("q_ids", "<i8"), ("q_vectors", "<f8")))
                if held is None or not np.array_equal(ids, held):  # the same block may meet several blocks of queries in turn
                    held, block = ids, Block(ids, vectors.reshape(-1, dimension), longest)
                found, _ = block.nearest(q_ids, queries.reshape(-1, dimension), k)
                q = batch.column("q")[i].as_py()
                rows = [(q, row, own, *x) for row, (own, some) in enumerate(zip(q_ids.tolist(), found, strict=True)) for x in some]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["q", "q_row", "query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k nearest found of each query, nearest first."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & usable("vector"))
    top = F.array_max(F.transform("vector", F.abs))
    length = F.sqrt(F.aggregate(F.transform("vector", lambda x: x / F.col("top")), F.lit(0.0), lambda s, x: s + x * x)) * F.col("top")
    sizes = rows.withColumn("top", top).groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("norm"))
    most = sizes.orderBy(F.desc("n"), "d").first()
    if most is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension, longest = most["d"], most["norm"]
    rows = rows.where(F.size("vector") == dimension)
    blocks = staged(rows.mapInArrow(_pack(BLOCK), "ids binary, vectors binary"), "blocks")
    asked = rows.where(is_query).distinct().mapInArrow(_pack(QUERY_BLOCK), "ids binary, vectors binary")
    asked = staged(asked.select(F.monotonically_increasing_id().alias("q"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")), "queries")
    # the stated queries against all rows, block by block; blocks are moved, never single pairs
    pairs = blocks.crossJoin(asked)
    found = pairs.mapInArrow(_search(dimension, longest, k), "q long, q_row long, query_id long, vec_id long, score double")
    best = F.row_number().over(W.partitionBy("q", "q_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
