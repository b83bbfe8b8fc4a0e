"""Approximate nearest neighbours by collision counting.

Every vector is projected on m random lines and each projection is one sorted array. A query opens a
window around its own projection in every array. Virtual rehashing widens the windows with the radius
R, and only the newly opened ends are read. A vector that lies in enough windows (the collision
threshold) is verified by its inner product. A query is done when its k-th best verified vector is
nearer than R: vectors that near collide often enough to have been verified, with the probability
that the threshold is chosen for. There is no cap on candidates.

The lines are random orthogonal frames: the squares of a vector's projections on a frame sum up to its
squared length, so that counts of collisions scatter less than with independent lines and tell near
from far vectors apart. A first window holds most rows; its collisions are counted by those outside.

Largest inner product becomes nearest neighbour by one more coordinate, sqrt(M^2 - |x|^2) with M the
largest norm, which is 0 for queries. Scores are inner products of the original vectors in double.

The rows are dealt over blocks of bounded size. A block's index is built once, and all queries pass by
it in a stream. Only k rows per query and block are shuffled afterwards.

Defined results: vectors that are null, empty, all zero, or hold a null or a non-finite component take
no part, nor do rows with a null id. A query meets only vectors of its own dimension. Ties go to the
smaller id. A row meets every row but those with its own id. Repeated rows are candidates each.
Fewer than k candidates: all. Empty tables give empty tables. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora_spark.llm.common import lean

#: Half-width of a query's windows, in radii.
WIDTH = 2.0
#: A window holds a vector at distance R with this probability.
AT_RADIUS = math.erf(WIDTH / math.sqrt(2))


def threshold(lines: int, miss: float) -> int:
    """The largest collision count that a vector at distance R reaches with probability 1 - miss at least."""
    p, total = AT_RADIUS, 0.0
    for k in range(lines + 1):
        total += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if total > miss:
            return max(1, k)
    return 1


class Index:
    """The sorted projections of one block of vectors."""

    def __init__(self, vectors: np.ndarray, longest: float, frames: int, seed: int):
        self.vectors = vectors
        self.bound = longest**2
        rest = np.sqrt(np.maximum(self.bound - np.einsum("ij,ij->i", vectors, vectors), 0))
        rng, size = np.random.default_rng(seed), vectors.shape[1] + 1
        # Rows of an orthogonal matrix, as long as standard normal ones; few dimensions take more frames.
        frames = max(frames, -(-64 // size))
        self.lines = np.concatenate([np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(frames)]) * math.sqrt(size)
        projected = vectors @ self.lines[:, :-1].T + rest[:, None] * self.lines[:, -1]
        order = np.argsort(projected, axis=0, kind="stable")
        self.order = np.ascontiguousarray(order.T)
        self.sorted = np.ascontiguousarray(np.take_along_axis(projected, order, axis=0).T)

    def search(self, queries: np.ndarray, k: int, least: int, radius: float, widen: float) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For each query the rows that were verified, their inner products, and the radius at which it ended."""
        n, m, most = len(self.vectors), len(self.lines), len(queries)
        centres = queries @ self.lines[:, :-1].T
        base = self.bound + np.einsum("ij,ij->i", queries, queries)
        seen, size = np.zeros((most, n), bool), np.zeros(most, np.int64)
        rows: list[list] = [[] for _ in range(most)]
        scores: list[list] = [[] for _ in range(most)]
        count: list = [None] * most
        before: list = [None] * most
        ended, active = np.zeros(most), np.arange(most)
        while len(active):
            reach = WIDTH * radius
            low = np.stack([np.searchsorted(self.sorted[j], centres[active, j] - reach) for j in range(m)], axis=1).tolist()
            high = np.stack([np.searchsorted(self.sorted[j], centres[active, j] + reach, "right") for j in range(m)], axis=1).tolist()
            going = []
            for at, q in enumerate(active.tolist()):
                if before[q] is None:  # what lies outside of the first windows
                    parts = [x for line, a, b in zip(self.order, low[at], high[at]) for x in (line[:a], line[b:])]
                    count[q] = m - np.bincount(np.concatenate(parts), minlength=n)
                else:
                    parts = [x for line, a, b, c, d in zip(self.order, low[at], *before[q], high[at]) for x in (line[a:b], line[c:d])]
                    count[q] += np.bincount(np.concatenate(parts), minlength=n)
                before[q] = low[at], high[at]
                fresh = np.flatnonzero((count[q] >= least) & ~seen[q])
                if len(fresh):
                    seen[q, fresh] = True
                    rows[q].append(fresh)
                    scores[q].append(self.vectors[fresh] @ queries[q])
                    size[q] += len(fresh)
                done = size[q] == n
                if not done and size[q] >= k:
                    done = base[q] - 2 * np.partition(np.concatenate(scores[q]), size[q] - k)[size[q] - k] <= radius * radius
                if done:
                    ended[q] = radius
                else:
                    going.append(at)
            active = active[going]
            radius *= widen
        return [np.concatenate(r) for r in rows], [np.concatenate(x) for x in scores], ended


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", frames: int = 2, miss: float = 0.1, widen: float = 1.03, block: int = 16_384, seed: int = 17, counted: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row that is_query selects.

    is_query is a condition on the column vec_id. block bounds the rows of an index block. miss is the
    probability that a vector at the radius misses the threshold if its projections were independent; on
    orthogonal lines it is much smaller. counted: with a column verified, how many rows the query verified.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    squared = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, longest = rows.agg(F.count("*"), F.max(F.sqrt(squared))).first()
    parts = max(6, -(-n // block))
    longest = (longest or 1.0) * (1 + 1e-12)
    data = rows.select("vec_id", "v", F.lit(False).alias("asks"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"))
    asks = rows.where(is_query).select("vec_id", "v", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    dealt = data.unionByName(asks).withColumn("d", F.size("v")).repartitionById(parts, F.col("part")).sortWithinPartitions("d", "asks")
    names = ["query_id", "vec_id", "score", "verified"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index, own, least, radius, dimension = [], None, None, 0, 0.0, None

        def answer(ids: np.ndarray, queries: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal radius
            starts = [0, *range(4, len(ids), 32)] if radius == 0.5 * longest else range(0, len(ids), 32)  # a few show where to begin
            for a, b in zip(starts, [*starts[1:], len(ids)]):
                part, out = slice(a, b), []
                found, scores, ends = index.search(queries[part], k + 1, least, radius, widen)
                radius = max(float(np.quantile(ends, 0.1)) * 0.98, 1e-6 * longest)  # later queries end alike; it only saves steps
                for q, rows, score in zip(ids[part], found, scores):
                    size, keep = len(rows), own[rows] != q
                    rows, score = rows[keep], score[keep]
                    if len(rows) > k:  # ties at the end stay
                        last = np.partition(score, len(score) - k)[len(score) - k]
                        rows, score = rows[score >= last], score[score >= last]
                    best = np.lexsort((own[rows], -score))[:k]
                    out.append((np.full(len(best), q), own[rows[best]], score[best], np.full(len(best), size)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[j] for o in out])) for j in range(4)], names=names)

        for batch in batches:
            d, is_ask, ids = batch.column(4).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False), batch.column(0).to_numpy()
            flat = batch.column(1).flatten().to_numpy()
            ends = np.cumsum(d)
            change = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (is_ask[1:] != is_ask[:-1]))))
            for a, b in zip(change, [*change[1:], len(d)]):
                vectors = flat[ends[a] - d[a] : ends[b - 1]].reshape(b - a, d[a])
                if d[a] != dimension:
                    dimension, held, index, own = d[a], [], None, None
                if not is_ask[a]:
                    held.append((ids[a:b], vectors))
                    continue
                if index is None and held:
                    own = np.concatenate([h[0] for h in held])
                    order = np.argsort(own, kind="stable")
                    own, held = own[order], [np.concatenate([h[1] for h in held])[order]]
                    index = Index(held.pop(), longest, frames, seed)
                    least, radius = threshold(len(index.lines), miss), 0.5 * longest
                if index is not None:
                    yield from answer(ids[a:b], vectors)

    found = dealt.mapInArrow(lean(run), "query_id long, vec_id long, score double, verified long")
    w = Window.partitionBy("query_id")
    out = found.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    out = out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", *([F.col("verified")] if counted else []))
    return out
