"""Approximate nearest neighbours by collision counting.

Each of ``projections`` random directions gives a sorted array of the vectors'
projections. A query opens a window around its own projection in each array and
widens all windows together (virtual rehashing: a wider window is the union of
finer buckets, nothing is hashed again). A vector collides in an array when it
lies in the window; once it has collided in ``threshold`` of the arrays its
exact distance is worked out. The search stops when the windows are just so wide
that a vector as near as the k-th found would have been verified with a margin
of ``margin`` standard deviations, or when they hold everything.

Every row is indexed, in shards of bounded size. A query first searches one
shard; the distance of the k-th found there bounds it, so in all other shards
its windows open at once as wide as that distance asks for, and only vectors
that may be nearer are verified. The k best of each shard are merged by query.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.llm.common import fresh, quoted, save, with_row_id

K, PROJECTIONS, THRESHOLD, MARGIN, WIDEN = 10, 96, 0.6, 1.65, 1.3
SHARD_ROWS, QUERY_ROWS, SEED = 8192, 32768, 42


def reach(projections: int, need: int, margin: float = MARGIN) -> float:
    """Half width of the windows, for a distance of 1, at which such a vector collides ``need`` times with the margin."""
    low, high = need / projections, 1.0
    for _ in range(60):
        p = (low + high) / 2
        low, high = (low, p) if p * projections - margin * math.sqrt(projections * p * (1 - p)) >= need else (p, high)
    return NormalDist().inv_cdf((1 + min(high, 1 - 1e-12)) / 2)


class Index:
    """Sorted projection arrays of one shard."""

    def __init__(self, vectors: np.ndarray, *, projections: int = PROJECTIONS, threshold: float = THRESHOLD, margin: float = MARGIN, seed: int = SEED) -> None:
        self.x = vectors
        self.directions = np.random.default_rng(seed).standard_normal((vectors.shape[1], projections))
        p = vectors @ self.directions
        self.order = np.argsort(p, axis=0, kind="stable").T.astype(np.int32).copy()
        self.sorted = np.take_along_axis(p, self.order.T, axis=0).T.copy()
        self.width = 0.25 * float(p.std(axis=0).mean()) or 1.0
        self.slack = 1e-9 * (1.0 + float(np.abs(self.sorted).max()))  # what rounding may part equal vectors by
        self.need = math.ceil(threshold * projections)
        self.reach = reach(projections, self.need, margin)
        self.verified = 0

    def windows(self, at: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end place of each query's window in each array; ``at`` holds a row of projections a query."""
        low, high = (np.empty(at.shape, np.int32) for _ in range(2))
        half = half + self.slack
        for j, s in enumerate(self.sorted):
            low[:, j], high[:, j] = np.searchsorted(s, at[:, j] - half, side="left"), np.searchsorted(s, at[:, j] + half, side="right")
        return low, high

    def collided(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Rows that lie in enough of one query's windows."""
        return np.flatnonzero(np.bincount(np.concatenate([o[a:z] for o, a, z in zip(self.order, low, high)]), minlength=len(self.x)) >= self.need)

    def best(self, q: np.ndarray, rows: np.ndarray, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest of ``rows`` and their distances, ties to the smaller id."""
        d = np.sqrt(((self.x[rows] - q) ** 2).sum(axis=1))
        self.verified += len(rows)
        if len(d) > k:  # all ties of the k-th stay
            near = d <= np.partition(d, k - 1)[k - 1]
            rows, d = rows[near], d[near]
        order = np.lexsort((ids[rows], d))[:k]
        return rows[order], d[order]

    def search(self, qs: np.ndarray, k: int, ids: np.ndarray, skip: list[np.ndarray], bound: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, distances) of the ``k`` nearest found of each query; rows of its ``skip`` don't count.

        A finite ``bound`` is a distance within which the query has ``k`` rows
        elsewhere, so that farther ones needn't be found. Without one the
        windows widen until the k-th found is itself such a bound.
        """
        at = qs @ self.directions
        half = np.where(np.isfinite(bound), bound * self.reach, self.width)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        low, high = self.windows(at, half)
        for i, q in enumerate(qs):
            a, z, own, need = low[i], high[i], half[i], bound[i] * self.reach
            while True:
                rows = self.collided(a, z)
                rows = rows[~np.isin(rows, skip[i])]
                if own >= need or (a == 0).all() and (z == len(self.x)).all():
                    break
                if len(rows) >= k:  # what is searched for is no farther than the k-th of these
                    need = min(need, self.best(q, rows, k, ids)[1][-1] * self.reach)
                if own >= need:
                    break
                own = min(own * WIDEN, need)
                (a,), (z,) = self.windows(at[i : i + 1], np.array([own]))
            out.append(self.best(q, rows, k, ids))
        return out


def nearest(
    vectors: DataFrame, is_query: Column, *, k: int = K, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` nearest found of each query row, by Euclidean distance.

    Candidates are all rows but the query's own; of fewer than ``k`` all are
    given. Null ids, and vectors that are null, zero, of another length than
    most or hold a null, NaN or infinity take no part. Ties go to the smaller
    id. Rows that repeat an id are candidates and queries of their own, told
    apart by their place in the table's files. An empty table gives an empty
    one. Other columns, whatever their names, play no part.
    """
    v = F.col("v")
    sound = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rid, asks = fresh(vectors, "__rid"), fresh(vectors, "__asks")
    rows = with_row_id(vectors.withColumn(asks, F.coalesce(is_query, F.lit(False))), rid).select(F.col(quoted(id_col)).alias("vec_id"), F.col(quoted(vector_col)).cast("array<double>").alias("v"), F.col(asks).alias("asks"), F.col(rid).alias("rid")).where(sound)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    dims, n = (sizes["d"], sizes["n"]) if sizes else (0, 0)
    rows = rows.where(F.size("v") == dims)
    shards = max(1, -(-n // shard_rows))
    queries = rows.where("asks")
    blocks = max(1, -(-queries.count() // query_rows))
    shard, block = F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int"), F.pmod(F.xxhash64(F.lit(1), "rid"), F.lit(blocks)).cast("int")
    data = rows.select("rid", "vec_id", "v", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = queries.select(*(F.col(c).alias(c) for c in ("rid", "vec_id", "v")), block.alias("block"), F.lit(float("inf")).alias("bound"))

    def run(data: pa.Table, asked: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [])
        if data.num_rows and asked.num_rows:
            matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            x, q, ids, rids = matrix(data), matrix(asked), data["vec_id"].to_numpy(), data["rid"].to_numpy()
            index, of, asking, bound = Index(x), asked["vec_id"].to_numpy(), asked["rid"].to_numpy(), asked["bound"].to_numpy()
            place = {r: i for i, r in enumerate(rids.tolist())}
            skip = [np.array([place[r]] if r in place else [], np.int64) for r in asking.tolist()]
            for at in range(0, len(q), 1024):
                for i, (rows, d) in enumerate(index.search(q[at : at + 1024], k, ids, skip[at : at + 1024], bound[at : at + 1024]), at):
                    for c, y in zip(out, (np.full(len(rows), asking[i]), np.full(len(rows), of[i]), ids[rows], d)):
                        c.append(y)
        cat = lambda c, kind: pa.array(np.concatenate(c) if c else [], kind)
        return pa.table({"rid": cat(out[0], pa.int64()), "query_id": cat(out[1], pa.int64()), "vec_id": cat(out[2], pa.int64()), "score": cat(out[3], pa.float64())})

    search = lambda data, asked: data.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(run, "rid long, query_id long, vec_id long, score double")
    found = search(data.where("shard = 0"), asked.withColumn("shard", F.lit(0)))
    if shards > 1:
        found = save(found, "first-shard")
        bounds = found.groupBy("rid").agg(F.count("*").alias("n"), F.max("score").alias("kth")).select("rid", F.when(F.col("n") >= k, F.col("kth")).otherwise(float("inf")).alias("bound"))
        bounded = asked.drop("bound").join(bounds, "rid", "left").fillna(float("inf"), ["bound"])
        found = found.unionByName(search(data.where("shard > 0"), bounded.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards - 1))))))
    rank = F.row_number().over(Window.partitionBy("rid").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
