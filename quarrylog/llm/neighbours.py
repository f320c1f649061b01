"""Operator 8: approximate nearest neighbours by collision counting.

Every block of vectors keeps, for each of ``PROJECTIONS`` random directions, its vectors
sorted by their projection. A query opens a window around its own projection in each sorted
array and widens all windows step by step (virtual rehashing: no new index for a larger
radius). Only a vector in at least ``THRESHOLD`` windows at once is verified, that is, its
distance is computed from the original components. A query stops in a block when it has as
many neighbours as asked for within the radius that the windows stand for; once it has them
from earlier blocks, it opens the windows of their radius at once.

A window's half is ``HALF`` times the radius, so a vector at the radius falls into a window
with probability ``P(|z| <= HALF)`` = 0.826 for a normal z (a projected difference is normal
with the distance as its deviation), and into ``THRESHOLD``, 1.7 deviations less than the
expected number of windows, with 0.95. One at 1.5 times the radius is in a window with 0.64
and passes with 0.0004. The share of vectors that were verified is counted and returned.

Queries are a stated set against all rows, in blocks. Vectors do not move: a task makes
blocks of the rows that it scans and keeps each query's best over all of them. Queries are
broadcast, ``FLOATS`` numbers at most at a time, so a table is scanned once for each such
part of its queries. Directions are fixed by a seed; only the first radius is fitted, on
``SAMPLE`` vectors of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

PROJECTIONS, HALF, THRESHOLD, GROW, NARROWER, SAMPLE = 160, 1.36, 124, 1.1, 0.995, 256
#: Vectors in a block, and numbers in the queries that are broadcast together, at most.
BLOCK, FLOATS = 1 << 15, 1 << 22


class ProjectionIndex:
    """Sorted projections of a block's vectors (rows of ``x``)."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        self.x = x.astype(np.float64)
        n, d = x.shape
        self.directions = np.random.default_rng(seed).standard_normal((d, PROJECTIONS))
        p = (self.x @ self.directions).T
        self.order = np.argsort(p, axis=1, kind="stable").astype(np.int32)
        self.widest = float(np.abs(p).max()) + 1.0
        # All arrays as one ascending array, each in a range of its own: one search finds all windows.
        self.place = 4 * self.widest * np.arange(PROJECTIONS)
        self.flat = (np.take_along_axis(p, self.order, axis=1) + self.place[:, None]).ravel()
        sample = self.x[:: max(1, n // SAMPLE)][:SAMPLE]
        apart = np.concatenate([np.sqrt(np.square(sample - v).sum(axis=1)) for v in sample[:64]])
        apart = apart[apart > 0]
        self.radius = float(np.quantile(apart, 0.005)) / 4 if len(apart) else 1.0

    def windows(self, at: np.ndarray, half: float) -> tuple[list[int], list[int]]:
        """First and last places of each array's window."""
        half += 1e-9 * self.widest  # the projections of equal vectors may differ in their last bits
        edge = lambda x, side: (np.searchsorted(self.flat, np.clip(x, -1.5 * self.widest, 1.5 * self.widest) + self.place, side) - len(self.x) * np.arange(PROJECTIONS)).tolist()
        return edge(at - half, "left"), edge(at + half, "right")

    def search(self, q: np.ndarray, at: np.ndarray, skip: np.ndarray, k: int, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of the verified vectors but those to ``skip``. ``best``: the k nearest distances so far, ascending."""
        done, found, distance = skip.copy(), [], []

        def verify(rows: np.ndarray) -> None:
            done[rows] = True
            found.append(rows)
            distance.append(np.sqrt(np.square(self.x[rows] - q).sum(axis=1)))

        some = max(4 * k, len(self.x) // 100)
        if len(best) < k:
            verify(self.expand(at, done, k - len(best), some))
            best = np.sort(np.concatenate([best, distance[0]]))[:k]
        while len(best) == k:
            a, z = self.windows(at, HALF * float(best[-1]))
            counts = np.bincount(np.concatenate([self.order[j, a[j] : z[j]] for j in range(PROJECTIONS)]), minlength=len(self.x))
            over = np.flatnonzero((counts >= THRESHOLD) & ~done)
            most = over[np.lexsort((over, -counts[over]))]
            verify(most[:some])
            nearer = np.sort(np.concatenate([best, distance[-1]]))[:k]
            if len(over) <= 2 * some or nearer[-1] > NARROWER * best[-1]:
                verify(most[some:])
                break
            best = nearer  # the windows can be narrower
        return (np.concatenate(found), np.concatenate(distance)) if found else (np.zeros(0, dtype=np.int64), np.zeros(0))

    def expand(self, at: np.ndarray, done: np.ndarray, k: int, some: int) -> np.ndarray:
        """Widens the windows until k vectors not ``done`` are over the threshold; of these some with most collisions (all vectors, if they are fewer than k)."""
        n = len(self.x)
        left = n - int(done.sum())
        if left <= k:
            return np.flatnonzero(~done)
        counts = np.zeros(n, dtype=np.int64)
        lo = hi = None
        radius = self.radius
        while True:
            a, b = self.windows(at, HALF * radius)
            if lo is None:
                new = [self.order[j, a[j] : b[j]] for j in range(PROJECTIONS)]
            else:
                new = [self.order[j, x:y] for j in range(PROJECTIONS) for x, y in ((a[j], lo[j]), (hi[j], b[j])) if x < y]
            lo, hi = a, b
            if new:
                counts += np.bincount(np.concatenate(new), minlength=n)
            over = np.flatnonzero((counts >= THRESHOLD) & ~done)
            if len(over) >= k:
                most = np.lexsort((over, -counts[over]))[:some]
                return over[most]
            radius *= GROW


class _Nearest:
    """Each query's k nearest of all blocks so far, and how many vectors were verified for it."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.found = [(np.zeros(0, dtype=np.int64), np.zeros(0))] * len(ids)
        self.verified = np.zeros(len(ids), dtype=np.int64)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        index = ProjectionIndex(x)
        at = self.q @ index.directions
        for j, own in enumerate(self.ids.tolist()):
            near, distance = self.found[j]
            rows, apart = index.search(self.q[j], at[j], ids == own, self.k, distance)
            self.verified[j] += len(rows)
            near, distance = np.concatenate([near, ids[rows]]), np.concatenate([distance, apart])
            best = np.lexsort((near, distance))[: self.k]
            self.found[j] = near[best], distance[best]


def _matrix(column, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), width)


def usable(embedding: Column) -> Column:
    """Neither null nor zero nor holding a null or non-finite component."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return embedding.isNotNull() & ~F.exists(embedding, bad) & F.exists(embedding, lambda v: v != 0)


def _search(v: DataFrame, queries, k: int) -> DataFrame:
    """(query, id, score) of each task's k nearest, and a row without id that has the number of verified vectors as score."""
    import pyarrow.compute as pc

    by_width = {}
    for width in set(pc.list_value_length(queries["v"]).to_pylist()):
        rows = queries.filter(pc.equal(pc.list_value_length(queries["v"]), width))
        by_width[width] = (rows["query"].to_numpy(), rows["id"].to_numpy(), _matrix(rows["v"].combine_chunks(), width))
    shared = v.sparkSession.sparkContext.broadcast(by_width)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        held = {w: ([], [], _Nearest(ids, q, k)) for w, (_, ids, q) in shared.value.items()}

        def flush(w: int) -> None:
            ids, x, nearest = held[w]
            if ids:
                nearest.add(np.concatenate(ids), np.concatenate(x))
                ids.clear()
                x.clear()

        for batch in batches:
            size = pc.list_value_length(batch["v"])
            for w in held:
                rows = batch.filter(pc.equal(size, w))
                for first in range(0, len(rows), BLOCK):
                    part = rows.slice(first, BLOCK)
                    if sum(map(len, held[w][0])) + len(part) > BLOCK:
                        flush(w)
                    held[w][0].append(part["id"].to_numpy(zero_copy_only=False))
                    held[w][1].append(_matrix(part["v"], w))
        for w, (names, _, _) in shared.value.items():
            flush(w)
            nearest = held[w][2]
            for name, (near, distance), verified in zip(names, nearest.found, nearest.verified.tolist(), strict=True):
                if len(near):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near) + 1, name)), pa.array([*near.tolist(), None], pa.int64()), pa.array([*distance.tolist(), float(verified)])], names=["query", "id", "score"])

    return v.select("id", "v").mapInArrow(run, "query long, id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, verified): for each row where ``is_query`` holds, its k nearest other rows by Euclidean distance.

    ``verified``: to how many vectors the query's distance was computed. Unusable vectors (see
    ``usable``) and null ids take no part; vectors meet those of their own length. Rows with
    the query's id are not its neighbours. A query id that comes in several rows has the
    neighbours of each (equal rows once). With fewer candidates than k all are returned; an
    empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double, verified long"
    v = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("v"), is_query.alias("q")).where(F.col("id").isNotNull()).where(usable(F.col("v")))
    asked, widest = v.where("q").agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not asked:
        return spark.createDataFrame([], schema)
    parts = -(-asked * widest // FLOATS)
    queries = v.where("q").select("id", "v", F.xxhash64("id", "v").alias("query"))
    found = None
    for part in range(parts):
        some = queries.where(F.pmod("query", F.lit(parts)) == part).dropDuplicates(["id", "v"]).toArrow()  # bounded by FLOATS
        if len(some):
            one = _search(v, some, k)
            found = one if found is None else found.union(one)
    found = materialize(found, "neighbours")
    names = queries.select(F.col("query").alias("_q"), F.col("id").alias("query_id")).distinct()
    order = Window.partitionBy("query").orderBy("score", "id")
    ranked = found.where("id IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    verified = found.where("id IS NULL").groupBy(F.col("query").alias("_v")).agg(F.sum("score").cast("long").alias("verified"))
    out = ranked.join(verified, F.col("query") == F.col("_v")).join(names, F.col("query") == F.col("_q"))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score", "verified")
