"""Operator 13: centroid clustering with a vantage-point tree over the centroids.

Components become integers, so every distance and sum is exact.  In each round the tree over the centroids is built anew
and broadcast (its size is that of the centroids, whatever the table's).  A vector searches it best first: of the nodes it has
open it takes the one with the least bound, measures the exact squared distance to that node's centroid, and bounds both
children by the ring of distances they hold; it stops when no bound is within its best distance.  The radius is inclusive, so
that an equally near centroid of a smaller number is still found.  The vectors of a batch take these steps side by side.
Each task sends one sum per cluster and component; the driver gets the total sums, k times the dimension.

Defined results: vectors that are null, have another number of components, or hold null or non-finite ones take no part, nor do
those with a component of 2^62 or more after scaling, whose distances no long holds (a distance or inertia beyond a long is
null); rows that repeat a vec_id are vectors of their own; rows without vec_id are clustered like others; if fewer vectors than
centroids are there, each begins a cluster; an empty table gives no rows; other columns stay out.
"""

from __future__ import annotations

from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrid.session import stage

#: Below this size of a component squared distances of some hundred components fit 64 bits.
SMALL = 1 << 27
LONG = 1 << 63
WORK = 1 << 20
SLACK = 1e-9


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to y."""
    d = x - y
    return (d * d).sum(1)


def settled(x: np.ndarray) -> np.ndarray:
    """Integers in the narrowest kind in which distances are exact."""
    if x.dtype == object and (not x.size or np.abs(x).max() < SMALL):
        return x.astype(np.int64)
    if x.dtype != object and x.size and np.abs(x).max() >= SMALL:
        return x.astype(object)
    return x


class VantageTree:
    """Nodes in arrays: the centroid of each, its children, and the least and greatest distance from it to what they hold."""

    def __init__(self, points: np.ndarray):
        self.points, self.of, self.below = points, [], []
        self._add(list(range(len(points))))

    def _add(self, members: list[int]) -> int:
        me, own, rest = len(self.of), members[0], members[1:]
        self.of.append(own)
        self.below.append([])
        if rest:
            d = np.sqrt(exact(self.points[rest], self.points[own]).astype(np.float64))
            order = np.argsort(d, kind="stable")
            for part in (order[: (len(order) + 1) // 2], order[(len(order) + 1) // 2 :]):
                if len(part):
                    ring = float(d[part].min()), float(d[part].max())
                    self.below[me].append((self._add([rest[i] for i in part]), *ring))
        return me

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest point of each row, the smaller number of equally near ones."""
        step = max(1, WORK // (len(self.of) + x.shape[1]))
        parts = [self._search(x[i : i + step]) for i in range(0, len(x), step)] or [(np.empty(0, np.int64), np.empty(0, np.int64))]
        return tuple(np.concatenate(p) for p in zip(*parts))

    def _search(self, x):
        wide = x.dtype == object or self.points.dtype == object
        x, points = (a.astype(object) if wide else a for a in (x, self.points))
        best = np.full(len(x), 1 << 200 if wide else LONG - 1, object if wide else np.int64)
        which = np.full(len(x), len(self.of), np.int64)
        bound = np.full((len(x), len(self.of)), np.inf)
        bound[:, 0] = 0
        going = np.arange(len(x))
        while len(going):
            node = bound[going].argmin(1)
            low = bound[going, node]
            near = low <= np.sqrt(best[going].astype(np.float64)) * (1 + SLACK) + SLACK
            going, node, low = going[near], node[near], low[near]
            for t in np.unique(node).tolist():
                at = node == t
                rows, c = going[at], self.of[t]
                d2 = exact(x[rows], points[c])
                better = (d2 < best[rows]) | ((d2 == best[rows]) & (c < which[rows]))
                best[rows[better]], which[rows[better]] = d2[better], c
                bound[rows, t] = np.inf
                d = np.sqrt(d2.astype(np.float64))
                for child, least, most in self.below[t]:
                    gap = np.maximum(least - d, d - most) - SLACK * (d + most)
                    bound[rows, child] = np.maximum(gap, low[at])
        return which, best


def _integers(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return settled(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def _scaled(dim: int, scale: int):
    """(vec_id, embedding) to (vec_id, v) with floor(scale x)."""

    def run(batches):
        for batch in batches:
            x = np.floor(scale * batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64))
            fits = np.abs(x).max(1, initial=0) < float(1 << 62)
            values = pa.array(x[fits].astype(np.int64).ravel())
            v = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, dim, dtype=np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fits)), v], names=["vec_id", "v"])

    return run


def _sums(tree, dim):
    """One row per cluster and task: the sums of the components, and last the number of vectors."""

    def run(batches):
        points = tree.value
        total = {}
        for batch in batches:
            x = _integers(batch, dim)
            which, _ = points.nearest(x)
            for c in np.unique(which).tolist():
                held = total.setdefault(c, [0] * (dim + 1))
                some = x[which == c]
                total[c] = [a + int(b) for a, b in zip(held, [*some.sum(0), len(some)])]
        if total:
            kind = pa.list_(pa.decimal128(38, 0))
            sums = pa.array([[Decimal(s) for s in row] for row in total.values()], kind)
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), sums], names=["cluster", "sums"])

    return run


def _assigned(tree, dim):
    def run(batches):
        points = tree.value
        for batch in batches:
            which, d2 = points.nearest(_integers(batch, dim))
            d2 = pa.array([int(d) if d < LONG else None for d in d2], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(which, pa.int32()), d2], names=["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the vectors of a table (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where((F.size("embedding") == dim) & ~bad)
    rows = stage(rows.mapInArrow(_scaled(dim, scale), "vec_id long, v array<bigint>"), "vectors")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(drawn, "v").limit(k).collect()
    out = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    if not first:
        kinds = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], kinds).select(out)
    points = np.array([r["v"] for r in first], object)
    for _ in range(rounds):
        tree = spark.sparkContext.broadcast(VantageTree(settled(points)))
        sums = rows.mapInArrow(_sums(tree, dim), "cluster int, sums array<decimal(38,0)>")
        sums = sums.select("cluster", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("s").alias("s"))
        total = {(r["cluster"], r["at"]): int(r["s"]) for r in sums.collect()}
        tree.destroy()
        for c in range(len(points)):
            if (c, dim) in total:
                points[c] = [total[c, i] // total[c, dim] for i in range(dim)]
    tree = spark.sparkContext.broadcast(VantageTree(settled(points)))
    found = stage(rows.mapInArrow(_assigned(tree, dim), "vec_id long, cluster int, distance long"), "assigned")
    tree.destroy()
    # k rows, whatever the table's size
    exact_sum = F.when(F.count_if(F.col("distance").isNull()) == 0, F.sum(F.col("distance").cast("decimal(38,0)")))
    held = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(exact_sum.alias("s")).collect()}
    fit = lambda s: int(s) if s is not None and s < LONG else None
    inertia = None if None in held.values() else fit(sum(held.values()))
    named = [(c, fit(s), inertia, sha256(",".join(map(str, points[c])).encode()).hexdigest()) for c, s in held.items()]
    named = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select(out)
