"""Operator 7: exact top-k inner products by pivot-table elimination.

Every vector's distances to ``PIVOTS`` pivots (the vectors with the smallest hashes) are computed once.  For a query q and a
candidate x, ``|d(q, p) - d(x, p)| <= d(q, x)`` for every pivot p, so the largest of these bounds gives
``score <= (|q|^2 + |x|^2 - bound^2) / 2``.  Candidates are evaluated in the order of that limit, in growing steps, until the
k-th score is above every limit that is left: nothing that could enter is skipped.  Queries and candidates meet
in blocks of bounded size; a block returns k rows per query.

Defined results: vectors that are null or hold null or non-finite components take no part, as do rows without
vec_id; vectors of another length than the query's are no candidates of it; rows that repeat a vec_id
are candidates of their own, but never of a query with their vec_id; ties go to the smaller vec_id; other columns stay out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.session import stage

PIVOTS, QUERIES, CANDIDATES = 32, 512, 8192


def whole(embedding: str = "embedding") -> Column:
    """floor(256 x) of each component."""
    return F.transform(embedding, lambda x: F.floor(256 * x.cast("double")).cast("long"))


def _matrix(rows) -> np.ndarray:
    x = np.stack([np.asarray(v, np.int64) for v in rows])
    top = int(np.abs(x).max(initial=0))
    if x.shape[1] * top * top < 2**53:
        return x.astype(np.float64)
    return x.astype(object)  # exact at any size


def _distances(x, pivots):
    x, p = x.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * (x @ p.T), 0))


def _best(scores, ids, k):
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    return np.lexsort((ids, -scores))[:k]


def search_block(q, q_ids, x, x_ids, pivots, k):
    """(query row, candidate row, score) of each query's k best."""
    dq, dx = _distances(q, pivots), _distances(x, pivots)
    nq, nx = (q.astype(np.float64) ** 2).sum(1), (x.astype(np.float64) ** 2).sum(1)
    out = []
    for i in range(len(q)):
        bound = np.zeros(len(x))
        for p in range(len(pivots)):
            np.maximum(bound, np.abs(dx[:, p] - dq[i, p]), out=bound)
        # rounding of the distances is far below the slack
        limit = (nq[i] + nx - np.maximum(bound - 1e-3 - 1e-9 * (nq[i] + nx), 0) ** 2) / 2 + 1
        limit[x_ids == q_ids[i]] = -np.inf
        order, at, step = np.argsort(-limit, kind="stable"), 0, 256
        rows, scores = np.empty(0, np.int64), np.empty(0, x.dtype)
        while at < len(order) and limit[order[at]] > -np.inf:
            if len(rows) == k and limit[order[at]] < scores[-1]:
                break
            some = order[at : at + step]
            some = some[limit[some] > -np.inf]
            at, step = at + step, step * 8
            rows, scores = np.concatenate([rows, some]), np.concatenate([scores, x[some] @ q[i]])
            if len(rows) > 4 * k:
                cut = np.partition(scores.astype(np.float64), len(scores) - k)[len(scores) - k] if k < len(scores) else -np.inf
                keep = scores >= cut
                rows, scores = rows[keep], scores[keep]
            best = _best(scores, x_ids[rows], k)
            rows, scores = rows[best], scores[best]
        out += [(i, int(r), int(s)) for r, s in zip(rows, scores)]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows of vectors (vec_id, embedding) that is_query picks, against all rows."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("query")).where("vec_id is not null and embedding is not null")
    rows = rows.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = stage(rows.select("vec_id", whole().alias("v"), F.size("embedding").alias("dim"), F.coalesce("query", F.lit(False)).alias("query")), "vectors")
    counts = rows.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("query").cast("int")).alias("q"))
    counts = counts.select("dim", F.ceil(F.col("n") / CANDIDATES).alias("nx"), F.ceil(F.greatest("q", F.lit(1)) / QUERIES).alias("nq"))
    # a fixed number of rows, by hash, reaches the driver
    picked = rows.select("dim", "v").orderBy(F.xxhash64("v"), "v").limit(4 * PIVOTS).collect()
    pivots = {d: np.array([r["v"] for r in picked if r["dim"] == d][:PIVOTS], np.float64) for d in {r["dim"] for r in picked}}
    rows = rows.join(counts, "dim")
    ask = rows.where("query").select("dim", "vec_id", "v", F.lit(True).alias("ask"), F.pmod(F.xxhash64("vec_id"), "nq").alias("qb"), F.explode(F.expr("sequence(0L, nx - 1)")).alias("xb"))
    held = rows.select("dim", "vec_id", "v", F.lit(False).alias("ask"), F.explode(F.expr("sequence(0L, nq - 1)")).alias("qb"), F.pmod(F.xxhash64("vec_id", "v"), "nx").alias("xb"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        asked, cand = rows[rows["ask"]], rows[~rows["ask"]]
        if not len(asked) or not len(cand):
            return pd.DataFrame({n: pd.Series(dtype="int64") for n in names})
        every = _matrix(rows["v"])
        q, x = every[rows["ask"].to_numpy()], every[~rows["ask"].to_numpy()]
        q_ids, x_ids = asked["vec_id"].to_numpy(np.int64), cand["vec_id"].to_numpy(np.int64)
        p = pivots.get(int(rows["dim"].iloc[0]), q[:1])
        found = search_block(q, q_ids, x, x_ids, p, k)
        return pd.DataFrame([(q_ids[i], x_ids[j], s) for i, j, s in found], columns=names)

    # a fixed number of tasks: adaptive execution would judge these small rows with much work to be one task
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = ask.unionByName(held).repartition(tasks, "dim", "qb", "xb").groupBy("dim", "qb", "xb").applyInPandas(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
