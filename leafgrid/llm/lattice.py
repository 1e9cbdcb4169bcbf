"""Operator 5: near-duplicate embeddings by lattice hashing.

Each of ``TABLES`` tables projects the unit vectors to eight random orthogonal directions, scales them and decodes the
result to the nearest point of the E8 lattice.  A vector stands in the cell of that point and in the ``PROBES``
neighbouring cells (of the 240 at the least distance) whose points come next.  Vectors that meet in a cell are compared
by cosine in double precision.

A cell's vectors are compared in blocks of about ``BLOCK``; a task gets about ``TASK`` rows of such blocks; a pair is counted only in the first cell it shares, which
each task sees from the vectors themselves, so no pairs are shuffled: a task returns the sums of links and a spanning
forest of what it linked.  Equal vectors collapse before and count with their number.  Cells are found for all
vectors.  The recall against brute force is tested.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different length do not link; rows that repeat are vectors of their own; an empty table gives no rows; other columns stay out.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrid.llm.common import components
from leafgrid.session import stage

#: SCALE holds for 64 components; eight of d directions hold a share of a distance that falls with sqrt(8 / d).
TABLES, PROBES, SCALE, BLOCK, TASK = 5, 2, 5.0, 2000, 20_000


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: (+-1, +-1, 0^6) in all places, and (+-1/2)^8 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [list(v) for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


ROOTS = _roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest point with whole coordinates and an even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2)
    if len(odd):
        off = x[odd] - r[odd]
        worst = np.abs(off).argmax(1)
        r[odd, worst] += np.where(off[np.arange(len(odd)), worst] < 0, -1, 1)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _directions(dim: int, table: int) -> np.ndarray:
    g = np.random.default_rng([dim, table, 8]).standard_normal((max(dim, 8), 8))
    return np.linalg.qr(g)[0][:dim]


def cells(unit: np.ndarray, table: int) -> np.ndarray:
    """(n, 1 + PROBES) cell numbers: a point's doubled coordinates, one byte each."""
    y = unit @ (_directions(unit.shape[1], table) * (SCALE * np.sqrt(unit.shape[1] / 64)))
    home = decode(y)
    near = (y - home) @ ROOTS.T
    best = np.argsort(-near, axis=1, kind="stable")[:, :PROBES]
    points = np.concatenate([home[:, None], home[:, None] + ROOTS[best]], 1)
    return ((2 * points).astype(np.int64) & 255) @ (1 << (8 * np.arange(8, dtype=np.int64)))


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cells_of(batches):
    for batch in batches:
        frame = batch.to_pandas()
        for dim, part in frame.groupby(frame["embedding"].map(len)):
            for lo in range(0, len(part), 2000):
                some = part.iloc[lo : lo + 2000]
                unit, ids = _unit(some["embedding"]), some["rep"].to_numpy(np.int64)
                for t in range(TABLES):
                    c = cells(unit, t)
                    n = c.size
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(ids, c.shape[1])), pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(c.reshape(-1))],
                        names=["rep", "dim", "t", "cell"],
                    )


def _pairs(unit, least, a, b, same):
    """Places (x, y) of the pairs between rows a and b that reach the cosine."""
    xs, ys = [], []
    for lo in range(0, len(a), 500):
        x, y = np.nonzero(unit[a[lo : lo + 500]] @ unit[b].T >= least)
        x, y = a[lo : lo + 500][x], b[y]
        xs.append(x[x < y] if same else x)
        ys.append(y[x < y] if same else y)
    return np.concatenate(xs), np.concatenate(ys)


def _compare(least):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """All cells (or pairs of blocks of a cell) of one task."""
        out = []
        for _, part in rows.groupby("dim"):
            part = part.sort_values(["t", "cell", "i", "j", "rep"], kind="stable")
            unit, many, ids = _unit(part["embedding"]), part["many"].to_numpy(np.int64), part["rep"].to_numpy(np.int64)
            t, cell, i, j, block = (part[c].to_numpy(np.int64) for c in ("t", "cell", "i", "j", "block"))
            own = [cells(unit, k) for k in range(int(t.max()) + 1)]
            change = (np.diff(t) != 0) | (np.diff(cell) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(ids)]
            xs, ys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for lo, hi in zip(edges, edges[1:]):
                at = np.arange(lo, hi)
                a, b = at[block[lo:hi] == i[lo]], at[block[lo:hi] == j[lo]]
                if len(a) and len(b) and hi - lo > 1:
                    x, y = _pairs(unit, least, a, b, i[lo] == j[lo])
                    xs.append(x)
                    ys.append(y)
            x, y = np.concatenate(xs), np.concatenate(ys)
            # a pair counts in the first cell it shares
            new = np.ones(len(x), bool)
            for k in range(len(own)):
                same = own[k][x][:, :, None] == own[k][y][:, None, :]
                new &= ~np.where(t[x] > k, same.any((1, 2)), (same & (own[k][x] < cell[x][:, None])[:, :, None]).any((1, 2)) & (t[x] == k))
            x, y = x[new], y[new]
            links = np.bincount(x, many[y], len(ids)) + np.bincount(y, many[x], len(ids))
            root = np.arange(len(ids))
            while True:
                low = np.minimum(root[x], root[y])
                if (root[x] == low).all() and (root[y] == low).all():
                    break
                np.minimum.at(root, x, low)
                np.minimum.at(root, y, low)
            at = np.flatnonzero(links)
            out.append(pd.DataFrame({"rep": ids[at], "links": links[at].astype(np.int64), "root": ids[root[at]]}))
        return pd.concat(out)

    return run


def lattice_links(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fine = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = rows.where("embedding is not null").where(fine & F.col("vec_id").isNotNull())
    reps = stage(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many")), "vectors")
    at = stage(reps.mapInArrow(_cells_of, "rep long, dim int, t int, cell long"), "cells")
    full = at.groupBy("dim", "t", "cell").agg(F.count("*").alias("n")).where("n > 1")
    full = stage(full.select("dim", "t", "cell", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "full")
    near = at.join(full.drop("n"), ["dim", "t", "cell"]).withColumn("block", F.pmod(F.xxhash64("rep", "t"), "blocks").cast("int"))
    # block x meets every block y: the task (least, greatest) gets both
    near = near.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    near = near.select("rep", "dim", "t", "cell", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    near = near.join(reps, "rep")
    # many cells to a task; a cell's block pair stays whole
    total = full.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    task = F.pmod(F.xxhash64("dim", "t", "cell", "i", "j"), F.lit(max(1, round(total / TASK)))).alias("task")
    found = near.groupBy(task).applyInPandas(_compare(least), "rep long, links long, root long")
    found = stage(found, "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = reps.join(links, "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    flagged = rows.withColumn("key", F.when(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull(), F.col("embedding")))
    out = flagged.join(known.withColumnRenamed("embedding", "key"), "key", "left")
    part = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), part.alias("component_id"), (F.col("vec_id") == part).alias("kept"))
