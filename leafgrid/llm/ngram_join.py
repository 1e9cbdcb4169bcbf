"""Operator 9: which documents share at least four fifths of their word shingles.

The documents by shingles incidence matrix is multiplied with its transpose in a blocked, sparse way.
A row is a distinct shingle set (copies collapse first), a block is what one shuffle partition holds of
the columns, and a pair is given up as soon as its sizes forbid enough overlap:

1. Each set gives the low part of its hashes, ``n // 5 + max(1, n // 20)`` of them.  Two sets of
   similarity 0.8 miss at most a fifth of each other, so at least ``max(1, n // 20)`` columns (n: the
   smaller set) are in both parts.  Sets with fewer columns that any other set has leave here.
2. The remaining sets order their columns by global frequency.  A pair must meet in the first
   ``n - ceil(4n / 5) + 1`` columns of each, and for the smaller set in the first
   ``n - ceil(8n / 9) + 1``; columns that only one set has need no row.
3. Every column compares its sets with its most central one.  What links is one component.  While columns
   hold many pairs of different components, each compares its sets with another one, chosen by hash, as long as
   that takes a tenth of those pairs away.  Then only sets of different components that meet in a column are compared, their overlap over the
   columns they meet in is accumulated, and pairs whose sum plus what may follow is below the bound
   8 (|A| + |B|) / 18 are dropped.
4. Overlaps of the pairs that are left are counted over the whole sets.

So no link between different components is lost, and no group of near copies is expanded to all
its pairs.  64-bit hashes stand for shingles.

Defined results: null, empty and blank texts have an empty set and are linked with nothing; of several
texts under one doc_id the one with the smallest (size, signature) counts; rows without doc_id have no
name in the result and are left out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.llm.common import components, shingles, signature, word_hashes
from leafgrid.session import stage


#: Pairs of rows in columns of several parts, as a multiple of all rows, beyond which other centres are tried first.
CROWD = 16


def low_part(n: int) -> int:
    """How many of a set's lowest hashes are compared first."""
    return min(n, n // 5 + max(1, n // 20))


def _lists(parts):
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64()))


def parity(values: np.ndarray, groups: int = 1) -> np.ndarray:
    """Groups of 256 parity bits of a set, one by each byte of its hashes: two sets differ in at least as many members
    as the bits of any group differ."""
    odd = [np.bincount((values >> 8 * k) & 255, minlength=256) & 1 for k in range(groups)]
    return np.packbits(np.concatenate(odd).astype(np.uint8)).view(np.int64)


def _features(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            piece = batch.slice(lo, 1000)
            size, one, two, low = [], [], [], []
            for text in piece.column(1):
                s = shingles(word_hashes(text.as_py() or ""))
                a, b = signature(s)
                size.append(len(s))
                one.append(a)
                two.append(b)
                low.append(s[: low_part(len(s))])
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), _lists(low)],
                names=["doc_id", "n", "s1", "s2", "low"],
            )


def _sets(batches, bits, shift):
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        keep = np.flatnonzero(_in_bits(ids, bits, shift))
        for lo in range(0, len(keep), 500):
            piece = batch.take(pa.array(keep[lo : lo + 500]))
            found = [shingles(word_hashes(t.as_py() or "")) for t in piece.column(1)]
            first = pa.array([signature(x)[0] for x in found], pa.int64())
            marks = _lists([parity(x) for x in found])
            yield pa.RecordBatch.from_arrays([piece.column(0), first, _lists(found), marks], names=["doc_id", "s1", "h", "q"])


def _slot(ids, shift):
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(shift)


def _in_bits(ids, bits, shift):
    at = _slot(ids, shift)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _some_ids(ids: DataFrame, log2: int = 22):
    """A bitmap of hashed ids, 512 KB whatever their number: a first sieve before an exact join."""
    shift = 64 - log2

    def gather(batches):
        for batch in batches:
            at = _slot(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), shift)
            bits = np.zeros(1 << (log2 - 6), np.uint64)
            np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
            used = np.flatnonzero(bits)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(bits[used].view(np.int64))], names=["word", "bits"])

    words = ids.mapInArrow(gather, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(1 << (log2 - 6), np.uint64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return bits, shift


def _overlap(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose whole sets reach the similarity."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("h").alias("ha"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("h").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb")).cast("long")
    union = F.size("ha") + F.size("hb") - both
    return pairs.join(one, "a").join(two, "b").where(100 * both >= 80 * union).select("a", "b")


def _parted(front: DataFrame, parts: DataFrame):
    """(front with the part of each set, columns of several parts with their largest, how many pairs of rows those columns hold)"""
    front = front.join(parts, "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id")).drop("component")
    front = stage(front, "front")
    held = front.groupBy("h", "part").agg(F.count("*").alias("c"))
    main = held.groupBy("h").agg(F.max(F.struct("c", "part")).alias("top"), F.count("*").alias("k"), F.sum("c").alias("size"))
    main = stage(main.where("k > 1"), "columns")
    return front, main, main.agg(F.coalesce(F.sum((F.col("size") - F.col("top.c")) * F.col("size").cast("double")), F.lit(0.0))).first()[0]


def link_sets(sets: DataFrame, groups: int = 1) -> DataFrame:
    """(id, component) of the sets that link with any other.  ``sets`` has one row per doc_id, with its distinct hashes
    ``h`` and their ``parity`` bits ``q``, in so many groups."""
    cells = sets.select("doc_id", F.size("h").cast("long").alias("n"), F.explode("h").alias("h"))
    often = cells.groupBy("h").agg(F.count("*").alias("f")).where("f > 1").select(again("h"), "f")
    met = cells.join(often.hint("shuffle_hash"), "h")
    order = F.row_number().over(_by("doc_id", "f", "h")) - 1
    count = F.count("*").over(_by("doc_id"))
    front = met.select("doc_id", "n", "h", order.alias("rank"), count.alias("met"))
    front = front.withColumn("pos", F.col("n") - F.col("met") + F.col("rank"))
    front = stage(front.where("pos < n - (4 * n + 4) div 5 + 1").select("doc_id", "n", "h", "pos", "met"), "front")

    # 3: each column's sets against its most central set
    centre = front.groupBy("h").agg(F.max(F.struct((F.col("met") / F.col("n")).alias("share"), "doc_id", "n")).alias("c"))
    star = front.join(centre, "h").where("doc_id <> c.doc_id and 5 * least(n, c.n) >= 4 * greatest(n, c.n)")
    star = star.select(F.greatest("doc_id", "c.doc_id").alias("a"), F.least("doc_id", "c.doc_id").alias("b")).distinct()
    sure = stage(_overlap(star, sets), "links")
    parts = stage(components(sure, "parts").withColumnRenamed("id", "doc_id"), "parts")
    front, main, pairs = _parted(front.drop("met").join(sets.select("doc_id", "q"), "doc_id"), parts)
    # where many sets of a column are still apart, other centres come before all pairs do
    turn, before = 0, None
    while pairs > CROWD * front.count() and (before is None or 10 * pairs < 9 * before):
        turn, before = turn + 1, pairs
        centre = front.groupBy("h").agg(F.max(F.struct(F.xxhash64("doc_id", "h", F.lit(turn)), "doc_id", "n", "part")).alias("c"))
        star = front.join(centre, "h").where("part <> c.part and 5 * least(n, c.n) >= 4 * greatest(n, c.n)")
        star = star.select(F.greatest("doc_id", "c.doc_id").alias("a"), F.least("doc_id", "c.doc_id").alias("b")).distinct()
        sure = sure.union(stage(_overlap(star, sets), "links"))
        parts = stage(components(sure, "parts").withColumnRenamed("id", "doc_id"), "parts")
        front, main, pairs = _parted(front.drop("part"), parts)
    mixed = front.join(main.select("h", F.col("top.part").alias("top")), "h")
    # at least one of two sets of different parts is outside the column's largest part
    x = mixed.where("part <> top").select("h", F.col("doc_id").alias("xd"), F.col("n").alias("xn"), F.col("pos").alias("xp"), F.col("part").alias("xc"), F.col("q").alias("xq"))
    y = mixed.select("h", F.col("doc_id").alias("yd"), F.col("n").alias("yn"), F.col("pos").alias("yp"), F.col("part").alias("yc"), F.col("q").alias("yq"), "top")
    met = x.join(y, "h").where("xc <> yc and (yc = top or xd < yd) and 5 * least(xn, yn) >= 4 * greatest(xn, yn)")
    small_first = "(xn < yn or xn = yn and xd < yd)"
    met = met.where(f"if({small_first}, xp < xn - (8 * xn + 8) div 9 + 1, yp < yn - (8 * yn + 8) div 9 + 1)")
    # from the first column they meet in on, a pair shares at most what either set has left
    met = met.where("18 * least(xn - xp, yn - yp) >= 8 * (xn + yn)")
    # and two sets of that similarity differ in at most a ninth of their sizes' sum
    differ = [" + ".join(f"bit_count(xq[{k}] ^ yq[{k}])" for k in range(4 * g, 4 * g + 4)) for g in range(groups)]
    met = met.where(" and ".join(f"9 * ({d}) <= xn + yn" for d in differ))
    swap = F.col("xd") < F.col("yd")
    side = lambda one, two: (F.when(swap, F.col(two)).otherwise(F.col(one)))
    met = met.select(side("xd", "yd").alias("a"), side("yd", "xd").alias("b"), side("xp", "yp").alias("ap"), side("yp", "xp").alias("bp"), side("xn", "yn").alias("an"), side("yn", "xn").alias("bn"))
    met = met.groupBy("a", "b", "an", "bn").agg(F.count("*").alias("both"), F.max("ap").alias("ap"), F.max("bp").alias("bp"))
    # the columns come in one order in both sets: what follows the last one met may still be shared
    met = met.where("18 * (both + least(an - ap, bn - bp) - 1) >= 8 * (an + bn)").select("a", "b")
    more = stage(_overlap(met, sets), "links")
    return components(sure.union(more), "components") if more.limit(1).count() else parts.withColumnRenamed("doc_id", "id")


def ngram_jaccard(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every distinct doc_id of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.where("doc_id is not null")
    feats = stage(docs.mapInArrow(_features, "doc_id long, n long, s1 long, s2 long, low array<long>"), "features")
    ids = feats.groupBy("doc_id").agg(F.min(F.struct("n", "s1", "s2")).alias("s")).select("doc_id", "s.*")
    groups = stage(ids.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("doc_id")), "groups")

    # 1: sets that share enough low columns with any other set
    # (copies count here too, which only lets a few more sets through)
    entries = feats.select("doc_id", "n", "s1", F.explode("low").alias("h"))
    common = entries.groupBy("h").agg(F.count("*").alias("f")).where("f > 1").select(again("h"))
    least = F.expr("greatest(1, ((4 * n + 4) div 5) div 20)")
    close = entries.join(common.hint("shuffle_hash"), "h").groupBy("doc_id", "n", "s1").agg(F.count("*").alias("met"))
    close = close.where(F.col("met") >= least).join(groups.select("doc_id", "s1"), ["doc_id", "s1"], "left_semi")
    close = stage(close.select("doc_id", F.col("s1").alias("set")).distinct(), "close")

    # 2 and 3: all columns of those sets
    bits, shift = _some_ids(close.select("doc_id"))
    sets = docs.mapInArrow(lambda batches: _sets(batches, bits, shift), "doc_id long, s1 long, h array<long>, q array<long>")
    sets = stage(sets.join(close, "doc_id").where(F.col("s1") == F.col("set")).dropDuplicates(["doc_id"]).drop("s1", "set"), "sets")
    linked = link_sets(sets)

    # back to all documents
    named = groups.withColumnRenamed("doc_id", "id").join(linked, "id", "left")
    named = named.select("n", "s1", "s2", F.coalesce("component", "id").alias("component_id"))
    out = ids.join(named, ["n", "s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def without_copies(docs: DataFrame) -> DataFrame:
    """One document of each group of docs (the smallest doc_id), all columns kept."""
    gone = ngram_jaccard(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_id"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_id"], "left_anti")


def again(key: str):
    """A key written anew, so that a join shuffles both its sides and can split a hot one."""
    return F.col(key).bitwiseXOR(F.lit(0).cast("long")).alias(key)


def _by(key, *order):
    w = Window.partitionBy(key)
    return w.orderBy(*order) if order else w
