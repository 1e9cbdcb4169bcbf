"""Operator 11: a Merkle manifest whose subtrees are stored in van Emde Boas order.

A row's leaf is the SHA-256 of its columns.  The leaves of a language are numbered in order by a range sort and sums over its
partitions; ``FAN ** LEVELS`` consecutive ones are an aligned subtree, built in one task and stored as one array.  Inside the
array the tree is cut at half its height: first the upper part, then the lower subtrees one after another, each cut again
in the same way; ``slots`` is the whole address arithmetic, used to fill the array and to find siblings in it.  The roots of
the subtrees are the leaves of the next round, until one subtree is left, whose root is the language's subroot; the
subroots are the leaves of one more such tree.  Proofs go the other way: from the last round down, each subtree hands to its
leaves the runs above them, so a row meets one stored subtree and one path.

Defined results: rows that repeat a doc_id stand by their leaf hash, equal rows in any order; a null doc_id stands first and
is never tampered with; null columns are ``-``; a text of any length is one leaf; an empty table gives no rows; other columns
are no part of a leaf.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.functions.joins import look_up
from leafgrid.session import stage

FAN, LEVELS = 8, 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STORED = "tree string, block long, size long, held int, nodes binary, root string"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def full(levels: int) -> int:
    """Nodes of a whole tree of so many levels."""
    return (FAN**levels - 1) // (FAN - 1)


def slots(levels: int, depth: int, nodes: np.ndarray) -> np.ndarray:
    """Places of the nodes of one depth in the array of a tree of so many levels."""
    if levels == 1:
        return np.zeros(len(nodes), np.int64)
    top = levels // 2
    if depth < top:
        return slots(top, depth, nodes)
    low, each = levels - top, FAN ** (depth - top)
    return full(top) + nodes // each * full(low) + slots(low, depth - top, nodes % each)


def lay_out(leaves: list[str], up: int) -> tuple[bytes, str]:
    """The array of a subtree ``up`` levels high, and its root."""
    array, level = np.zeros((full(up + 1), 32), np.uint8), leaves
    for depth in range(up, -1, -1):
        array[slots(up + 1, depth, np.arange(len(level)))] = np.frombuffer(bytes.fromhex("".join(level)), np.uint8).reshape(-1, 32)
        if depth:
            level = [digest("".join(level[i : i + FAN])) for i in range(0, len(level), FAN)]
    return array.tobytes(), level[0]


def runs(nodes: bytes, held: int, up: int) -> list[list[str]]:
    """The runs of siblings of each level of a stored subtree, from its leaves up, as joined digests."""
    array, out = np.frombuffer(nodes, np.uint8).reshape(-1, 32), []
    for depth in range(up, 0, -1):
        level = array[slots(up + 1, depth, np.arange(held))].tobytes().hex()
        out.append([level[i : i + 64 * FAN] for i in range(0, len(level), 64 * FAN)])
        held = -(-held // FAN)
    return out


def folded(leaf: str, path: list[tuple[int, str]]) -> str:
    """The root that a leaf and the runs above it (its place in each, and the run) lead to."""
    for at, run in path:
        leaf = digest(run[: 64 * at] + leaf + run[64 * at + 64 :])
    return leaf


def others(path: list[tuple[int, str]]) -> str:
    return "".join(run[: 64 * at] + run[64 * at + 64 :] for at, run in path)


def _write(path):
    return ",".join(f"{at}{run}" for at, run in path)


def _steps(text):
    return [(int(x[0]), x[1:]) for x in text.split(",") if x]


def _up(size: int, levels: int) -> int:
    """Levels of a subtree of a tree with so many leaves in this round."""
    return min(levels, height(size))


def leaf(columns=COLUMNS, **instead: Column) -> Column:
    """SHA-256 of the columns, each ``-`` or its UTF-8 length, a colon and its value."""
    values = [instead.get(c, F.col(c)).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, tree, leaf, tampered, at) of every row; tree is the language, null before all others."""
    change = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        leaf().alias("leaf"),
        F.when(change, leaf(text=F.translate("text", UPPER, LOWER))).alias("tampered"),
        F.monotonically_increasing_id().alias("at"),
    )


def placed(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with ``index``, their place in their tree in this order, and ``size``, the rows of the tree.

    The rows are sorted by ranges and written; what a range holds of each tree is counted, and those few counts are summed.
    No row passes a task that sees its whole tree.
    """
    rows = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = stage(rows.withColumns({"_part": F.spark_partition_id(), "_row": row}), name)
    held = rows.groupBy("tree", "_part").agg(F.count("*").alias("n"), F.min("_row").alias("_from"))
    whole = Window.partitionBy("tree")
    before = F.sum("n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select("tree", "_part", (F.coalesce(before, F.lit(0)) - F.col("_from")).alias("_from"), F.sum("n").over(whole).alias("size"))
    found = look_up(rows, held, ["tree", "_part"])
    return found.withColumn("index", F.col("_from") + F.col("_row")).drop("_part", "_row", "_from")


def _subtree(levels):
    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("index")
        size = int(rows["size"].iloc[0])
        nodes, root = lay_out(rows["digest"].tolist(), _up(size, levels))
        return pd.DataFrame({"tree": [key[0]], "block": [key[1]], "size": [size], "held": [len(rows)], "nodes": [nodes], "root": [root]})

    return build


def _block(levels: int) -> Column:
    return F.expr(f"index div {FAN**levels}").alias("block")


def stored(nodes: DataFrame, levels: int, name: str) -> list[DataFrame]:
    """The subtrees of trees given by (tree, index, size, digest), a table for each round; the last has one for each tree."""
    rounds = []
    while True:
        blocks = nodes.select("*", _block(levels)).groupBy("tree", "block").applyInPandas(_subtree(levels), _STORED)
        rounds.append(stage(blocks, f"{name}-{len(rounds)}"))
        if rounds[-1].where("block > 0").isEmpty():
            return rounds
        size = F.expr(f"(size + {FAN**levels - 1}) div {FAN**levels}")
        nodes = rounds[-1].select("tree", F.col("block").alias("index"), size.alias("size"), F.col("root").alias("digest"))


def _way(i: int, levels: list[list[str]]) -> list[tuple[int, str]]:
    """The path of leaf i inside its subtree."""
    return [(i // FAN**k % FAN, level[i // FAN ** (k + 1)]) for k, level in enumerate(levels)]


def _hand_down(levels):
    def run(batches):
        for rows in batches:
            for tree, block, size, held, nodes, path, subroot, root in rows.itertuples(index=False):
                own, above = runs(nodes, held, _up(size, levels)), _steps(path)
                out = [(tree, block * FAN**levels + i, _write(_way(i, own) + above), subroot, root) for i in range(held)]
                yield pd.DataFrame(out, columns=["tree", "block", "path", "subroot", "root"])

    return run


def handed_down(blocks: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """(tree, block, path, subroot, root) of the leaves of stored subtrees, from the same of the subtrees themselves."""
    met = look_up(blocks.select("tree", "block", "size", "held", "nodes"), above, ["tree", "block"])
    met = met.select("tree", "block", "size", "held", "nodes", "path", "subroot", "root")
    return met.mapInPandas(_hand_down(levels), "tree string, block long, path string, subroot string, root string")


def _prove(levels):
    def run(key: tuple, rows: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        b = block.iloc[0]
        own, above = runs(b["nodes"], b["held"], _up(b["size"], levels)), _steps(b["path"])
        rest, tails, out = others(above), {}, []
        for index, original, tampered in zip(rows["index"], rows["leaf"], rows["tampered"]):
            i = index - key[1] * FAN**levels
            path = _way(i, own)
            if i // FAN not in tails:  # the proof above a run is the same for all its leaves
                tails[i // FAN] = others(path[1:]) + rest
            proof = digest(others(path[:1]) + tails[i // FAN])
            out.append((proof, folded(tampered if isinstance(tampered, str) else original, path + above)))
        out = pd.DataFrame(out, columns=["proof_sha256", "folded_root"], index=rows.index)
        return pd.concat([rows[["doc_id", "leaf"]], out], axis=1).assign(subroot=b["subroot"], root=b["root"])

    return run


def manifest(docs: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, list[DataFrame], DataFrame, list[DataFrame]]:
    """The numbered leaves, the stored subtrees of the languages by round, the numbered subroots, and the subtrees above them."""
    rows = placed(stage(leaves(docs), "leaves"), ["doc_id", "leaf", "at"], "numbered")
    rounds = stored(rows.select("tree", "index", "size", F.col("leaf").alias("digest")), levels, "subtrees")
    tops = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("digest"))
    tops = placed(tops, ["of"], "subroots")
    return rows, rounds, tops, stored(tops, levels, "upper-subtrees")


def proofs(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per row of docs."""
    rows, rounds, tops, upper = manifest(docs, levels)
    above = upper[-1].select("tree", "block", F.lit("").alias("path"), F.lit("").alias("subroot"), "root")
    for blocks in reversed(upper):
        above = handed_down(blocks, above, levels)
    tops = tops.select("of", F.col("digest").alias("_own"), F.col("index").alias("block"))
    above = tops.join(above, "block").select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("block"), "path", F.col("_own").alias("subroot"), "root")
    for blocks in reversed(rounds[1:]):
        above = handed_down(blocks, above, levels)
    blocks = look_up(rounds[0].select("tree", "block", "size", "held", "nodes"), above, ["tree", "block"])
    # as text, because pandas has no whole numbers beside nulls
    asked = rows.select("tree", _block(levels), "index", F.col("doc_id").cast("string").alias("doc_id"), "leaf", "tampered")
    out = "doc_id string, leaf string, proof_sha256 string, folded_root string, subroot string, root string"
    found = asked.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInPandas(_prove(levels), out)
    doc_id = F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")
    return found.select(doc_id, "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
