"""Helpers the operators share: word hashes, shingle sets, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrid.session import stage

WORDS = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
#: What a byte adds to its word: capitals as small letters, white space nothing.
_ADDS = np.where(_SPACE, np.uint64(0), _BYTE[_LOWER])
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_JOIN = np.uint64(0xD1342543DE82EF95)
_PIECE = 1 << 20


_worker: dict = {}


def worker_cache(owner: str) -> dict:
    """What a Python worker keeps for one operator between batches and tasks.

    Workers are used again by later stages; when another operator asks, what the one before kept is given up, so that
    the caches of a pipeline's stages do not add up.
    """
    if owner not in _worker:
        _worker.clear()
        _worker[owner] = {}
    return _worker[owner]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_edges(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after its last."""
    if not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = np.zeros(len(b) + 2, bool)
    np.logical_not(_SPACE[b], out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


_powers: dict = {}


def _powers_of(base: np.uint64, n: int) -> np.ndarray:
    """base^0, base^1, ... (n of them); those of texts up to _PIECE bytes are kept."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        size = n if n > _PIECE else max(1 << 16, 1 << (n - 1).bit_length())
        known = np.full(size, base)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if size <= _PIECE:
            _powers[int(base)] = known
    return known[:n]


def _hash_piece(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words of some bytes, from ``start`` to ``end`` each."""
    if not len(start):
        return np.empty(0, np.uint64)
    adds = _ADDS[b]
    adds *= _powers_of(_STEP, len(b))
    # white space adds nothing, so a word's sum may go on to the next one
    return mix(np.add.reduceat(adds, start) * _powers_of(_BACK, len(b))[start] + (end - start).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z taken as a-z.

    A word's hash depends on its bytes alone.  Long texts are taken in pieces that end at white
    space, so that the work space stays small.
    """
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return hashes_between(b, *word_edges(b))


def hashes_between(b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """``word_hashes`` of the words that begin at the bytes ``first`` and end before ``last``."""
    if len(b) <= _PIECE:
        return _hash_piece(b, first, last)
    found, k = [], 0
    while k < len(first):
        j = max(k + 1, int(np.searchsorted(last, first[k] + _PIECE, "right")))
        at = first[k]
        found.append(_hash_piece(b[at : last[j - 1]], first[k:j] - at, last[k:j] - at))
        k = j
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def window_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hash of every run of ``width`` words; of the whole sequence if it is shorter."""
    n = len(words)
    k = min(n, width)
    if not k:
        return np.empty(0, np.uint64)
    h = words[: n - k + 1].copy()
    for i in range(1, k):
        h = h * _JOIN + words[i : n - k + 1 + i]
    return mix(h + np.uint64(k))


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words."""
    return np.unique(window_hashes(words, width).view(np.int64))


def signature_parts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = values.view(np.uint64)
    return mix(v ^ np.uint64(0x5851F42D4C957F2D)), mix(v + _STEP)


def signature(values: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole set of hashes: a sum and an exclusive or over its members."""
    one, two = signature_parts(values)
    a = one.sum(dtype=np.uint64)
    b = np.bitwise_xor.reduce(two) if len(two) else np.uint64(0)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _forest(batches):
    """Edges (u, v) of one task as (id, smallest id it is joined to here)."""
    parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if not parts:
        return
    u, v = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    top = list(range(len(ids)))
    for x, y in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        while top[y] != y:
            top[y] = top[top[y]]
            y = top[y]
        if x != y:  # ids are sorted, so the smaller place is the smaller id
            top[max(x, y)] = min(x, y)
    for x in range(len(top)):
        top[x] = top[top[x]]
    roots = np.array(top)
    keep = np.flatnonzero(roots != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(ids[roots[keep]])], names=["u", "v"])


#: Buckets in which equal hashes meet: the first 12 bits of a hash; the 32 bits after them tell hashes of a bucket apart.
BUCKET_BITS = 12
_REST = np.uint64(64 - BUCKET_BITS - 32)


def dealt(hashes: np.ndarray, with_ids: np.ndarray | None = None) -> pa.RecordBatch:
    """(bucket, rest, ids): for each bucket the next 32 bits of its hashes, four bytes each, and what goes with them, eight bytes each.

    ``hashes`` are unsigned and ascend.
    """
    ends = np.searchsorted(hashes, np.arange(1, 1 << BUCKET_BITS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS))
    ends = np.concatenate([[0], ends, [len(hashes)]])
    used = np.flatnonzero(np.diff(ends))
    rest = (hashes >> _REST).astype(np.uint32)
    columns, names = [pa.array(used, pa.int32()), _binaries(rest, ends, used)], ["bucket", "rest"]
    if with_ids is not None:
        columns, names = [*columns, _binaries(with_ids, ends, used)], [*names, "ids"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _binaries(values, ends, used):
    at = (np.concatenate([ends[used], ends[-1:]]) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(used), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def shared_key(hashes: np.ndarray) -> np.ndarray:
    """The bits of a hash that ``dealt`` sends, as one number."""
    return (hashes.view(np.uint64) >> _REST).view(np.int64)


def by_bucket(batches, most: int = 1 << 20):
    """(bucket, whether it goes on, columns after it) from rows sorted by bucket, about ``most`` hashes at once."""
    at, held, size = None, [], 0

    def gathered():
        return [np.frombuffer(b"".join(x), t) for x, t in zip(zip(*held), (np.uint32, np.int64))]

    for batch in batches:
        for bucket, *columns in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (bucket != at or size >= most):
                yield at, bucket == at, gathered()
                held, size = [], 0
            at, size = bucket, size + len(columns[0]) // 4
            held.append(columns)
    if held:
        yield at, False, gathered()


def components(edges: DataFrame, name: str = "links", task: int = 250_000) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b), for every id on an edge.

    Rounds of two steps: tasks of about ``task`` edges replace what they hold by stars to the smallest id,
    then a large and a small star step joins what different tasks hold.  When a single task is left, it is done;
    else it is done when no round changes anything.  Each round is written to the shared folder, so
    neither lineage nor driver memory grows, and no group of neighbours is gathered in one task.
    """

    def contracted(pairs):
        n = -(-pairs.count() // task)
        return max(1, n), stage(pairs.repartition(max(1, n)).mapInArrow(_forest, "u long, v long"), name)

    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    tasks, pairs = contracted(stage(pairs, name))
    seen = None
    while tasks > 1:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        after = small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        pairs = stage(after, name)
        mark = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:  # only stars are left
            break
        seen = mark
        if -(-mark[0] // task) == 1:
            tasks, pairs = contracted(pairs)
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
