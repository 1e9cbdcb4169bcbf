"""Operator 12: exact duplicates, found by owners at the ends of Patricia tries.

A text is compared without its ASCII white space.  Where texts are read, a task inserts whole byte strings into a compressed
radix trie below their partition (content hash and length); the node where a string ends holds its owner (most code points in
the original, then smallest id) and how many rows ended there.  A trie that outgrows ``HELD`` bytes spills by subtree: the
partitions below the heaviest first byte go out and leave the trie; what comes later for them starts anew.  So a text leaves a
task about once, however many copies it has.  What goes out is dealt by length and content hash, sorted by them, and inserted
whole once more; a subtree goes as soon as the next partition begins.  Members learn their owner by the number their end had
where they were read, so no join has a key that grows with a group of copies.

Defined results: a null text is an empty one; of rows that agree in code points and doc_id the first read stays; a null doc_id
comes after all others; very long texts are compared to the last byte; an empty table gives no rows; other columns stay out.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrid.functions.joins import look_up
from leafgrid.session import stage

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
HELD = 48 << 20
NODE = 400
ROWS = 500
_READ = pa.schema(
    [("mark", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("text_sha256", pa.string())]
    + [("ends", pa.bool_()), ("hash", pa.int64()), ("length", pa.int64()), ("body", pa.binary())]
    + [("n", pa.int64()), ("copies", pa.int64())]
)
_OWNED = pa.schema([("mark", pa.int64()), ("keep_id", pa.int64()), ("first", pa.int64()), ("group_size", pa.int64())])


class _Node:
    __slots__ = ("label", "below", "end")

    def __init__(self, label: bytes, below: dict = None):
        self.label, self.below, self.end = label, below, None


def _shared(label: bytes, key: bytes, at: int) -> int:
    """How many first bytes of label stand at this place of key."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if key.startswith(label[low:mid], at + low):
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """Byte strings by their shared beginnings; the end of each holds whatever its first insertion put there."""

    def __init__(self):
        self.below, self.sizes = {}, {}

    def end(self, key: bytes, new) -> tuple[object, bool]:
        """What the end of key holds, and whether it was there before; else ``new()`` is put there."""
        first, at = key[0], 0
        node = _Node(b"", self.below)
        while at < len(key):
            below = node.below.get(key[at]) if node.below else None
            if below is None:
                if node.below is None:
                    node.below = {}
                node.below[key[at]] = node = _Node(key[at:])
                self.sizes[first] = self.sizes.get(first, 0) + NODE + len(key) - at
                break
            if key.startswith(below.label, at):
                node, at = below, at + len(below.label)
                continue
            n = _shared(below.label, key, at)
            top = _Node(below.label[:n], {below.label[n]: below})
            below.label = below.label[n:]
            node.below[key[at]] = top
            self.sizes[first] += NODE
            node, at = top, at + n
        if node.end is not None:
            return node.end, True
        node.end = new()
        return node.end, False

    def size(self) -> int:
        return sum(self.sizes.values())

    def heaviest(self) -> int:
        return max(self.sizes, key=self.sizes.get)

    def take(self, first: int):
        """(key, end) of the subtree below this first byte, which leaves the trie."""
        self.sizes.pop(first)
        open_ = [(b"", self.below.pop(first))]
        while open_:
            before, node = open_.pop()
            key = before + node.label
            if node.end is not None:
                yield key, node.end
            if node.below:
                open_ += [(key, x) for x in node.below.values()]

    def take_all(self):
        for first in list(self.sizes):
            yield from self.take(first)


def _better(a: tuple, b: tuple) -> tuple:
    """The owner of two: (code points, doc_id, place of reading)."""
    rank = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    return a if rank(a) <= rank(b) else b


def _head(digest: bytes, length: int) -> bytes:
    return digest[:8] + length.to_bytes(8, "big")


def _sliced(rows, size):
    """Lists of rows with a bounded number of them and of bytes in their body."""
    some, held = [], 0
    for r in rows:
        some.append(r)
        held += size(r)
        if len(some) >= ROWS or held > HELD // 8:
            yield some
            some, held = [], 0
    if some:
        yield some


def _batch(rows, schema):
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _read(held):
    """Rows (at, doc_id, n, body) to members (mark, doc_id, at, text_sha256) and, once for each end, owners."""

    def gone(ends):
        rows = (
            (mark, owner[1], owner[2], None, True, int.from_bytes(key[:8], "big", signed=True), len(key) - 16, key[16:], owner[0], copies)
            for key, (mark, owner, copies) in ends
        )
        for some in _sliced(rows, lambda r: r[6]):
            yield _batch(some, _READ)

    def run(batches):
        trie = Trie()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                members = []
                for at, doc_id, n, body in zip(*(c.to_pylist() for c in batch.slice(start, ROWS).columns)):
                    body = body.translate(None, SPACE)
                    digest = sha256(body)
                    owner = (n, doc_id, at)
                    end, known = trie.end(_head(digest.digest(), len(body)) + body, lambda: [at, owner, 1])  # noqa: B023
                    if known:
                        end[1], end[2] = _better(end[1], owner), end[2] + 1
                    members.append((end[0], doc_id, at, digest.hexdigest(), False, None, None, None, None, None))
                    while trie.size() > held:
                        yield from gone(trie.take(trie.heaviest()))
                yield _batch(members, _READ)
        yield from gone(trie.take_all())

    return run


def _own(batches):
    """Owners of the same text, sorted by partition, to the one owner each mark has."""

    def settled(trie):
        rows = ((mark, owner[1], owner[2], copies) for _, (owner, copies, marks) in trie.take_all() for mark in marks)
        for some in _sliced(rows, lambda r: 0):
            yield _batch(some, _OWNED)

    trie, now = Trie(), None
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            for mark, doc_id, at, key, length, body, n, copies in zip(*(c.to_pylist() for c in batch.slice(start, ROWS).columns)):
                head = key.to_bytes(8, "big", signed=True) + length.to_bytes(8, "big")
                if head != now:
                    yield from settled(trie)
                    now = head
                owner = (n, doc_id, at)
                end, known = trie.end(head + body, lambda: [owner, 0, []])  # noqa: B023
                if known:
                    end[0] = _better(end[0], owner)
                end[1] += copies
                end[2].append(mark)
    yield from settled(trie)


def owners(docs: DataFrame, held: int = HELD) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of docs (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("at"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("at", "doc_id", F.char_length("text").cast("long").alias("n"), F.col("text").cast("binary").alias("body"))
    read = "mark long, doc_id long, at long, text_sha256 string, ends boolean, hash long, length long, body binary, n long, copies long"
    read = stage(rows.mapInArrow(_read(held), read), "ends")
    ends = read.where("ends").select("mark", "doc_id", "at", "hash", "length", "body", "n", "copies")
    ends = ends.repartition("hash", "length").sortWithinPartitions("hash", "length")
    owned = ends.mapInArrow(_own, "mark long, keep_id long, first long, group_size long")
    members = read.where("not ends").select("mark", "doc_id", "at", "text_sha256")
    found = look_up(members, owned, ["mark"])
    return found.select("doc_id", "keep_id", "group_size", (F.col("at") == F.col("first")).alias("kept"), "text_sha256")
