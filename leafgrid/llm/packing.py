"""Operator 2: pack token sequences into as few fixed-length sequences as possible.

Only documents longer than a sequence are cut.  Pieces of full length are sequences of their own.  The others go, by a
hash of their id, into blocks of about ``BLOCK`` pieces, each a mixed sample of all lengths; a block is packed by
best fit and then improved by local search between its underfull bins: a move of a piece, an exchange of one for one or of two
for one that raises the sum of squared fills, and the emptiest bins are given to the others piece by piece until no
bin empties.  What a block's few remaining underfull bins hold is packed again, together for ``MERGE`` blocks.  A block has a
bounded size at any scale, so there is no task that sees all documents.

Defined results: a null or empty text is the closing id alone; rows that repeat are packed each by itself
(``copy`` tells rows with one doc_id apart); a null doc_id is a document like any other; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from struct import pack as as_bytes

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrid.llm.common import worker_cache
from leafgrid.session import stage

BLOCK = 8000
MERGE = 16
OPEN = 0.98
#: Words a worker keeps, and the bytes of the longest one it does: about 200 bytes a word, at most 500.
CACHED, KEPT = 250_000, 64
ROWS = 500
PUNCTUATION = b".,;:!?*#$%&|()[]\"-"

# how the vocabulary's files write bytes: printable ones as themselves, the others from code point 256 on
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - _PLAIN))}

def _encoder(path):
    """Texts to bytes of ids.  No token of the vocabulary spans ASCII white space, so words are encoded alone and kept.

    A new word is looked up without its case and the punctuation at its end, which are tokens apart after a letter
    or figure; only stems that are new themselves reach the tokenizer.
    """
    kept = worker_cache("packing")
    if kept.get("path") != path:
        from tokenizers import Tokenizer

        kept.update(path=path, of=Tokenizer.from_file(path), words={}, stems={})
    known, stems, tokenizer = kept["words"], kept["stems"], kept["of"]
    model = tokenizer.model

    def look(x: bytes) -> bytes:
        s = x.decode("utf-8", "replace")
        if s.isalpha() and (s.isascii() or max(s) < "\u0130"):
            # letters of one case rule and no composition: the normalizers only lower them, the model takes them as they are
            s = s.lower()
            ids = [t.id for t in model.tokenize(s if s.isascii() else s.encode().decode("latin-1").translate(BYTES))]
        else:
            ids = tokenizer.encode(s, add_special_tokens=False).ids
        return as_bytes(f"<{len(ids)}I", *ids)

    def fresh(words):
        """Keep the ids of new words; those of words too long to keep are returned."""
        long = {}
        for w in words:
            stem = w.lower().rstrip(PUNCTUATION)
            if stem[-1:].isalnum() and b"<|" not in w and b"'" not in w:
                tail = w[len(stem) :]
            else:
                stem, tail = w, b""
            ids = stems.get(stem)
            if ids is None:
                ids = look(stem)
                if len(stem) <= KEPT:
                    stems[stem] = ids
            if tail:
                more = stems.get(tail)
                if more is None:
                    more = look(tail)
                    if len(tail) <= KEPT:
                        stems[tail] = more
                ids += more
            if len(w) <= KEPT:
                known[w] = ids
            else:
                long[w] = ids
        return long

    def encode(text: str) -> bytes:
        words = text.encode("utf-8", "surrogatepass").split()
        for kept in (known, stems):
            if len(kept) > CACHED:
                kept.clear()
        new = [w for w in dict.fromkeys(words) if w not in known]
        long = fresh(new) if new else None
        if long:
            return b"".join([known[w] if w in known else long[w] for w in words])
        return b"".join([known[w] for w in words])

    return encode


def _pieces(path, length, close):
    end = np.array([close], "<u4").tobytes()

    def run(batches):
        encode = _encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                out = []
                for doc, copy, text in zip(*(batch.slice(lo, ROWS).column(i).to_pylist() for i in range(3))):
                    ids = encode(text or "") + end
                    for k, start in enumerate(range(0, len(ids), 4 * length)):
                        part = ids[start : start + 4 * length]
                        out.append((doc, copy, k, start // 4, len(part) // 4, zlib.crc32(part)))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "copy", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of piece numbers; each piece, longest first, goes where least room is left."""
    room = [[] for _ in range(size + 1)]
    filled, bins = [], []  # filled: the rooms some bin has, in order
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect_left(filled, n)
        if at < len(filled):
            r = filled[at]
            b = room[r].pop()
            if not room[r]:
                filled.pop(at)
        else:
            r, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        left = r - n
        if left:
            if not room[left]:
                filled.insert(bisect_left(filled, left), left)
            room[left].append(b)
    return bins


def least_bins(lengths: np.ndarray, size: int) -> int:
    """No packing has fewer bins.

    Pieces over half a bin need one each, and pieces of k tokens or more fit beside them only in bins that leave k; and
    of pieces over the (k + 1)-th part of a bin no more than k fit together.
    """
    many = np.bincount(lengths, minlength=size + 1)
    count = np.concatenate([[0], np.cumsum(many)])
    total = np.concatenate([[0], np.cumsum(many * np.arange(size + 1))])
    half = size // 2
    k = np.arange(half + 1)
    alone = count[size + 1] - count[half + 1]
    beside = (size * (count[size - k + 1] - count[half + 1])) - (total[size - k + 1] - total[half + 1])
    over = np.maximum(0, total[half + 1] - total[k] - beside)
    k = np.arange(1, size + 1)
    return int(max((alone + -(-over // size)).max(), (-(-(count[size + 1] - count[size // (k + 1) + 1]) // k)).max()))


def local_search(bins: list[list[int]], lengths: np.ndarray, size: int) -> list[list[int]]:
    """Exchange pieces between underfull bins while the sum of squared fills grows; drop bins that empty.

    A bin that is to empty gives a piece x to a bin that is as full or fuller and has room r: by a move (x <= r), or by an
    exchange against one piece or two pieces of that bin worth y with y < x <= y + r, which leaves the emptying bin
    smaller.  All underfull bins are asked, emptiest first to give and all others to take, until nothing improves or
    no packing can have fewer bins.  Every step raises the sum of squared fills, so the search ends.
    """
    fewest = least_bins(lengths, size)
    if len(bins) <= fewest:
        return bins
    of = np.empty(len(lengths), np.int64)
    for b, held in enumerate(bins):
        of[held] = b
    fill = np.bincount(of, lengths, len(bins)).astype(np.int64)
    some = np.flatnonzero(fill[of] < size)  # pieces of underfull bins
    left, changed = len(bins), True
    while changed and left > fewest:
        changed = False
        for source in sorted(np.flatnonzero(fill < size).tolist(), key=lambda b: (fill[b], b)):
            while 0 < fill[source] < size:
                step = _best_step(of, fill, lengths, size, some, source)
                if not step:
                    break
                gain, to, given, back = step
                of[given] = to
                of[list(back)] = source
                fill[source] -= gain
                fill[to] += gain
                changed = True
            left = np.count_nonzero(fill)
            if left <= fewest:
                break
    order = np.argsort(of, kind="stable")
    return [held.tolist() for held in np.split(order, np.cumsum(np.bincount(of, minlength=len(bins)))[:-1]) if len(held)]


def _best_step(of, fill, lengths, size, some, source):
    """(gain, bin, piece given, pieces taken back) of a step that lowers a bin, or None.

    The step that lowers it most among moves and exchanges of one; those against two are looked at where there is none.
    """
    takes = (fill >= fill[source]) & (fill < size)
    takes[source] = False
    own = some[of[some] == source]
    sizes, first = np.unique(lengths[own], return_index=True)
    room = size - fill
    open_bins = np.flatnonzero(takes)
    if not len(open_bins):
        return None
    widest = room[open_bins].max()
    best = None
    for x, i in zip(sizes[::-1].tolist(), own[first[::-1]].tolist()):
        if x <= widest:  # the fullest bin that takes it whole
            fits = open_bins[room[open_bins] >= x]
            best = (x, int(fits[np.argmin(room[fits])]), i, ())
            break
    others = some[takes[of[some]]]
    others = others[np.argsort(of[others], kind="stable")]
    n, where = lengths[others], of[others]

    def look(y, bin_of, *pieces):
        nonlocal best
        for x, i in zip(sizes.tolist(), own[first].tolist()):
            if best and x <= best[0]:
                continue
            gain = np.where((y < x) & (x - y <= room[bin_of]), x - y, 0)
            k = int(np.argmax(gain))
            if gain[k] > (best[0] if best else 0):
                best = (int(gain[k]), int(bin_of[k]), i, tuple(int(p[k]) for p in pieces))

    if len(others):
        look(n, where, others)
    if best:
        return best
    # pieces of one bin stand together: two of a bin are some places apart
    for apart in range(1, int(np.bincount(where).max()) if len(others) else 0):
        same = np.flatnonzero(where[apart:] == where[:-apart])
        if len(same):
            look(n[same] + n[same + apart], where[same], others[same], others[same + apart])
    return best


def _pack(size, again):
    """Pack one block; bins with more room than is worth keeping are marked for the second turn."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy(np.int64)
        bins = local_search(best_fit(lengths, size), lengths, size)
        order = np.concatenate([np.array(b, np.int64) for b in bins])
        counts = np.array([len(b) for b in bins])
        bin_of = np.repeat(np.arange(len(bins)), counts)
        n = lengths[order]
        total = np.cumsum(n)
        first = np.repeat(total[np.cumsum(counts) - counts] - n[np.cumsum(counts) - counts], counts)
        out = rows.iloc[order].copy()
        out["bin"] = bin_of
        out["offset"] = total - n - first
        fill = np.bincount(bin_of, n, len(bins))
        out["open"] = (fill < OPEN * size)[bin_of] & again
        return out

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, close: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, copy), one row per piece of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("copy"), F.col("text").cast("string").alias("text"))
    cut = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"
    pieces = stage(rows.mapInArrow(_pieces(tokenizer, length, close), cut), "pieces")
    whole = pieces.where(F.col("length") == length).withColumns({"block": F.lit(-1).cast("long"), "offset": F.lit(0).cast("long")})
    short = pieces.where(F.col("length") < length)
    blocks = max(1, round(short.count() / BLOCK))
    schema = f"{cut}, block long, bin long, offset long, open boolean"
    short = short.withColumn("block", F.pmod(F.xxhash64("copy", "doc_id", "piece"), F.lit(blocks)))
    first = stage(short.groupBy("block").applyInPandas(_pack(length, blocks > 1), schema), "packed")
    done = first.where("not open").drop("open")
    turns = max(1, blocks // MERGE)
    rest = first.where("open").drop("open", "bin", "offset").withColumn("block", F.pmod("block", F.lit(turns)) + blocks)
    rest = rest.groupBy("block").applyInPandas(_pack(length, False), schema).drop("open")
    packed = done.unionByName(rest).withColumn("sequence_id", F.col("block") * (BLOCK * MERGE * 64) + F.col("bin"))
    alone = whole.withColumn("sequence_id", -1 - F.monotonically_increasing_id())
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "copy"]
    return packed.select(*out).unionByName(alone.select(*out))
