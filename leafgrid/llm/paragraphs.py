"""Operator 1: passages that repeat, paragraph by paragraph, by MinHash banding.

A paragraph is a line of at least ``LEAST`` words.  Its five-word shingles give ``BANDS`` bands of ``WIDE`` minima; at
similarity 0.8 two paragraphs share a band with probability 1 - (1 - 0.8^3)^9 = 0.998.  Lines of equal shingles
collapse first.  Paragraphs that share a band with another one are joined and verified by exact Jaccard over their
whole shingle sets; the join inside the colliding paragraphs is that of ``ngram_join.link_sets``, which expands no group to all its pairs.
Of every component the first paragraph (smallest doc_id, then position) stays and the others are removed.

``repeated_passages``, which the query runs, takes every line of ``FEW`` words (one shingle) or more, and then what repeats inside
lines or across line breaks: ``windows_of`` cuts windows of ``RUN`` words from the word sequence of a text at places that its content
chooses, at least one in every ``STEP`` neighbouring ones.  So a run of RUN + STEP - 1 = 23 words that stands anywhere in two places
always shares a window.  A passage of 50 words or more of similarity 0.8 holds such a run, as each change inside costs five shingles.
Hashes of windows are counted first, in buckets of packed bytes (``common.dealt``), and a sieve of those that stand in two places says which windows are
written, one row a text.  Windows in removed lines are left out; of equal ones the first stays, the others are joined to spans, and spans that share windows are a component.
At either end of a run up to STEP - 1 words may stay, and likewise beside a changed word.

Defined results: null and empty texts have no paragraphs; a paragraph that repeats inside one document is removed there too;
rows that repeat a doc_id are texts of one document, and their paragraphs count one by one; rows equal in doc_id and text
are one text, from each of which the same is removed; rows without doc_id are left
out; an empty table gives no rows; other columns are ignored.  Positions count code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.llm.common import by_bucket, components, dealt, hashes_between, mix, shared_key, signature_parts, window_hashes, word_edges
from leafgrid.llm.ngram_join import _in_bits, _lists, _slot, again, link_sets, parity
from leafgrid.session import stage

LEAST, BANDS, WIDE = 45, 9, 3
FEW, RUN, STEP = 5, 16, 8
#: Groups of 256 parity bits a set has: lines are many and alike, and one group lets half the pairs through that differ by a little too much.
PARITY = 8

_A = np.random.default_rng(77).integers(1, 2**31, BANDS * WIDE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = np.random.default_rng(78).integers(0, 2**32, BANDS * WIDE, dtype=np.uint32)
_C = np.random.default_rng(79).integers(1, 2**63, WIDE, dtype=np.uint64) | np.uint64(1)


class Texts:
    """Words and lines of some texts, taken as one sequence of bytes in which a line break ends each text.

    ``first`` and ``last`` are the bytes at which words begin and end, ``line`` is the line of each word and
    ``text`` the text of each line.
    """

    def __init__(self, texts: list[str]):
        whole = "\n".join(texts)
        raw = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
        self.first, self.last = word_edges(raw)
        self.words = hashes_between(raw, self.first, self.last)
        breaks = np.flatnonzero(raw == 10)
        self.later = np.flatnonzero((raw & 0xC0) == 0x80) if len(raw) > len(whole) else np.empty(0, np.int64)
        ends = np.searchsorted(self.first, breaks)  # words before each break
        self.line = np.repeat(np.arange(len(breaks) + 1), np.diff(ends, prepend=0, append=len(self.first)))
        self.begin, self.end = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(raw)]])
        lines = np.array([t.count("\n") + 1 for t in texts], np.int64)
        self.text = np.repeat(np.arange(len(texts)), lines)
        self.top = np.cumsum(lines) - lines  # first line of each text

    def point(self, at):
        """Code points before a byte."""
        return at - np.searchsorted(self.later, at) if len(self.later) else at

    def place(self, at, line):
        """Code points from the begin of a line's text to a byte."""
        return self.point(at) - self.point(self.begin[self.top[self.text[line]]])


def _portions(batches, bound: int = 1 << 17):
    """Columns before the text, and texts of up to 500 rows and about ``bound`` characters together (one row at least): what a
    processor's cache holds."""
    for batch in batches:
        at, size, texts = 0, 0, []
        column = batch.column(batch.num_columns - 1)
        for k in range(batch.num_rows):
            texts.append(column[k].as_py() or "")
            size += len(texts[-1])
            if size >= bound or len(texts) == 500 or k == batch.num_rows - 1:
                yield [batch.column(i).slice(at, len(texts)) for i in range(batch.num_columns - 1)], texts
                at, size, texts = k + 1, 0, []


def paragraphs_of(texts: list[str], least: int):
    """(Texts, lines of at least ``least`` words, their numbers of words, ends, values, sums): the five-word shingles of the
    k-th line are ``values[ends[k] : ends[k + 1]]``, in the order of the text, and their sum stands for the line.  Takes
    ``least`` of five or more; no word or shingle spans two lines."""
    t = Texts(texts)
    n = np.bincount(t.line, minlength=len(t.text))
    long = n >= max(least, 5)
    taken = np.flatnonzero(long)
    if not len(taken):
        return t, taken, n[taken], np.zeros(1, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    of = t.line[:-4]
    values = window_hashes(t.words)[(of == t.line[4:]) & long[of]]
    ends = np.concatenate([[0], np.cumsum(n[taken] - 4)])
    return t, taken, n[taken], ends, values, np.add.reduceat(signature_parts(values)[0], ends[:-1])


def bands(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(sets, BANDS) keys of the minima of sets under 32-bit permutations; a chance meeting only adds a candidate."""
    v = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    keys = np.zeros((len(ends) - 1, BANDS), np.uint64)
    for k in range(BANDS * WIDE):
        low = np.minimum.reduceat(v * _A[k] ^ _B[k], ends[:-1])
        keys[:, k // WIDE] += low.astype(np.uint64) * _C[k % WIDE]
    return mix(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _rows(least):
    def run(batches):
        for (docs, marks), texts in _portions(batches):
            t, line, n, ends, values, sums = paragraphs_of(texts, least)
            if not len(line):
                continue
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(line) + 1) * BANDS, pa.int32()), pa.array(bands(values, ends).ravel()))
            of = pa.array(t.text[line])
            start = t.place(t.begin[line], line)
            columns = [line - t.top[t.text[line]], start, t.place(t.end[line], line) - start, n, sums.view(np.int64)]
            names = ["doc_id", "text_id", "paragraph", "start", "length", "n_words", "s1", "bands"]
            yield pa.RecordBatch.from_arrays([docs.take(of), marks.take(of), *[pa.array(c, pa.int64()) for c in columns], lists], names=names)

    return run


def _dealt_keys(batches, most: int = 1 << 22):
    """Band keys of the distinct lines (s1, bands) of a task, dealt to buckets."""
    held, size = [], 0

    def out():
        ids, keys = (np.concatenate(x) for x in zip(*held))
        ids, first = np.unique(ids, return_index=True)
        keys = keys.reshape(-1, BANDS)[first].ravel().view(np.uint64)
        order = np.argsort(keys)
        return dealt(keys[order], ids[order // BANDS])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False)))
            size += len(held[-1][1])
        if size >= most:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _met_keys(batches):
    """Lines that share a key with a line of other shingles, from buckets; may name a line more than once."""
    known = None
    for _, more, (keys, ids) in by_bucket(batches):
        many = np.zeros(len(keys), bool)
        if known:
            keys, ids, many = (np.concatenate(x) for x in zip(known, (keys, ids, many)))
        order = np.argsort(keys, kind="stable")
        keys, ids, many = keys[order], ids[order], many[order]
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        met = np.minimum.reduceat(ids, begin) != np.maximum.reduceat(ids, begin)
        met |= np.logical_or.reduceat(many, begin)
        # of a bucket that goes on, one line of each key is kept
        known = (keys[begin], ids[begin], met) if more else None
        found = np.unique(ids[np.repeat(met, np.diff(begin, append=len(keys)))])
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["s1"])


def _sets_of(least, bits, shift):
    def run(batches):
        for _, texts in _portions(batches):
            *_, ends, values, sums = paragraphs_of(texts, least)
            ids, first = np.unique(sums.view(np.int64), return_index=True)
            kept = _in_bits(ids, bits, shift)
            found = [np.unique(values[ends[k] : ends[k + 1]].view(np.int64)) for k in first[kept].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids[kept], pa.int64()), _lists(found), _lists([parity(x, PARITY) for x in found])], names=["doc_id", "h", "q"])

    return run


def repeated_paragraphs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, paragraph, start, length, n_words, cluster_id, kept_doc_id, kept_paragraph), one row per paragraph to remove."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return _repeated(docs.withColumn("text_id", F.xxhash64("text")), least).drop("text_id", "kept_start")


def _repeated(docs: DataFrame, least: int) -> DataFrame:
    kinds = "doc_id long, text_id long, paragraph long, start long, length long, n_words long, s1 long, bands array<long>"
    rows = stage(docs.select("doc_id", "text_id", "text").mapInArrow(_rows(least), kinds), "paragraphs")
    # one node per distinct line
    place = F.struct("doc_id", "paragraph", "start", "text_id")
    nodes = stage(rows.groupBy("s1").agg(F.min(place).alias("first"), F.count("*").alias("copies")), "nodes")
    keys = rows.select("s1", "bands").mapInArrow(_dealt_keys, "bucket int, rest binary, ids binary")
    close = stage(_by_bucket(keys).mapInArrow(_met_keys, "s1 long").select(F.col("s1").alias("doc_id")).distinct(), "close")
    bits, shift = _sieve(close)
    sets = docs.select("text").mapInArrow(_sets_of(least, bits, shift), "doc_id long, h array<long>, q array<long>").join(close, "doc_id", "left_semi")
    linked = link_sets(stage(sets.dropDuplicates(["doc_id"]), "sets"), PARITY).withColumnRenamed("id", "s1")
    named = nodes.join(linked, "s1", "left").withColumn("cluster_id", F.coalesce("component", "s1"))
    kept = named.groupBy("cluster_id").agg(F.min("first").alias("kept"), F.sum("copies").alias("copies")).where("copies > 1")
    named = named.select("s1", "cluster_id").join(kept.select(again("cluster_id"), "kept"), "cluster_id")
    out = rows.drop("bands").join(named.select(again("s1"), "cluster_id", "kept"), "s1")
    first = "doc_id = kept.doc_id and paragraph = kept.paragraph and start = kept.start and text_id = kept.text_id"
    out = out.where(f"not ({first})")
    number = lambda name: F.col(name).cast("int")
    return out.select("doc_id", "text_id", number("paragraph").alias("paragraph"), "start", "length", "n_words", "cluster_id", F.col("kept.doc_id").alias("kept_doc_id"), number("kept.paragraph").alias("kept_paragraph"), F.col("kept.start").alias("kept_start"))


def windows_of(texts: list[str]):
    """(text, word, start, end, line, hash) arrays of the windows of RUN words that the contents of texts choose.

    Word, line, start and end count from the begin of the text, start and end code points.
    """
    t = Texts(texts)
    if len(t.words) < RUN:
        return [np.empty(0, np.int64)] * 6
    value, of = window_hashes(t.words, RUN), t.text[t.line]
    n = len(value)
    inside = of[:n] == of[RUN - 1 :]
    # a window is taken if it is the least of any STEP neighbours of its text
    low = np.zeros(n + STEP - 1, np.uint64)
    if n >= STEP:
        least = value[: n - STEP + 1].copy()
        for k in range(1, STEP):
            np.minimum(least, value[k : n - STEP + 1 + k], out=least)
        least[of[: n - STEP + 1] != of[RUN + STEP - 2 :]] = 0
        low[STEP - 1 : n] = least
    best = low[:n].copy()
    for k in range(1, STEP):
        np.maximum(best, low[k : n + k], out=best)
    taken = (best == value) & inside
    # and at both ends of each text and of each longer line; all of a text that has fewer than STEP
    for parts in (t.line, of):
        turn = np.flatnonzero(np.diff(parts)) + 1
        begin, end = np.concatenate([[0], turn]), np.concatenate([turn, [len(parts)]])
        long = end - begin >= RUN
        taken[begin[long]] = True
        taken[end[long] - RUN] = True
    for lo, hi in zip(begin[long].tolist(), end[long].tolist()):
        if hi - lo < RUN + STEP - 1:
            taken[lo : hi - RUN + 1] = True
    at = np.flatnonzero(taken)
    line, text = t.line[at], of[at]
    word = at - begin[np.searchsorted(begin, at, "right") - 1]
    return [text, word, t.place(t.first[at], line), t.place(t.last[at + RUN - 1], line), line - t.top[text], value[at].view(np.int64)]


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def _dealt_windows(batches, most: int = 1 << 22):
    """Hashes of the windows of a task, at most two of a kind, dealt to buckets."""
    held, size = [], 0

    def out():
        v = np.sort(np.concatenate(held).view(np.uint64))
        third = np.zeros(len(v), bool)
        third[2:] = v[2:] == v[:-2]
        return dealt(v[~third])

    for _, texts in _portions(batches):
        held.append(windows_of(texts)[5])
        size += len(held[-1])
        if size >= most:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def _met_windows(batches):
    """Keys that stand in two places, once each, from buckets."""
    known, told = np.empty(0, np.uint32), np.empty(0, np.uint32)
    for bucket, more, (rest,) in by_bucket(batches):
        v = np.sort(np.concatenate([known, rest]))
        met = np.setdiff1d(v[1:][v[1:] == v[:-1]], told)
        # what a bucket that goes on has shown so far
        known, told = (np.unique(v), np.concatenate([told, met])) if more else (np.empty(0, np.uint32),) * 2
        yield pa.RecordBatch.from_arrays([pa.array((bucket << 32) + met.astype(np.int64))], names=["key"])


def _windows(bits, shift):
    """One row per text: what may stand in two places, as lists."""

    def run(batches):
        for (docs, marks), texts in _portions(batches):
            of, *columns = windows_of(texts)
            kept = _in_bits(shared_key(columns[-1]), bits, shift)
            of = of[kept]
            used = np.unique(of)
            ends = pa.array(np.searchsorted(of, np.append(used, len(texts))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(c[kept], pa.int64() if k == 4 else pa.int32())) for k, c in enumerate(columns)]
            used = pa.array(used, pa.int64())
            yield pa.RecordBatch.from_arrays([docs.take(used), marks.take(used), *lists], names=["doc_id", "text_id", "word", "start", "end", "line", "hash"])

    return run


def _outside(batches):
    """The windows of texts, one row each, that touch no part of ``out`` (begins and ends, disjoint)."""
    for batch in batches:
        lists = [batch.column(k) for k in range(2, 7)]
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists[0].offsets.to_numpy()))
        columns = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
        out = batch.column(7)
        size = out.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        parts = out.flatten()
        lo, hi = (np.sort((np.repeat(np.arange(batch.num_rows), size) << 32) + parts.field(k).to_numpy(zero_copy_only=False)) for k in (0, 1))
        begin, end = ((row << 32) + columns[k] for k in (1, 2))
        # the first part that ends after a window's begin
        after = np.searchsorted(hi, begin, "right")
        kept = np.append(lo, np.iinfo(np.int64).max)[after] >= end
        row, columns = pa.array(row[kept]), [c[kept] for c in columns]
        place = [batch.column(0).take(row), batch.column(1).take(row)]
        key = pa.array(shared_key(columns[4]))
        yield pa.RecordBatch.from_arrays([*place, *map(pa.array, columns), key], names=["doc_id", "text_id", "word", "start", "end", "line", "hash", "key"])


def _sieve(ids: DataFrame, most: int = 24):
    """A bitmap of a column of ids, about eight bits for each and 2^most (2 MB) at most: a first sieve of what meets the exact join."""
    log2 = min(most, max(16, (8 * ids.count()).bit_length()))
    shift = 64 - log2

    def gather(batches):
        bits = np.zeros(1 << (log2 - 6), np.uint64)
        for batch in batches:
            at = _slot(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), shift)
            np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(bits[used].view(np.int64))], names=["word", "bits"])

    words = ids.mapInArrow(gather, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << (log2 - 6), np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return bits, shift


def repeated_passages(docs: DataFrame, least: int = FEW) -> DataFrame:
    """The columns of ``repeated_paragraphs`` and kept_start, one row per line or span to remove; a span names the line it starts in."""
    gone, spans = _passages(docs, least)
    return gone.drop("text_id").unionByName(spans.drop("text_id"))


def _passages(docs: DataFrame, least: int):
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    docs = docs.withColumn("text_id", F.xxhash64("text"))
    # rows equal in doc_id and text are one text
    gone = stage(_repeated(docs, least).dropDuplicates(["doc_id", "text_id", "start"]), "repeated")
    place = ["doc_id", "text_id"]
    # only windows that stand in two places are written
    counts = _by_bucket(docs.select("text").mapInArrow(_dealt_windows, "bucket int, rest binary"))
    shared = stage(counts.mapInArrow(_met_windows, "key long"), "shared")
    kinds = "doc_id long, text_id long, word array<int>, start array<int>, end array<int>, line array<int>, hash array<long>"
    cells = docs.select(*place, "text").mapInArrow(_windows(*_sieve(shared)), kinds)
    # what a removed line holds is neither kept nor removed once more
    out = gone.groupBy(*place).agg(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))).alias("out"))
    cells = cells.join(out, place, "left").dropDuplicates(place)
    met = cells.mapInArrow(_outside, "doc_id long, text_id long, word long, start long, end long, line long, hash long, key long")
    met = stage(met.join(shared.select(again("key")).hint("shuffle_hash"), "key").drop("key"), "met")
    first = met.groupBy("hash").agg(F.min(F.struct(*place, "word", "start", "end", "line")).alias("kept"), F.count("*").alias("c")).where("c > 1")
    hits = met.join(first.select(again("hash"), "kept"), "hash").where("not (doc_id = kept.doc_id and text_id = kept.text_id and word = kept.word)")
    # in the text of the first one, what follows it only
    own = "doc_id = kept.doc_id and text_id = kept.text_id and word < kept.word + " + str(RUN)
    order = Window.partitionBy(*place).orderBy("word")
    parted = F.coalesce(F.col("word") > F.lag("word").over(order) + RUN, F.lit(True)).cast("int")
    hits = hits.where(f"not ({own})").withColumn("parted", parted)
    # a text has each word once, so the first window of a span is the least
    head = F.last(F.when(F.col("parted") == 1, F.col("hash")), True).over(order)
    hits = stage(hits.select("*", F.sum("parted").over(order).alias("span"), head.alias("head")).drop("parted"), "hits")
    # spans that share windows are one component; a hash is a node
    named = components(hits.select(F.col("hash").alias("a"), F.col("head").alias("b")).distinct(), "spans")
    low = F.struct("word", "line", "kept")
    spans = hits.groupBy(*place, "span").agg(F.min("head").alias("head"), F.min(low).alias("low"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("word").alias("top"))
    spans = spans.join(named.withColumnRenamed("id", "head"), "head", "left")
    spans = spans.select(
        *place,
        F.col("low.line").cast("int").alias("paragraph"),
        "start",
        (F.col("end") - F.col("start")).alias("length"),
        (F.col("top") + RUN - F.col("low.word")).alias("n_words"),
        F.coalesce("component", "head").alias("cluster_id"),
        F.col("low.kept.doc_id").alias("kept_doc_id"),
        F.col("low.kept.line").cast("int").alias("kept_paragraph"),
        F.col("low.kept.start").alias("kept_start"),
    )
    return gone, spans


def cut_out(text: str, spans) -> str:
    """A text without some spans (start, end); lines of which nothing is left go whole."""
    out, at, spans, k = [], 0, sorted(spans), 0
    for line in text.split("\n"):
        end, left, pos = at + len(line), [], at
        while k and spans[k - 1][1] > at:
            k -= 1
        j = k
        while j < len(spans) and spans[j][0] < end:
            lo, hi = spans[j]
            left.append(text[pos : max(pos, min(lo, end))])
            pos = max(pos, min(hi, end))
            j += 1
        k = j
        left.append(text[pos:end])
        rest = "".join(left)
        if pos == at or rest.strip():
            out.append(rest)
        at = end + 1
    return "\n".join(out)


def _free(name: str, docs: DataFrame) -> str:
    """The name, or one like it that no column has."""
    taken = {x.lower() for x in docs.columns}
    while name in taken:
        name += "_"
    return name


def without_repeats(docs: DataFrame, least: int = FEW) -> DataFrame:
    """docs (doc_id, text) with the repeated lines and passages taken out of the texts."""
    gone, spans = (x.select("doc_id", "text_id", "start", (F.col("start") + F.col("length")).alias("end")) for x in _passages(docs, least))
    names = [_free(x, docs) for x in ("gone_id", "gone_text", "gone")]
    gone = gone.union(spans).groupBy(F.col("doc_id").alias(names[0]), F.col("text_id").alias(names[1])).agg(F.collect_set(F.struct("start", "end")).alias(names[2]))
    joined = docs.join(gone, (F.col("doc_id").cast("long") == F.col(names[0])) & (F.xxhash64(F.col("text").cast("string")) == F.col(names[1])), "left").drop(*names[:2])
    at, cuts = docs.columns.index("text"), len(docs.columns)

    def run(batches):
        for batch in batches:
            for lo in range(0, max(1, batch.num_rows), 500):
                part = batch.slice(lo, 500)
                texts, spans = part.column(at).to_pylist(), part.column(cuts).to_pylist()
                columns = list(part.columns)[:cuts]
                columns[at] = pa.array([t if s is None else cut_out(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans)], pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names[:cuts])

    return joined.mapInArrow(run, docs.schema)
