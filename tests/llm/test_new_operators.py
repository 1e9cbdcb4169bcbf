"""Manifest, exact duplicates and centroid clustering against brute force."""

import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafgrid.llm import manifest as M
from leafgrid.llm.centroids import VantageTree, cluster, exact, settled
from leafgrid.llm.manifest import proofs
from leafgrid.llm.owners import Trie, owners


def sha(text):
    return sha256(text.encode()).hexdigest()


# -- manifest ------------------------------------------------------------------------


def plain_leaf(row, lower=False):
    out = ""
    for name, v in zip(("doc_id", "source", "lang", "n_chars", "text"), row):
        if v is None:
            out += "-"
            continue
        v = str(v)
        if lower and name == "text":
            v = re.sub("[A-Z]", lambda m: m.group().lower(), v)
        out += f"{len(v.encode())}:{v}"
    return sha(out)


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def plain_proofs(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    langs = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for lang in langs:
        trees[lang].sort(key=lambda x: x[:3])
        built[lang] = plain_tree([x[2] for x in trees[lang]])
    top = plain_tree([built[lang][-1][0] for lang in langs])
    out = []
    for t, lang in enumerate(langs):
        for i, (_, _, leaf, row) in enumerate(trees[lang]):
            mine = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                mine = plain_leaf(row, lower=True)
            proof = ""
            for levels, at in ((built[lang], i), (top, t)):
                for level in levels[:-1]:
                    first = at // 8 * 8
                    left, right = "".join(level[first:at]), "".join(level[at + 1 : first + 8])
                    proof += left + right
                    mine = sha(left + mine + right)
                    at //= 8
            out.append((row[0], leaf, built[lang][-1][0], top[-1][0], sha(proof), mine, mine == top[-1][0]))
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def some_docs(n, langs):
    r = random.Random(n)
    words = ["Alpha", "beta", "GAMMA", "é", "日本", "", "x\ny"]
    for i in range(n):
        text = None if r.random() < 0.05 else " ".join(r.choices(words, k=r.randrange(6)))
        yield (i * 7 % n, r.choice(["a", "b", None]), r.choice(langs), r.choice([None, i]), text)


@pytest.mark.parametrize("levels", [1, 2, 4])
@pytest.mark.parametrize("n", [1, 9, 700])
def test_proofs(spark, levels, n):
    rows = list(some_docs(n, ["de", None, "é", "Z", "en", "en"])) + [(None, "s", "en", 3, "no Id"), (0, "s", "en", 1, "id again"), (0, "s", "en", 1, "id again")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"tree": F.lit(1), "index": F.lit(2), "leaf": F.lit("x"), "_part": F.lit(3)})
    found = proofs(df.repartition(3), levels)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[4])
    assert sorted(map(tuple, found.collect()), key=key) == sorted(plain_proofs(rows), key=key)


def test_many_trees_and_no_rows(spark):
    rows = [(i, "s", f"l{i}", 1, "Text") for i in range(100)]
    found = sorted(map(tuple, proofs(spark.createDataFrame(rows, DOCS)).collect()))
    assert found == sorted(plain_proofs(rows))
    assert proofs(spark.createDataFrame([], DOCS)).count() == 0


def test_a_long_text_is_one_leaf(spark):
    rows = [(1, "s", "en", 5, "Aé" * 1_000_000), (2, "s", "en", 5, "b")]
    assert sorted(map(tuple, proofs(spark.createDataFrame(rows, DOCS)).collect())) == sorted(plain_proofs(rows))


def test_slots_are_a_layout():
    for levels in range(1, 6):
        places = np.concatenate([M.slots(levels, d, np.arange(8**d)) for d in range(levels)])
        assert sorted(places) == list(range(M.full(levels)))
    # cut at half height: the upper two of four levels come first, then each lower subtree as a whole
    assert sorted(M.slots(4, 1, np.arange(8))) == list(range(1, 9))
    assert M.slots(4, 2, np.arange(64)).tolist() == [9 + 9 * i for i in range(64)]
    assert M.slots(4, 3, np.arange(8)).tolist() == list(range(10, 18))


# -- exact duplicates ----------------------------------------------------------------


def plain_owners(rows):
    groups = {}
    for at, (doc, text) in enumerate(rows):
        text = text or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((-len(text), doc is None, doc or 0, at, doc))
    out = []
    for text, members in groups.items():
        best = min(members)
        out += [(m[4], best[4], len(members), m is best, sha(text)) for m in members]
    return out


def order(rows):
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[4], x[3], str(x)))


@pytest.mark.parametrize("held", [1, 3000, 1 << 20])
def test_owners(spark, held):
    r = random.Random(5)
    texts = [None, "", " \n\t", "a b", "ab", "a\vb ", "a b", "ab c", "日本", "日 本", "x" * 100_000, "x" * 99_999 + " x", "x" * 99_999 + "y"]
    rows = [(i, r.choice(texts)) for i in range(400)] + [(1000 + i, f"single {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"mark": F.lit(1), "at": F.lit(2), "keep_id": F.lit("x"), "first": F.lit(3)})
    found = owners(df.repartition(5), held)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert order(map(tuple, found.collect())) == order(plain_owners(rows))


def test_rows_that_repeat_and_null_ids(spark):
    rows = [(None, "a b"), (7, "a b"), (7, "a b"), (7, "a b"), (9, "ab"), (None, "alone"), (None, "alone"), (3, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert order(map(tuple, owners(df).collect())) == order(plain_owners(rows))
    assert owners(df.limit(0)).count() == 0


def test_trie_against_a_dictionary():
    r = random.Random(1)
    trie, known = Trie(), {}
    for _ in range(5000):
        key = bytes(r.choices(b"ab", k=r.randrange(1, 12)))
        end, was = trie.end(key, lambda: [0])
        assert was == (key in known)
        end[0] += 1
        known[key] = known.get(key, 0) + 1
    assert {k: e[0] for k, e in trie.take(trie.heaviest())} | {k: e[0] for k, e in trie.take_all()} == known
    assert trie.size() == 0 and not trie.below


def test_equal_partitions_of_different_texts(spark, monkeypatch):
    """Texts whose length and content hash agree are told apart by their bytes."""
    from leafgrid.llm import owners as O

    rows = [b"abc", b"abd", b"abc", b"xyz", b"abd", b"abd"]
    monkeypatch.setattr(O, "_head", lambda digest, length: bytes(8) + length.to_bytes(8, "big"))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(6)), pa.array(range(6)), pa.array([3] * 6), pa.array(rows, pa.binary())], names=["at", "doc_id", "n", "body"]
    )
    read = [r for b in O._read(10)([batch]) for r in b.to_pylist()]
    ends = [r for r in read if r["ends"]]
    again = pa.RecordBatch.from_pylist([{k: e[k] for k in ("mark", "doc_id", "at", "hash", "length", "body", "n", "copies")} for e in ends])
    owned = {r["mark"]: (r["keep_id"], r["group_size"]) for b in O._own([again]) for r in b.to_pylist()}
    members = {r["doc_id"]: owned[r["mark"]] for r in read if not r["ends"]}
    assert members == {0: (0, 2), 2: (0, 2), 1: (1, 3), 4: (1, 3), 5: (1, 3), 3: (3, 1)}


# -- centroids -----------------------------------------------------------------------


def plain_clusters(rows, k=8, rounds=10, dim=64, scale=1024):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v):
            kept.append((vec_id, [int(np.floor(scale * float(x))) for x in v]))
    points = [v for _, v in sorted(kept, key=lambda r: (sha(f"3:{'' if r[0] is None else r[0]}"), r[1]))[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, p)) for p in points]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        groups = {}
        for (_, v), (c, _) in zip(kept, assign()):
            groups.setdefault(c, []).append(v)
        points = [[sum(col) // len(groups[c]) for col in zip(*groups[c])] if c in groups else p for c, p in enumerate(points)]
    last = assign()
    inertia = {c: sum(d for x, d in last if x == c) for c, _ in last}
    return [(i, c, d, inertia[c], sum(inertia.values()), sha(",".join(map(str, points[c])))) for (i, _), (c, d) in zip(kept, last)]


def by_text(rows):
    return sorted(map(tuple, rows), key=str)


def test_clusters(spark):
    r = np.random.default_rng(4)
    rows = [(int(i), r.normal(r.integers(-2, 3), 0.6, 64).tolist()) for i in range(600)]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1])]
    # ties: the same few points many times
    rows += [(1000 + i, [float(i % 3)] * 64) for i in range(90)]
    bad = [(2000, None), (2001, [0.0] * 63), (2002, [0.0] * 63 + [None]), (2003, [0.0] * 63 + [float("nan")]), (2004, [float("inf")] + [0.0] * 63), (2005, [1e30] * 64)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "cluster": F.lit(2)})
    found = cluster(df.repartition(6))
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert by_text(found.collect()) == by_text(plain_clusters(rows))


def test_few_and_no_vectors(spark):
    kinds = "vec_id long, embedding array<float>"
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-1.25] * 64)]
    assert by_text(cluster(spark.createDataFrame(rows, kinds)).collect()) == by_text(plain_clusters(rows))
    none = cluster(spark.createDataFrame([(1, [0.5])], kinds))
    assert none.count() == 0 and none.columns[:3] == ["vec_id", "cluster", "distance"]


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**20 + i % 5)] * 63 + [0.25 * i]) for i in range(40)]
    found = cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert by_text(found.collect()) == by_text(plain_clusters(rows))
    wide = spark.createDataFrame([(1, [1e12] * 64), (2, [-1e12] * 64)], "vec_id long, embedding array<double>")
    assert {tuple(r)[:3] for r in cluster(wide, k=1, rounds=0).collect()} >= {(1, 0, 0)} or {r["distance"] for r in cluster(wide, k=1, rounds=0).collect()} == {0, None}


@pytest.mark.parametrize("k", [1, 2, 3, 50, 300])
def test_search_of_the_tree(k):
    r = np.random.default_rng(k)
    points = r.integers(-6, 7, (k, 3))
    x = r.integers(-9, 10, (2000, 3))
    which, d2 = VantageTree(points).nearest(x)
    every = np.stack([exact(x, p) for p in points], 1)
    assert (d2 == every.min(1)).all() and (which == every.argmin(1)).all()
    far = (x.astype(object) + 2**40) * 2**20
    which, d2 = VantageTree(settled((points.astype(object) + 2**40) * 2**20)).nearest(settled(far))
    assert (which == every.argmin(1)).all() and (d2 == every.min(1).astype(object) * 2**40).all()
