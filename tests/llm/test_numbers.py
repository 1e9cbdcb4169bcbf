"""Packing, mixing, lattice links and top-k against brute force."""

import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafgrid.llm.lattice import ROOTS, decode, lattice_links
from leafgrid.llm.mixing import mix_sources, mixture, targets
from leafgrid.llm.packing import _best_step, best_fit, least_bins, local_search, pack
from leafgrid.llm.topk import top_k

WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "a).b <|ENDOFTEXT|> <|endoftext|>. it's don't. Σίσυφος ΟΔΟΣ á. »x». 12.5, 3,4 e.g. A-B- (x) ![]! ''s 's. é. É.\x1c.x x\x85y İI ﬁ",
    "",
    None,
    " \n ",
    "word " * 5000,
    "Ünïcödé straße ÄÖİ áb ñ\n" * 300,
]


def test_pieces_and_sequences(spark):
    texts = ODD + [f"some words {i} " * (i * 7 % 400) for i in range(200)]
    docs = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, "again", "x", 1), (None, "no id", "x", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, piece string, copy long")
    rows = pack(df, WORDS).collect()
    t = Tokenizer.from_file(WORDS)
    want = []
    for i, text, *_ in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(i, k, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(want, key=key)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) <= math.ceil(sum(x[3] for x in want) / 2048) + 1
    assert pack(df.limit(0), WORDS).count() == 0


def test_no_packing_has_fewer_bins():
    def fewest(n, size):
        best = len(n)

        def put(k, room):
            nonlocal best
            if len(room) >= best:
                return
            if k == len(n):
                best = len(room)
                return
            for j in range(len(room)):
                if room[j] >= n[k]:
                    put(k + 1, [*room[:j], room[j] - n[k], *room[j + 1 :]])
            put(k + 1, [*room, size - n[k]])

        put(0, [])
        return best

    r = np.random.default_rng(4)
    for _ in range(200):
        n = r.integers(1, r.integers(2, 13), r.integers(1, 8))
        bins = best_fit(n, 12)
        found = local_search(bins, n, 12)
        assert least_bins(n, 12) <= fewest(n.tolist(), 12) <= len(found) <= len(bins)
        assert sorted(i for b in found for i in b) == list(range(len(n))) and all(sum(n[b]) <= 12 for b in found)
    assert least_bins(np.full(800, 690), 2048) == 400 and least_bins(np.array([6, 6, 6, 4, 4, 4, 4]), 10) == 4


def test_local_search_asks_every_bin():
    # only one bin of 702 can help, and of the 41 pieces in it two must come back
    long = [2] * 38 + [400, 401, 120]
    n = np.array([802, *[999] * 700, *long])
    of = np.repeat(np.arange(702), [1] * 701 + [41])
    fill = np.bincount(of, n).astype(np.int64)
    assert _best_step(of, fill, n, 1000, np.arange(len(n)), 0) == (1, 701, 0, (739, 740))
    alike = np.random.default_rng(2).integers(600, 800, 2000)
    bins = best_fit(alike, 2048)
    found = local_search(bins, alike, 2048)
    assert least_bins(alike, 2048) <= len(found) < len(bins) and all(sum(alike[b]) <= 2048 for b in found)
    assert sorted(i for b in found for i in b) == list(range(2000))


def test_local_search_empties_a_bin():
    # four for three, then three fits beside seven
    bins = local_search([[0], [1, 2], [3]], np.array([4, 3, 6, 7]), 10)
    assert sorted(map(sorted, bins)) == [[0, 2], [1, 3]]
    # seven for four and two
    bins = local_search([[0], [1, 2, 3], [4, 5]], np.array([7, 4, 2, 3, 6, 2]), 10)
    assert len(bins) == 3 and sorted(i for b in bins for i in b) == list(range(6))
    r = np.random.default_rng(3)
    n = r.integers(1, 100, 500)
    found = local_search(best_fit(n, 128), n, 128)
    assert sorted(i for b in found for i in b) == list(range(500))
    assert all(n[b].sum() <= 128 for b in found) and len(found) <= -(-n.sum() // 128) + 1


def filled(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    goal, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if w[s] * level > 2 * sizes[s]]
        if not over:
            goal.update({s: w[s] * level for s in free})
            break
        for s in over:
            goal[s] = 2.0 * sizes[s]
            left -= goal[s]
            free.remove(s)
    return goal


def test_mix_meets_its_targets(spark):
    r = np.random.default_rng(4)
    docs = [(i, ["big", "b", "é", "Z", None, "tiny"][min(5, int(r.geometric(0.5)) - 1)], " ".join(["w"] * int(r.integers(0, 60))), "x", 9) for i in range(3000)]
    docs += [(9000, "tiny", None, "x", 9), (9001, "none", "", "x", 9), (None, "b", "a b c", "x", 9), (4, docs[4][1], docs[4][2], "x", 9)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, target string, n_chars long")
    rows = mix_sources(df).collect()
    assert len(rows) == len(docs) and sorted(map(str, rows)) == sorted(map(str, mix_sources(df.repartition(7)).collect()))
    sizes: dict = {}
    for _, s, t, *_ in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    goal = filled(sizes)
    taken: dict = {}
    for x in rows:
        assert x["source_size"] == sizes[x["source"]] and x["target"] == pytest.approx(goal[x["source"]])
        assert 0 <= x["taken"] <= 2 * x["size"]
        taken[x["source"]] = taken.get(x["source"], 0) + x["taken"]
    assert all(taken[s] == math.floor(goal[s] + 1e-9) for s in sizes)
    out = mixture(df.where("doc_id is null or doc_id <> 4"))
    assert out.columns == df.columns
    got = out.groupBy("source").agg(F.sum(F.size(F.regexp_extract_all("text", F.lit("(w|a|b|c)"), F.lit(1)))).alias("n")).collect()
    rest = {s: n for s, n in sizes.items()}
    rest[docs[4][1]] -= 2 * len(docs[4][2].split())
    goal = filled(rest)
    assert {x["source"]: x["n"] for x in got} == {s: math.floor(g + 1e-9) for s, g in goal.items() if math.floor(g + 1e-9)}
    assert mix_sources(df.limit(0)).count() == 0 and mixture(df.limit(0)).count() == 0


def test_targets_without_words(spark):
    got = targets(spark.createDataFrame([("a", 0), (None, 0)], "source string, source_size long")).collect()
    assert [x["target"] for x in got] == [0.0, 0.0]


def test_decoder_finds_the_nearest_point():
    assert len(ROOTS) == 240 and np.allclose((ROOTS**2).sum(1), 2)
    assert (decode(ROOTS + 0.05) == ROOTS).all()
    x = np.random.default_rng(2).standard_normal((2000, 8)) * 2
    home = decode(x)
    best = ((x - home) ** 2).sum(1)
    assert (best <= 1 + 1e-9).all()  # the covering radius
    for root in ROOTS:
        assert (((x - home - root) ** 2).sum(1) >= best - 1e-9).all()


def vectors(seed):
    r = np.random.default_rng(seed)
    x = r.standard_normal((400, 24))
    for i in range(100, 220):
        x[i] = x[i % 7] + r.standard_normal(24) * r.choice([0.05, 0.15, 0.24])
    rows = [(i, [float(np.float32(v)) for v in row], i % 3) for i, row in enumerate(x)]
    rows += [(1000 + i, rows[3][1], 0) for i in range(50)] + [(2000, [2 * v for v in rows[3][1]], 0)]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [0.0] * 23, [None] + [1.0] * 23, [1.0] * 8, [2.0] * 8, [1.0]]
    return rows + [(3000 + i, v, None) for i, v in enumerate(odd)]


def test_lattice_links_match_brute_force(spark):
    rows = vectors(6)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep int")
    got = {x["vec_id"]: x for x in lattice_links(df).collect()}
    ok = {i: np.array(v) for i, v, _ in rows if v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    top, links = {i: i for i, *_ in rows}, {i: 0 for i, *_ in rows}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = list(ok)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = ok[a], ok[b]
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.95:
                links[a], links[b] = links[a] + 1, links[b] + 1
                p, q = sorted((find(a), find(b)))
                top[q] = p
    assert set(got) == set(top)
    found = sum(x["n_links"] for x in got.values())
    assert found >= 0.99 * sum(links.values()) and all(got[i]["n_links"] <= links[i] for i in links)
    assert sum(got[i]["component_id"] == find(i) for i in top) >= 0.99 * len(top)
    assert all(x["kept"] == (x["vec_id"] == x["component_id"]) for x in got.values())
    assert lattice_links(df.limit(0)).count() == 0


def test_top_k_is_exact(spark):
    rows = vectors(7)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = sorted(map(tuple, top_k(df, F.col("vec_id") % 50 == 0).collect()))
    ok = {i: [math.floor(256 * c) for c in v] for i, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    want = []
    for q in ok:
        if q % 50 == 0:
            all_of = [(-sum(a * b for a, b in zip(ok[q], ok[x])), x) for x in ok if x != q and len(ok[x]) == len(ok[q])]
            want += [(q, k + 1, x, -s) for k, (s, x) in enumerate(sorted(all_of)[:5])]
    assert got == sorted(want)
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("dim", [8, 16, 64, 384, 768])
def test_recall_of_the_cells_at_every_dimension(dim):
    from leafgrid.llm.lattice import TABLES, cells

    r = np.random.default_rng(dim)
    x = r.normal(size=(1500, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = r.normal(size=x.shape)
    other -= (other * x).sum(1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = r.uniform(0.95, 0.97, (len(x), 1))
    y = cosine * x + np.sqrt(1 - cosine**2) * other
    met = np.zeros(len(x), bool)
    for t in range(TABLES):
        met |= (cells(x, t)[:, :, None] == cells(y, t)[:, None, :]).any((1, 2))
    assert met.mean() >= 0.95
    # vectors that have nothing to do with each other do not fill a few cells
    assert len(np.unique(cells(x, 0)[:, 0])) > 0.3 * len(x)
