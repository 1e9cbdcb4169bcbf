"""Similarity join and repeated paragraphs against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafgrid.llm import common, ngram_join, paragraphs
from leafgrid.llm.common import by_bucket, components, dealt, shared_key, shingles, signature, window_hashes, word_hashes
from leafgrid.llm.ngram_join import ngram_jaccard, without_copies
from leafgrid.llm.paragraphs import cut_out, paragraphs_of, repeated_paragraphs, repeated_passages, windows_of, without_repeats

SCHEMA = "doc_id long, text string, n long, h string, rep long, component string"


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def joined(sets):
    """Smallest reachable id of each id, by plain comparison of all pairs."""
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: find(i) for i in sets}


def corpus(seed, n=160):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 6)))
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(120)]
    texts = [None, "", " \n\t", "one two", "One  TWO", "a b c d e", "a b c d e f", "x" * 5000, "same"]
    for _ in range(n):
        kind = r.random()
        if kind < 0.35:  # copies of one text with more and fewer changes
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 8, 15])):
                w[r.randrange(len(w))] = word()
        elif kind < 0.55:  # a common passage in a text of its own
            w = [word() for _ in range(r.randint(10, 150))] + passage
        elif kind < 0.7:
            w = passage[: r.randint(40, 60)]
        else:
            w = [word() for _ in range(r.randint(1, 80))]
        texts.append(" ".join(w) if r.random() < 0.9 else " ".join(w).upper())
    texts += texts[20:40]
    return list(enumerate(texts))


def test_hashes_follow_the_words():
    a, b = word_hashes("The  quick\tbrown\x0bFOX é "), word_hashes("the quick brown fox é")
    assert len(a) == 5 and (a == b).all()
    assert len(set(word_hashes("a b ab ba aa bb a.").tolist())) == 7
    assert len(word_hashes("a b")) == 1
    long = " ".join(f"w{i % 977}" for i in range(400_000))
    h = word_hashes(long)
    assert len(h) == 400_000 and (h[:977] == h[977:1954]).all()
    assert len(word_hashes("y" * 3_000_000 + " z")) == 2
    assert len(shingles(word_hashes("a b c"))) == 1 and len(shingles(word_hashes(""))) == 0
    assert shingles(word_hashes("a b c"))[0] != shingles(word_hashes("a b c d"))[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_finds_every_link(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "x", i, "c") for i, t in rows], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard(df).collect()}
    sets = {i: grams(t) for i, t in rows}
    want = joined(sets)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    kept = sorted(r["doc_id"] for r in without_copies(df).collect())
    assert kept == sorted(set(want.values()))
    assert without_copies(df).columns == df.columns


def test_join_defines_odd_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ngram_jaccard(empty).count() == 0
    rows = [(5, "a b c d e f g", 0, "", 0, ""), (5, "a b c d e f g", 0, "", 0, ""), (None, "a b c d e f g", 0, "", 0, ""), (7, "A b c d e f g", 0, "", 0, "")]
    got = sorted(map(tuple, ngram_jaccard(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == [(5, 3, 5), (7, 3, 5)]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (139, 500)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 140)}, 500: 100}
    for task in (250_000, 5, 30):  # one task, and rounds over several
        assert {r["id"]: r["component"] for r in components(df, task=task).collect()} == want
    assert components(df.limit(0)).count() == 0


def test_paragraphs_that_repeat(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    para = lambda n: [word() for _ in range(n)]
    shared = [para(60) for _ in range(6)]
    docs = []
    for i in range(60):
        lines = [para(r.randint(50, 90)) for _ in range(3)] + [para(5)]
        if i % 2:
            p = list(r.choice(shared))
            for _ in range(r.choice([0, 0, 1, 5])):
                p[r.randrange(len(p))] = word()
            lines.insert(r.randint(0, 4), p)
        docs.append((i, "\n".join(" ".join(x) for x in lines)))
    docs += [(100, docs[1][1]), (101, None), (102, ""), (103, "\n".join([" ".join(shared[0])] * 3)), (None, docs[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(x["doc_id"], x["paragraph"]): x for x in repeated_paragraphs(df).collect()}
    lines = {(i, k): x for i, t in docs if i is not None for k, x in enumerate((t or "").split("\n")) if len(x.split()) >= 45}
    names = {key: n for n, key in enumerate(sorted(lines))}
    want = joined({names[k]: grams(x) for k, x in lines.items()})
    assert set(got) == {k for k in lines if want[names[k]] != names[k]}
    back = {n: k for k, n in names.items()}
    texts = dict(docs)
    for k, x in got.items():
        assert back[want[names[k]]] == (x["kept_doc_id"], x["kept_paragraph"])
        assert texts[k[0]][x["start"] : x["start"] + x["length"]] == lines[k]
    rest = {x["doc_id"]: x["text"] for x in without_repeats(df).collect()}
    assert rest[103].count("\n") <= 1 and rest[101] is None and rest[102] == ""
    assert rest[0] == docs[0][1]
    assert repeated_paragraphs(df.limit(0)).count() == 0




def test_passages_inside_lines_and_in_short_lines(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijé") for _ in range(r.randint(3, 7)))
    run = lambda n: [word() for _ in range(n)]
    passage, line = run(50), " ".join(run(8))
    wrapped = run(60)
    texts = [
        " ".join(run(50) + passage + run(50)),
        "\n".join([" ".join(run(9)), " ".join(run(50) + passage + run(50)), line]),
        " ".join(run(900) + passage + run(900)),  # no line breaks
        "\n".join([" ".join(run(7)), line, " ".join(run(4))]),
        "\n".join(" ".join(wrapped[i : i + 4]) for i in range(0, 60, 4)),
        "\n".join(" ".join(wrapped[i : i + 3]) for i in range(0, 60, 3)),  # wrapped at another width, no line of five words
        " ".join(run(200)),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [x.asDict() for x in repeated_passages(df).collect()]
    parts = {i: [" ".join(texts[i][x["start"] : x["start"] + x["length"]].split()) for x in got if x["doc_id"] == i] for i in range(7)}
    for i in (1, 2):
        span = next(p for p in parts[i] if p != line)
        assert len(parts[i]) == 1 and span in " ".join(passage) and len(span.split()) >= 50 - 2 * 7
    assert parts[3] == [line] and parts[0] == parts[4] == parts[6] == []
    assert parts[5] == [" ".join(wrapped)]
    assert all(x["kept_doc_id"] < x["doc_id"] for x in got) and len({x["cluster_id"] for x in got if x["doc_id"] in (1, 2)}) == 1
    for x in got:
        assert texts[x["kept_doc_id"]][x["kept_start"] :].split()[0] == texts[x["doc_id"]][x["start"] :].split()[0]
    rest = {x["doc_id"]: x["text"] for x in without_repeats(df).collect()}
    assert rest[0] == texts[0] and rest[5] == "" and line not in rest[3] and rest[3].count("\n") == 1
    # any run of 23 words shares a window, whatever stands around it
    for _ in range(50):
        same = run(23)
        a, b = (set(windows_of([" ".join(run(r.randint(0, 40)) + same + run(r.randint(0, 40)))])[5].tolist()) for _ in range(2))
        assert a & b
    assert cut_out("ab cd\n\nef", [(0, 5), (1, 4)]) == "\nef" and cut_out("ab cd ef\ngh", [(3, 10)]) == "ab \nh"


@pytest.mark.parametrize("seed", range(3))
def test_lines_and_windows_of_many_texts_are_those_of_each(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé나") for _ in range(r.randint(1, 4)))
    line = lambda: r.choice(["", "  "]) + r.choice([" ", "\t"]).join(word() for _ in range(r.choice([0, 1, 4, 5, 6, 9, 16, 22, 40])))
    texts = ["\n".join(line() for _ in range(r.randint(0, 6))) for _ in range(40)] + ["", "\n", "a b a b a b a b a b a b"]
    texts.append(" ".join(["same"] * 60))
    t, lines, n, ends, values, sums = paragraphs_of(texts, 5)
    got = {}
    for k, at in enumerate(lines.tolist()):
        of = int(t.text[at])
        lo, hi = (int(t.place(x[at], at)) for x in (t.begin, t.end))
        got[of, at - int(t.top[of])] = (texts[of][lo:hi], int(n[k]), values[ends[k] : ends[k + 1]].view(np.int64).tolist(), int(sums[k].view(np.int64)))
    want = {}
    for i, text in enumerate(texts):
        for k, x in enumerate(text.split("\n")):
            if len(x.encode().split()) >= 5:
                s = window_hashes(word_hashes(x))
                want[i, k] = (x, len(x.encode().split()), s.view(np.int64).tolist(), signature(s)[0])
    assert got == want
    together = list(zip(*(c.tolist() for c in windows_of(texts))))
    assert together == [(i, *w[1:]) for i, x in enumerate(texts) for w in zip(*(c.tolist() for c in windows_of([x])))]
    for i, word_at, start, end, line_at, value in together:
        words = texts[i][start:end].split()
        assert len(words) == 16 and texts[i].split()[word_at : word_at + 16] == words
        assert texts[i][:start].count("\n") == line_at and int(window_hashes(word_hashes(" ".join(words)), 16).view(np.int64)[0]) == value


def test_passages_of_repeated_rows_and_clashing_names(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    run = lambda n: " ".join(word() for _ in range(n))
    passage, other = run(60), run(70)
    rows = [
        (1, f"{run(80)} {passage} {run(80)}", "x"),
        (2, passage, "y"),
        (2, passage, "z"),  # the row before once more
        (2, f"{run(20)}\n{other}", "y"),
        (3, f"{other}\n{run(9)}", None),
        (None, passage, "n"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string").withColumn("gone_id", F.lit(7)).withColumn("GONE_TEXT", F.col("text"))
    got = [x.asDict() for x in repeated_passages(df).collect()]
    assert len(got) == len({(x["doc_id"], x["start"], x["length"]) for x in got})
    rest = without_repeats(df)
    assert rest.columns == df.columns
    rest = sorted(((x["doc_id"], x["text"], x["gone"]) for x in rest.collect()), key=str)
    left = [x for x in rest if x[0] == 2 and x[2] in ("y", "z")]
    assert len(rest) == 6 and (None, passage, "n") in rest
    assert [t for d, t, _ in rest if d == 1] == [rows[0][1]]  # the first one stays whole
    # both rows lose the same, but for a few words at either end
    assert len({t for _, t, _ in left if t != rows[3][1]}) == 1 and len(left) == 3 and (2, rows[3][1], "y") in rest
    assert all(len(t.split()) <= 14 for _, t, _ in left if t != rows[3][1])
    assert [t for d, t, _ in rest if d == 3] == [rows[4][1].split("\n")[1]]
    assert repeated_passages(df.limit(0)).count() == 0


def test_equal_hashes_meet_in_buckets():
    r = np.random.default_rng(4)
    keys = r.choice(r.integers(0, 2**64, 3000, dtype=np.uint64) | (r.integers(0, 3, 3000).astype(np.uint64) << np.uint64(62)), 20_000)
    keys[::7] = keys[0]  # one that is met very often
    ids = r.integers(0, 400, len(keys))
    order = np.argsort(keys)
    parts = [dealt(np.sort(keys[k::3]), None) for k in range(3)]
    rows = sorted((row for p in parts for row in p.to_pylist()), key=lambda x: x["bucket"])
    assert sum(len(x["rest"]) for x in rows) == 4 * len(keys)  # four bytes a hash
    names = Counter(shared_key(keys).tolist())
    for most in (1 << 20, 3, 500):
        batches = [pa.RecordBatch.from_pylist(rows[k : k + 50]) for k in range(0, len(rows), 50)]
        with pytest.MonkeyPatch.context() as m:
            m.setattr(paragraphs, "by_bucket", lambda x, most=most: by_bucket(x, most))
            got = [x for b in paragraphs._met_windows(batches) for x in b.column(0).to_pylist()]
            assert sorted(got) == sorted(k for k, c in names.items() if c > 1)
            pairs = [pa.RecordBatch.from_pylist([x]) for x in dealt(keys[order], ids[order]).to_pylist()]
            met = {x for b in paragraphs._met_keys(pairs) for x in b.column(0).to_pylist()}
        of = {}
        for k, i in zip(keys.tolist(), ids.tolist()):
            of.setdefault(k, set()).add(i)
        assert met == {i for x in of.values() if len(x) > 1 for i in x}


def test_words_of_long_texts_are_those_of_short_ones(monkeypatch):
    words = ["Ab", "é나", "x" * 40, "\x1c", "ab"] * 30
    text = "  " + " \t\n".join(words) + "\n "
    whole = word_hashes(text).tolist()
    assert whole == [int(word_hashes(w)[0]) for w in words] and word_hashes("Ab") == word_hashes("aB")
    monkeypatch.setattr(common, "_PIECE", 50)
    assert word_hashes(text).tolist() == whole and len(word_hashes(" \n")) == len(word_hashes("")) == 0


def test_crowds_of_near_copies_are_joined_by_centres_first(spark, monkeypatch):
    """No set is near all others: each of 300 sequences has one word changed, and links with those changed nearby."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(87)]
    lines = []
    for i in range(300):
        words = list(base)
        words[r.randrange(8, 79)] = f"x{i}"
        lines.append(" ".join(words))
    lines += [" ".join(f"y{r.randrange(10**6)}" for _ in range(40)) for _ in range(20)]
    found = {i: shingles(word_hashes(x)) for i, x in enumerate(lines)}
    rows = [(i, s.tolist(), ngram_join.parity(s, 8).tolist()) for i, s in found.items()]
    sets = spark.createDataFrame(rows, "doc_id long, h array<long>, q array<long>")
    crowds, parted = [], ngram_join._parted

    def counted(*args):
        got = parted(*args)
        crowds.append(got[2])
        return got

    monkeypatch.setattr(ngram_join, "_parted", counted)
    got = {x["id"]: x["component"] for x in ngram_join.link_sets(sets, 8).collect()}
    want = joined({i: grams(x) for i, x in enumerate(lines)})
    members = Counter(want.values())
    assert got == {i: c for i, c in want.items() if members[c] > 1}
    assert len(crowds) > 1 and 2 * crowds[-1] < crowds[0], crowds
