"""Search of many terms, and cells with spans, against plain Python."""

import random

from pyspark.sql import functions as F

from leafgrid.functions import html as H
from leafgrid.functions import search as S


def _found(spark, texts, terms):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    asked = spark.createDataFrame([(t,) for t in terms], "needle string")
    return sorted(map(tuple, S.containing(rows, ["id"], "text", asked).collect()))


def test_terms_of_all_lengths(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab-1é😀") for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["", None, "?ab"]
    cut = lambda t, n: t[(at := rng.randint(0, max(len(t) - n, 0))) : at + n]
    few = ["", "?ab", "a", "-1", "zz", *{cut(t, n) for t in texts[:4] for n in (1, 2, 5, 8, 9, 12, 13, 20, 33)}]
    many = [*few, *{cut(t, rng.randint(1, 40)) for t in texts[:40] for _ in range(40)}]
    assert len(set(many)) > S.FEW > len(few)
    for terms in (few, many):
        want = sorted((i, t) for i, text in enumerate(texts) if text is not None for t in set(terms) if t in text)
        assert _found(spark, texts, terms) == want


def test_a_number_meets_only_the_texts_that_hold_it(spark):
    terms = spark.createDataFrame([("-1234",), ("-1234567",), ("-123456789",)], "needle string")
    assert [r.size for r in terms.select(S._size(F.col("needle")).alias("size")).collect()] == [5, 8, 8]


def _placed(rows):
    """Cells (text, down, across) on a board, row after row, as ``_place_spans`` says; gaps close up."""
    lines, board = [], {}
    for i, row in enumerate(rows):
        at = 0
        for text, down, across in row:
            for _ in range(across):
                while (i, at) in board:
                    at += 1
                for d in range(min(down, len(rows) - i)):
                    board[i + d, at] = text
        lines.append([board[k] for k in sorted(k for k in board if k[0] == i)])
    return lines


def test_spans_that_meet(spark):
    rng = random.Random(5)
    cases = []
    for _ in range(150):
        rows = [[(f"{i}.{j}", rng.choice([1, 1, 1, 2, 3, 9]), rng.choice([1, 1, 2, 3])) for j in range(rng.randint(1, 4))] for i in range(rng.choice([1, 3, 6, 140]))]
        body = "".join("<tr>" + "".join(f'<td rowspan="{d}" colspan="{a}">{t}</td>' for t, d, a in r) + "</tr>" for r in rows)
        cases.append((f"<table>{body}</table>", rows))
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "id long, html string")
    got = {r.id: r.body for r in df.select("id", H.table_grid(F.col("html")).body.alias("body")).collect()}
    for i, (_, rows) in enumerate(cases):
        want = _placed(rows)
        width = max(map(len, want))
        padded = [line + [""] * (width - len(line)) for line in want]
        assert got[i] == ([r for r in padded if r != [""]] if width == 1 else padded)


def test_a_bound_value_is_not_copied(spark):
    plan = spark.range(1).select(H.let(F.array("id"), lambda a: F.size(a)))._jdf.queryExecution().analyzed().toString()
    assert "transform(" not in plan
