"""Operator 4: toxic spans and document scores from a linear-chain conditional random field.

Labels say which documents are toxic, not which words.  Labelled words are made in two steps: terms (words and
word beginnings) whose contexts (neighbouring words) are found in toxic documents far more often than chance
allows, by a likelihood ratio over distinct contexts, so that copies count once; then every word of a toxic
training document that is or begins with such a term is labelled toxic.  The field is fitted on stretches around those words and
on stretches of clean documents, and learns from affixes, n-grams and neighbours what it was not told.
Forward-backward gives each word's probability; a logistic curve over a document's largest one, their sum and the
length gives its score, and runs of words above ``SPAN`` are the offending spans: (start, end, probability), in code points, with
the largest probability of the run.

The fit uses a bounded sample: about ``toxic`` toxic and ``clean`` other labelled documents, by a hash of the id.

Defined results: null, empty and letterless texts score as a document without toxic words; without labels of both
kinds every score is 0; repeated rows score alike; of contradicting labels of one doc_id, toxic counts; other
columns stay out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from leafgrid.llm.crf import Tagger, chunks, fit, hash_text, places_of, words_of
from leafgrid.llm.language import ROWS, Shared, sample, tagger, windows_of
from leafgrid.session import stage

SPAN = 0.5
LEAST = 0.7
TERMS = 20_000
PREFIXES = (4, 5, 6)


def _terms(frames):
    """(term, toxic, context): each word of a document and its beginnings, with the neighbours at its first place."""
    for frame in frames:
        for lo in range(0, len(frame), 200):
            out = []
            part = frame.iloc[lo : lo + 200]
            for toxic, text in zip(part["toxic"], part["text"]):
                words, seen = words_of(text), set()
                around = ["", *words, ""]
                for i, w in enumerate(words):
                    if w not in seen:
                        seen.add(w)
                        context = hash_text(f"{around[i]} {w} {around[i + 2]}") >> 1
                        out += [(term, toxic, context) for term in (w, *(w[:k] + "*" for k in PREFIXES if len(w) >= k))]
            yield pd.DataFrame(out, columns=["term", "toxic", "context"])


def toxic_terms(rows: DataFrame, bound: float = 40.0) -> dict[str, float]:
    """Terms of rows (toxic, text) that mark toxic documents, with the share of their contexts that are toxic."""
    found = rows.mapInPandas(_terms, "term string, toxic int, context long").groupBy("term", "context").agg(F.max("toxic").alias("toxic"))
    found = found.groupBy("term").agg(F.sum("toxic").alias("hit"), F.sum(1 - F.col("toxic")).alias("miss")).where("hit >= 3")
    n, y = rows.agg(F.count("*"), F.sum("toxic")).first()
    if not y or n == y:
        return {}
    base = y / n
    p = F.col("hit") / (F.col("hit") + F.col("miss"))
    ratio = 2 * (F.col("hit") * F.log(p / base) + F.when(F.col("miss") > 0, F.col("miss") * F.log((1 - p) / (1 - base))).otherwise(0))
    terms = found.withColumns({"p": p, "ratio": ratio}).where((p > 0.5) & (F.col("ratio") >= bound))
    return {r["term"]: r["p"] for r in terms.orderBy(F.desc("ratio"), "term").limit(TERMS).collect()}


def marked(words: list[str], terms) -> list[int]:
    return [int(w in terms or any(w[:k] + "*" in terms for k in PREFIXES if len(w) >= k)) for w in words]


def train(docs: DataFrame, labels: DataFrame, toxic: int = 1000, clean: int = 6000, span: int = 12, windows: int = 3) -> dict:
    """A model from docs (doc_id, text) and labels (doc_id, toxic), all of which may be learned from."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    yes = sample(known.where("toxic = 1"), "toxic", toxic)
    no = sample(known.where("toxic = 0"), "toxic", clean)
    picked = stage(yes.select("doc_id", "toxic").union(no.select("doc_id", "toxic")), "picked")
    # the sample's size is its parameters'; that is checked, and only such a small side is broadcast, so texts are not shuffled
    if picked.count() <= 4 * (toxic + clean):
        picked = F.broadcast(picked)
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(picked, "doc_id").select("toxic", "text")
    rows = stage(rows.withColumn("toxic", F.col("toxic").cast("int")), "labelled")
    terms = toxic_terms(rows)

    def cut(frames):
        for frame in frames:
            out = []
            for y, text in zip(frame["toxic"], frame["text"]):
                words = words_of(text)
                marks = marked(words, terms) if words else []
                at = [i for i, x in enumerate(marks) if x][: 4 * windows]
                for i in at if y else at[:windows]:
                    lo = max(0, i - span // 2)
                    out.append((" ".join(words[lo : i + span]), "".join(str(x * y) for x in marks[lo : i + span])))
                if not y:
                    out += [(" ".join(w), "0" * len(w)) for w in windows_of(words, windows, span) if w]
            yield pd.DataFrame(out, columns=["words", "marks"])

    found = rows.mapInPandas(cut, "words string, marks string").toPandas().sort_values(["words", "marks"], kind="stable")
    model = fit([w.split() for w in found["words"]], [[int(x) for x in m] for m in found["marks"]], 2)
    model["curve"] = None
    if not terms:
        return model
    seen = facts(rows, model).select("toxic", "_most", "_total", "_n").toPandas()
    model["curve"] = _curve(seen[["_most", "_total", "_n"]].to_numpy(float), seen["toxic"].to_numpy(float))
    return model


def _inputs(most, total, n):
    most = np.clip(most, 1e-9, 1 - 1e-9)
    return np.stack([np.clip(np.log(most / (1 - most)), -12, 12) / 4, np.log1p(total), np.log1p(n) / 4, np.ones(len(most))], 1)


def _curve(x, y):
    """Logistic regression by Newton steps with a small ridge."""
    if len(set(y)) < 2:
        return np.array([0, 0, 0, -20.0 if not y.any() else 20.0])
    x, w = _inputs(*x.T), np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(4)
        w += np.linalg.solve(h, x.T @ (y - p) - 0.01 * w)
    return w


SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("probability", DoubleType())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))


def spans_in(text: str, p: np.ndarray) -> list[dict]:
    """The runs of words whose probability is above SPAN."""
    high = p > SPAN
    if not high.any():
        return []
    places, edge = places_of(text), np.flatnonzero(np.diff(high.astype(np.int8), prepend=0, append=0))
    return [{"start": places[a][0], "end": places[b - 1][1], "probability": float(p[a:b].max())} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def _facts(shared):
    """The columns before the last, which is the text, with its largest toxic probability, their sum, its number of words and its spans."""

    def run(batches):
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            texts, names = batch.column(batch.num_columns - 1).to_pylist(), batch.schema.names[:-1]
            most, total, n = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            spans: list[list] = [[] for _ in texts]
            for group in chunks(texts):
                for (i, words), g in zip(group, tagger(shared).tag([w for _, w in group])):
                    if len(words):
                        most[i], total[i], n[i] = g[:, 1].max(), g[:, 1].sum(), len(words)
                        spans[i] = spans_in(texts[i], g[:, 1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(most), pa.array(total), pa.array(n), pa.array(spans, _SPANS)], names=[*names, "_most", "_total", "_n", "_spans"])

    return run


def facts(rows: DataFrame, model: dict) -> DataFrame:
    """All columns of rows (text) with _most, _total, _n and _spans of their texts."""
    kinds = [*rows.schema.fields, StructField("_most", DoubleType()), StructField("_total", DoubleType()), StructField("_n", LongType()), StructField("_spans", SPANS)]
    return rows.select("*", F.col("text").cast("string").alias("_text")).mapInArrow(_facts(Shared(rows.sparkSession, model)), StructType(kinds))


def score(rows: DataFrame, model: dict) -> DataFrame:
    """All columns of rows (text), ``_score`` and ``_spans``."""
    if model["curve"] is None:
        return rows.withColumns({"_score": F.lit(0.0), "_spans": F.array().cast(SPANS)})
    a, b, c, d = map(float, model["curve"])
    most = F.least(F.greatest(F.col("_most"), F.lit(1e-9)), F.lit(1 - 1e-9))
    odds = F.least(F.greatest(F.log(most / (1 - most)), F.lit(-12)), F.lit(12)) / 4
    z = odds * a + F.log1p("_total") * b + F.log1p("_n") / 4 * c + d
    return facts(rows, model).withColumn("_score", 1 / (1 + F.exp(-z))).drop("_most", "_total", "_n")


def fold() -> Column:
    """Whether a document is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) for every row of docs (doc_id, text); learns outside the held-out fold."""
    model = train(docs, labels.where(~fold()))
    found = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return found.select("doc_id", fold().alias("held_out"), F.col("_score").alias("score"), F.when(F.col("_score") >= LEAST, 1).otherwise(0).alias("predicted"), F.col("_spans").alias("spans"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, all columns kept."""
    return score(docs, train(docs, labels.where(~fold()))).where(F.col("_score") < LEAST).drop("_score", "_spans")


def toxic_span_rows(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, start, end, probability), one row per offending span of docs (doc_id, text)."""
    found = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return found.select("doc_id", F.inline("_spans"))


def toxic_spans(text: str, model: dict) -> list[tuple[int, int]]:
    """(start, end) offsets of the runs of words whose probability is above SPAN."""
    tags = Tagger(model).tag([words_of(text)])[0]
    return [(x["start"], x["end"]) for x in spans_in(text or "", tags[:, 1])] if len(tags) else []
