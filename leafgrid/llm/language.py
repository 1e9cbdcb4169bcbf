"""Operator 8: language of texts from a conditional random field over their words.

Training: documents of the training fold with a language, about ``per_language`` of each by a hash of the id; of each,
up to ``windows`` stretches of ``span`` words spread over the whole text, every word labelled with the document's language.
Prediction: forward-backward over all words of every text; a document's language is the one with the largest
sum of marginals, its score that sum's share.  Words of code-switched text keep their own labels:
``stretches`` are the runs (start, end, lang) of words of one language, in code points.

Defined results: null, empty and letterless texts are ``und`` with score 0; without training rows every text
is; repeated rows are predicted alike; ties go to the first language in order; other columns stay out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrid.llm.common import worker_cache
from leafgrid.llm.crf import Tagger, chunks, fit, places_of, words_of


ROWS = 500


def windows_of(words, windows, span):
    """Up to ``windows`` stretches of ``span`` words, spread evenly over the text."""
    if len(words) <= windows * span:
        return [words[i : i + span] for i in range(0, len(words), span)]
    starts = np.linspace(0, len(words) - span, windows).astype(int)
    return [words[i : i + span] for i in starts]


def sample(rows: DataFrame, label: str, per_label: int, key: str = "doc_id", seed: int = 11) -> DataFrame:
    """About ``per_label`` rows of each label, by a hash of the key.

    The labels are the model's, so their counts come to the driver and go back as a filter: no row is shuffled, and of
    rows not taken only label and key are read.
    """
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return rows
    kind = rows.schema[label].dataType
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k).cast(kind), F.lit(per_label / n))])
    at = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) / F.lit(1e6)
    return rows.where(at < F.try_element_at(share, F.col(label)))


def train(docs: DataFrame, per_language: int = 300, windows: int = 5, span: int = 30) -> dict:
    """A model from docs (doc_id, text, lang), all of which may be learned from."""
    rows = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")

    def cut(frames):
        for frame in frames:
            out = [(lang, " ".join(w)) for lang, text in zip(frame["lang"], frame["text"]) for w in windows_of(words_of(text), windows, span) if w]
            yield pd.DataFrame(out, columns=["lang", "words"])

    found = sample(rows, "lang", per_language).mapInPandas(cut, "lang string, words string").toPandas()
    found = found.sort_values(["lang", "words"], kind="stable")
    names = sorted(found["lang"].unique())
    texts = [t.split() for t in found["words"]]
    labels = [[names.index(x)] * len(t) for x, t in zip(found["lang"], texts)]
    return {"languages": names, **fit(texts, labels, max(1, len(names)))}


def tagger(shared):
    """One tagger per worker and model."""
    kept = worker_cache("tagger")
    if kept.get("id") != shared.id:
        kept.update(id=shared.id, of=Tagger(shared.value))
    return kept["of"]


class Shared:
    """A model broadcast to the executors (its size is fixed), with a name the workers know it by."""

    def __init__(self, spark, model):
        self.at, self.id = spark.sparkContext.broadcast(model), f"{spark.sparkContext.applicationId}-{id(model)}-{model['weight'].sum()}"

    @property
    def value(self):
        return self.at.value


def stretches_in(text: str, best: np.ndarray, names: list[str]) -> list[dict]:
    """The runs of words of one language."""
    places, edge = places_of(text), [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(best)]
    return [{"start": places[a][0], "end": places[b - 1][1], "lang": names[int(best[a])]} for a, b in zip(edge, edge[1:])]


_STRETCHES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def predict(docs: DataFrame, model: dict, held_out: Column) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, stretches) for every row of docs (doc_id, text)."""
    shared, names = Shared(docs.sparkSession, model), model["languages"]

    def run(batches):
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            texts = batch.column(2).to_pylist()
            best, score = ["und"] * len(texts), np.zeros(len(texts))
            parts: list[list] = [[] for _ in texts]
            for group in chunks(texts) if names else ():
                for (i, words), g in zip(group, tagger(shared).tag([w for _, w in group])):
                    if len(words):
                        total = g.sum(0)
                        best[i], score[i] = names[int(total.argmax())], min(1.0, float(total.max() / total.sum()))
                        parts[i] = stretches_in(texts[i], g.argmax(1), names)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.string()), pa.array(score), pa.array(parts, _STRETCHES)], names=["doc_id", "held_out", "lang_pred", "score", "stretches"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, stretches array<struct<start: long, end: long, lang: string>>")


def language_id(docs: DataFrame) -> DataFrame:
    """Train on the documents whose crc32(doc_id) mod 4 is not 2, predict all."""
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return predict(docs, train(docs.where(~F.coalesce(out, F.lit(True)))), out)


def language_stretches(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, start, end, lang), one row per run of words of one language in docs (doc_id, text)."""
    return predict(docs, model, F.lit(False)).select("doc_id", F.inline("stretches"))


def word_languages(texts: list[str], model: dict) -> list[list[tuple[str, str]]]:
    """(word, language) of every word of some texts."""
    split = [words_of(t) for t in texts]
    return [[(w, model["languages"][int(j)]) for w, j in zip(ws, g.argmax(1))] for ws, g in zip(split, Tagger(model).tag(split))]
