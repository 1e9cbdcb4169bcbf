"""The pipeline, stage by stage, against plain computations on a small table."""

import zlib

import corpus_pipeline as pipeline
import __spark_entry__ as entry
from leafgrid.llm.private import rewrite
from leafgrid.llm.queries import QUERIES

from .test_sets import grams, joined

SMALL = "/root/testdata/sf0.001"


def test_every_stage_does_its_work(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept, seen = {0: docs}, []
    for k, (name, step) in enumerate(pipeline.STAGES):
        step(spark, kept[k], SMALL).write.parquet(str(tmp_path / str(k)))
        kept[k + 1] = spark.read.parquet(str(tmp_path / str(k)))
        seen.append([r.asDict() for r in kept[k + 1].collect()])
        if k < len(pipeline.STAGES) - 1:
            assert sorted(kept[k + 1].columns) == sorted(docs.columns), name
    clean, single, private, mixed, packed = seen
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 0.8 * len(texts) <= len(clean) <= len(texts) and all(texts[r["doc_id"]] == r["text"] for r in clean)
    groups = joined({r["doc_id"]: grams(r["text"]) for r in clean})
    assert sorted(r["doc_id"] for r in single) == sorted(set(groups.values()))
    assert {r["doc_id"]: r["text"] for r in private} == {r["doc_id"]: rewrite(r["text"], b"leafgrid")[0] for r in single}
    before = {r["doc_id"]: r["text"] for r in private}
    copies: dict = {}
    for r in mixed:
        assert before[r["doc_id"]] == r["text"] or before[r["doc_id"]].split()[: len(r["text"].split())] == r["text"].split()
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert max(copies.values()) <= 2
    words = sum(len(t.split()) for t in before.values())
    sources = len({r["source"] for r in private})
    assert abs(sum(len(r["text"].split()) for r in mixed) - 1.5 * words) <= sources
    assert len({(r["doc_id"], r["copy"]) for r in packed}) == len(mixed)
    total = sum(r["length"] for r in packed)
    assert len({r["sequence_id"] for r in packed}) <= -(-total // 2048) + 1
    assert all(0 <= r["ids_crc32"] < 2**32 for r in packed) and zlib.crc32(b"") == 0


def test_everything_is_registered():
    names = entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
