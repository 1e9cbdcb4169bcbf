"""Completeness of documents while their chunks arrive."""

import datetime

import pytest
from pyspark.sql import functions as F

from leafgrid.operators import paging
from leafgrid.streaming import completeness as C

START = datetime.datetime(2024, 1, 1)
KINDS = "doc_id long, chunk_no int, planned boolean, at timestamp"


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


@pytest.fixture
def run(spark, tmp_path):
    """Reports of batches of events, one micro-batch each."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", C.STORE)

    def go(*batches):
        folder = str(tmp_path / "events")
        for i, rows in enumerate(batches):
            df = spark.createDataFrame([(d, c, p, at(m)) for d, c, p, m in rows], KINDS)
            df.coalesce(1).write.mode("append").json(folder)
            stream = spark.readStream.schema(KINDS).json(folder)
            out = C.completeness(stream, "60 minutes", "10 minutes").writeStream.format("parquet").outputMode("append")
            out = out.option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out"))
            out.trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(C.REPORT).parquet(str(tmp_path / "out"))

    yield go
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def plan(doc, n, minute):
    return [(doc, c, True, minute) for c in range(n)]


def test_reports(spark, run):
    batches = [
        # 1 is complete at once, 2 lacks a chunk, 3 gets one twice and one nobody planned, 4 gets nothing, 9 was never planned
        [*plan(1, 2, 0), *plan(2, 3, 0), *plan(3, 1, 1), *plan(4, 2, 2), (1, 0, False, 3), (1, 1, False, 3), (2, 0, False, 4), (9, 0, False, 4)],
        [(3, 0, False, 20), (3, 0, False, 21), (3, 7, False, 22), (2, 2, False, 30), (5, 0, False, 30)],
        # the plan of 5 comes after its response; 1 gets a chunk again after it was complete
        [*plan(5, 1, 35), (1, 1, False, 40)],
        # time goes on: 1 to 4 and 9 are over
        [*plan(6, 1, 80)],
        # too late for 2, which is closed
        [(2, 1, False, 5), (6, 0, False, 81)],
        [*plan(7, 1, 500)],
    ]
    found = run(*batches)
    rows = sorted((r.doc_id, r.status, r.planned, r.received, r.missing, r.repeated, r.unplanned, r.missing_chunks, r.failed) for r in found.collect())
    assert rows == [
        (1, "closed", 2, 2, 0, 1, 0, [], False),
        (1, "complete", 2, 2, 0, 0, 0, [], False),
        (2, "closed", 3, 2, 1, 0, 0, [1], True),
        (3, "closed", 1, 1, 0, 1, 1, [], True),
        (3, "complete", 1, 1, 0, 1, 1, [], True),
        (4, "closed", 2, 0, 2, 0, 0, [0, 1], True),
        (5, "closed", 1, 1, 0, 0, 0, [], False),
        (5, "complete", 1, 1, 0, 0, 0, [], False),
        (6, "closed", 1, 1, 0, 0, 0, [], False),
        (6, "complete", 1, 1, 0, 0, 0, [], False),
    ]
    # what was closed agrees with the batch query over the events that were in time
    events = [r for b in batches for r in b if (r[0], r[3]) != (2, 5) and r[0] != 7]
    plans = spark.createDataFrame([(d, c) for d, c, p, _ in events if p], "doc_id long, chunk_no int")
    received = spark.createDataFrame([(d, c) for d, c, p, _ in events if not p], "doc_id long, chunk_no int")
    want = paging.missing_chunks(plans, received)
    assert sorted(C.closed(found).collect()) == sorted(want.select(C.closed(found).columns).collect())


def test_events_of_both_sides(spark):
    p = spark.createDataFrame([(1, 0, 4, at(0))], "doc_id int, chunk_no int, start int, at timestamp")
    r = spark.createDataFrame([(1, 0, "x", at(1)), (None, 0, "x", at(1))], "doc_id long, chunk_no long, model string, at timestamp")
    assert sorted(map(tuple, C.events(p, r).where("doc_id = 1").select("doc_id", "chunk_no", "planned").collect())) == [(1, 0, False), (1, 0, True)]
    assert C.events(p, r).filter(F.col("doc_id").isNull()).count() == 1


def test_documents_of_a_bucket_share_one_state(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", C.STORE)
    events = [r for d in range(60) for r in (*plan(d, 3, d % 5), (d, 0, False, 6), (d, 1, False, 6), *([(d, 2, False, 7)] if d % 3 else []))]
    folder = str(tmp_path / "events")
    spark.createDataFrame([(d, c, p, at(m)) for d, c, p, m in events], KINDS).repartition(7).write.json(folder)
    try:
        reports = C.completeness(spark.readStream.schema(KINDS).json(folder), "60 minutes", "10 minutes", buckets=2)
        out = reports.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out"))
        query = out.option("maxFilesPerTrigger", 1).trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
        spark.createDataFrame([(99, 0, True, at(300))], KINDS).write.mode("append").json(folder)
        out.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    found = spark.read.schema(C.REPORT).parquet(str(tmp_path / "out"))
    assert sorted(r.doc_id for r in found.where("status = 'complete'").collect()) == [d for d in range(60) if d % 3]
    over = {r.doc_id: r for r in found.where("status = 'closed'").collect()}
    assert sorted(over) == list(range(60))
    assert all(r.missing_chunks == ([] if d % 3 else [2]) and r.received == (3 if d % 3 else 2) and r.repeated == 0 for d, r in over.items())
