"""Which documents have all their chunks, while responses keep arriving.

Two kinds of events meet by document: the plan (one event per planned chunk) and the responses.  A document is reported as soon
as its last planned chunk is there, and closed when its time is over, with what was missing, repeated or unplanned by then.
The counts of a closed document are those of ``paging.missing_chunks`` over the same events.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REPORT = "doc_id long, status string, planned long, received long, missing long, repeated long, unplanned long, missing_chunks array<int>, failed boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events(plan: DataFrame, responses: DataFrame) -> DataFrame:
    """``doc_id, chunk_no, planned, at`` of both; ``plan`` and ``responses`` carry the event time ``at``."""
    columns = lambda df, planned: df.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("chunk_no").cast("int").alias("chunk_no"), F.lit(planned).alias("planned"), "at"
    )
    return columns(plan, True).unionByName(columns(responses, False))


STATE = "chunks binary, documents binary"
BUCKETS = 4096
_CHUNKS = np.dtype([("doc_id", "<i8"), ("chunk_no", "<i4"), ("planned", "<i4"), ("received", "<i4")])
_DOCUMENTS = np.dtype([("doc_id", "<i8"), ("until", "<i8")])


def _frame(stored: bytes, kind: np.dtype) -> pd.DataFrame:
    rows = np.frombuffer(stored, kind)
    return pd.DataFrame({name: rows[name] for name in kind.names})


def _stored(frame: pd.DataFrame, kind: np.dtype) -> bytes:
    rows = np.empty(len(frame), kind)
    for name in kind.names:
        rows[name] = frame[name].to_numpy()
    return rows.tobytes()


def _complete(chunks: pd.DataFrame) -> set:
    """Documents with a plan whose planned chunks are all there."""
    planned = chunks[chunks.planned > 0]
    return set(planned.doc_id) - set(planned.doc_id[planned.received == 0])


def _reports(chunks: pd.DataFrame, status: str) -> pd.DataFrame:
    """A report on each document that has a plan."""
    planned, there = chunks.planned > 0, chunks.received > 0
    lacking = chunks[planned & ~there]
    flags = pd.DataFrame(
        {"planned": planned, "received": planned & there, "missing": planned & ~there, "repeated": chunks.received > 1, "unplanned": ~planned}
    )
    out = flags.astype("int64").groupby(chunks.doc_id).sum().query("planned > 0").reset_index()
    lists = lacking.groupby("doc_id").chunk_no.agg(list).to_dict()
    out.insert(1, "status", status)
    out["missing_chunks"] = [lists.get(d, []) for d in out.doc_id]
    out["failed"] = (out.missing > 0) | (out.unplanned > 0)
    return out


def _follow(limit_ms: int):
    """Of each document of a bucket: how often each chunk was planned and received, and until when it may take.

    A document by itself is a few rows, and a call of Python or of the state store takes longer than all its counts; so
    the documents of a bucket are counted together, 20 bytes a chunk."""

    def handle(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stored = state.get if state.exists else (b"", b"")
        chunks, documents = _frame(stored[0], _CHUNKS), _frame(stored[1], _DOCUMENTS)
        if not state.hasTimedOut:
            before = _complete(chunks)
            for batch in batches:
                come = batch[["doc_id", "chunk_no"]].assign(planned=batch.planned.astype("int32"), received=(~batch.planned).astype("int32"))
                chunks = pd.concat([chunks, come]).groupby(["doc_id", "chunk_no"], as_index=False).agg({"planned": "max", "received": "sum"})
                until = batch[["doc_id"]].assign(until=batch.ms + limit_ms)  # the earliest event counts
                documents = pd.concat([documents, until]).groupby("doc_id", as_index=False).min()
            done = _complete(chunks) - before
            if done:
                yield _reports(chunks[chunks.doc_id.isin(done)], "complete")
        over = documents.until <= state.getCurrentWatermarkMs()
        if over.any():
            past = chunks.doc_id.isin(documents.doc_id[over])
            found = _reports(chunks[past], "closed")
            if len(found):
                yield found
            chunks, documents = chunks[~past], documents[~over]
        if len(documents):
            state.update((_stored(chunks, _CHUNKS), _stored(documents, _DOCUMENTS)))
            state.setTimeoutTimestamp(int(documents.until.min()))
        else:
            state.remove()

    return handle


def completeness(happened: DataFrame, limit: str = "1 hour", late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Reports on a stream of ``events``: ``complete`` when all planned chunks are there, ``closed`` when ``limit`` has passed
    since the document's earliest event.  Events more than ``late`` behind the latest one are dropped; a document without
    a plan is not reported, an event without time is dropped.  A document's state is gone when it is closed.  The state is keyed by hash bucket: choose
    ``buckets`` so that the open documents of one fit into a task many times.  Meant for the state store ``STORE``, which
    keeps on disk what does not fit into memory."""
    limit_ms = int(pd.Timedelta(limit).total_seconds() * 1000)
    known = happened.where("doc_id IS NOT NULL AND chunk_no IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    keyed = known.select("*", F.unix_millis("at").alias("ms"), F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket")).groupBy("bucket")
    return keyed.applyInPandasWithState(_follow(limit_ms), REPORT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def closed(reports: DataFrame) -> DataFrame:
    """The rows of ``paging.missing_chunks``: documents closed with something missing, repeated or unplanned."""
    return reports.where("status = 'closed' AND missing + repeated + unplanned > 0").drop("status", "missing_chunks")


def over_stored(happened: DataFrame, folder: str, limit: str = "1 hour") -> DataFrame:
    """Reports on events that are already there, as the stream gives them: the events are written to ``folder``, and an event
    of no document (-1) long after all others lets the time of every document run out."""
    spark = happened.sparkSession
    stored = f"{folder}/events"
    happened.write.parquet(stored)
    last = spark.read.schema(happened.schema).parquet(stored).agg(F.max("at").alias("at")).where("at IS NOT NULL")
    end = last.select(
        F.lit(-1).cast("long").alias("doc_id"), F.lit(0).alias("chunk_no"), F.lit(False).alias("planned"), F.expr("at + INTERVAL 10 YEARS").alias("at")
    )
    end.write.mode("append").parquet(stored)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, STORE)
    try:
        reports = completeness(spark.readStream.schema(happened.schema).parquet(stored), limit)
        writer = reports.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/reports")
        writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(REPORT).parquet(f"{folder}/reports")
