"""Cached responses in storage: a partitioned table that is updated, and a bucketed one that is looked up."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrid.functions.joins import look_up
from leafgrid.operators.cache import LEGACY_MODE, NO_MODE, cache_upsert
from leafgrid.session import stage

ENTRY = "sha16 string, response string, ts long, mode string, prefix string"
PREFIX_DIGITS = 2
BUCKETS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a store, one per (sha16, mode).  The schema is given, so modes like ``01`` stay text."""
    if not _exists(spark, path):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).parquet(path)


def _partitioned(entries: DataFrame) -> DataFrame:
    """Without a mode and with an empty one are the same, as in ``cache_upsert``."""
    mode = F.nullif("mode", F.lit(NO_MODE)).alias("mode")
    prefix = F.substring("sha16", 1, PREFIX_DIGITS).alias("prefix")
    return entries.select("sha16", "response", F.col("ts").cast("long").alias("ts"), mode, prefix)


def _same_entry(a: DataFrame, b: DataFrame) -> Column:
    return (a.prefix == b.prefix) & (a.sha16 == b.sha16) & a["mode"].eqNullSafe(b["mode"])


def upsert_store(incoming: DataFrame, path: str) -> int:
    """Bring the latest responses of ``incoming`` into the store; returns how many entries changed.

    Folders are ``mode=.../prefix=...`` (the first digits of the hash).  Stored keys are compared without their
    responses, and only in folders the incoming entries fall into; only folders with a change are read whole and
    written again, the others are not touched.  What is written was staged before, so a run that fails half-way can be
    repeated, and a second run of the same changes nothing.
    """
    spark = incoming.sparkSession
    latest = _partitioned(cache_upsert(incoming.limit(0), incoming))
    latest = stage(latest.withColumn("h", F.xxhash64("response")), "latest")
    stored = read_store(spark, path)
    known = stored.select("prefix", "sha16", "mode", F.col("ts").alias("old_ts"), F.xxhash64("response").alias("old_h"))
    newer = F.col("old_ts").isNull() | (F.struct("ts", "h") > F.struct("old_ts", "old_h"))
    won = latest.join(known, _same_entry(latest, known), "left").where(newer)
    won = stage(won.select(latest.sha16, "response", "ts", latest["mode"], latest.prefix), "changed")
    changed = won.count()
    if not changed:
        return 0
    touched = won.select("mode", "prefix").distinct()
    same_folder = (stored.prefix == touched.prefix) & stored["mode"].eqNullSafe(touched["mode"])
    rest = stored.join(touched, same_folder, "left_semi")
    rest = rest.join(won, _same_entry(rest, won), "left_anti")
    merged = stage(rest.unionByName(won), "merged")
    writer = merged.hint("rebalance", F.col("mode"), F.col("prefix")).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("mode", "prefix").parquet(path)
    return changed


def save_bucketed(cache: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> None:
    """Write what each (sha16, mode) may hit as table ``name``, bucketed and sorted by the look-up key."""
    exact = F.col("mode").isNotNull()
    mode = F.coalesce("mode", F.lit(LEGACY_MODE))
    # of each mode the latest entry with it, and for enhanced the latest without one
    latest = cache_upsert(cache.limit(0), cache)
    entries = latest.select("sha16", mode.alias("mode"), exact.alias("exact"), "response")
    best = entries.groupBy("sha16", "mode").agg(F.bool_or("exact").alias("exact"))
    entries = entries.join(best, ["sha16", "mode", "exact"])
    entries = entries.select("sha16", "mode", F.when(F.col("exact"), "exact").otherwise("legacy").alias("matched"), "response")
    writer = entries.repartition(buckets, "sha16", "mode").write.bucketBy(buckets, "sha16", "mode").sortBy("sha16", "mode")
    writer.option("path", path).mode("overwrite").saveAsTable(name)


def lookup_bucketed(requests: DataFrame, name: str, buckets: int = BUCKETS) -> DataFrame:
    """``cache_lookup`` on a bucketed table: the stored entries are not shuffled.

    Each asked key meets its bucket once, however often it is asked for; what was found goes to the requests by a join
    whose hot keys adaptive execution can split.
    """
    stored = requests.sparkSession.table(name)
    asked = requests.select("sha16", "mode").distinct().repartition(buckets, "sha16", "mode")
    known = asked.join(stored, ["sha16", "mode"])
    found = look_up(requests, known, ["sha16", "mode"], "left")
    return found.select(*requests.columns, F.col("matched").isNotNull().alias("hit"), "matched", "response")
