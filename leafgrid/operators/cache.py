"""Reuse of earlier responses by content hash and mode."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrid import constants as K
from leafgrid.functions.joins import look_up

LEGACY_MODE = "enhanced"
NO_MODE = ""


def _hash():
    """Stands for the response where only its identity matters."""
    return F.xxhash64("response").alias("h")


def _fetch(winners: DataFrame, entries: DataFrame, keys: list) -> DataFrame:
    """The responses of chosen entries.  ``winners`` has keys, ``ts``, ``h`` and how many entries
    are equal in all of them (``n``); only those few equal entries are reduced by their text."""
    found = entries.withColumn("h", F.xxhash64("response")).join(winners, [*keys, "ts", "h"])
    single, equal = found.filter("n = 1").drop("n"), found.filter("n > 1").drop("n")
    return single.unionByName(equal.dropDuplicates([*keys, "ts", "h"]))


def cache_upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Latest response of each (sha16, mode).

    Winners are chosen on times and hashes by a plain partial aggregate, so a text that occurs
    very often is reduced before the shuffle and responses are moved once, for winners only.
    """
    both = existing.unionByName(incoming).withColumn("_mode", F.coalesce("mode", F.lit(NO_MODE)))
    equal = both.groupBy("sha16", "_mode", "ts", _hash()).agg(F.count(F.lit(1)).alias("n"))
    last = equal.groupBy("sha16", "_mode").agg(F.max(F.struct("ts", "h", "n")).alias("b"))
    winners = last.select("sha16", "_mode", "b.*")
    return _fetch(winners, both, ["sha16", "_mode"]).select("sha16", "mode", "response", "ts")


def effective_entries(cache: DataFrame) -> DataFrame:
    """One row per (sha16, mode) that a request may hit, without its response: an entry
    without mode serves enhanced requests unless an exact one exists."""
    exact = F.col("mode").isNotNull()
    entries = cache.groupBy("sha16", F.coalesce("mode", F.lit(LEGACY_MODE)).alias("mode"), exact.alias("exact"), "ts", _hash())
    entries = entries.agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct("exact", "ts", "h", "n"))
    return entries.groupBy("sha16", "mode").agg(best.alias("b")).select(
        "sha16", "mode", F.when(F.col("b.exact"), "exact").otherwise("legacy").alias("matched"), "b.ts", "b.h", "b.n"
    )


def cache_hits(requests: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    """Requests with ``hit`` and how it ``matched``; no response is read for this.

    The cache side is unique per key, so a request never fans out, and a hot hash on the
    request side is one that adaptive skew handling can split.
    """
    if force:
        return requests.select("*", F.lit(False).alias("hit"), F.lit(None).cast("string").alias("matched"))
    found = look_up(requests, effective_entries(cache).drop("ts", "h", "n"), ["sha16", "mode"], "left")
    return found.select(*requests.columns, F.col("matched").isNotNull().alias("hit"), "matched")


def cache_lookup(requests: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    """Requests with ``hit``, how it ``matched`` and the cached ``response``, which is fetched
    for entries that some request hits."""
    if force:
        return cache_hits(requests, cache, True).withColumn("response", F.lit(None).cast("string"))
    entries = effective_entries(cache)
    used = entries.join(requests.select("sha16", "mode"), ["sha16", "mode"], "left_semi")
    exact = F.col("mode").isNotNull()
    stored = cache.select(
        "sha16",
        F.coalesce("mode", F.lit(LEGACY_MODE)).alias("mode"),
        F.when(exact, "exact").otherwise("legacy").alias("matched"),
        "ts",
        "response",
    )
    known = _fetch(used, stored, ["sha16", "mode", "matched"]).select("sha16", "mode", "matched", "response")
    found = look_up(requests, known, ["sha16", "mode"], "left")
    return found.select(
        *requests.columns, F.col("matched").isNotNull().alias("hit"), "matched", "response"
    )


def cache_misses(requests: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    if force:
        return requests
    return look_up(requests, effective_entries(cache), ["sha16", "mode"], "left_anti").select(*requests.columns)


def parse_cost(looked_up: DataFrame, pages: DataFrame, rates=K.PAGE_RATES) -> DataFrame:
    """Cost of each request: pages times the rate of its mode, nothing for cache hits."""
    rate = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])
    cost = F.when(F.col("hit"), F.lit(0.0)).otherwise(
        F.round(F.col("n_pages") * F.try_element_at(rate, F.col("mode")), 4)
    )
    return looked_up.join(pages.select("doc_id", "n_pages"), "doc_id").select(
        "doc_id", "mode", "hit", "n_pages", cost.alias("cost")
    )
