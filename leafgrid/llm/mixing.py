"""Operator 6: mix the sources to target weights.

Every document gets a random key, the md5 of its id.  Within its source, documents stand in the order of
their keys; prefix sums of their sizes are computed in two levels (ranges of keys, then rows of a range),
so that no source, however large, is sorted in one task.  The source's budget is cut exactly: whole
epochs first, then the documents before the cut, then the words of the document at the cut.

Defined results: a null text has size 0; a null source is a source of its own and comes last; rows
that repeat are separate documents with the same key; ties in the key fall to doc_id and size; an
empty table gives no rows, sources without words get target 0; other columns stay untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.llm.common import WORDS
from leafgrid.session import stage

RANGE_ROWS = 2000


def targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights in turn over the sources by code
    point, null last; nobody gets more than ``most`` times its size, what is over goes to the others by weight.

    The fixed point in closed form: target = min(most * size, weight * level).  Sources reach their limit in the
    order of limit / weight; the level is taken where the sources before are full and the next one is not.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("double"))
    w = w.withColumn("limit", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    w = w.withColumn("level", left / F.sum("weight").over(on)).withColumn("pos", F.row_number().over(order))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct("pos", "level"))
    level = F.coalesce(F.min(fits).over(every)["level"], F.lit(math.inf))
    return w.select("source", "source_size", F.least(F.col("limit"), F.col("weight") * level).alias("target"))


def mix_sources(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of docs (doc_id, source, text).

    ``taken`` sums to the whole words of the target for each source.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.size(F.regexp_extract_all(text, F.lit(f"({WORDS})"), F.lit(1))).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"),
    )
    rows = stage(rows, "sizes")
    # the leading digits of the key are the range; ranges hold about RANGE_ROWS rows of the whole table
    digits = max(1, math.ceil(math.log(max(1, rows.count()) / RANGE_ROWS + 1, 16)))
    rows = rows.withColumn("range", F.substring("key", 1, digits))
    ranges = stage(rows.groupBy("source", "range").agg(F.sum("size").alias("words")), "ranges")
    goal = stage(targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most), "targets")
    start = F.sum("words").over(Window.partitionBy("source").orderBy("range")) - F.col("words")
    start = ranges.select("source", "range", start.alias("start"))
    start = start.join(goal, start["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    facts = rows.withColumnRenamed("source", "s").withColumnRenamed("range", "r")
    facts = facts.join(start, facts["s"].eqNullSafe(start["source"]) & (facts["r"] == start["range"])).drop("s", "r")
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    facts = facts.withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as long) div source_size")).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before")))
    taken = F.when(F.col("source_size") > 0, epochs * F.col("size") + last).otherwise(F.lit(0).cast("long"))
    return facts.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, all columns kept; the text at a source's cut ends at it.

    Rows with one doc_id share the largest decision for it; rows the mix takes no word of are not in the mixture.
    """
    plan = mix_sources(docs, **options).where("taken > 0").groupBy(F.col("doc_id").alias("_id")).agg(F.max("taken").alias("_taken"), F.max("size").alias("_size"))
    rows = docs.join(plan, docs["doc_id"].cast("long").eqNullSafe(plan["_id"]))
    rows = rows.withColumn("_copy", F.explode(F.expr("sequence(1L, (_taken + _size - 1) div _size)")))
    part = F.least(F.col("_size"), F.col("_taken") - (F.col("_copy") - 1) * F.col("_size")).cast("int")
    words = F.regexp_extract_all("text", F.lit(f"({WORDS})"), F.lit(1))
    text = F.when(part < F.col("_size"), F.array_join(F.slice(words, F.lit(1), part), " ")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
