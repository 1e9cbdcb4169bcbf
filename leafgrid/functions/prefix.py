"""Running aggregates that survive a hot group.

A plain window over ``doc_id`` sorts a whole document in one task.  Here a document is
cut into blocks of consecutive positions: the window runs inside a block, and the totals
of the earlier blocks (one small row per block, pre-aggregated before the shuffle) are
added by a join.  Most documents have one block, so that join is nearly empty.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 14
_B = "_block"


def with_block(df: DataFrame, order: str, width: int = BLOCK) -> DataFrame:
    return df.withColumn(_B, F.expr(f"`{order}` div {width}"))


def block_offsets(df: DataFrame, keys: list, sums=(), lasts=()) -> DataFrame:
    """Totals over all earlier blocks, only for blocks that have something before them."""
    blocks = df.groupBy(*keys, _B).agg(
        *[F.sum(c).alias(f"_before_{c}") for c in sums],
        *[F.max(c).alias(f"_before_{c}") for c in lasts],
    )
    w = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_before_{c}" for c in (*sums, *lasts)]
    aggs = [F.sum(f"_before_{c}").over(w) for c in sums] + [
        F.max(f"_before_{c}").over(w) for c in lasts
    ]
    return blocks.select(
        *keys,
        _B,
        F.lag(F.lit(True)).over(Window.partitionBy(*keys).orderBy(_B)).alias("_has_before"),
        *[a.alias(n) for a, n in zip(aggs, names)],
    ).filter("_has_before").drop("_has_before")


def add_offsets(local: DataFrame, offsets: DataFrame, keys: list, sums=(), lasts=()) -> DataFrame:
    """Combine in-block values (columns ``prev_*``) with the totals of earlier blocks."""
    out = local.join(offsets, [*keys, _B], "left")
    for c in sums:
        total = F.coalesce(F.col(f"prev_{c}"), F.lit(0)) + F.coalesce(F.col(f"_before_{c}"), F.lit(0))
        out = out.withColumn(f"prev_{c}", total)
    for c in lasts:
        out = out.withColumn(f"prev_{c}", F.coalesce(f"prev_{c}", f"_before_{c}"))
    return out.drop(*[f"_before_{c}" for c in (*sums, *lasts)])


def running(df: DataFrame, keys: list, order: str, sums=(), lasts=(), width: int = BLOCK) -> DataFrame:
    """Add ``prev_<c>`` for each column: over the earlier rows of the group, the sum
    (``sums``) or the latest value (``lasts``: structs that start with ``order``)."""
    df = with_block(df, order, width)
    w = Window.partitionBy(*keys, _B).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.select(
        "*",
        *[F.sum(c).over(w).alias(f"prev_{c}") for c in sums],
        *[F.max(c).over(w).alias(f"prev_{c}") for c in lasts],
    )
    return add_offsets(local, block_offsets(df, keys, sums, lasts), keys, sums, lasts).drop(_B)
