"""Look-ups in which one key may hold a large share of the rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _anew(kind, column):
    """The same value as an expression the planner does not see through."""
    if isinstance(kind, StringType):
        return F.concat(column, F.lit(""))
    return column.bitwiseXOR(F.lit(0).cast(kind))


def look_up(facts: DataFrame, unique: DataFrame, keys: list, how: str = "inner") -> DataFrame:
    """Join ``facts`` to a side with one row per key (text or whole numbers).

    Adaptive execution splits the partition of a hot key only if both inputs of the join
    are plain shuffles.  A side that comes out of an aggregate on the same keys would be
    joined in place, without a shuffle; its keys are written anew here, so the planner gives it one
    (it is small next to the facts).  Whether a side is small enough to broadcast stays Spark's
    measured decision.
    """
    kinds = {f.name: f.dataType for f in unique.schema}
    side = unique.select(*[_anew(kinds[c], F.col(c)).alias(c) if c in keys else F.col(c) for c in unique.columns])
    return facts.join(side, keys, how)
