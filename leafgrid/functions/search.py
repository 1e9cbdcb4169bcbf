"""Many search terms against many texts without comparing each with each.

A term as long as one of ``SIZES`` is looked up as it is: every text posts its distinct runs of the lengths asked for, and a run that
equals the term is the find.  Any other term asks for the one of its own runs (of the largest of ``SIZES`` that fits into it) which
the fewest texts hold, and what meets is verified.  With short runs alone the texts that meet a term would grow with the texts, and so all
meetings with texts times terms.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES = (0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 24, 32)
FEW = 512


def runs_of(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters; ``""`` for size 0."""
    if not size:
        return F.array(F.lit(""))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))."), F.lit(1)))


def _size(needle: Column) -> Column:
    """The largest of ``SIZES`` that fits into the needle."""
    return F.greatest(*[F.when(F.char_length(needle) >= n, n) for n in SIZES], F.lit(0))


def _posted(texts: DataFrame, keep: list, text: str, own: DataFrame) -> DataFrame:
    """``(*keep, run)`` of the runs of each text that have a size some row of ``own`` (``run, size``) asks for.

    Sizes, and the runs if they are few, come as one row; without any, no text is read.  A few runs are tried on each text."""
    some = own.select("run").distinct().limit(FEW + 1).agg(F.collect_list("run").alias("_few"))
    asked = own.agg(F.collect_set("size").alias("_sizes")).where("size(_sizes) > 0").crossJoin(some)
    of_size = lambda n: F.when(F.array_contains("_sizes", n), runs_of(F.col(text), n)).otherwise(F.array().cast("array<string>"))
    tried = F.filter("_few", lambda run: F.contains(F.col(text), run))
    runs = F.when(F.size("_few") <= FEW, tried).otherwise(F.flatten(F.array(*map(of_size, SIZES))))
    return texts.crossJoin(asked).select(*keep, F.explode(runs).alias("run"))


def containing(texts: DataFrame, keys: list, text: str, terms: DataFrame, needle: str = "needle", keep=()) -> DataFrame:
    """``(*keys, *keep, needle)`` of each text and each distinct term it contains.

    ``keys`` name one row of ``texts``; rows without them are left out.  Texts are fetched only to verify terms of other
    lengths than ``SIZES``; the posted runs are first reduced to those such a term has.
    """
    texts = texts.where(F.col(text).isNotNull()).dropna(subset=keys)
    needles = terms.select(F.col(needle).alias("needle")).where("needle IS NOT NULL").distinct()
    needles = needles.withColumn("size", _size(F.col("needle")))
    whole = F.char_length("needle") == F.col("size")
    short = needles.where(whole).select(F.col("needle").alias("run"), "size")
    exact = _posted(texts, [*keys, *keep], text, short).join(short.select("run"), "run")
    exact = exact.select(*keys, *keep, F.col("run").alias("needle"))

    own = needles.where(~whole)
    cut = F.coalesce(*[F.when(F.col("size") == n, runs_of(F.col("needle"), n)) for n in SIZES])
    own = own.select("needle", "size", F.explode(cut).alias("run"))
    posted = _posted(texts, keys, text, own.select("run", "size")).join(own.select("run").distinct(), "run", "left_semi")
    held = posted.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    rarest = own.join(held, "run", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("r"))
    rarest = rarest.where("r.n > 0").select("needle", F.col("r.run").alias("run"))
    met = posted.join(rarest, "run").select(*keys, "needle")
    found = met.join(texts.select(*keys, *keep, F.col(text).alias("_text")), keys)
    return exact.unionByName(found.where(F.contains("_text", "needle")).select(*keys, *keep, "needle"))
