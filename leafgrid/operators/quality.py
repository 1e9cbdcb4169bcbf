"""Checks of extracted tables and documents against golden values and thresholds."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from leafgrid import constants as K
from leafgrid.functions import html as H
from leafgrid.functions import text as T
from leafgrid.functions.search import containing
from leafgrid.operators.elements import label, once
from leafgrid.operators.tables import number, table_grids


def within_tolerance(actual: Column, expected: Column, tol: Column) -> Column:
    """Relative error at most ``tol``; an expected zero is compared absolutely."""
    relative = F.abs(actual - expected) / F.nullif(F.abs(expected), F.lit(0.0)) <= tol
    return F.when(expected == 0, F.abs(actual) < K.ZERO_TOLERANCE).otherwise(relative)


def asked_grids(elements: DataFrame, targets: DataFrame, keys: list) -> DataFrame:
    """Grids of the asked tables only: the keys meet the elements before any HTML is parsed."""
    data = elements.filter(F.col("category").isin("table", "chart"))
    return table_grids(data.join(targets.select(*keys).distinct(), keys, "left_semi"))


def asked_facts(elements: DataFrame, targets: DataFrame) -> DataFrame:
    """Data rows and column names of the asked tables as one value (``body, names``), so that checks of the same
    tables read the same columns and Spark parses the tables once for them: what is shuffled is shared.  The keys in
    another order than in the join before make the planner keep this shuffle."""
    grids = asked_grids(elements, targets, ["doc_id", "seq"])
    facts = F.struct("grid.body", H.header_names(F.col("grid")).alias("names")).alias("facts")
    return grids.select("doc_id", "seq", facts).repartition("seq", "doc_id")


def golden_cells(golden: DataFrame, elements: DataFrame) -> DataFrame:
    """Compare expected numbers (``doc_id, seq, row_label, col_name, expected, tol``).

    The row is the first data row with that label in its first column; a missing row,
    column or number is a miss.  The look-up happens inside the grid: one join on the
    table key, no exploded cells.
    """
    found = golden.join(asked_facts(elements, golden), ["doc_id", "seq"], "left")
    found = found.select("*", once(_fact("body"), _fact("names")))
    row = F.get(F.filter("body", lambda r: F.get(r, 0) == F.col("row_label")), 0)
    place = F.array_position("names", F.col("col_name")).cast("int") - 1
    text = F.when(place >= 0, F.get(row, place))
    out = found.withColumn("actual", number(text))
    hit = F.coalesce(within_tolerance(F.col("actual"), F.col("expected"), F.col("tol")), F.lit(False))
    return out.select("doc_id", "seq", "row_label", "col_name", "expected", "actual", hit.alias("hit"))


def _fact(name: str) -> Column:
    """Through a lambda: a plain field would be cut out before the shuffle, by each check its own."""
    return H.let(F.col("facts"), lambda f: f[name]).alias(name)


def golden_substrings(golden: DataFrame, elements: DataFrame, needed: int = 4) -> DataFrame:
    """How many expected strings (``doc_id, seq, wanted ARRAY<STRING>``) occur in the
    space-joined data cells; also inside longer numbers."""
    joined = H.let(F.col("facts"), lambda f: F.array_join(F.transform(f.body, lambda r: F.array_join(r, " ")), " "))
    found = golden.join(asked_facts(elements, golden), ["doc_id", "seq"], "left")
    found = found.select("*", once(joined.alias("_joined")))
    hits = F.size(F.filter("wanted", lambda w: F.coalesce(F.contains(F.col("_joined"), w), F.lit(False))))
    return found.select("doc_id", "seq", hits.alias("hits"), (hits >= needed).alias("passed"))


def find_substrings(wanted: DataFrame, elements: DataFrame) -> DataFrame:
    """Tables (``doc_id, seq``) whose space-joined data cells contain a string, for any number of strings
    (column ``wanted``), wherever they are expected."""
    joined = F.array_join(F.transform("grid.body", lambda r: F.array_join(r, " ")), " ")
    tables = table_grids(elements).select("doc_id", "seq", joined.alias("text"))
    found = containing(tables, ["doc_id", "seq"], "text", wanted, "wanted")
    return found.withColumnRenamed("needle", "wanted")


def largest_table_on_page(
    targets: DataFrame, elements: DataFrame, min_rows: int = 5, min_cols: int = 5
) -> DataFrame:
    """Largest table of each asked (doc_id, page), first one on ties, and whether it is
    large enough; a page without a table fails."""
    grids = asked_grids(elements, targets, ["doc_id", "page"])
    sized = grids.filter("label = 'real_table' AND grid IS NOT NULL").select(
        "doc_id", "page", "seq", F.size("grid.body").alias("n_rows"), F.col("grid.n_cols").alias("n_cols")
    )
    area = F.col("n_rows").cast("long") * F.col("n_cols")
    best = F.max(F.struct(area.alias("area"), (-F.col("seq")).alias("back"), "n_rows", "n_cols"))
    pages = sized.groupBy("doc_id", "page").agg(best.alias("b"))
    big = (F.col("b.n_rows") >= min_rows) & (F.col("b.n_cols") >= min_cols)
    return targets.join(pages, ["doc_id", "page"], "left").select(
        "doc_id",
        "page",
        (-F.col("b.back")).alias("seq"),
        "b.n_rows",
        "b.n_cols",
        F.coalesce(big, F.lit(False)).alias("passed"),
    )


def match_table_by_columns(grids: DataFrame, columns: list) -> DataFrame:
    """On each page with charts, the first chart that has all the named columns."""
    names = H.header_names(F.col("grid"))
    charts = grids.filter("label IN ('chart', 'chart_misid') AND grid IS NOT NULL").select(
        "doc_id", "page", "seq", (F.size(F.array_except(F.array(*map(F.lit, columns)), names)) == 0).alias("fits")
    )
    return charts.groupBy("doc_id", "page").agg(
        F.count(F.lit(1)).alias("n_charts"), F.min(F.when(F.col("fits"), F.col("seq"))).alias("matched_seq")
    )


def hangul_retained(grids: DataFrame) -> DataFrame:
    rows = F.concat("grid.head", "grid.body")
    kept = F.exists(rows, lambda r: F.exists(r, lambda t: t.rlike(K.HANGUL)))
    return grids.filter("grid IS NOT NULL").select("doc_id", "seq", kept.alias("retained"))


def text_integrity(texts: DataFrame, min_hangul: int = K.MIN_HANGUL) -> DataFrame:
    """Hangul and broken characters of each document's texts (``origin, doc_id, text``);
    counted per text before the shuffle."""
    counts = texts.select(
        "origin",
        "doc_id",
        F.regexp_count("text", F.lit(K.HANGUL)).alias("h"),
        F.regexp_count("text", F.lit(K.BROKEN_CHAR)).alias("b"),
        F.length("text").alias("n"),
    )
    sums = counts.groupBy("origin", "doc_id").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("h", "hangul"), ("b", "broken"), ("n", "n_chars"))]
    )
    return sums.withColumn("passed", (F.col("hangul") >= min_hangul) & (F.col("broken") == 0))


def _volumes(elements: DataFrame) -> DataFrame:
    ok = H.first_table(F.coalesce("html", F.lit(""))).isNotNull()
    data = F.col("category").isin("table", "chart")
    rows = elements.select(
        "doc_id", "category", once(label().alias("label"), F.when(data, ok).otherwise(False).alias("ok"))
    )
    table = (F.col("label") == "real_table") & F.col("ok")
    chart = F.col("label").isin("chart", "chart_misid") & F.col("ok")
    lost = (F.col("label") == "chart") | (F.col("label") == "chart_misid")
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("elements"),
        F.count_if(F.col("category") == "table").alias("raw_tables"),
        F.count_if(F.col("category") == "chart").alias("raw_charts"),
        F.count_if(table | chart).alias("assets"),
        F.count_if(chart).alias("charts"),
        F.count_if(chart & (F.col("category") == "chart")).alias("strict_charts"),
        F.count_if(lost & ~F.col("ok")).alias("failed_charts"),
    )


def volume_thresholds(elements: DataFrame, thresholds=None) -> DataFrame:
    """One row per document and metric: value, threshold, verdict."""
    limits = thresholds or K.VOLUME_THRESHOLDS
    checks = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(t).cast("long").alias("threshold"))
            for m, t in limits.items()
        ]
    )
    rows = _volumes(elements).select("doc_id", F.inline(checks))
    return rows.withColumn("passed", F.col("value") >= F.col("threshold"))


def silent_drop_check(elements: DataFrame, recorded: DataFrame) -> DataFrame:
    """Charts that vanished without a recorded failure.

    Charts found in tables count as extracted and can hide real drops; ``strict_passed``
    leaves them out.  ``recorded`` holds the boundary cases that were kept.
    """
    noted = recorded.filter(F.col("reason").startswith(K.CHART_FAILED.strip())).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    n = F.coalesce("n", F.lit(0))
    dropped = F.col("raw_charts") - F.col("charts")
    strict = F.col("raw_charts") - F.col("strict_charts")
    return _volumes(elements).join(noted, "doc_id", "left").select(
        "doc_id",
        "raw_charts",
        "charts",
        n.alias("recorded"),
        dropped.alias("dropped"),
        (dropped <= n).alias("passed"),
        (strict <= n).alias("strict_passed"),
    )


def eval_rollup(scenarios: DataFrame, checks: DataFrame) -> DataFrame:
    """A scenario (``doc_id, scenario``) passes if it has a check and all of them pass."""
    counts = checks.groupBy("doc_id", "scenario").agg(
        F.count(F.lit(1)).alias("n_checks"), F.count_if("passed").alias("n_passed")
    )
    rolled = scenarios.join(counts, ["doc_id", "scenario"], "left").fillna(0, ["n_checks", "n_passed"])
    good = (F.col("n_checks") > 0) & (F.col("n_checks") == F.col("n_passed"))
    return rolled.withColumn("passed", good)


def eval_totals(rollup: DataFrame) -> DataFrame:
    """Passed and failed evaluations of each scenario, of each document and over all, in one aggregate."""
    sets = [[F.col("scenario")], [F.col("doc_id")], []]
    totals = rollup.groupingSets(sets, F.col("scenario"), F.col("doc_id")).agg(
        F.when(F.grouping("scenario") == 0, "scenario").when(F.grouping("doc_id") == 0, "document").otherwise("all").alias("of"),
        F.count(F.lit(1)).alias("n"),
        F.count_if("passed").alias("n_pass"),
        F.count_if(~F.col("passed")).alias("n_fail"),
    )
    return totals.select("of", "scenario", "doc_id", "n", "n_pass", "n_fail", (F.col("n_fail") == 0).alias("passed"))


def mask_secrets(messages: DataFrame, rules=K.SECRET_RULES, length: int = K.MESSAGE_LENGTH) -> DataFrame:
    """Mask keys in the whole ``text``; ``excerpt`` is the cut shown to users."""
    masked = messages.withColumn("text", T.mask(F.col("text"), rules))
    return masked.withColumn("excerpt", F.substring("text", 1, length))


@F.pandas_udf(IntegerType())
def _smallest_period(tails: pd.Series) -> pd.Series:
    """By the prefix function: the words but for the longest border that is also their beginning."""

    def of(words):
        if words is None:
            return None
        words, border = list(words), [0] * len(words)
        k = 0
        for i in range(1, len(words)):
            while k and words[i] != words[k]:
                k = border[k - 1]
            k += words[i] == words[k]
            border[i] = k
        period = len(words) - k
        return period if 3 * period <= len(words) else None

    return tails.map(of).astype("Int32")


def _loop(words: Column, n: Column) -> Column:
    """Period of the last half of the words if it holds three turns of it or more, else null.

    In a loop the last third of that half has no word that its beginning lacks.  Few other texts are
    like that, and only such reach Python.
    """
    def suspect(tail):
        third = F.floor(F.size(tail) / 3).cast("int")
        start = F.slice(tail, F.lit(1), F.size(tail) - third)
        end = F.slice(tail, F.size(tail) - third + 1, third)
        return F.when(F.size(F.array_except(end, start)) == 0, tail)

    half = F.ceil(n / 2).cast("int")
    return _smallest_period(H.let(F.slice(words, n - half + 1, half), suspect))


def description_loops(texts: DataFrame, text: str = "text", share: float = 0.5, min_words: int = 20) -> DataFrame:
    """Descriptions stuck on one word (its share of all words) or on a phrase that repeats to the end (its
    ``period`` in words), and the verdict.

    The words of a text are sorted inside the row and the longest run is its top count,
    so no word is ever shuffled.
    """
    in_order = F.filter(F.split(T.strip(F.col(text)), f"{K.WS}+"), lambda w: w != "")
    words = F.array_sort("_in_order")
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("top"))

    def count(state, word):
        run = F.when(state["last"] == word, state.run + 1).otherwise(1)
        return F.struct(word.alias("last"), run.alias("run"), F.greatest(state.top, run).alias("top"))

    rows = texts.withColumn("_in_order", in_order).withColumn("_words", words)
    rows = rows.withColumn("n_words", F.size("_words"))
    rows = rows.withColumn("period", F.when(F.col("n_words") >= min_words, _loop(F.col("_in_order"), F.col("n_words"))))
    rows = rows.withColumn("top_count", F.aggregate("_words", start, count, lambda s: s.top))
    rate = F.col("top_count") / F.greatest("n_words", F.lit(1))
    return rows.drop("_words", "_in_order", text).select(
        "*",
        F.round(rate, 6).alias("top_share"),
        (((F.col("n_words") >= min_words) & (rate >= share)) | F.col("period").isNotNull()).alias("looping"),
    )
