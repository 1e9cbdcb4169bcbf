"""Follow-up questions on extracted tables.

They are answered inside each grid without a shuffle; only changes between periods need one, of bare numbers.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.functions import html as H
from leafgrid.functions.periods import MONTHS, period
from leafgrid.functions.text import strip
from leafgrid.operators.elements import once
from leafgrid.operators.tables import number

UNIT = r"(%p|%|pp|bp|조원|억원|만원|천원|원|달러|명|건|개|배)"


def compare_series(grids: DataFrame, label_col: int, left: str, right: str) -> DataFrame:
    """Difference and ratio of two named columns for each data row of each table that
    has both and a number in both."""
    def rows(g):
        names = H.header_names(g)
        columns = F.struct(
            (F.array_position(names, F.lit(left)).cast("int") - 1).alias("l"),
            (F.array_position(names, F.lit(right)).cast("int") - 1).alias("r"),
        )
        return H.let(columns, lambda c: F.when((c.l >= 0) & (c.r >= 0), compared(g.body, c)))

    def compared(body, c):
        return F.transform(
            body,
            lambda r, i: F.struct(
                i.alias("row"),
                F.get(r, F.lit(label_col)).alias("label"),
                number(F.get(r, c.l)).alias("left_value"),
                number(F.get(r, c.r)).alias("right_value"),
            ),
        )

    # one expression per grid and an outer explode: a filter before it would make the
    # optimizer compute the grid once more for the filter
    values = grids.select("doc_id", "seq", F.inline_outer(H.let(F.col("grid"), rows)))
    return values.filter("left_value IS NOT NULL AND right_value IS NOT NULL").select(
        "*",
        (F.col("left_value") - F.col("right_value")).alias("difference"),
        F.round(F.col("left_value") / F.nullif("right_value", F.lit(0.0)), 6).alias("ratio"),
    )


def period_columns(grids: DataFrame, labels: int = 1) -> DataFrame:
    """Numbers of the columns whose header names a period (``kind, at``); the first ``labels`` columns
    name the row.  Totals and other columns are no period; ``series`` is the row."""
    known = grids.select(
        "doc_id",
        "seq",
        F.col("grid.body").alias("body"),
        once(H.let(F.col("grid"), lambda g: F.transform(H.header_names(g), period)).alias("periods")),
    )
    rows = known.select("doc_id", "seq", "periods", F.posexplode_outer("body").alias("row", "cells")).filter("row IS NOT NULL")
    values = F.zip_with("cells", "periods", lambda t, p: F.struct(p.kind.alias("kind"), p.at.alias("at"), number(t).alias("num")))
    values = F.transform(values, lambda v, i: F.struct(i.alias("col"), v.kind.alias("kind"), v.at.alias("at"), v.num.alias("num")))
    values = F.filter(values, lambda v: (v.col >= labels) & v.kind.isNotNull() & v.num.isNotNull())
    return rows.select("doc_id", "seq", F.col("row").alias("series"), "row", F.inline(values))


def period_rows(grids: DataFrame, label_col: int = 0) -> DataFrame:
    """The same for tables whose rows are periods, named in ``label_col``; ``series`` is the column."""
    rows = grids.select("doc_id", "seq", F.posexplode_outer("grid.body").alias("row", "cells")).filter("row IS NOT NULL")
    rows = rows.select("*", period(F.get("cells", F.lit(label_col))).alias("p")).filter("p IS NOT NULL")
    values = F.transform("cells", lambda t, i: F.struct(i.alias("series"), i.alias("col"), number(t).alias("num")))
    values = F.filter(values, lambda v: (v.series != label_col) & v.num.isNotNull())
    values = rows.select("doc_id", "seq", "row", "p.kind", "p.at", F.inline(values))
    return values.select("doc_id", "seq", "series", "row", "col", "kind", "at", "num")


def period_change(values: DataFrame) -> DataFrame:
    """Change and rate of each number against the period before it and against a year before.

    ``values`` comes from ``period_columns`` or ``period_rows``.  The windows range over the calendar, so a missing
    period gives null, not the one before the gap; so does a period that a series states twice.  A rate is the
    change by the size of what it is compared with, null against zero.
    """
    series = Window.partitionBy("doc_id", "seq", "series", "kind").orderBy("at")

    def back(months):
        there = series.rangeBetween(-months, -months)
        return F.when(F.count("num").over(there) == 1, F.max("num").over(there))

    steps = {kind: back(n) for kind, n in MONTHS.items()}
    before = F.coalesce(*[F.when(F.col("kind") == kind, step) for kind, step in steps.items()])
    out = values.select("*", before.alias("previous"), steps["year"].alias("year_ago"))

    def rate(change, base):
        return F.round(change / F.nullif(F.abs(base), F.lit(0.0)), 6)

    change, yearly = F.col("num") - F.col("previous"), F.col("num") - F.col("year_ago")
    return out.select(
        "doc_id",
        "seq",
        "row",
        "col",
        "kind",
        F.make_date(F.floor(F.col("at") / 12), F.col("at") % 12 + 1, F.lit(1)).alias("period"),
        "num",
        "previous",
        change.alias("change"),
        rate(change, F.col("previous")).alias("rate"),
        "year_ago",
        yearly.alias("year_change"),
        rate(yearly, F.col("year_ago")).alias("year_rate"),
    )


def normalize_numbers(cells: DataFrame) -> DataFrame:
    """Numbers as written in reports: ``▲``/``▽``/parentheses mean negative, a trailing
    footnote mark like ``1)`` is dropped, ``%`` and other units go to ``unit``."""
    text = strip(F.col("text"))
    plain = F.regexp_replace(text, r"(?<=[0-9%)가-힣])\s+[0-9]{1,2}\)$", "")
    wrapped = F.regexp_extract(plain, r"^\((.*)\)$", 1)
    inner = F.when(wrapped != "", wrapped).otherwise(plain)
    negative = (wrapped != "") | inner.rlike(r"^[▲▽△▼]")
    bare = strip(F.regexp_replace(inner, r"^[▲▽△▼]", ""))
    unit = F.regexp_extract(bare, rf"^[+-]?[0-9.,]+\s*{UNIT}$", 1)
    digits = F.regexp_replace(bare, rf"\s*{UNIT}$", "")
    value = number(digits)
    return cells.select(
        *cells.columns,
        F.when(negative, -value).otherwise(value).alias("num"),
        F.when(value.isNotNull(), F.nullif(unit, F.lit(""))).alias("unit"),
    )


def units_of(row: Column) -> Column:
    """The unit of each column if the row's non-empty cells all state units, else null."""
    pattern = rf"^\(?\s*(?:단위\s*[::]\s*)?{UNIT}\s*\)?$"
    units = F.transform(row, lambda t: F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")))
    stated = F.exists(row, lambda t: t != "") & F.forall(F.zip_with(row, units, lambda t, u: (t == "") | u.isNotNull()), lambda fine: fine)
    return F.when(stated, units)


def _found_units(grid: str = "grid") -> Column:
    """Place and column units of the unit row: a header row or the first data row."""
    rows = F.concat(f"{grid}.head", F.slice(f"{grid}.body", 1, 1))
    return F.get(
        F.filter(
            F.transform(rows, lambda r, i: F.struct(i.alias("row"), units_of(r).alias("units"))),
            lambda u: u.units.isNotNull(),
        ),
        0,
    )


def unit_rows(grids: DataFrame) -> DataFrame:
    """Where tables state their units, one row per column with a unit; ``row`` counts from 0."""
    found = grids.select("doc_id", "seq", _found_units().alias("u"))
    units = found.select("doc_id", "seq", "u.row", F.posexplode_outer("u.units").alias("col", "unit"))
    return units.filter("unit IS NOT NULL")


def unit_cells(grids: DataFrame) -> DataFrame:
    """Numbers of the data cells with the unit of their column; the unit row itself drops out.
    Both sides are in the same grid, so nothing is joined."""
    found = grids.select("doc_id", "seq", F.size("grid.head").alias("n_head"), F.col("grid.body").alias("body"), _found_units().alias("u"))
    rows = found.select("doc_id", "seq", "n_head", "u", F.posexplode_outer("body").alias("at", "cells")).filter("at IS NOT NULL")
    row = F.col("n_head") + F.col("at")
    rows = rows.filter(~F.coalesce(F.col("u.row") == row, F.lit(False)))
    cells = rows.select("doc_id", "seq", row.alias("row"), "u", F.posexplode_outer("cells").alias("col", "text"))
    typed = cells.select("doc_id", "seq", "row", "col", number(F.col("text")).alias("num"), F.get("u.units", F.col("col")).alias("unit"))
    return typed.filter("num IS NOT NULL")
