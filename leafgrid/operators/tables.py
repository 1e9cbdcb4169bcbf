"""Tables as grids and cells.

``table_grids`` keeps one row per data asset with its whole grid, computed inside the
row; cells, headers, shapes and the follow-up analyses all start from it without a
shuffle.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrid import constants as K
from leafgrid.functions import html as H
from leafgrid.functions import text as T
from leafgrid.operators.elements import (
    DATA_LABELS,
    asset_rows,
    label,
    once,
    page_or_zero,
    with_name,
    with_slug,
)


def table_grids(elements: DataFrame) -> DataFrame:
    """``doc_id, seq, page, label, grid``; ``grid`` is null if the table is unreadable."""
    data = elements.filter(F.col("category").isin("table", "chart")).select(
        "doc_id", "seq", "page", "html", once(label().alias("label"))
    )
    data = data.filter(F.col("label").isin(*DATA_LABELS))
    return data.select("doc_id", "seq", "page", "label", once(H.table_grid(F.col("html")).alias("grid")))


def grid_rows(grids: DataFrame, *keep: str) -> DataFrame:
    """One row per grid row: ``row, is_header, cells``."""
    rows = grids.select(
        "doc_id",
        "seq",
        *keep,
        F.size("grid.head").alias("_n_head"),
        F.posexplode_outer(F.concat("grid.head", "grid.body")).alias("row", "cells"),
    ).filter("row IS NOT NULL")
    return rows.withColumn("is_header", F.col("row") < F.col("_n_head")).drop("_n_head")


def table_cells(grids: DataFrame, *keep: str) -> DataFrame:
    """The long cell table; merged cells are copied to every position they cover."""
    rows = grid_rows(grids, *keep)
    cells = rows.select(
        "doc_id", "seq", *keep, "row", "is_header", F.posexplode_outer("cells").alias("col", "text")
    )
    return cells.filter("col IS NOT NULL").select("doc_id", "seq", *keep, "row", "col", "is_header", "text")


def table_headers(grids: DataFrame) -> DataFrame:
    """Both header levels of each column and their flat name."""
    names = grids.select(
        "doc_id",
        "seq",
        F.size("grid.head").alias("n_levels"),
        F.posexplode_outer(H.header_names(F.col("grid"))).alias("col", "name"),
    )
    return names.filter("col IS NOT NULL AND n_levels > 0").select("doc_id", "seq", "col", "name", "n_levels")


def number(text: Column) -> Column:
    """Numeric value of a cell text; thousands commas are dropped, words stay null."""
    looks = text.rlike(r"^[+-]?([0-9][0-9,]*(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(looks, F.replace(text, F.lit(","), F.lit(""))).try_cast("double")


def typed_cells(cells: DataFrame) -> DataFrame:
    return cells.withColumn("num", number(F.col("text")))


def shape_columns(grid: str = "grid") -> list:
    return [F.size(f"{grid}.body").alias("n_rows"), F.col(f"{grid}.n_cols").alias("n_cols")]


def table_shapes(grids: DataFrame) -> DataFrame:
    return grids.select("doc_id", "seq", *shape_columns()).filter("n_cols IS NOT NULL")


def visuals(elements: DataFrame, captions=True, shapes=True, figures=False, notes=False) -> DataFrame:
    """Tables and charts (and figures, footnotes if asked), numbered, named, measured.

    The HTML is reduced to its shape before the shuffle, so it is never shuffled itself.
    """
    html = F.coalesce("html", F.lit(""))
    if shapes:
        measured = H.let(
            H.table_grid(html),
            lambda g: F.struct(F.size(g.body).alias("n_rows"), g.n_cols.alias("n_cols")),
        )
        facts = [("_shape", F.when(F.col("label").isin(*DATA_LABELS), measured))]
    else:
        facts = [("parsed_ok", H.first_table(html).isNotNull())]
    if figures:
        is_figure = F.col("label") == "figure"
        facts.append(("figure_type", F.when(is_figure, H.paragraph(html, "figure-type"))))
        facts.append(("description", F.when(is_figure, H.paragraph(html, "figure-description"))))
    if notes:
        facts.append(("markdown", F.when(F.col("label") == "footnote", T.strip(F.col("markdown")))))
    found = asset_rows(elements, captions=captions, notes=notes, carry=facts)
    if not figures:
        found = found.filter("prefix <> 'f'")
    if shapes:
        found = found.select("*", "_shape.n_rows", "_shape.n_cols").drop("_shape")
        found = found.withColumn("parsed_ok", F.col("n_cols").isNotNull())
    if captions:
        found = with_name(with_slug(found))
    kind = F.when(F.col("prefix") == "t", "table").when(F.col("prefix") == "c", "chart").when(
        F.col("prefix") == "f", "figure"
    )
    return found.withColumn("kind", kind).withColumn("page", page_or_zero())


def boundary_cases(assets: DataFrame) -> DataFrame:
    """Unreadable tables and charts, and tables that turned out to be charts."""
    assets = assets.withColumn("reason", boundary_reason())
    return assets.filter("reason IS NOT NULL").select(
        "doc_id", "seq", "page", "index", "reason", fallback_path().alias("fallback_path")
    )


def fallback_path() -> Column:
    return F.when(~F.col("parsed_ok"), F.col("name"))


def boundary_reason() -> Column:
    failed = ~F.col("parsed_ok")
    table = F.lit(f"{K.TABLE_FAILED}{K.PARSE_ERROR}")
    chart = F.lit(f"{K.CHART_FAILED}{K.PARSE_ERROR}: {K.PARSE_MESSAGE}")
    return (
        F.when(failed & (F.col("prefix") == "t"), table)
        .when(failed & (F.col("prefix") == "c"), chart)
        .when(F.col("label") == "chart_misid", K.CHART_LIKE)
    )


def parse_failures(elements: DataFrame) -> DataFrame:
    return boundary_cases(visuals(elements, shapes=False))


def wide_table(cells: DataFrame, n_cols: int) -> DataFrame:
    """Selected tables as wide rows ``c0 .. c<n-1>``; the width is named, so Spark needs
    no extra job to find it."""
    wide = cells.groupBy("doc_id", "seq", "row", "is_header").pivot("col", list(range(n_cols)))
    out = wide.agg(F.first("text"))
    return out.toDF("doc_id", "seq", "row", "is_header", *[f"c{i}" for i in range(n_cols)])


def wide_tables(grids: DataFrame, chosen: DataFrame, n_cols: int) -> DataFrame:
    """The same from grids, for the tables that ``chosen`` (``doc_id, seq``) names; columns beyond a table's
    width are null, and ``n_cols`` says how wide it is, so that a cut is seen.  Rows stay in their grid: nothing is pivoted."""
    rows = grid_rows(grids.join(chosen.select("doc_id", "seq").distinct(), ["doc_id", "seq"], "left_semi").withColumn("n_cols", F.col("grid.n_cols")), "n_cols")
    return rows.select("doc_id", "seq", "row", "is_header", "n_cols", *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(n_cols)])
