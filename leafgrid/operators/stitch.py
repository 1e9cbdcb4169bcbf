"""Tables that continue on the next page."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrid.functions.prefix import BLOCK, running
from leafgrid.functions import html as H
from leafgrid.functions.joins import look_up
from leafgrid.operators.elements import asset_rows
from leafgrid.operators.tables import table_cells

FURNITURE = ("header", "footer")


def page_edges(elements: DataFrame) -> DataFrame:
    """First and last position of each page, page headers, footers and numbers aside."""
    body = elements.filter(~F.coalesce(F.col("category").isin(*FURNITURE), F.lit(False)))
    return body.groupBy("doc_id", "page").agg(F.min("seq").alias("_top"), F.max("seq").alias("_bottom"))


def stitched_parts(elements: DataFrame, width: int = BLOCK, keep=lambda df, name: df) -> DataFrame:
    """Real tables with the table they continue: ``stitched_id`` is the ``seq`` of the
    first part, ``row_offset`` the number of data rows in the parts before.

    A table continues the previous one of its document if it starts its page, that one ends the page
    before, both have the same width and header, and the table has no caption.

    Lazy; ``keep(df, name)`` may store the two intermediate results that are read twice
    (``session.stage`` does).
    """
    facts = F.get(
        F.transform(
            F.array(H.table_grid(F.col("html"))),
            lambda g: F.struct(
                g.n_cols.alias("n_cols"),
                F.to_json(g["head"]).alias("signature"),
                F.size(g["head"]).alias("n_head"),
                F.size(g.body).cast("long").alias("n_body"),
            ),
        ),
        0,
    )
    fact = F.when(F.col("label") == "real_table", facts)
    tables = asset_rows(elements, numbers=False, carry=[("fact", fact)], width=width)
    tables = tables.filter("prefix = 't' AND fact.n_cols IS NOT NULL").select(
        "doc_id", "seq", "page", "caption", "fact.*"
    )
    tables = look_up(tables.filter("page IS NOT NULL"), page_edges(elements), ["doc_id", "page"])
    # n_head and caption are not asked of an earlier part; with them the totals of blocks read the same columns as the rows,
    # so Spark makes grids and captions once for both
    here = F.struct("seq", "page", "n_cols", "signature", (F.col("seq") == F.col("_bottom")).alias("ends"), "n_head", F.col("caption").isNull().alias("bare"), F.col("_top").alias("top"))
    tables = keep(tables.withColumn("_here", here), "tables")
    seen = running(tables, ["doc_id"], "seq", sums=["n_body"], lasts=["_here"], width=width)
    last = F.col("prev__here")
    continues = F.coalesce(
        (last.page == F.col("page") - 1)
        & last.ends
        & (F.col("seq") == F.col("_top"))
        & (last.n_cols == F.col("n_cols"))
        & (last.signature == F.col("signature"))
        & F.col("caption").isNull(),
        F.lit(False),
    )
    start = F.when(~continues, F.struct("seq", F.col("prev_n_body").alias("before")))
    chains = keep(
        seen.select("doc_id", "seq", "n_head", "prev_n_body", continues.alias("continues"), start.alias("_start")),
        "chains",
    )
    known = running(chains, ["doc_id"], "seq", lasts=["_start"], width=width)
    first = F.coalesce("_start", "prev__start")
    return known.select(
        "doc_id",
        "seq",
        first.seq.alias("stitched_id"),
        "continues",
        "n_head",
        (F.col("prev_n_body") - first.before).alias("row_offset"),
    )


def stitch_cells(grids: DataFrame, parts: DataFrame) -> DataFrame:
    """Cells of stitched tables: repeated headers dropped, rows renumbered.  Grids meet their
    parts before they are exploded."""
    whole = grids.join(parts.drop("n_head"), ["doc_id", "seq"])
    cells = table_cells(whole, "stitched_id", "continues", "row_offset").filter("NOT (continues AND is_header)")
    row = F.when(F.col("is_header"), F.col("row")).otherwise(F.col("row") + F.col("row_offset"))
    return cells.select("doc_id", "stitched_id", row.cast("long").alias("row"), "col", "is_header", "text")
