"""Write extracted tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrid.functions.html import header_names, table_grid
from leafgrid.operators.elements import once
from leafgrid.operators.tables import grid_rows, visuals


def named_grids(elements: DataFrame) -> DataFrame:
    """Grids of readable tables with the name of the file they belong to.

    Names need a look over the document, grids only their own row, so the two meet in
    one join on the element key, and the grid is made after it.
    """
    names = visuals(elements, shapes=False).filter("parsed_ok").select("doc_id", "seq", "name")
    tables = elements.filter(F.col("category").isin("table", "chart")).select("doc_id", "seq", "html")
    return tables.join(names, ["doc_id", "seq"]).select("doc_id", "seq", "name", once(table_grid(F.col("html")).alias("grid")))


def asset_cells(elements: DataFrame) -> DataFrame:
    """Cells with the name of their file."""
    rows = grid_rows(named_grids(elements), "name")
    cells = rows.select("doc_id", "seq", "name", "row", "is_header", F.posexplode_outer("cells").alias("col", "text"))
    return cells.filter("col IS NOT NULL")


def csv_line(cells):
    """Cells as one line of CSV, quoted where needed."""
    quoted = lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.array_join(F.transform(cells, lambda t: F.when(t.rlike('[",\r\n]'), quoted(t)).otherwise(t)), ",")


def asset_csv(elements: DataFrame) -> DataFrame:
    """Lines of each asset's CSV file (``doc_id, seq, name, row, line``); row 0 has the column names:
    the header levels joined, or the column numbers of a table without header."""
    grids = named_grids(elements)
    names = F.when(F.size("grid.head") > 0, header_names(F.col("grid"))).otherwise(
        F.transform(header_names(F.col("grid")), lambda t, i: i.cast("string"))
    )
    lines = F.concat(F.array(csv_line(names)), F.transform("grid.body", csv_line))
    lines = grids.select("doc_id", "seq", "name", once(F.when(F.col("grid").isNotNull(), lines).alias("lines")))
    return lines.select("doc_id", "seq", "name", F.posexplode("lines").alias("row", "line"))


def bucket(n_buckets: int):
    return F.pmod(F.xxhash64("doc_id", "seq"), F.lit(n_buckets)).cast("int")


def write_cells(cells: DataFrame, path: str, n_buckets: int = 64) -> None:
    """Parquet, one folder per bucket of tables instead of one file per table.

    The bucket hashes the table, not the document, so a huge document spreads out; adaptive
    execution splits and joins the write tasks by their size.
    """
    bucketed = cells.withColumn("bucket", bucket(n_buckets))
    bucketed.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(path)


def write_csv(lines: DataFrame, path: str) -> None:
    """Lines of ``asset_csv`` as text, one folder ``doc_id=.../name=...`` per asset.  All lines of a
    table come from one row, so they are in one file in their order."""
    ordered = lines.sortWithinPartitions("doc_id", "name", "row").select("doc_id", "name", "line")
    ordered.write.partitionBy("doc_id", "name").text(path)


def write_failures(elements: DataFrame, path: str) -> None:
    """Raw HTML of unreadable tables with the name of its fallback file."""
    failed = visuals(elements, shapes=False).filter("NOT parsed_ok").select("doc_id", "seq", "name")
    html = elements.filter(F.col("category").isin("table", "chart")).select("doc_id", "seq", "html")
    html.join(failed, ["doc_id", "seq"]).write.parquet(path)
