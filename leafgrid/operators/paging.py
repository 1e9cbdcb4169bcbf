"""Page ranges, chunk plans and the merge of chunked responses."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrid import constants as K
from leafgrid.functions.joins import look_up
from leafgrid.functions.prefix import BLOCK, running
from leafgrid.functions.text import strip
from leafgrid.operators.elements import explode_elements

def _whole_number(text: Column) -> Column:
    return F.when(text.rlike("^[+-]?[0-9]+$"), text).try_cast("int")


def page_ranges(requests: DataFrame) -> DataFrame:
    """Resolve ``spec`` (``a-b`` or ``n``) of ``doc_id, is_pdf, n_pages, spec``.

    ``status``: ``all`` (no range asked, or not a PDF), ``range`` or ``invalid``.
    """
    spec = F.col("spec")
    first = _whole_number(strip(F.substring_index(spec, "-", 1)))
    rest = strip(F.regexp_replace(spec, "(?s)^[^-]*-", ""))
    last = F.when(spec.contains("-"), _whole_number(rest)).otherwise(first)
    ranges = requests.withColumn("_a", first).withColumn("_b", last)
    fits = (F.col("_a") >= 1) & (F.col("_b") <= F.col("n_pages")) & (F.col("_a") <= F.col("_b"))
    status = (
        F.when(spec.isNull() | ~F.col("is_pdf"), "all").when(fits, "range").otherwise("invalid")
    )
    ranged = F.col("status") == "range"
    return ranges.withColumn("status", status).select(
        "doc_id",
        "status",
        F.when(ranged, F.col("_a")).alias("start"),
        F.when(ranged, F.col("_b")).alias("end"),
        F.when(ranged, F.col("_a") - 1).otherwise(0).alias("offset"),
    )


def page_range_filter(elements: DataFrame, requests: DataFrame) -> DataFrame:
    """Elements of the asked pages; ``slice_page`` counts from the start of the slice.

    Documents with an invalid range give nothing (see ``page_ranges`` for the status).
    """
    ranges = page_ranges(requests).filter("status <> 'invalid'")
    inside = (F.col("status") == "all") | F.col("page").between(F.col("start"), F.col("end"))
    return (
        look_up(elements, ranges, ["doc_id"])
        .filter(inside)
        .select(*elements.columns, (F.col("page") - F.col("offset")).alias("slice_page"))
    )


def restore_page_offset(sliced: DataFrame, requests: DataFrame) -> DataFrame:
    """Give the elements of a slice the page numbers of the whole document."""
    ranges = page_ranges(requests).select("doc_id", "offset")
    page = (F.col("page") + F.col("offset")).alias("page")
    columns = [page if c == "page" else F.col(c) for c in sliced.columns]
    return look_up(sliced, ranges, ["doc_id"]).select(*columns)


def chunk_plan(documents: DataFrame, size: int = K.CHUNK_PAGES) -> DataFrame:
    """Page ranges in which each document is parsed (``doc_id, is_pdf, n_pages``)."""
    whole = ~F.col("is_pdf") | (F.col("n_pages") <= size)
    starts = F.when(whole, F.array(F.lit(1))).otherwise(
        F.sequence(F.lit(1), F.greatest(F.col("n_pages"), F.lit(1)), F.lit(size))
    )
    rows = documents.select("doc_id", "n_pages", whole.alias("_whole"), F.posexplode(starts).alias("chunk_no", "start"))
    last = F.when(F.col("_whole"), F.col("n_pages")).otherwise(
        F.least(F.col("start") + size - 1, F.col("n_pages"))
    )
    return rows.select("doc_id", "chunk_no", "start", last.alias("end"), (F.col("start") - 1).alias("offset"))


def with_offsets(responses: DataFrame, plan: DataFrame) -> DataFrame:
    return responses.join(plan.select("doc_id", "chunk_no", "offset"), ["doc_id", "chunk_no"])


def merge_elements(chunks: DataFrame, width: int = BLOCK) -> DataFrame:
    """Elements of all chunks of a document in one numbering (chunks carry ``offset``).

    The first position of a chunk is the running size of the chunks before it.  Only the sizes
    go through the window; the elements meet their start in one join on the chunk.
    """
    size = F.when(F.col("elements").isNotNull(), F.size("elements")).otherwise(0).cast("long")
    sizes = chunks.select("doc_id", "chunk_no", size.alias("_n"))
    starts = running(sizes, ["doc_id"], "chunk_no", sums=["_n"], width=width)
    starts = starts.select("doc_id", "chunk_no", F.col("prev__n").alias("_start"))
    shift = chunks.select(
        "doc_id",
        "chunk_no",
        F.transform(
            "elements", lambda e: e.withField("page", e.page + F.col("offset"))
        ).alias("elements"),
    ).join(starts, ["doc_id", "chunk_no"])
    return explode_elements(shift, F.col("_start"))


def content_parts(chunks: DataFrame) -> DataFrame:
    """What each chunk adds to the text, markdown and HTML of its document, in chunk order:
    each non-empty part and a blank line.  The form to store for very long documents."""
    part = lambda f: F.concat(F.nullif(F.col(f"content.{f}"), F.lit("")), F.lit("\n\n"))
    return chunks.select("doc_id", "chunk_no", *[part(f).alias(f) for f in ("html", "markdown", "text")])


def merge_contents(chunks: DataFrame) -> DataFrame:
    """Whole-document text, markdown and HTML: one row per document, whatever its size."""

    def joined(field):
        parts = F.array_sort(F.collect_list(F.when(F.col(field).isNotNull(), F.struct("chunk_no", F.col(field).alias("p")))))
        return F.array_join(F.transform(parts, lambda s: s.p), "").alias(field)

    return content_parts(chunks).groupBy("doc_id").agg(joined("html"), joined("markdown"), joined("text"))


def merge_headers(chunks: DataFrame) -> DataFrame:
    """Model and page count of each document: last model that is named, sum of pages."""
    named = F.nullif(F.col("model"), F.lit(""))
    return chunks.groupBy("doc_id").agg(
        F.max_by(named, F.when(named.isNotNull(), F.col("offset"))).alias("model"),
        F.coalesce(F.sum("usage.pages"), F.lit(0)).alias("pages"),
    )


def latest_responses(responses: DataFrame) -> DataFrame:
    """The latest response (largest ``received_at``) of each (doc_id, chunk_no); equal times
    keep the larger hash.  The choice is made on keys and times alone."""
    keys = ["doc_id", "chunk_no"]
    rows = responses.withColumn("_at", F.struct("received_at", F.xxhash64(*[c for c in responses.columns]).alias("h")))
    last = rows.groupBy(*keys).agg(F.max("_at").alias("_last"))
    return look_up(rows, last, keys).filter("_at = _last").select(*responses.columns)


def missing_chunks(plan: DataFrame, responses: DataFrame) -> DataFrame:
    """Documents whose responses are not one per planned chunk.

    ``received`` counts planned chunks that arrived, so a repeated chunk does not stand for a lost one;
    ``missing``, ``repeated`` and ``unplanned`` count chunks.  Lost or unplanned chunks are failures.
    Both sides become rows of one aggregate per chunk, so no join is needed.
    """
    sides = plan.select("doc_id", "chunk_no", F.lit(1).alias("p"), F.lit(0).alias("r")).unionByName(
        responses.select("doc_id", "chunk_no", F.lit(0).alias("p"), F.lit(1).alias("r"))
    )
    chunks = sides.groupBy("doc_id", "chunk_no").agg(F.max("p").alias("p"), F.sum("r").alias("r"))
    counts = chunks.groupBy("doc_id").agg(
        F.sum("p").cast("long").alias("planned"),
        F.count_if(F.expr("p = 1 AND r > 0")).alias("received"),
        F.count_if(F.expr("p = 1 AND r = 0")).alias("missing"),
        F.count_if(F.expr("r > 1")).alias("repeated"),
        F.count_if(F.expr("p = 0")).alias("unplanned"),
    )
    failed = (F.col("missing") > 0) | (F.col("unplanned") > 0)
    return counts.filter("planned > 0 AND missing + repeated + unplanned > 0").withColumn("failed", failed)
