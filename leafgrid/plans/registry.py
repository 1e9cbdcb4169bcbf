"""Every operator as a query over the given tables."""

from pyspark.sql import functions as F

from leafgrid import constants as K
from leafgrid.operators import analysis, cache, catalog, paging, quality, reports, stitch, tables
from leafgrid.operators import elements as E
from leafgrid.session import run_folder
from leafgrid.sources import fixtures as X
from leafgrid.sources import responses as R
from leafgrid.sources import sinks, store
from leafgrid.streaming import completeness

SEARCH_TERMS = ["src1", "SRC1-2", "src19-", "résumé", "src3-3.", "nothing like it", "-"]
CHART_COLUMNS = ["수량__합계", "수량__건수"]
THRESHOLDS = {"elements": 30, "raw_tables": 8, "raw_charts": 3, "assets": 7, "charts": 2}
QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# -- catalog and cache ---------------------------------------------------------------


@query
def catalog_documents(spark, sf):
    return catalog.catalog_documents(X.files(spark, sf)).drop("mtime")


@query
def fingerprint_documents(spark, sf):
    return catalog.fingerprint_documents(X.table(spark, sf, "documents").select("doc_id", "text"), "text")


@query
def search_documents(spark, sf):
    return catalog.search_documents(catalog.catalog_documents(X.files(spark, sf)), SEARCH_TERMS)


@query
def search_many(spark, sf):
    files = catalog.catalog_documents(X.files(spark, sf))
    return catalog.search_documents(files, X.many_terms(spark, sf))


@query
def recent_documents(spark, sf):
    return catalog.recent_documents(catalog.catalog_documents(X.files(spark, sf)))


@query
def read_responses(spark, sf):
    parsed = R.parse_responses(X.raw_responses(spark, sf))
    return parsed.select(
        "doc_id",
        "chunk_no",
        "model",
        F.col("usage.pages").alias("pages"),
        F.when(F.col("elements").isNotNull(), F.size("elements")).alias("n_elements"),
        F.length("content.markdown").alias("markdown_length"),
        F.col("_corrupt_record").isNotNull().alias("corrupt"),
    )


@query
def response_fields(spark, sf):
    parsed = R.parse_responses(R.with_variant(X.raw_responses(spark, sf)))
    return parsed.select(
        "doc_id",
        "chunk_no",
        "model",
        R.response_field("$.api_version", "int").alias("api_version"),
        R.response_field("$['ocr.state'].box[0].y", "double").alias("top"),
        R.response_field("$.elements[0].content.markdown", "string").alias("first_markdown"),
        F.col("_corrupt_record").isNotNull().alias("corrupt"),
    )


@query
def unnamed_fields(spark, sf):
    found = R.unnamed_fields(R.with_variant(X.raw_responses(spark, sf)).drop("raw"))
    return found.withColumn("value", F.to_json("value"))


@query
def cache_lookup(spark, sf):
    return cache.cache_lookup(X.requests(spark, sf), X.cached(spark, sf))


@query
def cache_misses(spark, sf):
    return cache.cache_misses(X.requests(spark, sf), X.cached(spark, sf))


@query
def cache_upsert(spark, sf):
    # stored, brought up to date, and once more, which changes nothing
    path = run_folder(spark, "cache")
    store.upsert_store(X.cached(spark, sf), path)
    store.upsert_store(X.new_entries(spark, sf), path)
    store.upsert_store(X.new_entries(spark, sf), path)
    return store.read_store(spark, path).drop("prefix")


@query
def latest_entries(spark, sf):
    return cache.cache_upsert(X.cached(spark, sf), X.new_entries(spark, sf))


@query
def stored_cache_lookup(spark, sf):
    path = run_folder(spark, "bucketed")
    name = path.rpartition("/")[2].replace("-", "_")
    store.save_bucketed(X.cached(spark, sf), name, path, buckets=8)
    return store.lookup_bucketed(X.requests(spark, sf), name, buckets=8)


# -- paging --------------------------------------------------------------------------


@query
def page_range_filter(spark, sf):
    found = paging.page_range_filter(X.elements(spark, sf), X.page_requests(spark, sf))
    return found.select("doc_id", "seq", "page", "slice_page")


@query
def page_ranges(spark, sf):
    return paging.page_ranges(X.page_requests(spark, sf))


@query
def chunk_plan(spark, sf):
    return paging.chunk_plan(X.documents_meta(spark, sf), X.CHUNK_PAGES)


def _chunks(spark, sf):
    plan = paging.chunk_plan(X.chunk_documents(spark, sf), X.CHUNK_PAGES)
    return paging.with_offsets(X.responses(spark, sf), plan)


@query
def merge_chunks(spark, sf):
    # a narrow block, so that documents cross its border
    return paging.merge_elements(_chunks(spark, sf), width=2).drop("text")


@query
def merge_contents(spark, sf):
    return paging.merge_contents(_chunks(spark, sf))


@query
def content_parts(spark, sf):
    return paging.content_parts(_chunks(spark, sf))


@query
def merge_headers(spark, sf):
    return paging.merge_headers(_chunks(spark, sf))


@query
def restore_page_offset(spark, sf):
    asked = X.page_requests(spark, sf)
    cut = paging.page_range_filter(X.elements(spark, sf), asked)
    cut = cut.select("doc_id", "seq", F.col("slice_page").alias("page"))
    return paging.restore_page_offset(cut, asked)


@query
def missing_chunks(spark, sf):
    plan = paging.chunk_plan(X.chunk_documents(spark, sf), X.CHUNK_PAGES)
    return paging.missing_chunks(plan, X.received_responses(spark, sf))


@query
def streamed_missing_chunks(spark, sf):
    start = F.timestamp_seconds(F.lit(X.START) + F.col("doc_id") % 100 * 60)
    plan = paging.chunk_plan(X.chunk_documents(spark, sf), X.CHUNK_PAGES).withColumn("at", start)
    received = X.received_responses(spark, sf).withColumn("at", start + F.expr("INTERVAL 1 MINUTE"))
    happened = completeness.events(plan, received)
    return completeness.closed(completeness.over_stored(happened, run_folder(spark, "completeness")))


# -- elements ------------------------------------------------------------------------


@query
def elements(spark, sf):
    return E.explode_elements(X.responses(spark, sf), keys=("doc_id", "chunk_no")).drop("text")


@query
def classify_elements(spark, sf):
    return E.classify_elements(X.elements(spark, sf)).select("doc_id", "seq", "page", "category", "label")


@query
def element_text(spark, sf):
    return X.elements(spark, sf).select("doc_id", "seq", E.element_text().alias("content"))


@query
def clean_captions(spark, sf):
    return E.clean_captions(X.elements(spark, sf))


@query
def attach_captions(spark, sf):
    return E.attach_captions(X.elements(spark, sf))


@query
def slug_assets(spark, sf):
    return E.slug_assets(X.elements(spark, sf))


@query
def number_assets(spark, sf):
    return E.number_assets(X.elements(spark, sf))


@query
def name_assets(spark, sf):
    return E.name_assets(X.elements(spark, sf))


@query
def footnotes(spark, sf):
    return E.footnotes(X.elements(spark, sf))


@query
def figures(spark, sf):
    return E.figures(X.elements(spark, sf))


@query
def label_distribution(spark, sf):
    return E.label_distribution(X.elements(spark, sf))


# -- tables --------------------------------------------------------------------------


def _grids(spark, sf):
    return tables.table_grids(X.elements(spark, sf))


@query
def table_cells(spark, sf):
    return tables.table_cells(_grids(spark, sf))


@query
def spanned_cells(spark, sf):
    return tables.table_cells(tables.table_grids(X.spanned_elements(spark, sf)))


@query
def wide_tables(spark, sf):
    # the first readable table of each document
    first = tables.visuals(X.elements(spark, sf), captions=False, shapes=False).where("prefix = 't' AND parsed_ok")
    first = first.groupBy("doc_id").agg(F.min("seq").alias("seq"))
    return tables.wide_tables(_grids(spark, sf), first, 5)


@query
def table_headers(spark, sf):
    return tables.table_headers(_grids(spark, sf))


@query
def typed_cells(spark, sf):
    return tables.typed_cells(tables.table_cells(_grids(spark, sf)))


@query
def table_shapes(spark, sf):
    return tables.table_shapes(_grids(spark, sf))


@query
def parse_failures(spark, sf):
    return tables.parse_failures(X.elements(spark, sf))


@query
def page_parse_failures(spark, sf):
    return tables.parse_failures(X.page_elements(spark, sf))


@query
def write_assets(spark, sf):
    path = run_folder(spark, "assets")
    sinks.write_cells(sinks.asset_cells(X.elements(spark, sf)), path, n_buckets=8)
    return spark.read.parquet(path).drop("bucket")


@query
def asset_csv(spark, sf):
    return sinks.asset_csv(X.elements(spark, sf))


@query
def write_failures(spark, sf):
    path = run_folder(spark, "failures")
    sinks.write_failures(X.elements(spark, sf), path)
    return spark.read.parquet(path)


@query
def stitch_tables(spark, sf):
    e = X.continued_elements(spark, sf)
    return stitch.stitch_cells(tables.table_grids(e), stitch.stitched_parts(e, width=16))


# -- reports -------------------------------------------------------------------------


def _assets(spark, sf, **more):
    return tables.visuals(X.elements(spark, sf), **more)


@query
def asset_list(spark, sf):
    return reports.asset_list(_assets(spark, sf))


@query
def document_counts(spark, sf):
    return reports.document_counts(X.documents_meta(spark, sf), X.elements(spark, sf))


@query
def page_map(spark, sf):
    return reports.page_map(X.documents_meta(spark, sf), X.elements(spark, sf))


@query
def visual_pages(spark, sf):
    return reports.visual_pages(X.elements(spark, sf))


@query
def index_rows(spark, sf):
    return reports.index_rows(_assets(spark, sf, figures=True))


@query
def document_meta(spark, sf):
    assets = _assets(spark, sf, figures=True, notes=True)
    return reports.document_meta(X.documents_meta(spark, sf), assets)


@query
def meta_items(spark, sf):
    return reports.meta_items(_assets(spark, sf, figures=True, notes=True))


@query
def top_assets(spark, sf):
    assets = _assets(spark, sf, shapes=False, figures=True)
    return reports.top_assets(assets, tables=3, charts=2, figures=1)


@query
def boundary_report(spark, sf):
    return reports.boundary_report(_assets(spark, sf, shapes=False))


@query
def boundary_reasons(spark, sf):
    return reports.boundary_reasons(_assets(spark, sf, shapes=False))


@query
def page_contents(spark, sf):
    assets = _assets(spark, sf, shapes=False, figures=True)
    return reports.page_contents(X.documents_meta(spark, sf), assets)


# -- quality -------------------------------------------------------------------------


@query
def golden_cells(spark, sf):
    return quality.golden_cells(X.golden_numbers(spark, sf), X.elements(spark, sf))


@query
def golden_substrings(spark, sf):
    return quality.golden_substrings(X.golden_strings(spark, sf), X.elements(spark, sf))


@query
def find_substrings(spark, sf):
    found = quality.find_substrings(X.many_strings(spark, sf), X.elements(spark, sf).filter("seq % 3 = 1"))
    return found.groupBy("wanted").agg(F.count(F.lit(1)).alias("n_tables"), F.max("doc_id").alias("last_doc"))


@query
def largest_table_on_page(spark, sf):
    pages = X.documents_meta(spark, sf).select(
        "doc_id", F.explode(F.sequence(F.lit(1), F.col("n_pages"))).alias("page")
    )
    return quality.largest_table_on_page(pages, X.elements(spark, sf), min_rows=5, min_cols=4)


@query
def match_table_by_columns(spark, sf):
    return quality.match_table_by_columns(_grids(spark, sf), CHART_COLUMNS)


@query
def hangul_retained(spark, sf):
    return quality.hangul_retained(_grids(spark, sf))


@query
def text_integrity(spark, sf):
    return quality.text_integrity(X.texts(spark, sf), min_hangul=200)


@query
def volume_thresholds(spark, sf):
    return quality.volume_thresholds(X.elements(spark, sf), THRESHOLDS)


@query
def silent_drop_check(spark, sf):
    e = X.elements(spark, sf)
    return quality.silent_drop_check(e, X.kept_boundaries(tables.parse_failures(e)))


def _rollup(spark, sf):
    e = X.elements(spark, sf)
    strings = quality.golden_substrings(X.golden_strings(spark, sf), e)
    numbers = quality.golden_cells(X.golden_numbers(spark, sf), e)
    volumes = quality.volume_thresholds(e, THRESHOLDS)
    checks = (
        strings.select("doc_id", F.lit("complex_table").alias("scenario"), "passed")
        .unionByName(numbers.select("doc_id", F.lit("chart_to_data").alias("scenario"), F.col("hit").alias("passed")))
        .unionByName(volumes.select("doc_id", F.lit("volumes").alias("scenario"), "passed"))
    )
    names = F.array(*map(F.lit, ["complex_table", "chart_to_data", "volumes", "unchecked"]))
    scenarios = X.documents_meta(spark, sf).select("doc_id", F.explode(names).alias("scenario"))
    return quality.eval_rollup(scenarios, checks)


@query
def eval_rollup(spark, sf):
    return _rollup(spark, sf)


@query
def eval_totals(spark, sf):
    return quality.eval_totals(_rollup(spark, sf))


@query
def mask_secrets(spark, sf):
    return quality.mask_secrets(X.messages(spark, sf))


@query
def description_loops(spark, sf):
    found = E.figures(X.elements(spark, sf)).select(
        F.lit("figures").alias("origin"), "doc_id", "seq", F.col("description").alias("text")
    )
    whole = X.table(spark, sf, "documents").select(
        F.lit("documents").alias("origin"), "doc_id", F.lit(0).alias("seq"), "text"
    )
    stuck = X.stuck_texts(spark, sf).select(F.lit("stuck").alias("origin"), "doc_id", F.lit(0).alias("seq"), "text")
    return quality.description_loops(found.unionByName(whole).unionByName(stuck), share=0.05)


# -- follow-up analysis --------------------------------------------------------------


@query
def compare_series(spark, sf):
    return analysis.compare_series(_grids(spark, sf), 1, *CHART_COLUMNS)


@query
def period_change(spark, sf):
    grids = tables.table_grids(X.period_elements(spark, sf).filter("seq < 2"))
    return analysis.period_change(analysis.period_columns(grids))


@query
def period_rows(spark, sf):
    grids = tables.table_grids(X.period_elements(spark, sf).filter("seq = 2"))
    return analysis.period_change(analysis.period_rows(grids))


@query
def normalize_numbers(spark, sf):
    return analysis.normalize_numbers(X.written_numbers(spark, sf))


@query
def unit_rows(spark, sf):
    return analysis.unit_rows(tables.table_grids(X.elements_with_units(spark, sf)))


@query
def unit_cells(spark, sf):
    return analysis.unit_cells(tables.table_grids(X.elements_with_units(spark, sf)))


@query
def parse_cost(spark, sf):
    looked_up = cache.cache_hits(X.requests(spark, sf), X.cached(spark, sf))
    return cache.parse_cost(looked_up, X.request_pages(spark, sf), K.PAGE_RATES)
