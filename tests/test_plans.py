"""What the plans must keep: few shuffles, no Python in the hot path, hot keys spread."""

import re

import pytest
from pyspark.sql import functions as F

from leafgrid.operators import cache, catalog, elements, paging, quality, reports, stitch, tables
from leafgrid.plans import pipeline
from leafgrid.session import stage
from leafgrid.sources import fixtures as X
from leafgrid.sources import store


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """One document holds most elements, as the worst case of a hot key."""
    html = F.when(F.col("id") % 3 == 0, "<table><tr><th>a</th></tr><tr><td>1</td></tr></table>").otherwise("")
    df = spark.range(60000).select(
        F.when(F.col("id") < 40000, 0).otherwise(F.col("id") % 500 + 1).cast("long").alias("doc_id"),
        F.when(F.col("id") < 40000, F.col("id")).otherwise(F.floor((F.col("id") - 40000) / 500)).cast("int").alias("seq"),
        (F.col("id") % 50).cast("int").alias("page"),
        F.when(F.col("id") % 3 == 0, "table").otherwise("paragraph").alias("category"),
        F.lit("1").alias("markdown"),
        F.lit(None).cast("string").alias("text"),
        html.alias("html"),
    )
    path = str(tmp_path_factory.mktemp("stored") / "elements")
    df.repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange (?:hash|range|single|round)", plan(df)))


def test_captions_take_one_shuffle(stored):
    assert shuffles(elements.attach_captions(stored)) == 1


def test_cells_and_headers_take_none(stored):
    grids = tables.table_grids(stored)
    for df in (tables.table_cells(grids), tables.table_headers(grids), tables.table_shapes(grids)):
        assert shuffles(df) == 0
        assert plan(df).count("(?i)</?[a-z!]") == 1, "the grid is computed once"


def test_page_map_aggregates_before_the_shuffle(spark, stored):
    docs = spark.createDataFrame([(0, 5)], "doc_id long, usage_pages int")
    text = plan(reports.page_map(docs, stored))
    assert "partial_count_if" in text or "partial_count" in text


def test_scans_read_only_what_they_need(stored):
    schema = re.findall(r"ReadSchema: (\S+)", plan(elements.number_assets(stored)))
    assert all("html" not in s and "text:" not in s.replace("markdown", "") for s in schema)
    assert "PushedFilters: [In(category, [chart,table])" in plan(tables.table_cells(tables.table_grids(stored)))


def test_python_only_runs_for_slugs(stored):
    assert "ArrowEvalPython" in plan(elements.slug_assets(stored))
    for df in (elements.attach_captions(stored), elements.number_assets(stored), tables.table_cells(tables.table_grids(stored))):
        assert "Python" not in plan(df)


def test_a_hot_document_is_spread(spark, stored):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        rows = elements.asset_rows(stored, width=1000).withColumn("task", F.spark_partition_id())
        parts = rows.filter("doc_id = 0").groupBy("task")
        hot = parts.agg(F.count("doc_id").alias("n"), F.max("index"), F.max("caption")).collect()
        assert sum(r.n for r in hot) == 13334
        assert len(hot) > 12 and max(r.n for r in hot) < 13334 / 4
        last = rows.filter("doc_id = 0").agg(F.max("index"), F.count_distinct("index")).first()
        assert tuple(last) == (13333, 13334)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_top_lists_are_cut_before_the_shuffle(spark):
    files = spark.range(1000).select(
        F.format_string("/f/x%d.pdf", "id").alias("path"), F.lit(1).alias("size_bytes"), F.timestamp_seconds("id").alias("mtime")
    )
    known = catalog.catalog_documents(files)
    for df in (catalog.recent_documents(known), catalog.search_documents(known, ["x"])):
        text = plan(df)
        assert "WindowGroupLimit" in text and "Partial" in text
    assert [r.n_matches for r in catalog.search_documents(known, ["x99"]).collect()] == [11] * 10


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k",
}


@pytest.fixture
def skew(spark):
    before = {k: spark.conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def requests(spark):
    """Most requests carry one text; the mode is a real column."""
    return spark.range(0, 400000, 1, 4).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 10 < 7, "hot").otherwise(F.col("id").cast("string")).alias("sha16"),
        F.when(F.col("id") % 10 < 9, "enhanced").otherwise("standard").alias("mode"),
    )


@pytest.fixture(scope="module")
def entries(requests):
    return requests.filter("doc_id % 2 = 0").select(
        "sha16", "mode", F.col("doc_id").cast("string").alias("response"), F.col("doc_id").alias("ts")
    )


def test_a_hot_hash_is_split(skew, requests, entries):
    for look in (cache.cache_lookup, cache.cache_hits):
        found = look(requests, entries)
        rows = found.collect()
        assert len(rows) == 400000 and sum(r.hit for r in rows) > 280000
        assert "skew=true" in plan(found)
    missed = cache.cache_misses(requests, entries)
    assert len(missed.collect()) < 120000
    assert "skew=true" in plan(missed)


def test_a_hot_document_of_requests_is_split(spark, skew):
    rows = spark.range(0, 300000, 1, 4).select(
        F.when(F.col("id") < 250000, 0).otherwise(F.col("id")).cast("long").alias("doc_id"),
        F.col("id").cast("int").alias("seq"),
        (F.col("id") % 9 + 1).cast("int").alias("page"),
    )
    asked = spark.range(300000).select(
        F.col("id").alias("doc_id"), F.lit(True).alias("is_pdf"), F.lit(9).alias("n_pages"), F.lit("2-3").alias("spec")
    )
    asked = asked.groupBy("doc_id").agg(F.first("is_pdf").alias("is_pdf"), F.max("n_pages").alias("n_pages"), F.max("spec").alias("spec"))
    found = paging.page_range_filter(rows, asked)
    assert len(found.collect()) == rows.filter("page IN (2, 3)").count()
    assert "skew=true" in plan(found)


def test_a_bucketed_cache_is_not_shuffled(spark, skew, requests, entries, tmp_path):
    store.save_bucketed(entries, "bucketed_entries", str(tmp_path / "entries"), buckets=8)
    found = store.lookup_bucketed(requests, "bucketed_entries", buckets=8)
    lines = plan(found).splitlines()
    scan = next(i for i, x in enumerate(lines) if "Scan parquet" in x and "SelectedBucketsCount: 8 out of 8" in x)
    join = max(i for i, x in enumerate(lines[:scan]) if "Join" in x)
    branch = []
    depth = lambda x: len(re.match(r"[ :|+*()0-9-]*", x).group())
    at, level = scan, depth(lines[scan])
    while at > join:
        at -= 1
        if depth(lines[at]) < level:
            branch.append(lines[at])
            level = depth(lines[at])
    assert "Join" in branch[-1] and not any("Exchange" in x for x in branch)
    rows = found.collect()
    assert "skew=true" in plan(found)
    assert len(rows) == 400000
    key = lambda r: r.doc_id
    assert sorted(rows, key=key) == sorted(cache.cache_lookup(requests, entries).collect(), key=key)
    spark.sql("DROP TABLE bucketed_entries")


def test_many_terms_are_not_compared_with_every_text(spark):
    files = spark.range(20000).select(
        F.concat(F.lit("/a/report-"), F.hex(F.col("id") * 7919), F.lit(".pdf")).alias("path"), F.lit(1).alias("size_bytes"), F.lit(0).cast("timestamp").alias("mtime")
    )
    known = catalog.catalog_documents(files)
    terms = spark.range(100000).select(F.hex(F.col("id") * 13).alias("term"))
    found = catalog.search_documents(known, terms)
    text = plan(found)
    assert "Cartesian" not in text and "NestedLoop" not in text
    found = found.where("n_matches > 0").collect()
    stems = [f"report-{i * 7919:X}".lower() for i in range(20000)]
    some = [f"{i * 13:X}" for i in range(0, 100000, 997)]
    want = {t: n for t in some if (n := sum(t.lower() in s for s in stems))}
    got = {r.term: r.n_matches for r in found if r.term in set(some)}
    assert got == want and len(found) > 100


def test_terms_as_rows_give_what_a_list_gives(spark):
    names = ["Résumé 1", "re\u0301sume\u0301 2", "x", "", "aé b", "ÉÉ", "표 1", "a.b", "aa", "aaa"]
    rows = [(f"/d{k}/{n}.pdf", 1, None) for k in range(3) for n in names] + [("/d0/x.pdf", 1, None)]
    known = catalog.catalog_documents(spark.createDataFrame(rows, "path string, size_bytes long, mtime timestamp"))
    terms = ["RÉSUMÉ", "é", "", "x", "a", "aa", "aaa", "aaaa", "표 1", " ", ".", "é b", "no such", "éé"]
    key = lambda r: (r.term, r["rank"] or 0)
    few = sorted(catalog.search_documents(known, terms, 4).collect(), key=key)
    many = spark.createDataFrame([(t,) for t in [*terms, "x", None]], "term string")
    assert sorted(catalog.search_documents(known, many, 4).collect(), key=key) == few


def payload_nodes(df, column):
    """Aggregates and windows of the plan that hold a column."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in text.splitlines() if re.search("Aggregate|Window", x) and column in x.split("Arguments")[0]]


def test_payloads_stay_out_of_aggregates(spark, requests, entries):
    assert not payload_nodes(cache.cache_hits(requests, entries), "response#")
    lookup = cache.cache_lookup(requests, entries)
    # only entries equal in key, time and hash are reduced by their text
    assert all("ts#" in x for x in payload_nodes(lookup, "first(response"))
    schema = "doc_id long, chunk_no int, offset int, elements array<struct<category:string,page:int,content:struct<html:string,markdown:string,text:string>>>"
    chunks = spark.createDataFrame([(1, 0, 0, None)], schema)
    assert not payload_nodes(paging.merge_elements(chunks), "elements#")


def test_golden_keys_meet_the_elements_before_the_grid(spark, stored):
    golden = spark.createDataFrame([(0, 3, "1", "a", 1.0, 0.1)], "doc_id long, seq int, row_label string, col_name string, expected double, tol double")
    text = plan(quality.golden_cells(golden, stored))
    semi = text.index("LeftSemi")
    assert text.index("(?i)</?[a-z!]") < semi, "the grid is made above the semi join"


def test_reports_read_the_html_once(spark, stored):
    docs = spark.createDataFrame([(0, "n", "s", "m", 5, 5)], "doc_id long, name string, sha256 string, model string, usage_pages int, n_pages int")
    kept = []
    out = pipeline.extract(stored, docs, keep=lambda df, name: kept.append(stage(df, name)) or kept[-1])
    for name in ("assets", "counts", "page_map", "index", "meta", "boundary_cases", "footnotes", "figures"):
        assert "html" not in "".join(re.findall(r"ReadSchema: (\S+)", plan(out[name]))), name
    assert out["counts"].first().tables == 13334


def test_building_a_query_starts_no_job(spark):
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "lazy")
    stitch.stitched_parts(X.continued_elements(spark, "/root/testdata/sf0.001"))
    assert not [j for j in seen.getJobIdsForGroup("lazy") if (seen.getJobInfo(j) or None) and len(seen.getJobInfo(j).stageIds) > 1]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_no_query_multiplies_its_inputs(spark):
    from leafgrid.plans.registry import QUERIES

    lazy = [q for n, q in QUERIES.items() if n not in ("write_assets", "write_failures")]
    for query in lazy:
        text = plan(query(spark, "/root/testdata/sf0.001"))
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def reusing_plan(spark, df):
    """The plan with shared shuffles; adaptive execution would only find them as it runs."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_label_trims_its_text_once(stored):
    text = elements.classify_elements(stored)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("trim(") == 1


def test_checks_of_the_same_tables_parse_them_once(spark, stored):
    asked = stored.filter("seq % 3 = 1").select("doc_id", "seq")
    numbers = asked.select("*", F.lit("a").alias("row_label"), F.lit("b").alias("col_name"), F.lit(1.0).alias("expected"), F.lit(0.1).alias("tol"))
    strings = asked.select("*", F.array(F.lit("1")).alias("wanted"))
    both = quality.golden_cells(numbers, stored).select("doc_id", "hit").unionByName(
        quality.golden_substrings(strings, stored).select("doc_id", F.col("passed").alias("hit"))
    )
    assert reusing_plan(spark, both).count("Generate inline(array(struct(grid") == 1


def test_stitching_measures_each_table_once(spark, stored):
    text = reusing_plan(spark, stitch.stitched_parts(stored))
    assert text.count("Generate inline(array(struct(_facts") == 1
