"""Files in, files out, and the streaming path."""

import json

import pytest
from pyspark.sql import functions as F

from leafgrid.operators import catalog, elements, paging, reports, tables
from leafgrid.plans import pipeline
from leafgrid.session import clear_stages, run_folder, shared_folder, stage
from leafgrid.sources import responses, sinks, store
from leafgrid.streaming import ingest

TABLE = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>"


def response(n):
    return {
        "model": "m",
        "usage": {"pages": 1, "credits": 3},
        "content": {"html": "h", "markdown": "m", "text": ""},
        "elements": [
            {"category": "caption", "page": 1, "content": {"markdown": "<표 1> 제목 %d" % n}, "coordinates": [{"x": 0.1, "y": 0.2}]},
            {"category": "table", "page": 1, "content": {"html": TABLE, "markdown": "| a |"}, "id": 7},
        ],
    }


@pytest.fixture
def folder(tmp_path):
    for n in range(3):
        (tmp_path / f"doc{n}.json").write_text(json.dumps(response(n), ensure_ascii=False))
    (tmp_path / "bad.json").write_text('{"model": "m", "elements": [')
    return tmp_path


def test_read_responses(spark, folder):
    df = responses.read_responses(spark, str(folder)).cache()
    assert responses.quarantine(df).count() == 1
    good = responses.valid(df).withColumn("doc_id", F.xxhash64("path"))
    rows = elements.attach_captions(elements.explode_elements(good)).collect()
    assert sorted(r.caption for r in rows) == ["제목 0", "제목 1", "제목 2"]


def test_multiline_responses(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(response(0), indent=2))
    df = responses.valid(responses.read_responses(spark, str(tmp_path), multiline=True).cache())
    assert df.select(F.size("elements")).first()[0] == 2


def test_no_field_is_lost(spark, tmp_path):
    texts = ['{"model": "m", "elements": [{"page": 1, "id": 7}], "x.y": {"a": [1, null]}, "n": 1.50}', "{broken", '{"model": null}', "[1]", ""]
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.json").write_text(t)
    raw = responses.read_raw(spark, str(tmp_path), multiline=True).withColumn("i", F.regexp_extract("path", r"(\d)\.json$", 1).cast("int"))
    both = responses.parse_responses(responses.with_variant(raw)).orderBy("i")
    rows = both.select("i", "model", F.col("_corrupt_record").isNotNull().alias("bad"), responses.response_field("$.elements[0].id", "int").alias("id"), responses.response_field("$['x.y'].a[0]", "int").alias("a"), responses.response_field("$.model", "int").alias("no"))
    got = {r.i: tuple(r)[1:] for r in rows.collect()}
    assert got[0] == ("m", False, 7, 1, None) and got[1][:2] == (None, True) and got[2] == (None, False, None, None, None)
    fields = responses.unnamed_fields(both.select("i", "response")).select("i", "field", F.to_json("value").alias("v")).collect()
    assert sorted(map(tuple, fields)) == [(0, "n", "1.5"), (0, "x.y", '{"a":[1,null]}')]


def files_of(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_store_rewrites_only_what_changes(spark, tmp_path):
    folder = tmp_path / "store"
    kinds = "sha16 string, mode string, response string, ts long"
    first = [("aa1", "enhanced", "r1", 1), ("aa2", "enhanced", "r2", 1), ("bb1", "01", "r3", 1), ("bb1", None, "r4", 1), ("cc1", "a/b=c", "r5", 1)]
    assert store.upsert_store(spark.createDataFrame(first, kinds), str(folder)) == 5
    before = files_of(folder)
    # one newer, one older, one equal, one new in a folder of its own, one key twice
    second = [("aa1", "enhanced", "new", 2), ("bb1", "01", "old", 0), ("cc1", "a/b=c", "r5", 1), ("dd1", "x", "r6", 1), ("dd1", "x", "r7", 3), ("bb1", "", "late", 5)]
    incoming = spark.createDataFrame(second, kinds)
    assert store.upsert_store(incoming, str(folder)) == 3
    after = files_of(folder)
    kept = {p for p in before if after.get(p) == before[p]}
    assert sum("prefix=aa" in p for p in kept) == 0 and any("mode=01" in p for p in kept) and any("prefix=cc" in p for p in kept)
    assert store.upsert_store(incoming, str(folder)) == 0 and files_of(folder) == after
    rows = {(r.sha16, r["mode"]): (r.response, r.ts) for r in store.read_store(spark, str(folder)).collect()}
    assert rows == {
        ("aa1", "enhanced"): ("new", 2), ("aa2", "enhanced"): ("r2", 1), ("bb1", "01"): ("r3", 1),
        ("bb1", None): ("late", 5), ("cc1", "a/b=c"): ("r5", 1), ("dd1", "x"): ("r7", 3),
    }
    assert store.read_store(spark, str(tmp_path / "none")).count() == 0


def test_catalog_of_a_folder(spark, folder):
    (folder / "sub").mkdir()
    (folder / "sub" / "x.PDF").write_bytes(b"pdf")
    df = catalog.catalog_documents(responses.read_catalog(spark, str(folder)))
    got = {(r.stem, r.reason) for r in df.collect()}
    assert ("x", None) in got and ("doc0", "unsupported_ext") in got
    sha = catalog.fingerprint_documents(responses.read_contents(spark, str(folder / "sub"))).first()
    assert sha.sha256.startswith(sha.sha16) and sha.sha16.startswith(sha.sha8)


def test_stream_equals_batch(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("stream")
    stream = ingest.element_stream(ingest.response_stream(spark, str(folder)))
    ingest.write_stream(stream, str(out / "rows"), str(out / "checkpoint")).awaitTermination()
    (folder / "late.json").write_text(json.dumps(response(9)))
    stream = ingest.element_stream(ingest.response_stream(spark, str(folder)))
    ingest.write_stream(stream, str(out / "rows"), str(out / "checkpoint")).awaitTermination()
    rows = spark.read.parquet(str(out / "rows")).collect()
    assert sorted((r.doc_id, r.seq, r.label) for r in rows) == sorted(
        (d, s, lab) for d in ("doc0", "doc1", "doc2", "late") for s, lab in ((0, "other"), (1, "real_table"))
    )


def test_write_assets(spark, make):
    df = make([(1, 0, 1, "caption", "<표 1> 제목", ""), (1, 1, 1, "table", "1", TABLE), (1, 2, 1, "chart", "", "<p>x</p>")])
    cells, failures, wide = (run_folder(spark, n) for n in ("cells", "failures", "wide"))
    sinks.write_cells(sinks.asset_cells(df), cells, n_buckets=4)
    assert {(r.name, r.row, r.col, r.text) for r in spark.read.parquet(cells).collect()} == {
        ("t00_p1_제목.csv", r, c, t) for r, c, t in ((0, 0, "a"), (0, 1, "b"), (1, 0, "1"), (1, 1, "2"))
    }
    sinks.write_failures(df, failures)
    assert [(r.name, r.html) for r in spark.read.parquet(failures).collect()] == [("c00_p1_제목.html", "<p>x</p>")]
    lines = sinks.asset_csv(df)
    sinks.write_csv(lines, wide)
    files = [(r.doc_id, r.name, r.value) for r in spark.read.text(wide).collect()]
    assert files == [(1, "t00_p1_제목.csv", "a,b"), (1, "t00_p1_제목.csv", "1,2")]
    quoted = make([(1, 0, 1, "table", "1", '<table><tr><td>x, y</td><td>say "hi"</td></tr></table>')])
    assert [r.line for r in sinks.asset_csv(quoted).orderBy("row").collect()] == ["0,1", '"x, y","say ""hi"""']


def test_shared_folder_is_the_one_of_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_pipeline(spark, make):
    df = make([(1, 0, 1, "caption", "<표 1> 제목", ""), (1, 1, 1, "table", "1", TABLE), (1, 2, 2, "table", "주: x", "")])
    docs = spark.createDataFrame([(1, "a.pdf", "s", None, 2, 2)], "doc_id long, name string, sha256 string, model string, usage_pages int, n_pages int")
    lazy = pipeline.extract(df, docs)
    out = pipeline.extract(df, docs, keep=stage)
    assert all(lazy[n].count() == out[n].count() for n in out)
    meta = json.loads(out["meta"].first().meta)
    assert meta == {
        "source": {"name": "a.pdf", "sha256": "s", "pages": 2},
        "model": "document-parse",
        "counts": {"tables": 1, "charts": 0, "figures": 0, "footnotes": 1},
        "footnotes": [{"page": 2, "markdown": "주: x"}],
        "boundary_cases": [],
        "files": [{"type": "table", "path": "t00_p1_제목.csv", "page": 1, "caption": "제목", "rows": 1, "cols": 2}],
        "figures": [],
    }
    assert out["assets"].count() == 1 and out["cells"].count() == 4 and out["footnotes"].count() == 1
    pages = reports.page_contents(docs, tables.visuals(df, figures=True)).collect()
    assert sorted((r.page, r.answer, r.entry) for r in pages) == [(1, "data", "t00_p1_제목.csv"), (2, "empty", "sources/p2.png")]


def test_incomplete_documents_are_left_out(spark):
    docs = spark.createDataFrame([(d, True, 5) for d in (1, 2, 3, 4)], "doc_id long, is_pdf boolean, n_pages int")
    rows = [(1, 0, 5, "a"), (1, 1, 5, "b"), (1, 2, 5, "c"), (1, 1, 9, "new"), (1, 1, 2, "old")]
    rows += [(2, 0, 1, "a"), (2, 0, 2, "a"), (2, 2, 1, "c")]  # as many as planned, but one is lost
    rows += [(3, c, 1, "x") for c in (0, 1, 2, 7)]
    got = spark.createDataFrame(rows, "doc_id long, chunk_no int, received_at long, body string")
    plan = paging.chunk_plan(docs, 2)
    found = {r.doc_id: (r.planned, r.received, r.missing, r.repeated, r.unplanned, r.failed) for r in paging.missing_chunks(plan, got).collect()}
    assert found == {
        1: (3, 3, 0, 1, 0, False),
        2: (3, 2, 1, 1, 0, True),
        3: (3, 3, 0, 0, 1, True),
        4: (3, 0, 3, 0, 0, True),
    }
    kept = pipeline.complete_responses(got, docs, 2).select("doc_id", "chunk_no", "body", "offset")
    assert sorted(tuple(r) for r in kept.collect()) == [(1, 0, "a", 0), (1, 1, "new", 2), (1, 2, "c", 4)]


def test_one_summary_row_however_long_the_document(spark):
    """Assets on both sides of a block border are one document with one summary."""
    html = "<table><tr><th>a</th></tr><tr><td>1</td></tr></table>"
    rows = [(1, s, 1, "table", "| a | 1 |", None, html) for s in (0, 5, 20_000, 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, seq int, page int, category string, markdown string, text string, html string")
    docs = spark.createDataFrame([(1, "a.pdf", "s", None, 2, 2)], "doc_id long, name string, sha256 string, model string, usage_pages int, n_pages int")
    assets = tables.visuals(df, figures=True, notes=True)
    got = reports.document_meta(docs, assets).collect()
    assert len(got) == 1
    meta = json.loads(got[0].meta)
    assert meta["counts"]["tables"] == 4 and [f["path"][:3] for f in meta["files"]] == ["t00", "t01", "t02", "t03"]
    items = reports.meta_items(assets).orderBy("seq").collect()
    assert [json.loads(r.item) for r in items if r.list == "files"] == meta["files"]


def test_a_summary_reads_its_assets_once(spark, make):
    """Entries and counts come from one pass; documents without assets have empty lists, null documents no summary."""
    html = "<table><tr><th>a</th></tr><tr><td>1</td></tr></table>"
    df = make([(1, 0, 1, "table", "| a | 1 |", html), (1, 1, 1, "chart", "x", ""), (1, 2, 1, "table", "주: b", html), (None, 0, 1, "table", "| a | 1 |", html)])
    rows = [(d, "a.pdf", "s", None, 2, 2) for d in (1, 2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, name string, sha256 string, model string, usage_pages int, n_pages int")
    got = reports.document_meta(docs, tables.visuals(df.where("seq >= 0"), figures=True, notes=True))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("collect_list(") == 1
    meta = {r.doc_id: json.loads(r.meta) for r in got.collect()}
    assert sorted(meta) == [1, 2]
    assert meta[1]["counts"] == {"tables": 1, "charts": 0, "figures": 0, "footnotes": 1}
    assert [len(meta[1][n]) for n in ("files", "boundary_cases", "footnotes", "figures")] == [1, 1, 1, 0]
    assert "fallback_path" in meta[1]["boundary_cases"][0] and meta[1]["files"][0]["caption"] is None
    assert meta[2]["counts"]["tables"] == 0 and meta[2]["files"] == []


def test_stages_are_cleared(spark):
    df = stage(spark.range(3), "some")
    assert df.count() == 3
    clear_stages(spark)
    with pytest.raises(Exception):
        df.count()
