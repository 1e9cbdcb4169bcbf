"""Document-shaped inputs that Spark derives from the given tables.

Orders become layout elements (one customer is one document, two orders to a page), line
items become the HTML tables in them.  ``documents`` gives files, requests and texts.
Seeded faults (cut JSON, lost chunks, wrong golden values) make the checks fail where
they should.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrid.functions.prefix import running

CHUNK_PAGES = 4
START = 1704067200  # 2024-01-01 UTC
KEY_BLOCK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def order_lines(spark, sf_dir) -> DataFrame:
    """Lines of each order: number, summed quantity, rows.  The first aggregate leaves
    at most one row per line number, so the list per order is short even for a hot key."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty"), F.count(F.lit(1)).alias("n")
    )
    item = F.struct(F.col("l_linenumber").alias("no"), "qty", "n")
    return lines.groupBy(F.col("l_orderkey").alias("ok")).agg(F.array_sort(F.collect_list(item)).alias("lines"))


def placed_orders(spark, sf_dir) -> DataFrame:
    """Orders with their position ``i`` among the orders of the customer."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"),
        F.col("o_orderkey").alias("ok"),
        F.col("o_orderpriority").alias("pr"),
        F.lit(1).alias("one"),
    )
    placed = running(orders, ["doc_id"], "ok", sums=["one"], width=KEY_BLOCK)
    return placed.select(
        "doc_id",
        "ok",
        "pr",
        (F.col("ok") % 10).cast("int").alias("k"),
        F.col("prev_one").cast("int").alias("i"),
        (F.floor(F.col("prev_one") / 2) + 1).cast("int").alias("page"),
    )


def order_tables(spark, sf_dir) -> DataFrame:
    """Orders with their lines.  The explicit partitioning is the one the join needs; it
    also keeps small inputs from ending up in one task."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = placed_orders(spark, sf_dir).repartition(n, "ok")
    return placed.join(order_lines(spark, sf_dir), "ok", "left")


def elements(spark, sf_dir) -> DataFrame:
    """Three elements per order: title, visual, trailing paragraph or footnote table."""
    ok, k, pr, i = F.col("ok"), F.col("k"), F.col("pr"), F.col("i")
    s = lambda c: c.cast("string")
    none = F.lit("")
    row_html = F.transform(
        "lines",
        lambda l, n: _text(
            "<tr>",
            F.when(n == 0, _text('<td rowspan="', s(F.size("lines")), '">주문</td>')).otherwise(""),
            "<td>", s(l.no), "</td><td>", s(l.qty), "</td><td>", s(l.n), "</td></tr>",
        ),
    )
    row_md = F.transform(
        "lines", lambda l: _text("| 주문 | ", s(l.no), " | ", s(l.qty), " | ", s(l.n), " |")
    )
    rows = order_tables(spark, sf_dir).select(
        "doc_id", "ok", "k", "pr", "i", "page",
        F.coalesce(F.array_join(row_html, ""), none).alias("bh"),
        F.coalesce(F.array_join(row_md, ""), none).alias("bm"),
    )
    bh, bm = F.col("bh"), F.col("bm")
    variant = F.floor(ok / 10) % 3
    head = (
        '<table><thead><tr><th rowspan="2">구분</th><th rowspan="2">항목</th><th colspan="2">수량</th></tr>'
        "<tr><th>합계</th><th>건수</th></tr></thead><tbody>"
    )
    # one header row, upper-case tags, attributes, a comment, a hidden row
    single = (
        '<TABLE class="t"><!-- x > y --><TR><TH scope="col">구분</TH><TH>항목</TH><TH>합계</TH><TH>건수</TH></TR>'
        '<tbody><tr style="display: none"><td>숨김</td></tr>'
    )
    # no Hangul, a numeric character reference
    english = "<table><thead><tr><th>kind</th><th>line</th><th>sum</th><th>count</th></tr></thead><tbody>"
    whole = (
        F.when(variant == 0, _text(head, bh, "</tbody></table>"))
        .when(variant == 1, _text(single, bh, "</tbody></TABLE>"))
        .otherwise(_text(english, F.replace(bh, F.lit("주문"), F.lit("&#111;rder")), "</tbody></table>"))
    )
    figure = _text(
        '<figure><figcaption><p class="figure-type">diagram, ', pr,
        '</p><p class="figure-description">흐름 흐름 흐름 | ', s(ok), "</p></figcaption></figure>",
    )
    long_title = " 긴 제목" * 9
    title = F.struct(
        (i * 3).alias("seq"),
        F.when(ok % 3 == 0, "caption").when(ok % 3 == 1, "heading1").otherwise("paragraph").alias("category"),
        F.when(ok % 3 == 0, _text("<표 ", s(ok), "> ", pr, " 주문"))
        .when(ok % 3 == 1, _text("# ", pr, F.when(ok % 4 == 0, long_title).otherwise("")))
        .otherwise(_text("본문 ", pr))
        .alias("markdown"),
        none.alias("html"),
    )
    visual = F.struct(
        (i * 3 + 1).alias("seq"),
        F.when(k.isin(5, 6), "chart").when(k == 8, "figure").otherwise("table").alias("category"),
        F.when(k == 7, _text("| 단위: 조원<br>a<br>b<br>c |", bm))
        .when(k == 8, "")
        .when(k == 9, "| " + " ".join(["설명문"] * 13) + " |")
        .otherwise(_text("| 구분 | 항목 | 합계 | 건수 |", bm))
        .alias("markdown"),
        F.when(k == 6, "<figure><p>no data</p></figure>")
        .when(k == 8, figure)
        .when(bh == "", "<table></table>")
        .otherwise(whole)
        .alias("html"),
    )
    note = ok % 4 == 0
    trailing = F.struct(
        (i * 3 + 2).alias("seq"),
        F.when(note, "table").otherwise("paragraph").alias("category"),
        F.when(note, "| 주: | 합계 기준 |").otherwise(_text("문단 ", pr)).alias("markdown"),
        F.when(note, "<table><tr><td>주:</td><td>합계 기준</td></tr></table>").otherwise("").alias("html"),
    )
    out = rows.select("doc_id", "page", F.inline(F.array(title, visual, trailing)))
    return out.select(
        "doc_id", "seq", "page", "category", "markdown", F.lit(None).cast("string").alias("text"), "html"
    )


def continued_elements(spark, sf_dir) -> DataFrame:
    """Elements of which some tables start or end their page: the second order of a page loses its
    last element, the first one its title, or the title is a page header."""
    i = F.expr("seq div 3")
    kind, case = F.col("seq") % 3, F.col("doc_id") + i
    title = (kind == 0) & (i % 2 == 0)
    gone = (title & (case % 4 > 1)) | ((kind == 2) & (i % 2 == 1) & (case % 3 != 0))
    e = elements(spark, sf_dir).filter(~gone)
    return e.withColumn("category", F.when(title & (case % 4 == 1), "header").otherwise(F.col("category")))


def _as_elements(rows: DataFrame) -> DataFrame:
    """Table elements from ``doc_id, seq, page, html``."""
    return rows.select(
        "doc_id",
        F.col("seq").cast("int").alias("seq"),
        F.col("page").cast("int").alias("page"),
        F.lit("table").alias("category"),
        F.lit("| 1 |").alias("markdown"),
        F.lit(None).cast("string").alias("text"),
        "html",
    )


def spanned_elements(spark, sf_dir) -> DataFrame:
    """A table per order whose body cells span two rows and two columns; a last odd line ends such a cell early."""
    pair = F.transform(
        "lines",
        lambda l, n: _text(
            "<tr>",
            F.when(n % 2 == 0, _text('<td rowspan="', F.when(F.col("ok") % 3 == 0, "2").otherwise("02"), '" colspan=2>', l.no.cast("string"), "</td>")).otherwise(""),
            "<td>", l.no.cast("string"), "</td><td>", l.qty.cast("string"), "</td></tr>",
        ),
    )
    head = '<table><thead><tr><th rowspan="2" colspan="2">쌍</th><th colspan="2">값</th></tr><tr><th>항목</th><th>합계</th></tr></thead><tbody>'
    foot = '</tbody><tfoot><tr><td colspan="4000000000">끝</td></tr></tfoot></table>'
    # a few tables end with a cell of a limitless width
    end = F.when(F.col("ok") % 1000 == 0, foot).otherwise("</tbody></table>")
    o = order_tables(spark, sf_dir).filter("lines IS NOT NULL")
    return _as_elements(o.select("doc_id", (F.col("i") * 3 + 1).alias("seq"), "page", _text(head, F.array_join(pair, ""), end).alias("html")))


YEARS = range(1992, 1999)
LOST = (1995, 3)
QUARTERS = [(y, q) for y in YEARS for q in (1, 2, 3, 4) if (y, q) != LOST]


def period_elements(spark, sf_dir) -> DataFrame:
    """Three tables per customer of order totals by priority: years in columns, quarters in columns (one is lacking,
    the headers are spelled in four ways), years in rows; each has a column or row of totals."""
    o = table(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").alias("doc_id"),
        F.col("o_orderpriority").alias("pr"),
        F.year("o_orderdate").alias("y"),
        F.quarter("o_orderdate").alias("q"),
    ).agg(F.sum(F.col("o_totalprice").cast("bigint")).alias("v"))
    when = lambda y, q=None: (F.col("y") == y) & (F.lit(True) if q is None else F.col("q") == q)
    written = lambda c: F.coalesce(F.sum(c).cast("string"), F.lit("-"))
    per_row = o.groupBy("doc_id", "pr").agg(
        written(F.col("v")).alias("total"),
        *[written(F.when(when(y), F.col("v"))).alias(f"y{y}") for y in YEARS],
        *[written(F.when(when(y, q), F.col("v"))).alias(f"q{y}{q}") for y, q in QUARTERS],
    )
    years, quarters = [f"y{y}" for y in YEARS], [f"q{y}{q}" for y, q in QUARTERS]

    def line(names):
        return _text("<tr><td>", F.col("pr"), "</td>", *[_text("<td>", F.col(n), "</td>") for n in (*names, "total")], "</tr>")

    row = F.struct("pr", line(years).alias("years"), line(quarters).alias("quarters"), *years)
    rows = per_row.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    body = lambda name: F.array_join(F.transform("rows", lambda r: r[name]), "")
    ths = lambda texts: "".join(f"<th>{t}</th>" for t in texts)
    short = lambda y: str(y)[2:]
    heads = [
        ths(f"{y}Q{q}" for y, q in QUARTERS),
        ths(f"'{short(y)}.{q}/4" for y, q in QUARTERS),
        None,
        ths(f"{q}Q{short(y)}" for y, q in QUARTERS),
    ]
    single = [f"<table><tr><th>구분</th>{h}<th>합계</th></tr>" for h in heads if h]
    groups = "".join(f'<th colspan="{sum(x == y for x, _ in QUARTERS)}">{y}년</th>' for y in YEARS)
    double = (
        f'<table><thead><tr><th rowspan="2">구분</th>{groups}<th rowspan="2">합계</th></tr>'
        f"<tr>{ths(f'{q}분기' for _, q in QUARTERS)}</tr></thead><tbody>"
    )
    spelling = F.col("doc_id") % 4
    head = F.when(spelling == 0, single[0]).when(spelling == 1, single[1]).when(spelling == 2, double).otherwise(single[2])
    down = F.concat(
        *[_text(f"<tr><td>{y}년</td>", F.array_join(F.transform("rows", lambda r: _text("<td>", r[f"y{y}"], "</td>")), ""), "</tr>") for y in YEARS]
    )
    names = F.array_join(F.transform("rows", lambda r: _text("<th>", r.pr, "</th>")), "")
    tables = [
        _text("<table><tr><th>구분</th>" + ths(YEARS) + "<th>합계</th></tr>", body("years"), "</table>"),
        _text(head, body("quarters"), F.when(spelling == 2, "</tbody></table>").otherwise("</table>")),
        _text("<table><tr><th>연도</th>", names, "</tr>", down, "<tr><td>합계</td></tr></table>"),
    ]
    return _as_elements(rows.select("doc_id", F.lit(1).alias("page"), F.posexplode(F.array(*tables)).alias("seq", "html")))


def page_elements(spark, sf_dir) -> DataFrame:
    """Raw web pages as if each were a table: real HTML, most of it without one."""
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("doc_id"), F.lit(0).alias("seq"), F.lit(1).alias("page"), F.lit("table").alias("category"), F.lit("| 1 |").alias("markdown"), none.alias("text"), "html"
    )


def documents_meta(spark, sf_dir) -> DataFrame:
    """One row per document; every 13th reports no page count, every third no model."""
    doc = F.col("doc_id")
    pages = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(
        (F.floor((F.count(F.lit(1)) - 1) / 2) + 1).cast("int").alias("n_pages")
    )
    is_pdf = doc % 5 != 0
    name = _text("report-", doc.cast("string"), F.when(is_pdf, ".pdf").otherwise(".hwp"))
    return pages.select(
        "doc_id",
        "n_pages",
        name.alias("name"),
        is_pdf.alias("is_pdf"),
        F.sha2(name.cast("binary"), 256).alias("sha256"),
        F.when(doc % 3 != 2, _text("parse-", (doc % 3).cast("string"))).alias("model"),
        F.when(doc % 13 == 0, 0).otherwise(F.col("n_pages")).alias("usage_pages"),
    )


def responses(spark, sf_dir) -> DataFrame:
    """Chunked responses of four pages each, pages counted from the start of the chunk."""
    chunk = F.floor((F.col("page") - 1) / CHUNK_PAGES).cast("int")
    e = elements(spark, sf_dir).withColumn("chunk_no", chunk)
    item = F.struct(
        "seq",
        F.struct(
            "category",
            (F.col("page") - F.col("chunk_no") * CHUNK_PAGES).alias("page"),
            F.struct("html", "markdown", "text").alias("content"),
        ).alias("e"),
    )
    grouped = e.groupBy("doc_id", "chunk_no").agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.max("page").alias("last_page")
    )
    part = lambda f: F.array_join(F.transform("items", lambda x: x.e.content[f]), "\n").alias(f)
    return grouped.select(
        "doc_id",
        "chunk_no",
        F.when(F.col("chunk_no") % 3 != 2, _text("parse-", F.col("chunk_no").cast("string"))).alias("model"),
        F.struct((F.col("last_page") - F.col("chunk_no") * CHUNK_PAGES).alias("pages")).alias("usage"),
        F.struct(part("html"), part("markdown"), F.lit(None).cast("string").alias("text")).alias("content"),
        F.transform("items", lambda x: x.e).alias("elements"),
    )


def chunk_documents(spark, sf_dir) -> DataFrame:
    """Documents as the chunked parser sees them: all by pages, whatever their kind."""
    return documents_meta(spark, sf_dir).withColumn("is_pdf", F.lit(True))


def raw_responses(spark, sf_dir) -> DataFrame:
    """Responses as JSON text with fields nobody knows; some are cut off."""
    r = responses(spark, sf_dir)
    box = F.array(F.struct(F.lit(0.25).alias("x"), (F.col("chunk_no") + 0.5).alias("y")))
    ocr = F.when(F.col("doc_id") % 2 == 0, F.struct((F.col("doc_id") % 7).alias("dpi"), box.alias("box")))
    raw = F.to_json(F.struct("model", "usage", "content", "elements", F.lit(1).alias("api_version"), ocr.alias("ocr.state")))
    broken = (F.col("doc_id") + F.col("chunk_no")) % 11 == 5
    cut = F.when(broken, F.substr(raw, F.lit(1), F.length(raw) - 2)).otherwise(raw)
    return r.select("doc_id", "chunk_no", cut.alias("raw"))


def stuck_texts(spark, sf_dir) -> DataFrame:
    """Descriptions that end in a phrase of three words, said up to eleven times."""
    doc = F.col("doc_id")
    phrase = _text(F.col("lang"), " ", F.col("source"), " ", doc.cast("string"), " ")
    return table(spark, sf_dir, "documents").select(doc, _text("시작 말 ", F.repeat(phrase, (doc % 12).cast("int"))).alias("text"))


def many_terms(spark, sf_dir) -> DataFrame:
    """Search terms in the number of the customers, and some odd ones."""
    c = table(spark, sf_dir, "customer").select(_text("-", F.col("c_custkey").cast("string")).alias("term"))
    odd = spark.createDataFrame([("",), ("C",), ("résumé",), ("RE\u0301S",), ("nothing like it",), ("-1",), ("SRC1-",)], "term string")
    return c.unionByName(odd)


def many_strings(spark, sf_dir) -> DataFrame:
    """Strings as they stand in tables: number and quantity of a line, wherever it is."""
    lines = table(spark, sf_dir, "lineitem").select(
        _text(F.col("l_linenumber").cast("string"), " ", F.col("l_quantity").cast("bigint").cast("string"), " ").alias("wanted")
    )
    return lines.distinct()


def received_responses(spark, sf_dir) -> DataFrame:
    """Keys of the responses that arrived: some chunks got lost, some came twice (in some
    documents as often as others got lost), some nobody asked for."""
    doc, no = F.col("doc_id"), F.col("chunk_no")
    r = responses(spark, sf_dir).select("doc_id", "chunk_no").filter((doc + no) % 7 != 3)
    times = F.when((doc + no) % 7 == 4, 2).otherwise(1)
    twice = r.withColumn("n", F.explode(F.sequence(F.lit(1), times))).drop("n")
    extra = documents_meta(spark, sf_dir).filter(doc % 17 == 1).select("doc_id", F.lit(999).alias("chunk_no"))
    return twice.unionByName(extra)


def page_requests(spark, sf_dir) -> DataFrame:
    """A page range asked of each document, good and bad ones."""
    doc = F.col("doc_id") % 8
    spec = (
        F.when(doc == 0, "1").when(doc == 1, "1-2").when(doc == 2, "2-3").when(doc == 3, "0-1")
        .when(doc == 4, "3-2").when(doc == 5, "1-99").when(doc == 6, "x")
    )
    return documents_meta(spark, sf_dir).select("doc_id", "is_pdf", "n_pages", spec.alias("spec"))


EXTENSIONS = [
    ".pdf", ".JPG", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".heic", ".docx", ".pptx", ".xlsx",
    ".hwp", ".hwpx", ".txt", "",
]


def files(spark, sf_dir) -> DataFrame:
    """File metadata; every fourth name has a decomposed accent."""
    doc = F.col("doc_id")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (doc % 15).cast("int") + 1)
    accent = F.when(doc % 4 == 0, "-Résumé").otherwise("")
    path = _text("/corpus/", F.col("source"), "/", F.col("source"), "-", doc.cast("string"), accent, ext)
    return table(spark, sf_dir, "documents").select(
        path.alias("path"),
        (F.col("n_chars") * 3000).alias("size_bytes"),
        F.timestamp_seconds(F.lit(START) + doc * 3600).alias("mtime"),
    )


def requests(spark, sf_dir) -> DataFrame:
    sha16 = F.substring(F.sha2(F.col("text"), 256), 1, 16)
    mode = F.when(F.col("doc_id") % 4 < 3, "enhanced").otherwise("standard")
    return table(spark, sf_dir, "documents").select("doc_id", sha16.alias("sha16"), mode.alias("mode"))


def _entries(spark, sf_dir, chosen, mode) -> DataFrame:
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").filter(chosen).select(
        F.substring(F.sha2(F.col("text"), 256), 1, 16).alias("sha16"),
        mode.alias("mode"),
        _text("response-", doc.cast("string")).alias("response"),
        (F.lit(START) + doc * 3600).alias("ts"),
    )


def cached(spark, sf_dir) -> DataFrame:
    """Stored entries: a third of the texts, half of them without mode."""
    doc = F.col("doc_id")
    mode = F.when(doc % 6 != 0, F.when(doc % 4 == 3, "standard").otherwise("enhanced"))
    return _entries(spark, sf_dir, doc % 3 == 0, mode)


def new_entries(spark, sf_dir) -> DataFrame:
    doc = F.col("doc_id")
    chosen = (doc % 2 == 0) | (doc % 3 != 0)
    return _entries(spark, sf_dir, chosen, F.when(doc % 4 == 0, "enhanced").otherwise("standard"))


def request_pages(spark, sf_dir) -> DataFrame:
    pages = (F.floor(F.col("n_chars") / 3000) + 1).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", pages.alias("n_pages"))


def golden_numbers(spark, sf_dir) -> DataFrame:
    """An expected sum per table, straight from the line items: within tolerance, out of
    it, zero, with an unknown row label, exact."""
    o = order_tables(spark, sf_dir).filter("lines IS NOT NULL")
    first = F.get("lines", F.lit(0)).qty.cast("double")
    case = F.col("ok") % 5
    expected = (
        F.when(case == 0, first * 1.04).when(case == 1, first * 1.1).when(case == 2, 0.0).otherwise(first)
    )
    return o.select(
        "doc_id",
        (F.col("i") * 3 + 1).alias("seq"),
        F.when(case == 3, "없음").otherwise("주문").alias("row_label"),
        F.lit("수량__합계").alias("col_name"),
        expected.alias("expected"),
        F.lit(0.05).alias("tol"),
    )


def golden_strings(spark, sf_dir) -> DataFrame:
    """Five expected strings per table; one is always wrong, every fifth table has two."""
    o = order_tables(spark, sf_dir).filter("lines IS NOT NULL")
    last = F.element_at("lines", -1)
    wanted = F.array(
        F.lit("주문"),
        last.no.cast("string"),
        last.qty.cast("string"),
        F.when(F.col("ok") % 5 == 1, "없음").otherwise(last.n.cast("string")),
        F.lit("없는 값"),
    )
    return o.select("doc_id", (F.col("i") * 3 + 1).alias("seq"), wanted.alias("wanted"))


def kept_boundaries(boundaries: DataFrame) -> DataFrame:
    """Recorded failures after a seeded loss in every seventh document."""
    return boundaries.filter(F.col("doc_id") % 7 != 0)


def texts(spark, sf_dir) -> DataFrame:
    whole = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), "doc_id", "text")
    parts = elements(spark, sf_dir).select(
        F.lit("elements").alias("origin"), "doc_id", F.col("markdown").alias("text")
    )
    return whole.unionByName(parts)


def messages(spark, sf_dir) -> DataFrame:
    """Error messages that quote a key and the text of the request."""
    key = _text("up_", F.substring(F.sha2(F.col("text"), 256), 1, 12))
    short = _text("up_", F.substring(F.sha2(F.col("text"), 256), 1, 5))
    text = _text("HTTP 401: key ", key, " (not ", short, "): ", F.col("text"), " ", key)
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def written_numbers(spark, sf_dir) -> DataFrame:
    """Quantities as reports write them."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty")
    )
    q = (F.col("qty") * 1000).cast("string")
    comma = _text(F.substr(q, F.lit(1), F.length(q) - 3), ",000")
    case = (F.col("l_orderkey") + F.col("l_linenumber")) % 8
    text = (
        F.when(case == 0, _text("▲", comma)).when(case == 1, _text("▽ ", comma))
        .when(case == 2, _text("(", comma, ")")).when(case == 3, _text(F.col("qty").cast("string"), ".5%"))
        .when(case == 4, _text(comma, " 1)")).when(case == 5, _text("(", F.col("qty").cast("string"), "조원)"))
        .when(case == 6, _text("n/a ", comma)).otherwise(comma)
    )
    return lines.select("l_orderkey", "l_linenumber", text.alias("text"))


def elements_with_units(spark, sf_dir) -> DataFrame:
    """Elements whose odd tables start with a row that states the unit."""
    e = elements(spark, sf_dir)
    row = F.when(F.col("page") % 2 == 1, '<tbody><tr><td colspan="4">(단위: 건)</td></tr>').otherwise(
        "<tbody><tr><td></td><td></td><td>(%)</td><td>(%)</td></tr>"
    )
    marked = F.when(F.col("seq") % 2 == 1, F.replace("html", F.lit("<tbody>"), row)).otherwise(F.col("html"))
    return e.withColumn("html", marked)
