"""Hand-written rows for each rule and its edge."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from leafgrid import constants as K
from leafgrid.functions import html as H
from leafgrid.functions import text as T
from leafgrid.functions.periods import MONTHS, period
from leafgrid.operators import analysis, catalog, elements, paging, quality, reports, tables


def values(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("t"))).collect()]


def test_caption_prefixes(spark):
    cases = {
        "<그림 I-1> 가계 신용": "가계 신용",
        "[표 2] 대출": "대출",
        "표 1. 취약차주": "표 1. 취약차주",
        "표준 분류": "표준 분류",
        "# <표 1> 제목": "# <표 1> 제목",
        "Table 3 x > y": "y",
        "<표 1> 제목": "제목",
    }
    assert values(spark, list(cases), T.clean_caption) == list(cases.values())


def test_slugs(spark):
    cases = {
        "생성형 AI 활용률: 한국 VS. 미국": "생성형-AI-활용률-한국-VS-미국",
        "※★": "untitled",
        "": "untitled",
        " - a  b - ": "a-b",
        unicodedata.normalize("NFD", "표 제목"): "표-제목",
        unicodedata.normalize("NFD", "가é"): "가",
        "x" * 39 + " yz": "x" * 39 + "-",
    }
    assert values(spark, list(cases), T.slug) == list(cases.values())


def test_nfc_agrees_with_python(spark):
    texts = ["̈́", "Ω", "Å", "豈", "ι", "क़", "יִ", "각", "ȩ́", " ", "〈", "plain", "̀", "ẛ̣"]
    assert values(spark, texts, T.nfc) == [unicodedata.normalize("NFC", t) for t in texts]


def test_every_character_that_nfc_changes_is_suspected(spark):
    changed = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and unicodedata.normalize("NFC", chr(c)) != chr(c)]
    missed = [t for t, hit in zip(changed, values(spark, changed, lambda t: t.rlike(T.NFC_SUSPECTS))) if not hit]
    assert missed == []


def test_every_composing_character_is_suspected(spark):
    seconds = set()
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(chr(int(parts[1], 16)))
    seconds = sorted(seconds)
    missed = [t for t, hit in zip(seconds, values(spark, seconds, lambda t: t.rlike(T.NFC_SUSPECTS))) if not hit]
    assert missed == []


def test_strip_and_digits_follow_unicode(spark):
    odd = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    assert values(spark, [f"{c}a{c}" for c in odd], T.strip) == ["a"] * len(odd)
    digits = [chr(c) for c in range(0x110000) if chr(c).isdigit() and unicodedata.category(chr(c)) != "Nd"]
    assert all(values(spark, digits, lambda t: t.rlike(f"^{K.DIGIT}$")))


def labels(make, rows):
    df = make([(1, i, 1, c, m, "") for i, (c, m) in enumerate(rows)])
    return [r.label for r in elements.classify_elements(df).orderBy("seq").collect()]


def test_labels(make):
    prose = "| " + "설명문 " * 20 + "|"
    cases = [
        ("table", "| 주: | 대손충당금 |", "footnote"),
        ("table", " \t|자료: x", "footnote"),
        ("table", "<br><br><br>조원", "chart_misid"),
        ("table", "<br><br>조원", "real_table"),
        ("table", "<br><br><br>", "real_table"),
        ("table", "", "real_table"),
        ("table", None, "real_table"),
        ("table", prose, "other"),
        ("table", prose + "①②", "real_table"),
        ("table", "x" * 99 + "1", "real_table"),
        ("table", "x" * 100 + "1", "other"),
        ("table", "x" * 50, "real_table"),
        ("chart", prose, "chart"),
        ("figure", "", "figure"),
        ("paragraph", "1", "other"),
        (None, "1", "other"),
    ]
    assert labels(make, [c[:2] for c in cases]) == [c[2] for c in cases]


def test_element_text_falls_back(spark):
    rows = [(" m ", "t", "h"), (" \n", " t ", "h"), (None, "", " h"), (None, None, None)]
    df = spark.createDataFrame(rows, "markdown string, text string, html string")
    assert [r[0] for r in df.select(elements.element_text()).collect()] == ["m", "t", "h", ""]


def grid(spark, html):
    g = spark.createDataFrame([(html,)], "html string").select(H.table_grid(F.col("html")).alias("g")).first().g
    return g and (g.head, g.body, g.n_cols)


@pytest.mark.parametrize(
    "html, expected",
    [
        (
            '<table><thead><tr><th rowspan="2">G</th><th colspan="2">23</th></tr><tr><th>1/4</th><th>2/4</th></tr>'
            "</thead><tbody><tr><td>a</td><td>1</td><td>2</td></tr></tbody></table>",
            ([["G", "23", "23"], ["G", "1/4", "2/4"]], [["a", "1", "2"]], 3),
        ),
        (
            "<table><tr><td>a</td><td rowspan=2>b</td><td>c</td></tr><tr><td>d</td><td>e</td></tr></table>",
            ([], [["a", "b", "c"], ["d", "b", "e"]], 3),
        ),
        ("<table><tr><th>x</th></tr><tr><td>1</td><td>2</td></tr></table>", ([["x", ""]], [["1", "2"]], 2)),
        ("<TABLE><TR><TH>x<TH>y<TR><TD CLASS='a'>1<TD>2</TABLE>", ([["x", "y"]], [["1", "2"]], 2)),
        ("<table><tr><td>a &amp;lt; &lt;b&gt;</td><td>x<br/>y<b> z</b></td></tr></table>", ([], [["a &lt; <b>", "x y z"]], 2)),
        ("<table><tr><td>a </td><td> b  c </td></tr></table>", ([], [["a", "b c"]], 2)),
        ("<table><tr><th>only</th></tr></table>", ([["only"]], [], 1)),
        ("<table></table>", None),
        ("<table><tr><td> </td></tr></table>", None),
        ("<p>no table</p>", None),
        (None, None),
        ("<table></table><table><tr><td>2nd</td></tr></table>", ([], [["2nd"]], 1)),
        ("<table><tr><td>a</td></tr><tfoot><tr><td>f</td></tr></tfoot><tr><td>b</td></tr></table>", ([], [["a"], ["b"], ["f"]], 1)),
        ("<table><tr><td>a</td></tr><tr><td> </td></tr></table>", ([], [["a"]], 1)),
        ("<table><thead><tr><th></th></tr><tr><th>h</th></tr><tr><th> </th></tr></thead><tr><td>1</td><td>2</td></tr></table>",
         ([["h", ""]], [["", ""], ["1", "2"]], 2)),
        # a span ends with its section
        ("<table><tr><td rowspan='3'>a</td><td>b</td></tr></table>", ([], [["a", "b"]], 2)),
        ("<table><tbody><tr><td rowspan='300000000'>a</td><td>b</td></tr><tr><td>c</td></tr></tbody></table>", ([], [["a", "b"], ["a", "c"]], 2)),
        ("<table><tr><td rowspan=0>a</td><td COLSPAN=0>b</td></tr><tr><td>c</td></tr><tr></tr></table>", ([], [["a", "b"], ["a", "c"], ["a", ""]], 2)),
        ("<table><tr><td rowspan=-1 colspan=x>a</td><td colspan=+02>b</td></tr></table>", ([], [["a", "b", "b"]], 3)),
    ],
)
def test_grids(spark, html, expected):
    assert grid(spark, html) == expected


def test_header_names(spark):
    g = spark.sql("select array(array('a','x','x','p'), array('a','u','x','')) head, cast(array() as array<array<string>>) body, 4 n_cols")
    row = g.select(H.header_names(F.struct("head", "body", "n_cols")).alias("n")).first()
    assert row.n == ["a", "x__u", "x", "p"]


def test_figures(make):
    html = '<figure><P class="figure-type" id=x>diagram,\n timeline</p><p class="figure-description"> a\t b </P></figure>'
    rows = elements.figures(make([(1, 0, 2, "figure", "", html), (1, 1, None, "figure", "", "<img>")])).orderBy("seq").collect()
    assert [(r.figure_type, r.description, r["index"], r.page) for r in rows] == [("diagram, timeline", "a b", 0, 2), ("", "", 1, 0)]


def test_names_beyond_two_digits_and_without_page(make):
    cell = "<table><tr><td>1</td></tr></table>"
    df = make([(1, i, 3 if i < 124 else None, "table", "1", cell if i != 5 else "") for i in range(125)])
    names = {r["index"]: r.name for r in elements.name_assets(df).collect()}
    assert names[0] == "t00_p3_table-p3.csv" and names[123] == "t123_p3_table-p3.csv"
    assert names[124] == "t124_p0_table-p0.csv" and names[5] == "t05_p3_table-p3.html"


def test_page_zero_is_not_a_visual_page(make):
    df = make([(1, 0, None, "figure", "", ""), (1, 1, 2, "figure", "", "")])
    assert [tuple(r) for r in reports.visual_pages(df).collect()] == [(1, 2)]


def test_page_ranges(spark):
    specs = [("12", True), ("12-15", True), ("0-3", True), ("5-2", True), ("1-99", True), (None, True), ("2", False), ("x", True), (" 3 - 4 ", True)]
    df = spark.createDataFrame([(i, p, 20, s) for i, (s, p) in enumerate(specs)], "doc_id long, is_pdf boolean, n_pages int, spec string")
    got = [(r.status, r.start, r.end, r.offset) for r in paging.page_ranges(df).orderBy("doc_id").collect()]
    assert got == [
        ("range", 12, 12, 11), ("range", 12, 15, 11), ("invalid", None, None, 0), ("invalid", None, None, 0),
        ("invalid", None, None, 0), ("all", None, None, 0), ("all", None, None, 0), ("invalid", None, None, 0), ("range", 3, 4, 2),
    ]


def test_chunk_plan(spark):
    df = spark.createDataFrame([(1, True, 250), (2, True, 100), (3, False, 500), (4, True, 101)], "doc_id long, is_pdf boolean, n_pages int")
    rows = [tuple(r) for r in paging.chunk_plan(df).orderBy("doc_id", "chunk_no").collect()]
    assert rows == [
        (1, 0, 1, 100, 0), (1, 1, 101, 200, 100), (1, 2, 201, 250, 200), (2, 0, 1, 100, 0), (3, 0, 1, 500, 0),
        (4, 0, 1, 100, 0), (4, 1, 101, 101, 100),
    ]


def test_tolerance(spark):
    cases = [(0.0, 0.0, True), (1e-8, 0.0, False), (105.0, 100.0, True), (105.1, 100.0, False), (-95.0, -100.0, True)]
    df = spark.createDataFrame([c[:2] for c in cases], "a double, e double")
    got = [r[0] for r in df.select(quality.within_tolerance(F.col("a"), F.col("e"), F.lit(0.05))).collect()]
    assert got == [c[2] for c in cases]


def test_mask(spark):
    assert values(spark, ["key up_abcdefghij1", "up_short"], T.mask) == ["key up_***REDACTED***", "up_short"]


def test_description_is_escaped_then_cut(make):
    long, edge = "y" * 81, "z" * 79 + "|x"
    html = '<p class="figure-type">d</p><p class="figure-description">%s</p>'
    assets = tables.visuals(make([(1, 0, 1, "figure", "", html % long), (1, 1, 1, "figure", "", html % edge)]), figures=True)
    got = [r.description for r in reports.index_rows(assets).orderBy("seq").collect()]
    assert got == ["y" * 80 + "…", "z" * 79 + "\\…"]


def test_typed_numbers(spark):
    texts = ["1,234", "-5", "1.5e3", "Infinity", "NaN", "", "12%", ".5", "1,2,3"]
    assert values(spark, texts, tables.number) == [1234.0, -5.0, 1500.0, None, None, None, None, 0.5, 123.0]


def test_written_numbers(spark):
    cases = {
        "▲1,234": (-1234.0, None), "▽ 5": (-5.0, None), "(12.5)": (-12.5, None), "12.3%": (12.3, "%"),
        "7 1)": (7.0, None), "(5조원)": (-5.0, "조원"), "n/a": (None, None), "1)": (None, None),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, text string")
    rows = analysis.normalize_numbers(df).orderBy("i").collect()
    assert [(r.num, r.unit) for r in rows] == list(cases.values())


def test_unit_rows(spark):
    rows = [["(%)", "(%)"], ["(단위: 조원)", ""], ["(%)", "x"], ["", ""], ["%", "건"]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r array<string>")
    got = [x[0] for x in df.orderBy("i").select(analysis.units_of(F.col("r"))).collect()]
    assert got == [["%", "%"], ["조원", None], None, None, ["%", "건"]]


def test_periods(spark):
    year, half, quarter, month = ((k, lambda y, p=1, n=n: y * 12 + (p - 1) * n) for k, n in MONTHS.items())
    cases = {
        "2024": (year, 2024), "2024년": (year, 2024), "2024년도": (year, 2024), "'24": (year, 2024), "’98년": (year, 1998), "24년": (year, 2024),
        "2024Q1": (quarter, 2024, 1), "2024 4Q": (quarter, 2024, 4), "'24.1/4": (quarter, 2024, 1), "2024년 1분기": (quarter, 2024, 1),
        "2024.3/4분기": (quarter, 2024, 3), "2024년__2/4": (quarter, 2024, 2), "1Q24": (quarter, 2024, 1), "q3 '99": (quarter, 1999, 3),
        "2024년 상반기": (half, 2024, 1), "2024 하반기": (half, 2024, 2), "2024H2": (half, 2024, 2), "'24.1H": (half, 2024, 1),
        "2024.12": (month, 2024, 12), "2024-03": (month, 2024, 3), "'24.3월": (month, 2024, 3), "2024년 9월": (month, 2024, 9), " 2024/1 ": (month, 2024, 1),
    }
    want = [(kind[0], kind[1](*rest)) for kind, *rest in cases.values()]
    assert [tuple(p) for p in values(spark, list(cases), period)] == want
    none = ["", "24", "합계", "계", "1/4", "2024년 합계", "2024.13", "2024년 5/4", "12345", "2024Q5", "증감률(2024)", "전년 대비", "1899", None]
    assert values(spark, none, period) == [None] * len(none)


def test_period_change(make):
    head = "".join(f"<th>{t}</th>" for t in ("x", "2022Q4", "2023Q1", "2023.2/4", "합계", "2023년 4분기", "2024Q1", "'24.1/4", "2023"))
    html = f"<table><tr>{head}</tr><tr><td>7</td><td>8</td><td>10</td><td>-5</td><td>99</td><td>6</td><td>1</td><td>1</td><td>50</td></tr></table>"
    grids = tables.table_grids(make([(1, 0, 1, "table", "1", html)]))
    got = analysis.period_change(analysis.period_columns(grids)).orderBy("kind", "col").collect()
    assert [(r["col"], r.kind, r.num, r.previous, r.change, r.rate, r.year_ago, r.year_rate) for r in got] == [
        (1, "quarter", 8.0, None, None, None, None, None),
        (2, "quarter", 10.0, 8.0, 2.0, 0.25, None, None),
        (3, "quarter", -5.0, 10.0, -15.0, -1.5, None, None),
        (5, "quarter", 6.0, None, None, None, 8.0, -0.25),  # the third quarter is lacking
        (6, "quarter", 1.0, 6.0, -5.0, -0.833333, 10.0, -0.9),  # stated twice, but not compared with
        (7, "quarter", 1.0, 6.0, -5.0, -0.833333, 10.0, -0.9),
        (8, "year", 50.0, None, None, None, None, None),
    ]
    assert [str(r.period) for r in got][-2:] == ["2024-01-01", "2023-01-01"]


def test_periods_in_rows(make):
    rows = [("2021", "0", "a"), ("2022년", "5", "4"), ("합계", "9", "9"), ("'23", "4", "8")]
    html = "<table><tr><th>연도</th><th>a</th><th>b</th></tr>" + "".join(f"<tr>{''.join(f'<td>{t}</td>' for t in r)}</tr>" for r in rows) + "</table>"
    grids = tables.table_grids(make([(1, 0, 1, "table", "1", html), (1, 1, 1, "table", "1", "<table><tr><td></td></tr></table>")]))
    got = analysis.period_change(analysis.period_rows(grids)).orderBy("col", "row").collect()
    assert [(r["row"], r["col"], r.previous, r.change, r.rate) for r in got] == [
        (0, 1, None, None, None), (1, 1, 0.0, 5.0, None), (3, 1, 5.0, -1.0, -0.2), (1, 2, None, None, None), (3, 2, 4.0, 4.0, 1.0)
    ]


def test_markup_that_must_not_leak(make):
    pages = {
        "<table><tr><td>a<!-- x > y --></td><td>&#8722;5 &times; &#x41;&#0;</td></tr></table>": [["a", "−5 × A&#0;"]],
        '<table><tr style="color:red; display : none"><td>no</td></tr><tr><td>b</td><td style="display:none">no</td><td>c</td></tr></table>': [["b", "c"]],
        "<table><!-- </table> --><tr><td>d</td></tr></table>": [["d"]],
        "<table><tr><td>out<table><tr><td>in</td></tr></table></td><td>z</td></tr></table>": None,
    }
    df = make([(1, i, 1, "table", "1", h) for i, h in enumerate(pages)])
    got = tables.table_grids(df).orderBy("seq").collect()
    assert [r.grid.body if r.grid else None for r in got] == list(pages.values())
    assert [r.seq for r in tables.parse_failures(df).collect()] == [3]


def test_file_names(spark):
    paths = ["/a/b.PDF", "/a/.hidden", "/a/x.tar.gz", "/a/noext", "/a/dot.", "/a.b/c"]
    assert values(spark, paths, catalog.extension) == [".pdf", "", ".gz", "", "", ""]
    assert values(spark, paths, catalog.stem) == ["b", ".hidden", "x.tar", "noext", "dot.", "c"]


def test_size_limit_is_strict_and_first(spark):
    limit = K.MAX_FILE_BYTES
    df = spark.createDataFrame([("/a.pdf", limit), ("/b.txt", limit + 1), ("/c.txt", 1)], "path string, size_bytes long").withColumn("mtime", F.lit(0))
    got = {r.path: r.reason for r in catalog.catalog_documents(df).collect()}
    assert got == {"/a.pdf": None, "/b.txt": "too_large", "/c.txt": "unsupported_ext"}


def test_phrases_that_repeat_to_the_end(spark):
    prose = " ".join(f"w{i * i % 31} v{i % 17}" for i in range(60))
    cases = {
        "가 나 다 " * 20: 3,
        "가 " * 30: 1,
        "도식의 설명은 다음과 같다 " * 2 + "a b c d " * 30: 4,
        "a b c " * 6 + "a b": 3,  # the last turn is not whole
        "a b a c " * 8: 4,
        "a a b " * 9 + "c": None,  # it goes on
        prose: None,
        " ".join(f"w{i}" for i in range(40)) + " x" * 3: None,
        "a b " * 9: None,  # too short
        " ".join(str(i) for i in range(10)) + " " + " ".join(str(i) for i in range(10)): None,  # twice is no loop
        "": None,
    }
    got = values(spark, list(cases), lambda t: t)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(got)], "i int, text string")
    rows = quality.description_loops(df).orderBy("i").collect()
    assert [r.period for r in rows] == list(cases.values())
    assert [r.looping for r in rows] == [p is not None or t.startswith("a a b") for t, p in cases.items()]


def test_totals_by_scenario_document_and_over_all(spark):
    rows = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "a", True), (2, "b", True)], "doc_id long, scenario string, passed boolean")
    got = {(r.of, r.scenario, r.doc_id): (r.n, r.n_pass, r.n_fail, r.passed) for r in quality.eval_totals(rows).collect()}
    assert got == {
        ("scenario", "a", None): (2, 2, 0, True), ("scenario", "b", None): (2, 1, 1, False),
        ("document", None, 1): (2, 1, 1, False), ("document", None, 2): (2, 2, 0, True), ("all", None, None): (4, 3, 1, False),
    }


def test_loops(spark):
    df = spark.createDataFrame([("w " * 20,), ("w " * 19,), ("w x " * 10,), ("",)], "text string")
    got = [(r.n_words, r.top_count, r.looping) for r in quality.description_loops(df).collect()]
    assert got == [(20, 20, True), (19, 19, False), (20, 10, True), (0, 0, False)]


def test_wide_table(make):
    cells = tables.table_cells(tables.table_grids(make([(1, 0, 1, "table", "1", "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>")])))
    assert [tuple(r)[2:] for r in tables.wide_table(cells, 2).orderBy("row").collect()] == [(0, True, "a", "b"), (1, False, "1", "2")]


@pytest.mark.parametrize(
    "rows, body",
    [
        # spans that follow each other, and spans that meet
        ('<tr><td rowspan="2">a</td><td>1</td></tr><tr><td>2</td></tr><tr><td rowspan=2>b</td><td>3</td></tr><tr><td>4</td></tr>', [["a", "1"], ["a", "2"], ["b", "3"], ["b", "4"]]),
        ('<tr><td rowspan="3">a</td><td>1</td></tr><tr><td rowspan="2">b</td></tr><tr><td>2</td></tr>', [["a", "1", ""], ["a", "b", ""], ["a", "b", "2"]]),
        # white space at the edges, a tag inside a tag, a mark in the text, upper case
        ("<tr><td> a </td><td>b\n\n c</td></tr>", [["a", "b  c"]]),
        ("<tr><td>a<br <td>b</td></tr>", [["a<br", "b"]]),
        ("<TR><TD>a\x03b</TD><td >c</TR>", [["ab", "c"]]),
        ('<tr><td rowspan="x" colspan="02">a</td></tr>', [["a", "a"]]),
    ],
)
def test_regular_and_irregular_tables(spark, rows, body):
    assert grid(spark, f"<table>{rows}</table>")[1] == body
