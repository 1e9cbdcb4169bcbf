"""Reports per document and page.

``assets`` below is the output of ``tables.visuals``; ``documents`` has one row per
document (``doc_id, name, sha256, model, usage_pages``).
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrid import constants as K
from leafgrid.functions import html as H
from leafgrid.functions import text as T
from leafgrid.functions.joins import look_up
from leafgrid.operators.elements import label, once, page_or_zero
from leafgrid.operators.tables import boundary_cases, boundary_reason, fallback_path


def asset_list(assets: DataFrame) -> DataFrame:
    """Readable tables and charts; tables come first (``section`` 0, then 1), each in
    document order (``index``)."""
    return assets.filter("parsed_ok AND prefix IN ('t', 'c')").select(
        "doc_id",
        (F.col("prefix") == "c").cast("int").alias("section"),
        "index",
        "seq",
        "kind",
        "page",
        "caption",
        "name",
        "n_rows",
        "n_cols",
    )


def _flags(elements: DataFrame) -> DataFrame:
    """What each element counts as; needs neither captions nor numbers, so no window."""
    kinds = elements.filter(F.col("category").isin("table", "chart", "figure"))
    ok = H.first_table(F.coalesce("html", F.lit(""))).isNotNull()
    kinds = kinds.select(
        "doc_id",
        page_or_zero().alias("page"),
        once(label().alias("label"), F.when(F.col("category") != "figure", ok).alias("ok")),
    )
    return kinds.select(
        "doc_id",
        "page",
        ((F.col("label") == "real_table") & F.col("ok")).alias("t"),
        (F.col("label").isin("chart", "chart_misid") & F.col("ok")).alias("c"),
        (F.col("label") == "figure").alias("f"),
        (F.col("label") == "footnote").alias("n"),
    )


def asset_flags(assets: DataFrame, *keep: str) -> DataFrame:
    """The same from rows of ``visuals(figures=True, notes=True)``: no HTML is read again."""
    prefix, ok = F.col("prefix"), F.coalesce("parsed_ok", F.lit(False))
    return assets.select(
        "doc_id", "page", ((prefix == "t") & ok).alias("t"), ((prefix == "c") & ok).alias("c"), (prefix == "f").alias("f"), (prefix == "n").alias("n"), *keep
    )


def document_counts(documents: DataFrame, elements: DataFrame, flags: DataFrame = None) -> DataFrame:
    """``flags`` (``asset_flags``) may stand for the elements."""
    names = {"t": "tables", "c": "charts", "f": "figures", "n": "footnotes"}
    counts = (flags or _flags(elements)).groupBy("doc_id").agg(*[F.count_if(c).alias(n) for c, n in names.items()])
    return documents.select("doc_id").join(counts, "doc_id", "left").fillna(0, list(names.values()))


def page_map(documents: DataFrame, elements: DataFrame, flags: DataFrame = None) -> DataFrame:
    """Tables, charts and figures on each page that has any, for documents with a page
    count; one partial aggregate, then a join of small rows."""
    pages = (flags or _flags(elements)).filter("t OR c OR f").groupBy("doc_id", "page").agg(
        *[F.count_if(c).alias(n) for c, n in (("t", "tables"), ("c", "charts"), ("f", "figures"))]
    )
    return pages.join(documents.filter("usage_pages > 0").select("doc_id"), "doc_id", "left_semi")


def visual_pages(elements: DataFrame) -> DataFrame:
    """Pages worth rendering: those with a table, chart or figure."""
    return _flags(elements).filter("(t OR c OR f) AND page <> 0").select("doc_id", "page").distinct()


def index_rows(assets: DataFrame) -> DataFrame:
    """Lines of the human-readable listing."""
    is_figure = F.col("prefix") == "f"
    size = F.concat(F.col("n_rows").cast("string"), F.lit("×"), F.col("n_cols").cast("string"))
    described = F.coalesce(F.replace("description", F.lit("|"), F.lit("\\|")), F.lit(""))
    short = F.coalesce(F.nullif(T.shorten(described, K.DESCRIPTION_LENGTH), F.lit("")), F.lit(K.DASH))
    kind = F.coalesce(F.nullif("figure_type", F.lit("")), F.lit(K.DASH))
    return assets.filter("prefix = 'f' OR (parsed_ok AND prefix IN ('t', 'c'))").select(
        "doc_id",
        F.concat("kind", F.lit("s")).alias("section"),
        "seq",
        F.when(~is_figure, F.col("name")).alias("name"),
        "page",
        F.coalesce("caption", F.lit(K.NO_TITLE)).alias("title"),
        F.when(~is_figure, size).alias("size"),
        F.when(is_figure, kind).alias("figure_type"),
        F.when(is_figure, short).alias("description"),
    )


def top_assets(
    assets: DataFrame,
    tables=K.TOP_TABLES,
    charts=K.TOP_CHARTS,
    figures=K.TOP_FIGURES,
) -> DataFrame:
    """First assets of each document and how many more there are.

    The ``rank <=`` filter lets Spark keep the first rows map-side; the totals are a
    partial aggregate of flags.  Neither gathers a document.
    """
    limits = {"t": tables, "c": charts, "f": figures}
    shown = assets.filter("prefix = 'f' OR (parsed_ok AND prefix IN ('t', 'c'))")
    first = Window.partitionBy("doc_id", "prefix").orderBy("seq")
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("prefix")]
    top = (
        shown.withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= max(limits.values()))
        .filter(F.col("rank") <= limit)
    )
    totals = asset_flags(assets).groupBy("doc_id").agg(*[F.count_if(p).alias(f"_n_{p}") for p in limits])
    total = F.when(F.col("prefix") == "t", F.col("_n_t")).when(F.col("prefix") == "c", F.col("_n_c")).otherwise(
        F.col("_n_f")
    )
    title = F.substring(F.coalesce("caption", F.lit(K.NO_TITLE)), 1, K.TOP_CAPTION_LENGTH)
    entry = F.when(F.col("prefix") == "f", F.coalesce(F.nullif("figure_type", F.lit("")), F.lit("figure")))
    return top.join(totals, "doc_id").select(
        "doc_id",
        "prefix",
        "rank",
        F.coalesce(entry, F.col("name")).alias("entry"),
        title.alias("title"),
        F.greatest(total - limit, F.lit(0)).alias("overflow"),
    )


def boundary_report(assets: DataFrame) -> DataFrame:
    """One line of text per boundary case, ``seq`` gives the order."""
    arrow = F.coalesce(F.concat(F.lit(" → `"), "fallback_path", F.lit("`")), F.lit(""))
    line = F.concat(F.format_string("페이지 %d, #%d: ", "page", "index"), F.col("reason"), arrow)
    return boundary_cases(assets).select("doc_id", "seq", line.alias("line"))


def boundary_reasons(assets: DataFrame) -> DataFrame:
    return boundary_cases(assets).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def page_contents(documents: DataFrame, assets: DataFrame) -> DataFrame:
    """What is on each page: its data, else its figures, else a pointer to the source.

    The per-page verdict is a small aggregate; assets look it up by (document, page).
    """
    page = asset_flags(assets).groupBy("doc_id", "page").agg(
        F.bool_or(F.col("t") | F.col("c")).alias("has_data"), F.bool_or("f").alias("has_figure")
    )
    shown = assets.filter("prefix = 'f' OR (parsed_ok AND prefix IN ('t', 'c'))")
    shown = look_up(shown, page, ["doc_id", "page"])
    shown = shown.filter("prefix <> 'f' OR NOT has_data").select(
        "doc_id",
        "page",
        F.when(F.col("prefix") == "f", "figure").otherwise("data").alias("answer"),
        "seq",
        F.coalesce(F.when(F.col("prefix") == "f", F.col("figure_type")), F.col("name")).alias("entry"),
    )
    every = documents.filter("n_pages > 0").select(
        "doc_id", F.explode(F.sequence(F.lit(1), F.col("n_pages"))).alias("page")
    )
    bare = every.join(page.filter("has_data OR has_figure"), ["doc_id", "page"], "left_anti")
    source = F.concat(F.lit("sources/p"), F.col("page").cast("string"), F.lit(".png"))
    return shown.unionByName(
        bare.select("doc_id", "page", F.lit("empty").alias("answer"), F.lit(None).cast("int").alias("seq"), source.alias("entry"))
    )


def _items() -> dict:
    """The lists of a document's summary: which rows, in which order, with which fields."""
    col = F.col
    return {
        "footnotes": (col("prefix") == "n", ["seq"], dict(page=col("page"), markdown=col("markdown"))),
        "boundary_cases": (
            col("reason").isNotNull(),
            ["seq"],
            dict(page=col("page"), index=col("index"), reason=col("reason"), fallback_path=col("fallback")),
        ),
        "files": (
            col("parsed_ok") & col("prefix").isin("t", "c"),
            [(col("prefix") == "c").alias("section"), "seq"],
            dict(
                type=col("kind"), path=col("name"), page=col("page"), caption=col("caption"), rows=col("n_rows"), cols=col("n_cols")
            ),
        ),
        "figures": (
            col("prefix") == "f",
            ["seq"],
            dict(
                index=col("index"),
                page=col("page"),
                figure_type=col("figure_type"),
                description=col("description"),
                caption=col("caption"),
            ),
        ),
    }


KEEP_NULLS = {"ignoreNullFields": "false"}


def _json_options(name):
    """Absent fallback paths are left out, other nulls are written."""
    return {} if name == "boundary_cases" else KEEP_NULLS


def meta_items(assets: DataFrame) -> DataFrame:
    """The entries of all summaries, one row each (``doc_id, list, seq, item``): the form to store
    where documents are very long.  ``assets`` comes from ``visuals(figures=True, notes=True)``."""
    known = assets.withColumn("reason", boundary_reason()).withColumn("fallback", fallback_path())
    entries = [
        F.when(when, F.struct(F.lit(name).alias("list"), F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), _json_options(name)).alias("item")))
        for name, (when, _, fields) in _items().items()
    ]
    found = known.select("doc_id", "seq", F.explode(F.array_compact(F.array(*entries))).alias("e"))
    return found.select("doc_id", "e.list", "seq", "e.item")


def document_meta(documents: DataFrame, assets: DataFrame) -> DataFrame:
    """Machine-readable summary of each document as JSON text, one row per document of any size.

    ``assets`` comes from ``visuals(figures=True, notes=True)``.
    """

    known = assets.withColumn("reason", boundary_reason()).withColumn("fallback", fallback_path())
    entries = [
        F.when(
            when,
            F.struct(
                F.lit(i).alias("list"),
                (order[0] if len(order) > 1 else F.lit(0)).cast("int").alias("part"),
                "seq",
                F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), _json_options(name)).alias("item"),
            ),
        )
        for i, (name, (when, order, fields)) in enumerate(_items().items())
    ]
    # an entry is text before it is gathered, and a document's entries and counts are gathered at once
    mine = F.array_compact(F.array(*entries))
    counted = {"t": "tables", "c": "charts", "f": "figures", "n": "footnotes"}
    flags = asset_flags(known.withColumn("_mine", F.when(F.size(mine) > 0, mine)), "_mine")
    gathered = flags.groupBy("doc_id").agg(
        *[F.count_if(c).alias(n) for c, n in counted.items()], F.array_sort(F.flatten(F.collect_list("_mine"))).alias("_entries")
    )
    head = documents.where("doc_id IS NOT NULL").select(
        "doc_id",
        F.struct("name", "sha256", F.col("usage_pages").alias("pages")).alias("source"),
        F.coalesce("model", F.lit(K.DEFAULT_MODEL)).alias("model"),
    )
    full = head.join(gathered, "doc_id", "left").fillna(0, list(counted.values()))
    full = full.withColumn("counts", F.struct(*counted.values()))

    def listing(name):
        at = list(_items()).index(name)
        found = F.transform(F.filter("_entries", lambda e: e["list"] == at), lambda e: e["item"])
        return F.concat(F.lit("["), F.coalesce(F.array_join(found, ","), F.lit("")), F.lit("]"))

    meta = F.concat(
        F.lit('{"source":'),
        F.to_json("source", KEEP_NULLS),
        F.lit(',"model":'),
        F.regexp_replace(F.to_json(F.array("model")), r"^\[|\]$", ""),
        F.lit(',"counts":'),
        F.to_json("counts", KEEP_NULLS),
        *[x for name in _items() for x in (F.lit(f',"{name}":'), listing(name))],
        F.lit("}"),
    )
    return full.select("doc_id", meta.alias("meta"))
