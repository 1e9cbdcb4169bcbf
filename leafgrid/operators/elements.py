"""Flatten responses to elements; classify, read and caption them.

``elements`` has one row per layout element: ``doc_id`` (not null), ``seq`` (dense
position in the document, from 0), ``page``, ``category``, ``markdown``, ``text``,
``html``.  Classification looks at one row only, so it works on streams as well.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrid import constants as K
from leafgrid.functions import html as H
from leafgrid.functions import text as T
from leafgrid.functions.prefix import BLOCK, add_offsets, block_offsets, with_block

DATA_LABELS = ("real_table", "chart", "chart_misid")
_PREFIX = {"real_table": "t", "chart": "c", "chart_misid": "c", "figure": "f"}


def explode_elements(responses: DataFrame, first_seq: Column = None, keys=("doc_id",)) -> DataFrame:
    """One row per element; coordinates are never read, so they are never scanned."""
    start = F.lit(0) if first_seq is None else first_seq
    rows = responses.select(
        *keys,
        start.alias("_start"),
        F.posexplode(
            F.transform(
                "elements",
                lambda e: F.struct(
                    e.page.alias("page"),
                    e.category.alias("category"),
                    e.content.markdown.alias("markdown"),
                    e.content.text.alias("text"),
                    e.content.html.alias("html"),
                ),
            )
        ).alias("_pos", "_e"),
    )
    return rows.select(*keys, (F.col("_start") + F.col("_pos")).cast("int").alias("seq"), "_e.*")


def label() -> Column:
    """Kind of an element: chart, figure, footnote, chart_misid, real_table or other."""
    category = F.col("category")
    return (
        F.when(category == "chart", "chart")
        .when(category == "figure", "figure")
        .when((category != "table") | category.isNull(), "other")
        .otherwise(H.let(T.strip(F.coalesce("markdown", F.lit(""))), _table_label))
    )


def _table_label(md: Column) -> Column:
    breaks = (F.length(md) - F.length(F.replace(md, F.lit("<br>"), F.lit("")))) / 4
    length = F.length(md)
    # plain digits settle most tables; the full digit class is only tried after them
    plain = length - F.length(F.translate(md, "0123456789", ""))
    digits = length - F.length(F.regexp_replace(md, K.DIGIT, ""))
    few = [n / F.greatest(length, F.lit(1)) < K.MIN_DIGIT_SHARE for n in (plain, digits)]
    return (
        F.when(T.starts_with_any(md, K.FOOTNOTE_PREFIXES), "footnote")
        .when(T.contains_any(md, K.AXIS_HINTS) & (breaks >= K.CHART_BR_COUNT), "chart_misid")
        .when((length > K.PROSE_LENGTH) & few[0] & few[1], "other")
        .otherwise("real_table")
    )


def classify_elements(elements: DataFrame) -> DataFrame:
    return elements.withColumn("label", label())


def element_text() -> Column:
    return T.first_text(F.col("markdown"), F.col("text"), F.col("html"))


def caption_candidate() -> Column:
    """Cleaned text of an element that may serve as caption of a later one, else null."""
    raw = element_text()
    usable = (F.col("category") == "caption") & (raw != "")
    heading = (F.col("category") == "heading1") & (raw != "") & (F.length(raw) < K.HEADING_LENGTH)
    return F.when(usable | heading, T.clean_caption(raw))


def clean_captions(elements: DataFrame) -> DataFrame:
    """Every caption or short heading with its cleaned text."""
    return elements.select(
        "doc_id", "seq", element_text().alias("raw"), caption_candidate().alias("caption")
    ).filter(F.col("caption").isNotNull())


def label_distribution(elements: DataFrame) -> DataFrame:
    """Share of each label among the elements that arrived as tables."""
    counts = (
        elements.filter(F.col("category") == "table")
        .groupBy(label().alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def footnotes(elements: DataFrame) -> DataFrame:
    return elements.filter((F.col("category") == "table") & (label() == "footnote")).select(
        "doc_id", "seq", "page", T.strip(F.col("markdown")).alias("markdown")
    )


def asset_rows(
    elements: DataFrame, captions=True, numbers=True, notes=False, carry=(), width: int = BLOCK
) -> DataFrame:
    """Tables, charts and figures with caption and number.

    Output: ``doc_id, seq, page, label, prefix`` (t/c/f), ``caption`` and ``index``
    (0-based per document and prefix, failed parses count) plus the columns of
    ``carry`` ((name, expression) pairs evaluated before the shuffle).  ``notes`` adds
    the footnotes (prefix n, not numbered).  ``_block`` tells blocks of a document apart.

    One shuffle on (doc_id, block of positions).  The last nine rows of a block are also
    sent to the next block, so each block sees the whole look-back of its first rows and
    no document ends up in a single task.
    """
    width = max(width, K.CAPTION_LOOKBACK + 1)
    asset_kinds = elements.filter(F.col("category").isin("table", "chart", "figure"))
    source = elements if captions else asset_kinds
    cand = caption_candidate() if captions else F.lit(None).cast("string")
    keep = ["doc_id", "seq", "page", *(["_cand"] if captions else [])]
    thin = _with_prefix(source.withColumn("_cand", cand), keep, notes, carry)
    if not captions:
        thin = thin.filter("prefix IS NOT NULL")
    blocked = with_block(thin, "seq", width)
    home = blocked.withColumn("_home", F.lit(True))
    if captions:
        reach = F.col("seq") % width >= width - K.CAPTION_LOOKBACK
        targets = F.when(reach, F.array("_block", F.col("_block") + 1)).otherwise(F.array("_block"))
        home = blocked.withColumn("_to", F.explode(targets)).select(
            *[c for c in blocked.columns if c != "_block"],
            (F.col("_to") == F.col("_block")).alias("_home"),
            F.col("_to").alias("_block"),
        )
    order = Window.partitionBy("doc_id", "_block").orderBy("seq")
    out = home
    if captions:
        out = _nearest_caption(out, order)
    if numbers:
        upto = order.rowsBetween(Window.unboundedPreceding, -1)
        mine = {p: ((F.col("prefix") == p) & F.col("_home")).cast("int") for p in "tcf"}
        out = out.select("*", *[F.sum(mine[p]).over(upto).alias(f"prev_{p}") for p in "tcf"])
    out = out.filter("_home AND prefix IS NOT NULL").drop("_home")
    if numbers:
        flags = _with_prefix(asset_kinds, ["doc_id", "seq"]).filter("prefix IS NOT NULL").select(
            "doc_id", "seq", *[(F.col("prefix") == p).cast("int").alias(p) for p in "tcf"]
        )
        offsets = block_offsets(with_block(flags, "seq", width), ["doc_id"], sums="tcf")
        out = add_offsets(out, offsets, ["doc_id"], sums="tcf")
        number = F.when(F.col("prefix") == "t", F.col("prev_t")).when(
            F.col("prefix") == "c", F.col("prev_c")
        ).when(F.col("prefix") == "f", F.col("prev_f"))
        out = out.withColumn("index", number.cast("int")).drop("prev_t", "prev_c", "prev_f")
    return out


def once(*columns: Column) -> Column:
    """The columns through a one-row generator.  Unlike a plain projection the optimizer
    never copies it into a later filter, so costly expressions are computed once."""
    return F.inline(F.array(F.struct(*columns)))


def _with_prefix(elements: DataFrame, keep, notes=False, carry=()) -> DataFrame:
    """``keep`` plus label, prefix and the carried facts (null for other elements)."""
    cases = F.create_map(*[F.lit(x) for pair in _PREFIX.items() for x in pair])
    if notes:
        cases = F.map_concat(cases, F.create_map(F.lit("footnote"), F.lit("n")))
    base = elements.select(*keep, "category", "markdown", "html", once(label().alias("label")))
    prefix = F.try_element_at(cases, F.col("label")).alias("prefix")
    if not carry:
        return base.select(*keep, "label", prefix)
    facts = F.struct(*[e.alias(n) for n, e in carry])
    named = base.select(*keep, "label", prefix, "category", "markdown", "html")
    return named.select(
        *keep, "label", "prefix", once(F.when(F.col("prefix").isNotNull(), facts).alias("_facts"))
    ).select(*keep, "label", "prefix", "_facts.*")


def _nearest_caption(rows: DataFrame, order) -> DataFrame:
    """Nearest candidate among the nine rows before, on the same unbroken run of pages.

    Runs are contiguous, so if the nearest candidate lies outside the run, all do.  An
    element without page has no page boundary.
    """
    turn = ~F.col("page").eqNullSafe(F.lag("page").over(order))
    look = order.rowsBetween(-K.CAPTION_LOOKBACK, -1)
    rows = rows.withColumn("_turn", turn.cast("int"))
    rows = rows.withColumn("_run", F.sum("_turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = F.when(F.col("_cand").isNotNull(), F.struct("_cand", "_run"))
    rows = rows.withColumn("_near", F.last(found, ignorenulls=True).over(look))
    same = F.col("page").isNull() | (F.col("_near._run") == F.col("_run"))
    return rows.withColumn("caption", F.when(same, F.col("_near._cand"))).drop(
        "_cand", "_turn", "_run", "_near"
    )


def attach_captions(elements: DataFrame, width: int = BLOCK) -> DataFrame:
    return asset_rows(elements, numbers=False, width=width).select("doc_id", "seq", "caption")


def number_assets(elements: DataFrame, width: int = BLOCK) -> DataFrame:
    return asset_rows(elements, captions=False, width=width).select("doc_id", "seq", "prefix", "index")


def page_or_zero() -> Column:
    return F.coalesce("page", F.lit(0)).cast("int")


def with_slug(assets: DataFrame) -> DataFrame:
    """Slug of the caption, or of ``table-p<page>`` / ``chart-p<page>`` without one."""
    kind = F.when(F.col("prefix") == "t", "table").when(F.col("prefix") == "c", "chart").otherwise("figure")
    base = F.coalesce("caption", F.concat(kind, F.lit("-p"), page_or_zero().cast("string")))
    normal = assets.withColumn("_base", T.nfc(base))
    return normal.withColumn("slug", T.slug(F.col("_base"), normalised=True)).drop("_base")


def with_name(assets: DataFrame) -> DataFrame:
    """File name; ``.html`` if the table could not be read (needs ``parsed_ok``)."""
    ending = F.when(F.col("parsed_ok"), ".csv").otherwise(".html")
    return assets.withColumn(
        "name",
        F.concat(
            F.format_string("%s%02d_p%d_", "prefix", "index", page_or_zero()), F.col("slug"), ending
        ),
    )


def slug_assets(elements: DataFrame) -> DataFrame:
    data = asset_rows(elements, numbers=False).filter("prefix <> 'f'")
    return with_slug(data).select("doc_id", "seq", "caption", "slug")


def name_assets(elements: DataFrame) -> DataFrame:
    named = asset_rows(elements, carry=[("parsed_ok", H.first_table(F.col("html")).isNotNull())])
    named = with_name(with_slug(named.filter("prefix <> 'f'")))
    return named.select("doc_id", "seq", "prefix", "index", "name")


def figures(elements: DataFrame) -> DataFrame:
    found = asset_rows(
        elements,
        carry=[
            ("figure_type", H.paragraph(F.coalesce("html", F.lit("")), "figure-type")),
            ("description", H.paragraph(F.coalesce("html", F.lit("")), "figure-description")),
        ],
    )
    return found.filter("prefix = 'f'").select(
        "doc_id", "seq", "index", page_or_zero().alias("page"), "figure_type", "description", "caption"
    )
