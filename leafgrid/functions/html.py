"""Column expressions that turn one element's table HTML into a grid of cell texts.

All of it stays inside the row: no shuffle, no Python.  A grid is
``STRUCT<head ARRAY<ARRAY<STRING>>, body ARRAY<ARRAY<STRING>>, n_cols INT>``.

Table tags are first replaced by one-character marks in whole-table passes.  Most tables are regular (every tag ends
before the next begins, no white space at the edge of a cell, row spans that do not meet): what only others need is asked
for once per table and left out if it would change nothing.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafgrid import constants as K
from leafgrid.functions.text import contains_any, squeeze, strip

_ENTITIES = (
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&times;", "×"),
    ("&minus;", "−"),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
    ("&middot;", "·"),
    ("&hellip;", "…"),
    ("&amp;", "&"),
)
# row, cell, start of its text, end of cell or row, header section, footer section, end of section
_ROW, _CELL, _TEXT, _DONE, _HEAD, _FOOT, _END = (chr(i) for i in range(1, 8))
_PLAIN_TAGS = (
    ("<tr>", _ROW),
    ("<td>", f"{_CELL}d{_TEXT}"),
    ("<th>", f"{_CELL}h{_TEXT}"),
    ("</td>", _DONE),
    ("</th>", _DONE),
    ("</tr>", _DONE),
    ("<thead>", _HEAD),
    ("</thead>", _END),
    ("<tbody>", _END),
    ("</tbody>", _END),
    ("<br>", "\n"),
)
_OTHER_TAGS = (
    (r"(?i)<br\b[^>]*>", "\n"),
    (r"(?i)<tr\b[^>]*>", _ROW),
    (r"(?i)<td\b([^>]*)>", f"{_CELL}d$1{_TEXT}"),
    (r"(?i)<th\b([^>]*)>", f"{_CELL}h$1{_TEXT}"),
    (r"(?i)</t[dhr]\b[^>]*>", _DONE),
    (r"(?i)<thead\b[^>]*>", _HEAD),
    (r"(?i)<tfoot\b[^>]*>", _FOOT),
    (r"(?i)<(?:/?tbody|/thead|/tfoot)\b[^>]*>", _END),
    (r"(?i)</?[a-z!][^>]*>", ""),
)
# the same for text in which every tag ends before the next begins, so that their order does not matter; few passes, most frequent first
_REGULAR_TAGS = (
    (r"</[tT][dhrDHR]\b[^>]*>", _DONE),
    (r"<[tT]([dhDH])\b([^>]*)>", f"{_CELL}$1$2{_TEXT}"),
    (r"<[tT][rR]\b[^>]*>", _ROW),
    (r"(?i)<(?:/?tbody|/thead|/tfoot)\b[^>]*>", _END),
    (r"(?i)<thead\b[^>]*>", _HEAD),
)
_REST_OF_TAGS = ((r"(?i)<br\b[^>]*>", "\n"), (r"(?i)<tfoot\b[^>]*>", _FOOT), (r"(?i)</?[a-z!][^>]*>", ""))
# line ends, runs of white space, and white space at the start or end of a cell's text; both patterns begin with one class
# of characters, so few places of a text take more than one step
_SPACE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LOOSE = f"[{_TEXT}{_SPACE}](?:(?<=[\r\n])|[{_SPACE}]|(?<!{_TEXT})(?:[{_ROW}-{_END}]|\\z))"
_IRREGULAR = f"[<{_ROW}{_CELL}{_TEXT}{_DONE}{_HEAD}{_FOOT}{_END}](?:(?<!<)|[^>]*<)"
_OPEN = "array<struct<i:int,text:string,left:int>>"
_FEW = 1 << 12
_ALL = 1 << 30
_PIECE = 128


def let(value: Column, use) -> Column:
    """Bind ``value`` so that it is computed once however often ``use`` refers to it.

    An aggregate over nothing hands its start to ``use`` as it is; a transform of a one-element array would copy the whole result.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, use)


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 1)


def visible(html: Column) -> Column:
    """Without comments and without rows and cells that are not displayed."""
    shown = F.when(html.contains("<!--"), F.regexp_replace(html, r"(?s)<!--.*?(?:-->|$)", "")).otherwise(html)

    def displayed(text):
        for tag in ("tr", "t[dh]"):
            text = F.regexp_replace(text, rf"(?is)<({tag})\b(?=[^>]*\bdisplay\s*:\s*none)[^>]*>.*?</\1\s*>", "")
        return text

    return let(shown, lambda t: F.when(t.rlike("[dD][iI][sS][pP][lL][aA][yY]"), displayed(t)).otherwise(t))


def first_table(html: Column) -> Column:
    """Inner HTML of the first table with a cell and some text, else null.

    A table inside a table counts as unreadable: its rows would mix with the outer ones.
    """
    tables = _matches(visible(html), r"(?is)<table\b[^>]*>(.*?)</table\s*>")
    some_text = f"(?:^|>){K.WS}*[^<{K.WS[1:]}"
    usable = F.filter(tables, lambda t: t.rlike(r"(?i)<t[dh]\b") & t.rlike(some_text))
    first = let(F.get(usable, 0), lambda t: F.when(~t.rlike(r"(?i)<table\b"), t))
    return F.when(html.rlike(r"(?i)<table\b"), first)


def _marked(table: Column) -> Column:
    """``text`` with marks instead of tags, entities decoded, whitespace collapsed; ``loose`` if a cell's text may have some at its ends."""

    def decode(text):
        decoded = F.when(text.contains("&#"), _numbered(text)).otherwise(text)
        for entity, char in _ENTITIES:
            decoded = F.replace(decoded, F.lit(entity), F.lit(char))
        return F.when(text.contains("&"), decoded).otherwise(text)

    text = F.when(table.rlike(_IRREGULAR), _replace_any(table)).otherwise(_replace_regular(table))

    def settled(text):
        collapsed = lambda loose: F.when(loose, F.regexp_replace(text, f"[\\r\\n]+|{K.WS}{{2,}}", " ")).otherwise(text)
        return let(text.rlike(_LOOSE), lambda loose: F.struct(collapsed(loose).alias("text"), loose.alias("loose")))

    return let(let(text, decode), settled)


def _replace_regular(text: Column) -> Column:
    text = _each(text, _REGULAR_TAGS)
    return let(text, lambda t: F.when(t.contains("<"), _each(t, _REST_OF_TAGS)).otherwise(t))


def _replace_any(text: Column) -> Column:
    """Marks in the text drop out; then plain tags by literal replacement, the other ones by patterns."""
    text = F.translate(text, "".join(map(chr, range(ord(_ROW), ord(_END) + 1))), "")
    for tag, mark in _PLAIN_TAGS:
        text = F.replace(text, F.lit(tag), F.lit(mark))
    return let(text, lambda t: F.when(t.contains("<"), _each(t, _OTHER_TAGS)).otherwise(t))


def _each(text: Column, patterns) -> Column:
    for pattern, mark in patterns:
        text = F.regexp_replace(text, pattern, mark)
    return text


def _numbered(text: Column) -> Column:
    """Numeric character references as characters; ``&#39;`` and the like included."""

    def put(t, ref):
        wide = F.conv(F.regexp_extract(ref, "(?i)x([0-9a-f]+)", 1), 16, 10)
        code = F.coalesce(wide, F.regexp_extract(ref, "#([0-9]+)", 1)).try_cast("int")
        good = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")
        return F.when(good, F.replace(t, ref, char)).otherwise(t)

    refs = F.array_distinct(F.regexp_extract_all(text, F.lit("(?i)(&#(?:[0-9]{1,7}|x[0-9a-f]{1,6});)"), 1))
    return F.aggregate(refs, text, put)


def _span(attrs: Column, name: str, most: int, zero: int) -> Column:
    """A span as HTML reads it: at most ``most``, one if it is not a number; ``zero`` is what 0 means."""
    start = rf"(?i)\b{name}\s*=\s*[\"']?\s*\+?"

    def read(digits):
        return F.when(F.length(digits) > 9, most).when(digits == "", zero).otherwise(F.least(digits.try_cast("int"), F.lit(most)))

    later = F.when(attrs.rlike(rf"{start}\d"), zero).otherwise(1)  # the first mention has no number
    number = let(F.regexp_extract(attrs, rf"{start}(\d*)", 1), lambda d: F.when(d == "", later).otherwise(read(F.ltrim(d, F.lit("0")))))
    return F.when(F.lower(attrs).contains(name), number).otherwise(1)


def _parse_cell(part: Column, loose: Column) -> Column:
    """``loose`` tells whether some text of the table has white space at its start or end."""
    one, bare = F.lit(1), F.substring_index(F.substring_index(part, _TEXT, -1), _DONE, 1)

    def parsed(attrs):
        spanned = (F.octet_length(attrs) > 1) & attrs.rlike("(?i)span")
        return F.struct(
            (attrs.startswith("h") | attrs.startswith("H")).alias("th"),
            F.when(spanned, _span(attrs, "rowspan", K.MAX_ROWSPAN, K.MAX_ROWSPAN)).otherwise(one).alias("down"),
            F.when(spanned, _span(attrs, "colspan", K.MAX_COLSPAN, 1)).otherwise(one).alias("across"),
            F.when(loose, strip(bare)).otherwise(bare).alias("text"),
        )

    return let(F.substring_index(part, _TEXT, 1), parsed)


def _parse_rows(section: Column, loose: Column) -> Column:
    rows = F.slice(F.split(section, _ROW), 2, _ALL)
    return F.transform(rows, lambda r: F.transform(F.slice(F.split(r, _CELL), 2, _ALL), lambda c: _parse_cell(c, loose)))


def sections(table: Column) -> Column:
    """Rows of parsed cells of the header, the footer and the rest."""
    head, foot = f"{_HEAD}([^{_FOOT}{_END}]*)", f"{_FOOT}([^{_HEAD}{_END}]*)"

    def part(text, mark, pattern):
        return F.when(text.contains(mark), F.array_join(_matches(text, pattern), "")).otherwise("")

    def parsed(marked):
        t = marked.text
        parts = F.array(part(t, _HEAD, head), _without(t, f"{head}|{foot}"), part(t, _FOOT, foot))
        return F.transform(parts, lambda p: _parse_rows(p, marked.loose))

    parts = let(_marked(table), parsed)
    return let(
        parts,
        lambda p: F.struct(F.get(p, 0).alias("head"), F.get(p, 1).alias("rest"), F.get(p, 2).alias("foot")),
    )


def _without(text: Column, sections: str) -> Column:
    return F.when(contains_any(text, [_HEAD, _FOOT]), F.regexp_replace(text, sections, "")).otherwise(text)


def split_header(s: Column) -> Column:
    """Without a header section the leading rows made only of ``<th>`` are the header."""
    first_data = F.array_position(
        F.transform(s.rest, lambda r: F.exists(r, lambda c: ~c.th)), F.lit(True)
    )
    lead = (
        F.when(F.size(s["head"]) > 0, F.lit(0))
        .when(first_data > 0, first_data - 1)
        .otherwise(F.size(s.rest))
        .cast("int")
    )
    return F.struct(
        F.concat(s["head"], F.slice(s.rest, F.lit(1), lead)).alias("head"),
        F.slice(s.rest, lead + 1, F.lit(_ALL)).alias("rest"),
        s.foot.alias("foot"),
    )


def _place(rows: Column) -> Column:
    """Grid of texts; a cell's text is copied to every position its spans cover.

    A span ends with its section.  If all spans together cover more than ``MAX_POSITIONS``, every cell
    is taken once, without its spans.
    """
    n = F.size(rows)
    none = F.lit(0).cast("long")

    def covered():
        return F.aggregate(
            F.transform(rows, lambda r, i: F.aggregate(r, none, lambda b, c: b + F.least(c.down, n - i).cast("long") * c.across)),
            none,
            lambda a, b: a + b,
        )

    plain = F.transform(rows, lambda r: F.transform(r, lambda c: c.text))
    spanned = lambda r: F.exists(r, lambda c: (c.down != 1) | (c.across != 1))
    return F.when(F.exists(rows, spanned) & (covered() <= K.MAX_POSITIONS), _place_spans(rows)).otherwise(plain)


def _place_spans(rows: Column) -> Column:
    """Rows are placed one after another; ``open`` holds, by column, the cells that hang down into the next row.

    Each step only appends its own small result.  The rows are taken in pieces, so no list gets longer than a piece or
    the number of pieces.  Most rows hang from few cells and start none: a row costs what hangs into it and what it starts.
    """
    n = F.size(rows)
    nothing_open = F.array().cast(_OPEN)

    def spread(row, i):
        """Texts of a row's own cells, widened, and those of them that hang into the rows after it, by their place among them."""
        some = F.exists(row, lambda c: c.across != 1)
        texts = F.when(
            some, F.flatten(F.transform(row, lambda c: F.array_repeat(c.text, c.across)))
        ).otherwise(F.transform(row, lambda c: c.text))
        down = lambda c: F.least(c.down, n - i)
        wide = F.flatten(F.transform(row, lambda c: F.array_repeat(F.struct(c.text.alias("text"), down(c).alias("left")), c.across)))
        hang = F.filter(
            F.transform(wide, lambda c, at: F.struct(at.alias("i"), c.text.alias("text"), c.left.alias("left"))), lambda o: o.left > 1
        )
        starts = F.exists(row, lambda c: down(c) > 1)
        return F.struct(texts.alias("texts"), F.when(starts, hang.cast(_OPEN)).otherwise(nothing_open).alias("hang"))

    def apart(spread_rows, use, otherwise):
        """``use(cells that hang)`` if none of them hangs into a row that starts others, and there are not too many."""

        def hanging(row, i):
            return F.transform(row.hang, lambda o: F.struct(i.alias("row"), o.i.alias("i"), o.text.alias("text"), (i + o.left).alias("end")))

        def reach(most, o):
            # the last row that starts a cell, and the end of the cells up to there
            return (
                F.when(o.row == most.row, F.struct(most.row.alias("row"), F.greatest(most.end, o.end).alias("end")))
                .when(most.end <= o.row, F.struct(o.row.alias("row"), o.end.alias("end")))
                .otherwise(F.struct(F.lit(-1).alias("row"), F.lit(_ALL).alias("end")))
            )

        first = F.struct(F.lit(-1).alias("row"), F.lit(0).alias("end"))

        def chosen(all_hanging):
            few = F.size(all_hanging).cast("long") * n <= _FEW
            fine = F.aggregate(all_hanging, first, reach, lambda most: most.end < _ALL)
            return F.when(few & fine, use(all_hanging)).otherwise(otherwise)

        return let(F.flatten(F.transform(spread_rows, hanging)), chosen)

    def hung(spread_rows, all_hanging):
        """Rows with the cells that hang into them; these ascend by column."""

        def line(row, at):
            over = F.filter(all_hanging, lambda o: (o.row < at) & (o.end > at))
            return F.aggregate(over, row.texts, lambda w, o: F.array_insert(w, F.least(o.i, F.size(w)) + 1, o.text))

        return F.transform(spread_rows, line)

    def placed(hanging, row):
        # ``hanging`` ascends by column, so each insert leaves the places before it as they are
        line = F.aggregate(
            hanging, row.texts, lambda w, o: F.array_insert(w, F.least(o.i, F.size(w)) + 1, o.text)
        )
        still = F.transform(
            F.filter(hanging, lambda o: o.left > 1),
            lambda o: F.struct(o.i.alias("i"), o.text.alias("text"), (o.left - 1).alias("left")),
        )
        moved = F.transform(
            row.hang,
            lambda o: F.struct(
                F.aggregate(hanging, o.i, lambda at, h: F.when(h.i <= at, at + 1).otherwise(at)).alias("i"),
                o.text.alias("text"),
                (o.left - 1).alias("left"),
            ),
        )
        kept = F.when(F.size(row.hang) == 0, still).when(F.size(hanging) == 0, moved).otherwise(F.array_sort(F.concat(still, moved)))
        quiet = (F.size(hanging) == 0) & (F.size(row.hang) == 0)
        return F.struct(
            F.when(quiet, nothing_open).otherwise(kept.cast(_OPEN)).alias("open"),
            F.when(F.size(hanging) == 0, row.texts).otherwise(line).alias("line"),
        )

    def step(done, row):
        return F.concat(done, F.array(let(F.element_at(done, -1).open, lambda hanging: placed(hanging, row))))

    def piece(done, some):
        hanging = F.element_at(F.element_at(done, -1), -1).open
        first = F.array(F.struct(hanging.alias("open"), F.array().cast("array<string>").alias("line")))
        return F.concat(done, F.array(F.aggregate(some, first, step)))

    def whole(spread_rows):
        starts = F.sequence(F.lit(0), F.greatest(F.size(spread_rows) - 1, F.lit(0)), F.lit(_PIECE))
        pieces = F.transform(starts, lambda at: F.slice(spread_rows, at + 1, F.lit(_PIECE)))
        nothing = F.array(F.array(F.struct(nothing_open.alias("open"), F.array().cast("array<string>").alias("line"))))
        placed_rows = F.aggregate(pieces, nothing, piece)
        return F.flatten(F.transform(placed_rows, lambda p: F.transform(F.slice(p, F.lit(2), F.lit(_ALL)), lambda r: r.line)))

    return let(F.transform(rows, spread), lambda rows: apart(rows, lambda cells: hung(rows, cells), whole(rows)))


def place_sections(s: Column) -> Column:
    """Each section is placed on its own: spans never cross from header to body."""
    grids = F.transform(F.array(s["head"], s.rest, s.foot), _place)
    return let(
        grids,
        lambda g: F.struct(F.get(g, 0).alias("head"), F.concat(F.get(g, 1), F.get(g, 2)).alias("body")),
    )


def _has_text(row: Column) -> Column:
    return F.exists(row, lambda t: t != "")


def settle_header(g: Column) -> Column:
    """In a header of several rows, blank rows drop out; blank rows after the last
    one with text count as data."""
    rows = F.transform(g["head"], lambda r, i: F.when(_has_text(r), i + 1).otherwise(0))
    split = let(
        F.array_max(rows),
        lambda last: F.struct(
            F.filter(F.slice(g["head"], F.lit(1), last), _has_text).alias("head"),
            F.concat(F.slice(g["head"], last + 1, F.lit(_ALL)), g.body).alias("body"),
        ),
    )
    blank = F.exists(g["head"], lambda r: ~_has_text(r))
    return F.when((F.size(g["head"]) > 1) & blank, split).otherwise(g)


def square(g: Column) -> Column:
    """Pad every row to the widest one; in a one-column table blank data rows drop out.

    Rows stay as they are if the padded grid had more than ``MAX_POSITIONS``.
    """

    def padded(width):
        small = width.cast("long") * (F.size(g["head"]) + F.size(g.body)) <= K.MAX_POSITIONS

        def pad(rows):
            ragged = small & F.exists(rows, lambda r: F.size(r) < width)
            full = F.transform(
                rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))
            )
            return F.when(ragged, full).otherwise(rows)

        body = F.when(width == 1, F.filter(g.body, _has_text)).otherwise(g.body)
        return F.struct(pad(g["head"]).alias("head"), pad(body).alias("body"), width.alias("n_cols"))

    sizes = F.transform(F.concat(g["head"], g.body), lambda r: F.size(r))
    return let(F.coalesce(F.array_max(sizes), F.lit(0)), padded)


def table_grid(html: Column) -> Column:
    """The whole way from element HTML to a squared grid; null if there is no table."""
    grid = first_table(html)
    for stage in (sections, split_header, place_sections, settle_header, square):
        grid = let(grid, _unless_null(stage))
    return grid


def _unless_null(stage):
    return lambda v: F.when(v.isNotNull(), stage(v))


def header_names(g: Column) -> Column:
    """One flat name per column: header levels joined by ``__``, equal neighbours once."""

    def name(i):
        levels = F.transform(g["head"], lambda r: F.get(r, i))
        kept = F.filter(levels, lambda t, j: (j == 0) | (t != F.get(levels, j - 1)))
        return F.array_join(F.filter(kept, lambda t: t != ""), "__")

    columns = F.filter(F.sequence(F.lit(0), g.n_cols), lambda i: i < g.n_cols)
    return F.transform(columns, name)


def paragraph(html: Column, css_class: str) -> Column:
    """Text of the first ``<p>`` with that class, ``""`` if there is none."""
    pattern = rf'(?is)<p[^>]*class="{css_class}"[^>]*>(.*?)</p>'
    return squeeze(F.regexp_extract(html, pattern, 1))
