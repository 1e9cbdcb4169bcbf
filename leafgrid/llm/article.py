"""Operator 10: the main text of a web page by tree scoring.

A page's tags form a light tree of blocks.  Every paragraph passes points for its length and commas to its parent, half of them
to the grandparent, a third to the next; a container's points are discounted by its share of link text.  The best container is
kept, widened to the article it is part of, with those of its siblings that score well or read like prose.  Menus, headers,
footers, sidebars, notices, adverts, forms, comments, scripts and styles are taken out by tag, role and class name first.  Forms and class
names only suggest it: an element that has all the articles of a page or most of its paragraph points stays, and words such as
``with-sidebar`` or ``ad-free`` say nothing of the element itself.

Character references are decoded, white space inside a block becomes one space, blocks are joined by an empty line.  Nothing is cut.

Defined results: null and empty pages and pages without content give an empty text; unclosed tags end with their container;
a tag that the page's end cuts off is markup, not text; repeated rows give equal texts; an empty table gives no rows; other columns
stay out.  A page is handled in its own row.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|itemprop|aria-label)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
RAW = {"script", "style", "template", "noscript", "iframe", "textarea", "svg", "object", "canvas", "math"}
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th "
    "thead title tr ul".split()
)
JUNK_TAGS = set("nav footer aside form head title select button dialog menu fieldset input label option".split())
JUNK_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs byline-share comment comments commentlist consent "
    "cookie cookies copyright disqus donate footer footnav gdpr header infobar login masthead menu menubar message-bar modal nav navbar navigation "
    "newsletter notice notices notification outbrain overlay pager pagination paywall popular popup privacy promo promoted promotion recommended "
    "related replies reply respond rss search share sharing shoutbox sidebar sidenav signup site-header site-footer skyscraper social sponsor sponsored "
    "subscribe subscription taboola tags teaser toolbar topbar trending warning widget widgets".split()
)
#: First and last parts of class names that tell of something beside the element, or of a state.
BESIDE_FIRST = set("with has no not without is hide show tags tag".split())
BESIDE_LAST = set("free open opened closed enabled disabled none off on left right visible hidden".split())
REPLIES = set("comment comments commentlist disqus replies reply respond".split())
JUNK_ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
GOOD_WORDS = set("article body content entry main page post story text blog hentry articlebody".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
FENCES = {"ul", "ol", "dl", "table", "html", "body", "article", "section", "main", "div"}


DEEP = 512


class Node:
    __slots__ = ("tag", "parent", "points", "junk", "size", "links", "first", "last", "article", "good", "most", "inside", "depth")

    def __init__(self, tag, parent, junk, good, most=0.0):
        self.tag, self.parent, self.junk, self.good = tag, parent, junk, good
        self.most = most  # junk unless it has more than this share of the page's points
        self.points, self.size, self.links, self.first, self.last = 0.0, 0, 0, -1, -1
        self.article = tag in ("article", "main")
        #: whether it is an article or in one
        self.inside = self.article or parent is not None and parent.inside
        self.depth = parent.depth + 1 if parent is not None else 0


def _look(tag, attributes, parent):
    """(junk, good, share of the page's points it needs to stay) of a tag by its name, role and class words."""
    if parent.junk or tag in JUNK_TAGS and tag != "form":
        return True, False, 0.0
    if tag == "header":
        return not parent.inside, False, 0.0
    words, names, role, hidden = set(), set(), "", False
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            names.update(value.split())
            words.update(re.split(r"[\s_-]+", value))
        elif name == "role":
            role = value.strip()
        elif name == "hidden":
            hidden = True
        elif name == "style":
            hidden = hidden or "display:none" in value.replace(" ", "") or "visibility:hidden" in value.replace(" ", "")
        elif name == "itemprop" and value == "articlebody":
            words.add("articlebody")
    words |= names
    if hidden or role in JUNK_ROLES:
        return True, False, 0.0
    if tag in ("body", "html", "main") or tag in HEADINGS and "h1" == tag:
        return False, False, 0.0
    most = 0.5 if tag == "form" else 0.0
    for name in names:
        parts = re.split(r"[_-]+", name)
        if name in JUNK_WORDS:
            most = 0.9
        elif tag != "article" and JUNK_WORDS.intersection(parts) and parts[0] not in BESIDE_FIRST and parts[-1] not in BESIDE_LAST:
            most = max(most, 0.9 if REPLIES.intersection(parts) else 0.5)
    return False, not most and bool(words & GOOD_WORDS), most


def points_of(node, text):
    """What a block counts for its containers."""
    return 1 + text.count(",") + min(len(text) / 100, 3) if len(text) >= 25 and node.tag not in HEADINGS else 0


def without_junk(blocks):
    """The blocks outside elements that their names make junk and that hold too little of the page to be its text."""
    total, inside = 0.0, 0.0
    held: dict[int, list] = {}
    above = []
    for node, text, _ in blocks:
        points, up, article, soft = points_of(node, text), node, False, []
        while up is not None:
            article = article or up.article and up.most < 0.9
            if up.most:
                soft.append((up, article))
            up = up.parent
        total += points
        inside += points * article
        above.append([n for n, _ in soft])
        for n, own in soft:
            x = held.setdefault(id(n), [n, 0.0, 0.0])
            x[1] += points
            x[2] += points * own
    gone = {k for k, (n, points, own) in held.items() if points <= n.most * total and (not own or own < inside)}
    return [b for b, nodes in zip(blocks, above) if not any(id(n) in gone for n in nodes)] if gone else blocks


def blocks_of(page: str):
    """(root, blocks): each block is (container, text, share of link text, tag)."""
    root = Node("html", None, False, False)
    at, links, blocks = root, 0, []
    pieces: list[tuple[str, bool]] = []

    def end_block():
        if pieces:
            text = " ".join("".join(p for p, _ in pieces).split())
            if text and not at.junk:
                linked = sum(len(" ".join(p.split())) for p, is_link in pieces if is_link)
                blocks.append((at, text, linked))
            pieces.clear()

    pos, size = 0, len(page)
    while pos < size:
        m = TOKEN.search(page, pos)
        stop = m.start() if m else size
        if stop > pos:
            pieces.append((entities.unescape(page[pos:stop]), links > 0))
        if not m:
            break
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m[1])
        if tag in RAW:
            if not closing and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|\Z)", re.I).search(page, pos)
                pos = end.end() if end else size
            continue
        if tag == "a":
            links = max(0, links - 1) if closing else 1
            continue
        if tag == "br":
            pieces.append((" ", False))
            continue
        if tag not in BLOCKS and tag not in JUNK_TAGS:
            continue
        if tag == "hr" or tag in EMPTY:
            if tag == "hr":
                end_block()
            continue
        if closing:
            node = at
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                end_block()
                at, links = node.parent, 0
            elif tag == "p":
                end_block()
            continue
        end_block()
        links = 0
        if at.tag == "p" or at.tag in HEADINGS and tag in BLOCKS:
            at = at.parent
        if tag in CLOSES:
            node = at
            while node.parent is not None and node.tag not in FENCES:
                if node.tag in CLOSES[tag]:
                    at = node.parent
                    break
                node = node.parent
        if at.depth >= DEEP:  # as browsers do, what is deeper stands beside
            at = at.parent
        at = Node(tag, at, *_look(tag, m[3], at))
    end_block()
    return root, blocks


PARTS = {"p", "pre", "td", "th", "li", "dd", "dt", "blockquote", "figcaption", "caption", "summary"} | HEADINGS


#: Siblings of the best container that are text of the same article if they hold text and few links.
OWN_PARTS = {"p", "section", "article", "blockquote", "pre"}


def main_text(page: str | None) -> str:
    """The article of one page."""
    if not page:
        return ""
    _, blocks = blocks_of(page)
    blocks = without_junk(blocks)
    if not blocks:
        return ""
    nodes: dict[int, Node] = {}
    for i, (node, text, linked) in enumerate(blocks):
        up = node
        while up is not None:
            if id(up) not in nodes:
                nodes[id(up)] = up
                up.first = i
                up.points = 25.0 * up.article + 25.0 * up.good
            up.last = i
            up.size += len(text)
            up.links += linked
            up = up.parent
        if points := points_of(node, text):
            up, share = node.parent if node.tag in PARTS and node.parent is not None else node, 1
            while up is not None and share <= 3:
                up.points += points / share
                up, share = up.parent, share + 1
    value = lambda n: n.points * (1 - min(1.0, n.links / max(1, n.size)))
    held = [n for n in nodes.values() if n.tag not in PARTS]
    best = max(held, key=lambda n: (value(n), n.size, -n.first)) if held else blocks[0][0]
    up = best
    while up is not None and not up.article:
        up = up.parent
    if up is not None:
        best = up
    keep = {id(best)}
    if best.parent is not None and not best.article:
        for n in nodes.values():
            if n is not best and n.parent is best.parent:
                dense = n.links / max(1, n.size)
                if value(n) >= max(10, value(best) / 5) or n.tag in OWN_PARTS and dense < 0.25 and n.size > 80 or n.tag in HEADINGS and n.last < best.first:
                    keep.add(id(n))
    # lists and tables that are mostly links are menus
    menus = {id(n) for n in nodes.values() if n.tag in ("ul", "ol", "table", "dl") and n.last > n.first and n.links > 0.6 * n.size}
    out = []
    for node, text, _ in blocks:
        up, inside = node, False
        while up is not None:
            if id(up) in menus:
                break
            inside = inside or id(up) in keep
            up = up.parent
        else:
            if inside:
                out.append(text)
    return "\n\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html)."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
