"""HTML extraction: text-to-tag ratios, smoothed and clustered, select content regions.

The standard library's parser turns a page into a stream of events.  Each block
element's own text is a line; a line knows its characters, its tags and its chain of
open elements.  Lines under elements that cannot hold the article (menus, page headers
and footers, sidebars, forms, notices, adverts, reader comments, hidden elements; by
element name, role, class or id) count as tags without text.  A line's ratio is
characters by tags.  The ratios are smoothed with a Gaussian over neighbouring lines
and split into two clusters by one-dimensional 2-means; lines of the upper cluster, and
first headings, select the region: the article or main elements around them, or, where there are
none, the lowest element that holds them all.  All text of the region is returned,
short lines included, except what those boilerplate elements hold.

Inside an article or main element a name is weaker evidence: of headings, paragraphs of
prose, tables, figures and sections it decides nothing by a single word of it.  There an
element is boilerplate only by its element name or role, or if a class (for a plain box
an id, too; for a section one about comments) consists of nothing but words for boilerplate and for boxes: ``ad``,
``comment-list`` and ``related-posts`` are, ``related-work``, ``menu-prices`` and
``recommended-dose`` are not.

Character references are decoded, white space inside a block becomes one blank, a
block is trimmed, blocks are joined by a newline in page order.

Nulls and odd input: a null or empty page, or one without text, gives an empty text
with 0 characters; unclosed elements end with their parent or the page; a page
without markup is one block; repeated rows and null ids or urls are passed on; a page
is parsed whole whatever its length, in time that grows with it (a tag looks up the
open elements only if there is one that it can close); an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import read

SIGMA = 1.0
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text of a page.
SILENT = set("head script style noscript template svg object iframe canvas audio video map title textarea select button datalist".split())
#: Elements and roles that never hold the article.
APART = set("nav aside footer form menu dialog".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that mark what is not the article.
MARKED = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion promoted "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription paywall "
    "sidebar sidebars aside nav navbar navigation navi menu menus breadcrumb breadcrumbs footer footnav masthead topbar "
    "comment comments commentlist respond replies disqus share sharing social related recommended recommendations "
    "widget widgets toolbar pagination pager skip login signup search legal copyright disclaimer adsbygoogle".split()
)
#: A class name that starts so tells of the page around an element (has-sidebar, menu-open), not of the element.
AROUND = set("has with no without is layout page body wrap wrapper".split())
#: Beside a word for a header, these say that it is the article's own.
OWN = set("article post entry content story".split())
HEADS = set("header head banner masthead topbar".split())
MAIN = set("article main".split())
#: Words for boxes: beside a word for boilerplate they change nothing.
BOX = set("list lists box boxes block blocks wrap wrapper container section area form item items bar bars link links post posts article articles content inner outer slot unit module panel group row col left right top bottom header title text body site page thread js".split())
#: Inside an article, elements that a class can mark, and those that an id can mark.
BY_CLASS = set("div section ul ol p span ins dl center".split())
BY_ID = set("div ins center ul ol".split())
READERS = set("comment comments commentlist respond replies disqus".split())
WORDS = re.compile(r"[a-z]+")


class Element:
    __slots__ = ("apart", "main", "number", "parent", "silent", "tag", "titled")

    def __init__(self, tag: str, parent: Element | None, apart: bool, silent: bool, main: Element | None, number: int):
        self.tag, self.parent, self.apart, self.silent, self.number = tag, parent, apart, silent, number
        self.main = self if main is True else main
        self.titled = tag == "h1" or parent is not None and parent.titled  # under a first heading


class Line:
    __slots__ = ("at", "tags", "text")

    def __init__(self, text: str, tags: int, at: Element):
        self.text, self.tags, self.at = text, tags, at


class Lines(HTMLParser):
    """Parser events to lines, one for each run of text that block tags part."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Element("", None, False, False, None, 0)
        self.elements = [self.root]  # parents come before what they hold
        self.open: Counter[str] = Counter()
        self.out: list[Line] = []
        self.parts: list[str] = []
        self.tags = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text or self.tags:
            self.out.append(Line("" if self.here.apart else text, self.tags, self.here))
        self.parts, self.tags = [], 0

    def apart(self, tag: str, attrs: list) -> bool:
        if tag in APART:
            return True
        inside = self.here.main is not None
        if tag == "header" and not inside:
            return True
        words: set[str] = set()
        marked = False
        for name, value in attrs:
            if name == "hidden":
                return True
            value = (value or "").lower()
            if name == "role" and value.strip() in ROLES or name == "aria-hidden" and value == "true":
                return True
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
            if name in ("class", "id"):
                for part in map(WORDS.findall, value.split()):
                    if part and part[0] not in AROUND:
                        words.update(part)
                        by, kind = (BY_CLASS, MARKED) if name == "class" else (BY_ID, MARKED) if tag in BY_ID else (BY_CLASS, READERS)
                        marked |= tag in by and not kind.isdisjoint(part) and (kind | BOX).issuperset(part)
        if tag in ("html", "body", "main"):
            return False
        if tag == "article":
            return bool(words & {"comment", "comments", "related", "promo", "sponsored", "ad", "advert"})
        if inside:
            return marked
        return bool(words & MARKED) or bool(words & HEADS) and not words & OWN and tag not in ("h1", "h2")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        block = tag in BLOCKS
        if block:
            self.flush()
            self.close_implied(tag)
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        apart = self.here.apart or self.apart(tag, attrs)
        main = True if tag in MAIN and not apart else self.here.main
        self.here = Element(tag, self.here, apart, self.here.silent or tag in SILENT, main, len(self.elements))
        self.elements.append(self.here)
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def close_implied(self, tag: str) -> None:
        """A block ends an open paragraph; an item ends the one before it; body ends head."""
        ends, walls = {"li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "body": ({"head"}, set())}.get(tag, ({"p"}, BLOCKS - {"p"}))
        if not any(self.open[t] for t in ends):
            return
        e, last = self.here, None
        while e.parent and e.tag not in walls:
            if e.tag in ends:
                last = e
            e = e.parent
        if last:
            self.leave(last)

    def leave(self, e: Element) -> None:
        """Closes an open element and what is open in it."""
        while self.here is not e.parent:
            self.open[self.here.tag] -= 1
            self.here = self.here.parent

    def handle_endtag(self, tag: str) -> None:
        e = self.here if self.open[tag] else self.root
        while e.parent and e.tag != tag:
            e = e.parent
        if tag in BLOCKS or (e.parent and self.apart_changes(e)):
            self.flush()
        self.tags += 1
        if e.parent:
            self.leave(e)

    def apart_changes(self, e: Element) -> bool:
        return self.here.apart != e.parent.apart

    def handle_data(self, data: str) -> None:
        if not self.here.silent and not self.here.apart:
            self.parts.append(data)


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian over neighbouring lines; weights beyond the ends are left out."""
    reach = max(1, math.ceil(2 * sigma))
    g = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        w = g[lo - i + reach : hi - i + reach]
        out.append(sum(a * b for a, b in zip(w, values[lo:hi], strict=True)) / sum(w))
    return out


def threshold(values: list[float]) -> float:
    """The middle between the two cluster means of one-dimensional 2-means."""
    lo, hi = min(values), max(values)
    for _ in range(50):
        cut = (lo + hi) / 2
        low, high = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not low or not high:
            return cut
        a, b = sum(low) / len(low), sum(high) / len(high)
        if (a, b) == (lo, hi):
            break
        lo, hi = a, b
    return (lo + hi) / 2


def region(lines: list[Line], elements: list[Element]) -> set[Element]:
    """The elements that hold the content."""
    ratios = smooth([len(x.text) / max(1, x.tags) for x in lines])
    cut = threshold(ratios)
    full = [(x, r) for x, r in zip(lines, ratios, strict=True) if x.text]
    # a first heading counts whatever its ratio; one of the page's own header has no text left
    chosen = [x.at for x, r in full if r >= cut or x.at.titled] or [x.at for x, _ in full]
    mains = {e.main for e in chosen if e.main}
    if mains:
        return mains
    held = [0] * len(elements)
    for e in chosen:
        held[e.number] += 1
    for e in reversed(elements[1:]):
        held[e.parent.number] += held[e.number]
    # elements that hold all are a chain; the last to open is the lowest
    top = elements[max(i for i, n in enumerate(held) if n == len(chosen))]
    if top.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre") and top.parent:
        top = top.parent  # a single block: what stands beside it belongs to it
    return {top}


def main_text(html: str | None) -> str:
    """The page's main text, blocks joined by a newline."""
    if not html:
        return ""
    cut = html.rfind("<")
    if cut >= 0 and ">" not in html[cut:] and re.match(r"[/!?a-zA-Z]", html[cut + 1 :]):
        html = html[:cut]  # the page ends inside a tag
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    if not any(x.text for x in parser.out):
        return ""
    own = region(parser.out, parser.elements)
    inside: dict[Element, bool] = {}

    def holds(e: Element) -> bool:
        chain, at = [], e
        while at is not None and at not in inside and at not in own:
            chain.append(at)
            at = at.parent
        found = at is not None and (at in own or inside[at])
        inside.update(dict.fromkeys(chain, found))
        return found

    return "\n".join(x.text for x in parser.out if x.text and holds(x.at))


def extract(pages: DataFrame, *, html_col: str = "html", keep: list[str]) -> DataFrame:
    """The columns ``keep`` with text and n_chars, for every whole page."""
    source = pages.select(*keep, F.col(html_col).alias("__html"))
    schema = pages.select(*keep, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return source.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"), keep=["page_id", "url"])
