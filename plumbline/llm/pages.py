"""Main text of web pages by text-to-tag ratios.

The standard library's parser sends its events to a reader that keeps blocks (the page's lines):
their text, the tags met since the last block, and the elements they stand in.  The ratio of text
to tags of each line is smoothed by a Gaussian, two clusters of the smoothed ratios give the
threshold, and the lines above it show the content region: the outermost element outside of which
nothing but boilerplate is left.  Of this region every line is kept, short ones too, but for those
in elements that say what they are: menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments.
"""

from __future__ import annotations

import functools
import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0  # of the smoothing, in lines
MOST = 0.5  # of the text without links: an element with more of it is not boilerplate by its name

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var".split()
)
REGION = frozenset("html body main article section div td center".split())
HIDDEN = frozenset(
    "nav footer aside form script style noscript template button select option textarea svg math "
    "iframe object canvas audio video dialog menu head title datalist map".split()
)
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer "
    "sidebar aside complementary contentinfo cookie cookies consent gdpr notice alert popup modal "
    "overlay subscribe subscription newsletter signup login share sharing social related "
    "recommended comment comments commentlist respond reply replies disqus form search pagination "
    "pager widget skip".split()
)
# what may stand behind the word that says it
TRAILING = frozenset(
    "area bar bars block blocks bottom box column container content inner item items left link links "
    "list outer panel primary right secondary section site top widgets wrap wrapper".split()
)
# the name is that of a state or of a layout: has-sidebar, no-comments, layout-sidebar-left
STATE = frozenset(
    "has have no not non with without is are hide hides hidden show shows open opened closed enabled disabled "
    "layout single".split()
)
READERS = frozenset("comment comments commentlist respond reply replies disqus".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
HEADING = 2  # kind of a block; 1 is other text, 0 links
SURE, WHOLE, PART = 3, 2, 1  # how an element says that it is not the article


@functools.lru_cache(1 << 12)
def _named(token: str) -> int:
    """Whether one name of a class, id or role says it: as a whole, in a part, or not (0)."""
    words = WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower())
    if not STATE.isdisjoint(words):
        return 0
    while words and words[-1] not in NAMED and words[-1] in TRAILING:
        words.pop()
    if not words or words[-1] not in NAMED:
        return 0
    if not READERS.isdisjoint(words[-1:]):
        return SURE
    return WHOLE if NAMED.issuperset(words) else PART


def _called(attrs) -> int:
    """How surely an element's attributes say that it is not the article."""
    said = 0
    for key, value in attrs:
        if key in ("class", "id", "role") and value:
            said = max(said, *(_named(x) for x in value.split()), 0)
        elif key == "hidden" or (key == "aria-hidden" and value == "true"):
            return SURE
        elif key == "style" and value and "display:none" in value.replace(" ", "").lower():
            return SURE
    return said


class Reader(HTMLParser):
    """Blocks in page order, of a page that may be malformed.

    A block is (text, tags, outside, region, names, kind): ``names`` are the numbers of elements
    around it that only their name calls boilerplate, ``kind`` is 0 for mostly text of links.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int, int]] = []  # tag, out: 1 header, 2 other, region, name
        self.parents: list[int] = [-1]
        self.kinds: list[str] = [""]  # tags of the regions
        self.names: list[list] = []  # how surely, whether it has an article, main or h1 inside
        self.blocks: list[tuple[str, int, bool, int, tuple[int, ...], int]] = []
        self.parts: list[str] = []
        self.tags = 0
        self.anchor = False
        self.linked = 0  # characters of links in this block

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        self.parts = []
        if text:
            names = tuple(x[3] for x in self.stack if x[3] >= 0)
            kind = int(2 * self.linked < len(text))
            if any(x[0] in HEADINGS for x in self.stack):
                kind = HEADING
            self.blocks.append((text, self.tags, self.outside(), self.region(), names, kind))
            self.tags = 0
        self.linked = 0

    def region(self) -> int:
        return self.stack[-1][2] if self.stack else 0

    def outside(self) -> bool:
        out = max((x[1] for x in self.stack), default=0)
        if out == 1:  # a heading in the header of an article is its title
            names = {x[0] for x in self.stack}
            return not (names & HEADINGS and names & {"article", "main"})
        return out == 2

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in VOID:
            if tag == "br" or tag == "hr":
                self.parts.append(" ")
                if tag == "hr":
                    self.flush()
            return
        called = _called(attrs)
        if tag in INLINE and not called:
            self.anchor |= tag == "a"
            return
        self.flush()
        self.anchor = False  # a link does not reach over blocks here, which keeps more text
        self.implied(tag)
        if tag in ("article", "main", "h1"):
            for x in self.stack:
                if x[3] >= 0:
                    self.names[x[3]][1] = True
        out, name = 0, -1
        if tag == "header":
            out = 1
        elif tag in HIDDEN:
            out = 2
        elif called and tag not in ("html", "body", "main"):
            if called == SURE:
                out = 2
            else:
                self.names.append([called, False])
                name = len(self.names) - 1
        number = self.region()
        if tag in REGION:
            self.parents.append(number)
            self.kinds.append(tag)
            number = len(self.parents) - 1
        self.stack.append((tag, out, number, name))

    def implied(self, tag: str) -> None:
        """Close what a new block closes by itself: an open paragraph, a list item, a cell."""
        if tag in INLINE:
            return
        ends = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",),
                "td": ("tr",), "th": ("tr",), "option": ("select",)}
        same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name == "p":
                del self.stack[k:]
                break
            if name in REGION or name in HIDDEN or name in ("ul", "ol", "table", "dl", "header"):
                break
        if tag in ends:
            for k in range(len(self.stack) - 1, -1, -1):
                name = self.stack[k][0]
                if name in same.get(tag, (tag,)):
                    del self.stack[k:]
                    break
                if name in ends[tag]:
                    break

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.anchor = False
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.flush()
                del self.stack[k:]
                return
            if tag == "p" and self.stack[k][0] in REGION:
                break
        if tag not in INLINE:
            self.flush()

    def handle_data(self, data):
        if not any(x[0] in ("script", "style") for x in self.stack[-1:]):
            self.parts.append(data)
            self.linked += len(data.strip()) if self.anchor else 0

    def close(self):
        super().close()
        self.flush()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel, mode="full")[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel, mode="full")[reach : reach + len(ratios)] / weight


def threshold(values: np.ndarray) -> float:
    """Border between two clusters: where the variance between them is largest."""
    v = np.sort(values)
    if len(v) < 2 or v[0] == v[-1]:
        return float(v[0]) if len(v) else 0.0
    n = np.arange(1, len(v))
    low = np.cumsum(v)[:-1] / n
    high = (v.sum() - np.cumsum(v)[:-1]) / (len(v) - n)
    best = int(np.argmax(n * (len(v) - n) * (high - low) ** 2))
    return float((v[best] + v[best + 1]) / 2)


def main_text(html: str | None) -> str:
    """Blocks of the content region, joined by line feeds; empty if there is none."""
    if not html:
        return ""
    reader = Reader()
    reader.feed(html)
    reader.close()
    blocks = reader.blocks
    if all(b[2] for b in blocks):
        return ""
    ratios = np.array([len(b[0]) / (1 + b[1]) for b in blocks])
    smooth = np.log1p(smoothed(ratios))
    content = smooth >= threshold(smooth)
    hidden = np.array([b[2] for b in blocks])
    # a name does not count on an element that holds most of the text, but for links
    sizes = np.array([0 if b[2] or not b[5] else len(b[0]) for b in blocks])
    held = np.zeros(len(reader.names))
    for b, size in zip(blocks, sizes, strict=True):
        held[list(b[4])] += size
    fires = [
        h <= MOST * sizes.sum() or (how == WHOLE and not inside)
        for h, (how, inside) in zip(held, reader.names, strict=True)
    ]
    hidden |= np.array([any(fires[k] for k in b[4]) for b in blocks], bool)
    if hidden.all():
        return ""
    # characters of lines in the content cluster and headings, but for links, of an element with its
    # inner elements (numbers grow inwards); any text but links of its own
    weight, own = np.zeros(len(reader.parents)), np.zeros(len(reader.parents))
    for b, high, out in zip(blocks, content, hidden, strict=True):
        if not out and b[5]:
            weight[b[3]] += len(b[0]) * (high or b[5] == HEADING)
            own[b[3]] += len(b[0])
    for k in range(len(weight) - 1, 0, -1):
        weight[reader.parents[k]] += weight[k]
    inner: dict[int, list[int]] = {}
    for k in range(1, len(weight)):
        inner.setdefault(reader.parents[k], []).append(k)
    region = 0
    # only boilerplate may be left outside
    while reader.kinds[region] not in ("article", "main") and not own[region]:
        best = max(inner.get(region, ()), key=lambda k: weight[k], default=0)
        if not weight[best] or weight[best] < weight[0]:
            break
        region = best
    inside = np.zeros(len(weight), bool)
    inside[region] = True
    for k in range(region + 1, len(weight)):
        inside[k] = inside[reader.parents[k]]
    return "\n".join(b[0] for b, out in zip(blocks, hidden, strict=True) if inside[b[3]] and not out)


def extracted(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars (code points).

    White space inside a block becomes one blank, character references are decoded, blocks are
    joined by one line feed in page order.  Null and empty html, and pages of boilerplate alone,
    give an empty text.  Null ids and urls are passed on; repeated rows give repeated results;
    other columns are ignored; an empty table gives no rows.  Pages of any length are read whole.
    """

    @F.pandas_udf("string")
    def extract(html: pd.Series) -> pd.Series:
        return html.map(lambda h: main_text(h) if isinstance(h, str) else "")

    out = pages.select("page_id", "url", extract("html").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
