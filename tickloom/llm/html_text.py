"""Main text of web pages: parser events, text-to-tag ratios smoothed over lines, and the region that the high cluster lies in.

The standard library's parser tells tags and text one after another; no document tree is built, only a row an element (tag, parent, what it is
for) and a row a line (a block's text, the tags met in it, its text in links, its element). A line's ratio is its text outside links by its tags, 0 in
page furniture. Ratios are smoothed by a Gaussian, so that a short line among long ones stays with them, and cut in two clusters. The region is then the
innermost container with nearly all text of the high cluster (an article or main element where the page has them); its lines that are no furniture
are the text, short ones too, joined in page order.

Furniture is what tags, roles and names of classes and ids say: menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts, styles, hidden elements.

Defined cases: null and empty html, and pages without text, give an empty text; unclosed and stray tags are read as browsers read them; rows alike give
rows alike; null ids and urls come through; other columns are not read; pages are independent, each is held whole by one task.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option"
    " p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that a region may be.
CONTAINERS = frozenset("article body center div html main section table tbody td tr".split())
#: Never shown as text, or furniture by their tag alone.
UNSEEN = frozenset("script style template noscript title iframe svg math object canvas audio video datalist head".split())
FURNITURE = frozenset("nav footer aside form button select option textarea dialog menu fieldset label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split())
#: A start tag of the key ends an open element of the value, if one of the third stands not between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead"}, {"table"}), "a": ({"a"}, {"td", "div"}), "body": ({"head"}, {"html"}),
}
#: Words of classes and ids that say what an element is for. Furniture around a whole layout does not hide the article in it.
LAYOUT = frozenset("banner topbar sidebar sidebars notice notices notification notifications alert alerts overlay widget widgets toolbar".split())
OTHERS = frozenset(
    "nav navbar navigation navi subnav menu menus submenu breadcrumb breadcrumbs pagination pager paging footer foot colophon copyright ad ads adv adbox adslot adunit adsense adwords dfp"
    " cookie cookies consent gdpr ccpa popup popups modal lightbox toast newsletter subscribe subscription signup login signin search searchbox share sharing social sociallinks related recommended"
    " recommendations promo promos promotion promoted teaser teasers outbrain taboola reply replies respond disqus skip skiplink form forms".split()
)
STEMS = re.compile(r"(?:advert|sponsor|comment(?!ary)|breadcrumb|cookie)")
HEADERS = frozenset("header masthead".split())
#: A header by these names is the article's own.
OWN = frozenset("article post entry story content".split())
#: Names with these tell of a page's layout or state, not of the element.
STATES = frozenset("has no not with without layout open closed enabled disabled".split())
#: What makes an article element someone else's.
FOREIGN = frozenset("ad ads promo teaser related recommended reply replies respond".split())

_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SHOWN, HARD, SOFT, HEADER, OWN_HEADER = range(5)

#: Width of the Gaussian in lines, and the share of the high cluster's text that a region holds.
SIGMA, SHARE = 1.0, 0.8
ROWS = 256


def words(names: str) -> Iterator[list[str]]:
    """The words of each class or id."""
    for name in names.split():
        yield [w.lower() for w in _WORDS.findall(name)]


def _named(attrs: dict[str, str | None]) -> set[str]:
    """What an element's classes and id say that it is: layout, other, foreign (said of an article), header, own (an article's header)."""
    out = set()
    for found in words(f"{attrs.get('class') or ''} {attrs.get('id') or ''}"):
        have = set(found)
        if have & STATES:
            continue
        stem = any(map(STEMS.match, found))
        told = {"other": stem or have & OTHERS, "foreign": stem or have & FOREIGN, "layout": have & LAYOUT, "header": have & HEADERS, "own": have & HEADERS and have & OWN}
        out |= {k for k, v in told.items() if v}
    return out


class Page(HTMLParser):
    """Lines and elements of a page, from parser events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        #: Elements: tag, parent, innermost block, purpose (own or from above); lines: text, tags, characters in links, element, purpose.
        self.tags, self.parents, self.block, self.purpose = ["#"], [0], [0], [SHOWN]
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.stack, self.open = [0], Counter()
        self.text: list[str] = []
        self.met = self.linked = 0

    def flush(self) -> None:
        if self.text:
            t = " ".join("".join(self.text).split())
            if t:
                at = self.block[self.stack[-1]]
                self.lines.append((t, self.met, min(self.linked, len(t)), at, self.purpose[at]))
                self.met = 0
            self.text, self.linked = [], 0

    def _pop(self) -> None:
        tag = self.tags[self.stack[-1]]
        if tag in BLOCKS:
            self.flush()
        self.open[tag] -= 1
        self.stack.pop()

    def _close(self, tags: set[str], fence: set[str]) -> None:
        """End the innermost open element of these tags, unless a fence is further in."""
        if not any(self.open[t] for t in tags):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.tags[self.stack[k]]
            if tag in tags:
                while len(self.stack) > k:
                    self._pop()
                return
            if tag in fence:
                return

    def _for(self, tag: str, attrs: dict[str, str | None], above: int) -> int:
        named = _named(attrs)
        if tag in ("main", "article"):
            # An article in an article is a comment on it.
            return HARD if above == HARD or (tag == "article" and ("foreign" in named or self.open["article"])) else SHOWN
        if above == HARD or tag in UNSEEN or tag in FURNITURE or (attrs.get("role") or "").lower() in ROLES or "hidden" in attrs or _HIDDEN.search(attrs.get("style") or ""):
            return HARD
        if tag in ("html", "body"):
            return above
        if "other" in named:
            return HARD
        if "layout" in named:
            return SOFT
        if tag == "header" or "header" in named:
            return above if above == SOFT else OWN_HEADER if "own" in named or self.open["article"] or self.open["main"] else HEADER
        return SHOWN if above == OWN_HEADER and tag in HEADINGS else above

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("br", "wbr"):
            self.met += 1
            if tag == "br":
                self.text.append(" ")
            return
        if tag in BLOCKS:
            self.flush()
            if self.open["p"]:
                self._close({"p"}, {"td", "th", "li", "button"})
            if self.open["head"] and tag not in ("title", "head"):
                self._close({"head"}, set())
        if tag in ENDS:
            self._close(*ENDS[tag])
        self.met += 1
        if tag in VOID:
            return
        above = self.purpose[self.stack[-1]]
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        self.purpose.append(self._for(tag, dict(attrs), above) if attrs or tag in BLOCKS or tag in UNSEEN or tag in FURNITURE else above)
        self.stack.append(len(self.tags) - 1)
        self.block.append(self.stack[-1] if tag in BLOCKS else self.block[self.stack[-2]])
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self.open["svg"] and self.tags[self.stack[-1]] == tag:
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS and (self.open[tag] or tag == "p"):
            self.flush()
        self.met += 1
        if tag not in VOID and self.open[tag]:
            self._close({tag}, set() if tag in BLOCKS else {"td", "th", "table"})

    def handle_data(self, data: str) -> None:
        at = self.stack[-1]
        # Furniture within a block is left out of it; furniture that is a block is a line, without a ratio.
        if self.tags[at] not in UNSEEN and (self.purpose[at] != HARD or self.purpose[self.block[at]] == HARD):
            self.text.append(data)
            if self.open["a"]:
                self.linked += len(data)


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """A Gaussian mean over three widths to each side."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        a, z = max(0, i - reach), min(len(values), i + reach + 1)
        part = kernel[a - i + reach : z - i + reach]
        out.append(sum(w * v for w, v in zip(part, values[a:z], strict=True)) / sum(part))
    return out


def threshold(values: list[float]) -> float:
    """Between the two clusters of values: means of those below and above, until they stay."""
    low, high = min(values), max(values)
    while True:
        cut = (low + high) / 2
        under, over = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not under or not over:
            return cut
        now = sum(under) / len(under), sum(over) / len(over)
        if abs(now[0] - low) + abs(now[1] - high) < 1e-9 * (1 + high):
            return cut
        low, high = now


def _sums(page: Page, own: list[float]) -> list[float]:
    """Each element's value and those of all within it; elements stand after their parents."""
    out = list(own)
    for e in range(len(out) - 1, 0, -1):
        out[page.parents[e]] += out[e]
    return out


def _regions(page: Page, weights: list[float]) -> set[int]:
    """The elements that hold the article, given what text of each line is in the high cluster."""
    n = len(page.tags)
    high, any_ = [0.0] * n, [0.0] * n
    for (t, _, _, e, purpose), w in zip(page.lines, weights, strict=True):
        if purpose == SHOWN:
            high[e] += w
            any_[e] += len(t)
    high, any_ = _sums(page, high), _sums(page, any_)
    shown = [e for e in range(1, n) if page.purpose[e] == SHOWN and any_[e]]
    articles, mains = ([e for e in shown if page.tags[e] == tag] for tag in ("article", "main"))
    rank = lambda e: (high[e], any_[e])
    if mains and len(articles) < 2:
        return {max(mains, key=rank)}
    if articles:
        best = max(map(rank, articles))
        return {e for e in articles if 2 * high[e] >= best[0]} if best[0] else set(articles)
    inner: dict[int, list[int]] = {}
    for e in shown:
        if page.tags[e] in CONTAINERS and high[e] >= SHARE * high[0] > 0:
            inner.setdefault(page.parents[e], []).append(e)
    at = 0
    while at in inner:
        at = max(inner[at], key=rank)
    return {at}


def extract(html: str | None) -> str:
    """The main text of a page."""
    page = Page()
    page.feed(html or "")
    page.close()
    page.flush()
    if not any(purpose == SHOWN for *_, purpose in page.lines):
        return ""
    ratio = [(len(t) - linked) / max(1, tags) if purpose == SHOWN else 0.0 for t, tags, linked, _, purpose in page.lines]
    smooth = smoothed(ratio)
    cut = threshold(smooth)
    weights = [float(len(t) - linked) if s >= cut else 0.0 for (t, _, linked, _, _), s in zip(page.lines, smooth, strict=True)]
    inside = [False] * len(page.tags)
    for e in _regions(page, weights):
        inside[e] = True
    for e in range(1, len(page.tags)):
        inside[e] = inside[e] or inside[page.parents[e]]
    return "\n\n".join(t for t, _, _, e, purpose in page.lines if purpose == SHOWN and inside[e])


RESULT = "page_id long, url string, text string, n_chars long"
_RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def main_text(pages: DataFrame) -> DataFrame:
    """The main text of each row of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, ROWS):
                part = b.slice(s, ROWS)
                texts = [extract(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_RESULT)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, RESULT)
