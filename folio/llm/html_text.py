"""HTML extraction: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams a page's events. A line is the text between
two block boundaries; it knows its number of characters and tags and the element
it stands in. Frames by tag or role (nav, footer, ...) and what is never rendered
are left out. A line's ratio is its characters outside links for each tag; the ratios
of a region, the lines of one parent, are smoothed by a Gaussian over neighbours, and
a threshold between the means of two clusters of their logarithms parts content lines
from the others. Where a line stands counts as markup: its tags weigh eight times in
an element whose class or id is made of words of frames or that is a form, and
again outside of the page's article and main elements, if it has such.

The clusters choose the text. An element that looks like a frame, or is a form, goes
unless its lines are content for at least half of their characters and, on a page without
article and main elements, hold more than half of the content text. From the page down,
the element that holds more than half of the content text is entered as long as there is
one: all of that core is kept, so headings, lists and short paragraphs in it are not
lost. Containers beside the way to the core are regions of their own and are kept if at
least half of their text is content. Paragraphs and headings directly on the way are
kept, unless they are links for the most part. A section is a part of what is around it.

Elements are numbered and known by their parent, and open elements by name, so work and
memory grow with the page, however deep it is and whatever end tags stray.

Defined results: null and empty pages give an empty text; unclosed and stray tags
are borne as browsers do, unknown declarations are comments; rows map one to one.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements in a line of text; all others part lines.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that are never rendered as text of a page.
NEVER = frozenset("head script style noscript template title iframe object svg canvas video audio button select textarea input datalist".split())
#: Elements and roles of a page's frame, elements that may hold an article as well, and words of class and id.
FRAMES = frozenset("nav header footer aside dialog menu".split())
FORMS = frozenset("form fieldset label".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form note toolbar".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs"
    " footer header masthead cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login"
    " share sharing social comment comments discussion reply replies disqus related recommended teaser teasers rail widget toolbar pagination pager copyright disclaimer".split()
)
#: Words of a class beside a hint that say nothing about what the element holds.
NEUTRAL = frozenset("area bar block body box button buttons bottom col column container content form group head icon icons inner item items left link links list main outer page panel post row right section site slot text title top unit wrap wrapper".split())
#: Elements whose class is no hint: the page's own, and those that say that an article is inside.
OWN = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag closes: the element of that name nearest above, within the named bounds.
CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt", {"dl"}), "dd": ("dd", {"dl"}), "tr": ("tr", {"table"}), "td": ("td", {"tr", "table"}), "th": ("th", {"tr", "table"}), "option": ("option", {"select"})}
#: Elements that are parts of a text and no regions of their own.
PARTS = HEADINGS | frozenset("p section ul ol li dl dt dd table tbody thead tfoot tr caption blockquote pre figure figcaption address hgroup details summary hr".split())
#: How many times a line's tags weigh where it stands in what looks like a frame, and outside of article and main elements.
WEIGHT = 8
#: Opening one of these closes an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_P_BOUNDS = frozenset("button td th caption table html body article section div main li blockquote".split())

_SPLIT = re.compile(r"[^a-z0-9]+")


def _hinted(name: str) -> bool:
    """Whether one class or id is made of words of a page's frame and neutral ones: "cookie-banner", "page-footer", but not "share-story"."""
    words = [w for w in _SPLIT.split(re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name).lower()) if w.isalpha()]
    return not HINTS.isdisjoint(words) and all(w in HINTS or w in NEUTRAL for w in words)


def _framed(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """2: part of a frame; 1: looks like it, by its class or as a form; 0."""
    if tag in FRAMES:
        return 2
    if tag in OWN:
        return 0
    if any(name == "role" and (value or "").strip().lower() in ROLES for name, value in attrs):
        return 2
    return int(tag in FORMS or any(name in ("class", "id") and value is not None and any(map(_hinted, value.split())) for name, value in attrs))


class Lines(HTMLParser):
    """Collects a page's lines: (pieces of (element, text), tags, block element), and by element its parent and kind. Element 0 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int]] = []  # name, number and block of each open element
        self.open: defaultdict[str, list[int]] = defaultdict(list)  # depths of the open elements of a name
        self.out_from = None  # depth of the element that is never rendered
        self.name, self.parent, self.framed, self.link = [""], [0], [0], [False]
        self.lines: list[tuple[list[tuple[int, str]], int, int]] = []
        self.pieces: list[tuple[int, str]] = []
        self.tags, self.block = 0, 0

    def _flush(self) -> None:
        if any(not t.isspace() for _, t in self.pieces):
            self.lines.append((self.pieces, self.tags, self.block))
            self.tags = 0
        self.pieces = []

    def parse_marked_section(self, i, report=1):
        """``<![...`` is no part of HTML: a comment up to the next ``>``."""
        return self.parse_bogus_comment(i)

    def _last(self, name: str) -> int:
        """Depth of the innermost open element of a name, or -1."""
        depths = self.open.get(name)
        return depths[-1] if depths else -1

    def _pop(self, depth: int) -> None:
        if any(name not in INLINE for name, _, _ in self.stack[depth:]):
            self._flush()
        for name, _, _ in self.stack[depth:]:
            self.open[name].pop()
        del self.stack[depth:]
        if self.out_from is not None and depth <= self.out_from:
            self.out_from = None

    def _close(self, name: str, bounds) -> None:
        depth = self._last(name)
        if depth >= 0 and all(self._last(b) < depth for b in bounds):
            self._pop(depth)

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._close("p", _P_BOUNDS)
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag == "body" and self.out_from is not None and self._last("head") >= 0:
            self._close("head", ())
        if tag not in INLINE:
            self._flush()
        self.tags += self.out_from is None
        if tag in VOID:
            return
        if self.out_from is None:
            self.parent.append(self.stack[-1][1] if self.stack else 0)
            self.name.append(tag)
            self.framed.append(_framed(tag, attrs))
            self.link.append(tag == "a" and any(n == "href" for n, _ in attrs))
            if tag in NEVER or any(n == "hidden" or n == "aria-hidden" and v == "true" for n, v in attrs):
                self.out_from = len(self.stack)
        number = len(self.parent) - 1
        self.open[tag].append(len(self.stack))
        self.stack.append((tag, number, number if tag not in INLINE else self.stack[-1][2] if self.stack else 0))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += self.out_from is None
        depth = self._last(tag)
        if depth >= 0:
            self._pop(depth)
        elif tag not in INLINE:
            self._flush()

    def handle_data(self, data):
        if self.out_from is None:
            if not self.pieces:
                self.block = self.stack[-1][2] if self.stack else 0
            self.pieces.append((self.stack[-1][1] if self.stack else 0, data))

    def close(self):
        super().close()
        self._flush()

    def up(self, values: list) -> list:
        """Sums by element, of itself and all in it."""
        for k in range(len(self.parent) - 1, 0, -1):
            values[self.parent[k]] += values[k]
        return values

    def down(self, own: list[bool]) -> list[bool]:
        """Whether something holds of an element or of one around it."""
        for k in range(1, len(self.parent)):
            own[k] = own[k] or own[self.parent[k]]
        return own


def smooth(raw: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian means over neighbouring lines."""
    if len(raw) == 1:
        return raw
    reach = int(3 * sigma)
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    inside = np.convolve(np.ones(len(raw)), weight, "full")[reach : reach + len(raw)]
    return np.convolve(raw, weight, "full")[reach : reach + len(raw)] / inside


def dense(ratios, sizes) -> np.ndarray:
    """The lines of the upper of two clusters, by smoothed ratios and sizes.

    The threshold lies halfway between the clusters' means of the logarithms, lines weighed by their sizes; the search starts in the middle of the range, so a few lines far off are a cluster however many the others are. All lines, if the means are less than a factor of 2 apart.
    """
    value, size = np.log1p(np.asarray(ratios, float)), np.maximum(1.0, np.asarray(sizes, float))
    cut, apart = (value.min() + value.max()) / 2, 0.0
    for _ in range(32):
        high = value >= cut
        if high.all() or not high.any():
            break
        upper, lower = np.average(value[high], weights=size[high]), np.average(value[~high], weights=size[~high])
        new, apart = (upper + lower) / 2, upper - lower
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return value >= cut if apart >= np.log(2) else np.ones(len(value), bool)


def _one_line(text: str) -> str:
    return " ".join(text.split())


def _rendered(page: Lines) -> list[tuple[str, int, int, int]]:
    """(text, tags, block element, characters in links) of the lines outside of frames by tag or role; headings of an article's own header stay."""
    article = page.down([name in ("article", "main") for name in page.name])
    gone = [framed == 2 for framed in page.framed]
    out = page.down(list(gone))
    always = page.down([g and not (name == "header" and a) for g, name, a in zip(gone, page.name, article)])
    heading = page.down([name in HEADINGS for name in page.name])
    linked, left = list(page.link), []
    for k in range(1, len(linked)):
        linked[k] = linked[k] or page.name[k] in INLINE and linked[page.parent[k]]
    for pieces, tags, block in page.lines:
        kept = [(k, t) for k, t in pieces if not out[k] or heading[k] and not always[k]]
        if text := _one_line("".join(t for _, t in kept)):
            left.append((text, tags, block, sum(len(_one_line(t)) for k, t in kept if linked[k])))
    return left


def _ratios(page: Lines, lines: list[tuple[str, int, int, int]], looks: list[bool]) -> np.ndarray:
    """Smoothed ratios of the lines, region by region."""
    inside = page.down([name in ("article", "main") for name in page.name])
    weighs, apart = page.down(list(looks)), any(inside[b] for _, _, b, _ in lines)
    own = Counter(b for _, _, b, _ in lines)
    raw, regions = np.empty(len(lines)), defaultdict(list)
    for k, (text, tags, b, linked) in enumerate(lines):
        raw[k] = max(0, len(text) - linked) / (max(1, tags) * (WEIGHT if weighs[b] else 1) * (WEIGHT if apart and not inside[b] else 1))
        # what looks like a frame is smoothed by itself
        regions[b if own[b] > 1 or looks[b] else page.parent[b]].append(k)
    for at in regions.values():
        raw[at] = smooth(raw[at])
    return raw


def _sums(page: Lines, lines, values) -> list[int]:
    out = [0] * len(page.parent)
    for (_, _, b, _), v in zip(lines, values):
        out[b] += v
    return page.up(out)


def _core(page: Lines, dense_text: list[int], n_lines: list[int], own: Counter) -> int:
    """The innermost element on the way down that holds more than half of the content's text; neither a part of a text nor a line by itself."""
    heaviest: dict[int, int] = {}
    for k in range(1, len(page.parent)):
        up = page.parent[k]
        if up not in heaviest or dense_text[k] > dense_text[heaviest[up]]:
            heaviest[up] = k
    core = 0
    while (k := heaviest.get(core)) is not None and 2 * dense_text[k] > dense_text[0] and page.name[k] not in PARTS and (n_lines[k] > 1 or not own[k] or page.name[k] in OWN):
        core = k
    return core


def extract(html: str, clusters=dense) -> str:
    """The main text. clusters: which lines are content, by their smoothed ratios and sizes."""
    page = Lines()
    page.feed(html)
    page.close()
    lines = _rendered(page)
    if not lines:
        return ""
    looks = [framed == 1 for framed in page.framed]
    sizes = [len(t) for t, _, _, _ in lines]
    content = [bool(c) for c in clusters(_ratios(page, lines, looks), sizes)]
    # what looks like a frame goes unless its text is content, and, with no article or main element to tell, most of the page's content
    apart = any(name in ("article", "main") and n for name, n in zip(page.name, _sums(page, lines, sizes)))
    text, dense_text = _sums(page, lines, sizes), _sums(page, lines, [n * c for n, c in zip(sizes, content)])
    gone = page.down([f and (2 * d < n or not apart and 2 * d <= dense_text[0]) for f, d, n in zip(looks, dense_text, text)])
    left = [(line, n, c) for line, n, c in zip(lines, sizes, content) if not gone[line[2]]]
    lines = [line for line, _, _ in left]
    text, dense_text = _sums(page, lines, [n for _, n, _ in left]), _sums(page, lines, [n * c for _, n, c in left])
    own = Counter(b for _, _, b, _ in lines)
    core = _core(page, dense_text, _sums(page, lines, [1] * len(lines)), own)
    # the way from the page to the core: its own lines and parts stay, other elements beside it vote
    way, k = {0}, core
    while k:
        way.add(k)
        k = page.parent[k]
    keeps, beside = [True] * len(page.parent), [False] * len(page.parent)
    for k in range(1, len(page.parent)):
        up = page.parent[k]
        if k in way or up == core or up not in way and not beside[up]:
            keeps[k] = keeps[up]
        elif page.name[k] in PARTS or page.name[k] in INLINE:
            keeps[k], beside[k] = keeps[up], up in way or beside[up]
        else:
            keeps[k] = keeps[up] and 2 * dense_text[k] >= text[k]
    inside = page.down([k == core for k in range(len(page.parent))])
    return " ".join(t for t, _, b, linked in lines if inside[b] or keeps[b] and 2 * linked <= len(t))


def extract_all(pages: pa.Array) -> pa.Array:
    return pa.array([extract(p or "") for p in pages.to_pylist()], pa.string())


extract_udf = F.arrow_udf(extract_all, T.StringType())


def html_text(df: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """The input's columns and the main text of each page, in place of a column of that name."""
    small_batches(df.sparkSession)
    return df.withColumn(out_col, extract_udf(F.col(html_col)))
