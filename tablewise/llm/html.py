"""Main text of web pages from the standard library's parser events.

The events of a page become lines, one for each block element. A line has the length of its text outside links and the
number of tags in it. Their ratio, smoothed by a Gaussian over neighbouring lines, is clustered by a threshold: a quarter of
the mean, in which a line weighs as its length, at most ``LONG``, and no ratio counts more than ``CAP`` times the median of such
weights, so that neither one very long line nor many short ones push others out. Content is the stretch from the first to
the last line of the containers that lines of this cluster stand in; a container of several lines that all lie far below
the threshold is none, nor is one of nothing but links. Lists and articles that are mostly links are no lines.

``article`` and ``main`` elements are a prior, not the answer. On every page the cluster of the lines outside them is
compared with them: they are the content, short articles like long ones, unless it holds more than ``PRIOR`` times their text.
So teasers in articles do not hide a story that stands in a ``div``.

Menus, page headers, footers,
sidebars, notices, adverts, forms, comments, scripts and styles are known by their element, role, class or
id, and are never lines. A class or id counts by its whole name or last part, the id of a heading or paragraph never;
and a ``div`` or ``section`` with such a name that holds most of the page's text stays. The parser goes through the page once; nothing is shuffled.

Defined cases: null and empty html give the empty text. An unclosed paragraph ends at the next block, an unclosed list
item or cell at the next one, other unclosed elements with the element around them or the page. A tag cut off by the end of the page is dropped. Repeated rows give equal
texts. An empty table gives an empty result. Input columns called like a result column are replaced.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import by_value, text_pieces

by_value(__name__)

#: Width of the Gaussian in lines.
SIGMA = 1.5
#: In the threshold only, a line counts at most so many times the median ratio.
CAP = 4
#: Code points that a line weighs at most, those of a long paragraph.
LONG = 500
#: Parts of the mean that a smoothed ratio, and the highest ratio of a container, must reach.
CLUSTER, OWN = 4, 16
#: Text outside articles is the content if it is longer than theirs by this factor.
PRIOR = 2
#: A container has several lines from this number on. A list is a menu if it has so many lines and more than two thirds of its text in links.
LIST_LINES = 3
# Fixed values of the markup language.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HOLDERS = frozenset("article aside body details dialog div figure footer form head header main menu nav section table ul ol dl".split())
OUT = frozenset("head script style noscript template nav menu aside form footer button select textarea iframe svg canvas object dialog title".split())
CLOSED = OUT - HOLDERS
#: Elements that hold a stretch of the page.
CONTAINERS = frozenset("article body div main section".split())
LISTS = frozenset(["ul", "ol", "dl"])
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay"
    " sidebar aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar comment comments respond reply replies disqus share sharing social related"
    " recommended footer newsletter subscribe subscription signup login widget masthead topbar skip".split()
)
HEAD_WORDS = frozenset(["header"])
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
#: First and last parts of class names that tell what a page has, and do not name the element (``with-sidebar``, ``comments-open``).
TELLING = frozenset("has have with without no not is show hide open closed enabled disabled on off".split())
#: Last parts of class names and ids that name a form; what is in it stands before.
FORMS = frozenset("box container wrapper wrap unit slot bar list".split())
#: Elements that may be named like a part of the page and yet hold its main text; and those whose id is made from their text.
WRAPPERS = frozenset(["div", "section"])
TITLED = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: Ways to be hidden.
SHOWN, BY_NAME, ALWAYS = 0, 1, 2
#: Elements without content, and those that the next one of their kind ends.
VOID = frozenset(["hr"])
NEXT_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
WORD = re.compile("[a-z]+")


def named(tag: str, value: str) -> set[str]:
    """The words of a class or id that say what the element is: whole names, and the last parts of others but for an article."""
    out = set()
    for name in value.lower().split():
        words = WORD.findall(name)
        if len(words) == 1:
            out.update(words)
        elif words and tag != "article" and words[0] not in TELLING and words[-1] not in TELLING:
            while len(words) > 1 and words[-1] in FORMS:
                words.pop()
            out.add(words[-1])
    return out


class Line(NamedTuple):
    text: str
    tags: int
    linked: int  # code points inside links
    region: int  # the article or main element around, or 0
    container: int
    listing: int  # the innermost list around, or 0
    wrapper: int  # the innermost element around that is hidden by its name for now, or 0


class Open(NamedTuple):
    tag: str
    hides: bool
    region: int
    container: int
    listing: int
    wrapper: int


class Lines(HTMLParser):
    """Collects the lines of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[Open] = []
        self.buffer: list[str] = []
        self.tags = self.linked = self.regions = self.hidden = 0
        self.link = False
        self.region = self.container = self.listing = self.wrapper = 0
        self.containers = self.listings = 0
        self.around = [0]  # the wrapper around each wrapper

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                linked = min(self.linked, len(text))
                self.lines.append(Line(text, self.tags, linked, self.region, self.container, self.listing, self.wrapper))
            self.buffer = []
        self.tags = self.linked = 0

    def inside(self) -> None:
        """Take the place of the innermost open element."""
        self.region, self.container, self.listing, self.wrapper = self.open[-1][2:] if self.open else (0, 0, 0, 0)

    def hides(self, tag: str, attrs) -> int:
        if tag in OUT:
            return ALWAYS
        how, inside = SHOWN, self.region > 0
        if tag == "header" and not inside:
            return ALWAYS
        for name, value in attrs:
            if value and (name == "class" or name == "id" and tag not in TITLED):
                words = named(tag, value)
                if tag not in ("body", "html", "main") and (not OUT_WORDS.isdisjoint(words) or not inside and not HEAD_WORDS.isdisjoint(words)):
                    how = BY_NAME if tag in WRAPPERS else ALWAYS
            elif name == "role" and value in OUT_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                return ALWAYS
            elif name == "style" and value and "display:none" in "".join(value.lower().split()):
                return ALWAYS
        return how

    def end_before(self, tag: str) -> None:
        """End what a block ends that has no end tag: the paragraph, and the one before of its kind."""
        for kinds in (("p",), NEXT_ENDS.get(tag, ())):
            while self.open and self.open[-1][0] in kinds:
                self.hidden -= self.open.pop().hides
                self.inside()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            self.end_before(tag)
            self.link = False
        elif tag == "a":
            self.link = True
        self.tags += 1
        if tag == "br":
            self.buffer.append(" ")
        if tag in VOID:
            return
        if tag in HOLDERS or tag in CLOSED or attrs and tag in BLOCKS:
            how = self.hides(tag, attrs)
            hides = how == ALWAYS
            if how == BY_NAME and not self.hidden:
                self.around.append(self.wrapper)
                self.wrapper = len(self.around) - 1
            if tag in ("article", "main") and not hides:
                if not self.region:
                    self.regions += 1
                    self.region = self.regions
            if tag in CONTAINERS:
                self.containers += 1
                self.container = self.containers
            if tag in LISTS:
                self.listings += 1
                self.listing = self.listings
            self.open.append(Open(tag, hides, self.region, self.container, self.listing, self.wrapper))
            self.hidden += hides

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag == "br":
            self.buffer.append(" ")

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        elif tag == "a":
            self.link = False
        self.tags += 1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                self.hidden -= sum(x.hides for x in self.open[i:])
                del self.open[i:]
                self.inside()
                return

    def handle_data(self, data):
        if not self.hidden:
            self.buffer.append(data)
            if self.link:
                self.linked += len(data.strip())


def smoothed(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def shown(lines: list[Line], around: list[int]) -> list[Line]:
    """The lines without those in wrappers that are named like a part of the page and hold no more than half of its text."""
    size = [0] * len(around)
    for x in lines:
        size[x.wrapper] += len(x.text)
    for i in range(len(around) - 1, 0, -1):  # what is inside is counted before
        size[around[i]] += size[i]
    stays = [True] * len(around)
    for i in range(1, len(around)):
        stays[i] = stays[around[i]] and 2 * size[i] > size[0]
    return [x for x in lines if stays[x.wrapper]]


def unlinked(lines: list[Line], least: int, share: int, of: str) -> list[Line]:
    """The lines without those of lists or regions (``of``) with at least ``least`` lines and text in links above ``share`` parts in six."""
    seen: dict[int, list[int]] = {}
    for x in lines:
        sums = seen.setdefault(getattr(x, of), [0, 0, 0])
        sums[0] += 1
        sums[1] += len(x.text)
        sums[2] += x.linked
    menus = {k for k, (n, size, linked) in seen.items() if k and n >= least and 6 * linked > share * size}
    return [x for x in lines if getattr(x, of) not in menus]


def clustered(lines: list[Line]) -> list[Line]:
    """The stretch of lines that the smoothed text-to-tag ratio selects."""
    if not lines:
        return []
    ratio = np.array([(len(x.text) - x.linked) / max(x.tags, 1) for x in lines])
    weight = np.array([min(len(x.text), LONG) for x in lines])
    order = np.argsort(ratio, kind="stable")
    upto = np.cumsum(weight[order])
    median = ratio[order][np.searchsorted(upto, upto[-1] / 2)]
    mean = np.average(np.minimum(ratio, CAP * median), weights=weight)
    _, container = np.unique([x.container for x in lines], return_inverse=True)
    high, own = np.zeros(container.max() + 1, bool), np.zeros(container.max() + 1)
    high[container[smoothed(ratio) >= mean / CLUSTER]] = True
    np.maximum.at(own, container, ratio)
    few = np.bincount(container) < LIST_LINES
    at = np.flatnonzero((high & (own >= np.where(few, np.minimum(mean / OWN, 1), mean / OWN)))[container])
    return lines[at[0] : at[-1] + 1] if len(at) else []


def content(lines: list[Line]) -> list[Line]:
    """All articles, or the cluster of the lines outside them if that holds far more text."""
    lines = unlinked(lines, LIST_LINES, 4, "listing") or lines
    lines = unlinked(lines, 1, 3, "region") or lines
    inside = [x for x in lines if x.region]
    outside = clustered([x for x in lines if not x.region and not (inside and x.wrapper)])
    size, rest = (sum(len(x.text) - x.linked for x in part) for part in (inside, outside))
    return outside if rest > PRIOR * size else inside or outside


def main_text(page: str | None) -> str:
    if not page:
        return ""
    last = page.rfind("<")
    if last > page.rfind(">") and re.match(r"</?[A-Za-z!]|</?$", page[last : last + 3]):
        page = page[:last]
    parser = Lines()
    parser.feed(page)
    parser.close()
    parser.flush()
    return "\n".join(x.text for x in content(shown(parser.lines, parser.around)))


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """The input with ``text`` and its number of code points ``n_chars``."""

    def run(column: pa.Array) -> pa.Array:
        texts = [main_text(page) for piece in text_pieces(column) for page in piece.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["text", "n_chars"])

    udf = F.arrow_udf(run, "text string, n_chars bigint").asNondeterministic()
    old = [F.col(f"`{c}`") for c in pages.columns if c not in ("text", "n_chars")]
    return pages.select(*old, udf(html).alias("_main")).select(*old, "_main.*")
