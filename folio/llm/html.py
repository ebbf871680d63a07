"""HTML extraction: parser events, text-to-tag ratio per line, Gaussian smoothing and threshold clustering.

The standard library's streaming parser turns a page into lines, one per block, with the characters of text
and the tags of each and the path of elements it stands in. Lines inside elements that never hold the
article (menus, headers, footers, sidebars, forms, scripts, styles and the like, by name, role or a word
of class or id) are boilerplate. The text-to-tag ratios of the lines are smoothed by a Gaussian and split at
their standard deviation or, on short pages, their mean; the lines above make the content cluster. The region is the
innermost article or main element around all of the cluster's text; where there is none, the element that holds most of the
cluster's text over text that is not the cluster's, so a link list beside the article, whatever its names, stays out. A class or id marks nothing where it negates its word or gives a state
(no-sidebar, comments-open) or stands around most of the text. All lines of the region that are not boilerplate are the text: within
the region nothing short is dropped.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and
joined by one space in page order. Markup of any kind, nested however deep, is read in time linear in its length. A null or empty page, or one of boilerplate alone, gives the empty string.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import record, slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is never the article.
DROPPED = frozenset("head title script style noscript template iframe object svg math canvas audio video map form button select option optgroup textarea input label fieldset datalist output progress meter nav menu aside footer dialog search frameset noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Words of class or id that mark what is not the article.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar side aside cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup social share sharing comment comments commentlist respond reply replies discussion disqus related recommended recommendations widget pagination pager login legal copyright disclaimer toolbar skip".split()
)
#: Words that make one of WORDS beside them, in the same name, the state of what the page shows.
STATES = frozenset("no not non without has have with open opened closed enabled disabled off on is".split())
ENDS_P = BLOCK - frozenset("br head body html title option optgroup caption tbody td tfoot th thead tr li dd dt".split())
#: An open element that a start tag ends, and what it may not cross.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
SIGMA = 1.5


def _marked(tag: str, attrs: list, inside: bool) -> bool | None:
    """Whether an element never holds the article; None where only a word of its class or id says so."""
    if tag in DROPPED:
        return True
    if tag == "header":
        return not inside  # a page's header, not the article's own
    if tag in ("html", "body", "main", "article"):
        return False
    named = None if any(k in ("class", "id") and v and _named(v) for k, v in attrs) else False
    for k, v in attrs:
        if not v:
            continue
        if k == "role" and v.strip().lower() in ROLES:
            return True
        if k in ("hidden",) or (k == "aria-hidden" and v.strip().lower() == "true"):
            return True
    return True if any(k == "hidden" for k, _ in attrs) else named


def _named(value: str) -> bool:
    """Whether a class or id holds one of WORDS, other than with a word that negates it or gives a page's state."""
    return any(not WORDS.isdisjoint(w) and STATES.isdisjoint(w) for w in map(_words, value.split()))


def _words(value: str) -> list[str]:
    return [w.lower() for w in re.split(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])", value) if w]


class Lines(HTMLParser):
    """Lines (text, tags, boilerplate, number of the innermost element) from parser events, and each element's parent.

    Every event costs what it closes, or a fixed number of steps: open elements are also kept by name."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []  # element, number, boilerplate
        self.places: dict[str, list[int]] = {}  # where in ``open`` each name stands
        self.parents = [0]  # by number; 0 is the page
        self.named: set[int] = set()  # elements that a word of class or id marks
        self.lines, self.text, self.tags, self.kinds = [], [], 0, {}

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text or self.tags:
            self.lines.append((text, self.tags, bool(self.open) and self.open[-1][2], self.open[-1][1] if self.open else 0))
        self.text, self.tags = [], 0

    def _last(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def _cut(self, at: int) -> None:
        for name, _, _ in self.open[at:]:
            self.places[name].pop()
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.flush()
        if tag in ENDS_P:
            self._end({"p"}, {"table", "button", "article", "section", "div", "blockquote", "td", "body"})
        if tag in CLOSES:
            self._end(*CLOSES[tag])
        self.tags += 1
        if tag not in VOID:
            number = len(self.parents)
            self.parents.append(self.open[-1][1] if self.open else 0)
            if tag in ("article", "main"):
                self.kinds[number] = tag
            mark = _marked(tag, attrs, tag == "header" and self._last(("article", "main")) >= 0)
            if mark is None:
                self.named.add(number)
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append((tag, number, bool(self.open) and self.open[-1][2] or bool(mark)))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash means nothing in HTML

    def _end(self, names: set, stop: set) -> None:
        if (at := self._last(names)) > self._last(stop):
            self._cut(at)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if (at := self._last((tag,))) >= 0:
            self._cut(at)

    def handle_data(self, data: str) -> None:
        self.text.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![`` opens a comment that ends at the next ``>``, as in browsers; the library's own refuses words that it does not know."""
        end = self.rawdata.find(">", i + 3)
        if end < 0:
            return -1
        self.handle_comment(self.rawdata[i + 2 : end])
        return end + 1

    def within(self, marks: set[int]) -> list[bool]:
        """By number: whether an element is one of these or stands in one. Parents have smaller numbers."""
        out = [0 in marks]
        for n in range(1, len(self.parents)):
            out.append(n in marks or out[self.parents[n]])
        return out

    def summed(self, sizes: list[tuple[int, int]]) -> list[int]:
        """(number, size) to the sum of sizes in each element."""
        out = [0] * len(self.parents)
        for n, size in sizes:
            out[n] += size
        for n in range(len(out) - 1, 0, -1):
            out[self.parents[n]] += out[n]
        return out


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        part = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(map(float.__mul__, part, values[lo:hi])) / sum(part))
    return out


def extract(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = [x for x in parser.lines if x[0]]
    # A name that stands around most of what is no boilerplate by element or role marks nothing.
    held = parser.summed([(n, len(text)) for text, _, bad, n in lines if not bad])
    within = parser.within({n for n in parser.named if 2 * held[n] <= held[0]})
    lines = [(text, tags, bad or within[n], n) for text, tags, bad, n in lines]
    good = [x for x in lines if not x[2]]
    if not good:
        return ""
    ratios = smoothed([0.0 if bad else len(text) / max(tags, 1) for text, tags, bad, _ in lines])
    mean = sum(ratios) / len(ratios)
    spread = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    cluster = [x for x, r in zip(lines, ratios) if r >= min(mean, spread) and not x[2]] or good
    chosen = {id(x) for x in cluster}
    share = parser.summed([(n, len(text)) for text, _, _, n in cluster])
    gain = parser.summed([(x[3], len(x[0]) if id(x) in chosen else -len(x[0])) for x in good])
    held = parser.summed([(n, 1) for _, _, _, n in good])
    named = [n for n in parser.kinds if share[n] == share[0]]
    # The innermost: numbers grow inwards.
    region = max(named) if named else max((n for n in range(len(gain)) if held[n]), key=lambda n: (gain[n], n))
    inside = parser.within({region})
    return " ".join(text for text, _, _, n in good if inside[n])


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield record(_OUT, b.column(0), b.column(1), texts, [len(t) for t in texts])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    from folio.llm.common import table

    return main_text(table(spark, sf_dir, "pages"))
