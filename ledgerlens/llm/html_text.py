"""Main-text extraction from HTML by text-to-tag ratios.

The events of the standard library's parser are cut into lines, one per block
element.  A line's ratio is its characters over its tags; ratios are smoothed
with a Gaussian and those of at least half a standard deviation below the mean
are clustered as content, and so are lines whose own ratio is as high; these are
seeds.  The main text is what they span:

* an outermost article or main element that holds a content line is kept whole;
* the elements (div, section, td, body) that directly hold the seeds outside of
  articles are lifted to their lowest common ancestor, of which all lines are
  kept; if that is the body itself, all from the first such seed to the last;
* beside these, an article of ``PROSE`` characters a tag or more is kept too (a short
  one whose lines lie under the threshold), and the last first-level heading
  above the text if no article or main holds it.

Other articles in between are not part of it.  Lines in menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments never
count, by element or by the words of class, id and role; no lifting enters them.

Inside a line every run of white space is one space; lines are joined by a
blank line.  Character references are decoded by the parser.

Defined results: null and empty pages give an empty text, also pages without
content; broken or cut-off markup is read as far as it goes; repeated rows are
extracted each; an empty table gives no rows.

Scale: one Arrow step, no shuffle; a worker holds one page's lines at a time.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import small_batches

SIGMA = 1.0
PROSE = 20        # characters a tag of an article that is text by itself
# elements that end a line where they start and where they end
_BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir
div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li
main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr
ul""".split())
# block elements that stay open until their end tag, or that of one around them
_NESTED = frozenset("""article aside blockquote body center details dialog div dl fieldset figure
footer form head header html main menu nav ol section select table ul""".split())
_NEVER = frozenset("""aside button canvas dialog fieldset footer form head iframe input label menu
nav noscript object option script select style svg template textarea title""".split())
_VOID = frozenset("""area base br col embed hr img input link meta param source track
wbr""".split())
_WORDS = frozenset("""ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment
comments consent cookie cookies copyright disqus footer gdpr masthead menu modal nav navbar
navigation newsletter notice popup promo promoted recommended related share sharing sidebar
signup social sponsor sponsored subscribe subscription teaser toolbar widget complementary
contentinfo search""".split())
_RESULTS = frozenset(["result", "results"])
_OUTSIDE = frozenset(["header"])          # boilerplate unless inside an article
_REGIONS = frozenset(["article", "body", "center", "div", "main", "section", "td"])
_UNCLOSED = frozenset("p li dt dd h1 h2 h3 h4 h5 h6".split())
_SPLIT = re.compile(r"[^a-z]+")


class _Lines(HTMLParser):
    """Collects (text, tags, article number, region number, in a first-level
    heading) per line; ``parents`` has the region around every region."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple] = []
        self.parts: list[str] = []
        self.tags = 0
        self.open: list[tuple] = []        # (tag, hides, article, region around)
        self.hidden = 0
        self.articles = 0
        self.article = 0
        self.parents = [0]                 # region 0: outside of all
        self.roots = {0}                   # regions that are the whole page
        self.region = 0
        self.heading = False

    def flush(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.tags, self.article, self.region, self.heading))
            self.parts = []
        self.tags = 0

    def _hides(self, tag, attrs) -> bool:
        if tag in _NEVER:
            return True
        if tag in _OUTSIDE and not self.article:
            return True
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                words = _SPLIT.split(value.lower())
                if "search" in words and not _RESULTS.isdisjoint(words):
                    words.remove("search")        # what was found, not the field
                if not _WORDS.isdisjoint(words) or (not self.article and tag != "body"
                                                    and "header" in words):
                    return tag not in ("html", "body", "article", "main")
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            elif name == "style" and value and "display:none" in value.replace(" ", ""):
                return True
        return False

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in _BLOCK:
            self.flush()
            if self.open and self.open[-1][0] in _UNCLOSED:
                self._close(len(self.open) - 1)
            if tag == "body":
                self._close_tag("head")
            self.heading = tag == "h1"
        self.tags += 1
        if tag in _VOID:
            return
        hides = self._hides(tag, attrs)
        if not hides and tag not in _NESTED:
            return
        starts = tag in ("article", "main") and not self.hidden and not hides
        self.open.append((tag, hides, starts and not self.article, self.region))
        if tag in _REGIONS:
            self.parents.append(self.region)
            self.region = len(self.parents) - 1
            if tag == "body":
                self.roots.add(self.region)
        self.hidden += hides
        if starts and not self.article:
            self.articles += 1
            self.article = self.articles

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in _BLOCK:
            self.flush()
            self.heading = False
        self.tags += 1
        self._close_tag(tag)

    def _close_tag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._close(at)
                return

    def _close(self, at):
        self.region = self.open[at][3]
        for _, hides, article, _ in self.open[at:]:
            self.hidden -= hides
            if article:
                self.article = 0
        del self.open[at:]

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights = np.convolve(np.ones(len(ratios)), kernel)[reach:reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach:reach + len(ratios)] / weights


def content_lines(ratios: np.ndarray, sigma: float = SIGMA) -> tuple[np.ndarray, np.ndarray]:
    """Which lines belong to the cluster of high smoothed ratios (or are as high by
    themselves), and which of these are not only lifted by the lines around them."""
    if not len(ratios):
        return np.zeros(0, bool), np.zeros(0, bool)
    smooth = smoothed(ratios, sigma)
    threshold = max(smooth.mean() - 0.5 * smooth.std(), 0.0) * (1 - 1e-9)
    alone = ratios >= threshold
    content = (smooth >= threshold) | alone
    return content, alone if alone.any() else content


def _path(region: int, parents: list[int]) -> list[int]:
    """The regions around a region, outermost first, and itself."""
    path = [region]
    while region:
        region = parents[region]
        path.append(region)
    return path[::-1]


def _spanned(lines: list[tuple], seeds: np.ndarray, parents: list[int],
             roots: set[int]) -> np.ndarray:
    """Lines outside of articles that the seeds there span."""
    keep = np.zeros(len(lines), bool)
    own = [i for i in np.flatnonzero(seeds) if not lines[i][2]]
    if not own:
        return keep
    common = _path(lines[own[0]][3], parents)
    for i in own[1:]:
        path = _path(lines[i][3], parents)
        size = 0
        while size < min(len(common), len(path)) and common[size] == path[size]:
            size += 1
        common = common[:size]
    top = common[-1]
    first, last = (own[0], own[-1]) if top in roots else (0, len(lines) - 1)
    for i in range(first, last + 1):
        keep[i] = not lines[i][2] and top in _path(lines[i][3], parents)
    return keep


def extract(html: str, sigma: float = SIGMA) -> str:
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    content, seeds = content_lines(
        np.array([len(line[0]) / max(1, line[1]) for line in lines]), sigma)
    if not content.any():
        return ""
    keep = _spanned(lines, seeds, parser.parents, parser.roots)
    held: dict[int, list] = {}
    for i, (text, tags, article, _, _) in enumerate(lines):
        if article:
            held.setdefault(article, []).append((i, len(text), max(1, tags)))
    for own in held.values():
        at = [i for i, _, _ in own]
        if content[at].any() or sum(n for _, n, _ in own) >= PROSE * sum(t for _, _, t in own):
            keep[at] = True
    first = int(np.flatnonzero(keep)[0]) if keep.any() else 0
    above = [i for i in range(first) if lines[i][4] and not lines[i][2]]
    if above and not any(lines[i][4] for i in np.flatnonzero(keep)):
        keep[above[-1]] = True
    return "\n\n".join(line[0] for line, k in zip(lines, keep) if k)


def extract_text(pages: DataFrame, html_col: str = "html",
                 keep: tuple = ("page_id", "url"), sigma: float = SIGMA) -> DataFrame:
    """The columns ``keep`` of every page, then text and n_chars."""
    rows = pages.select(*[F.col(c) for c in keep], F.col(html_col).alias("_html"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])

    def step(batches):
        for batch in small_batches(batches, len(keep)):
            texts = [extract(h or "", sigma) for h in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return rows.mapInArrow(step, schema)
