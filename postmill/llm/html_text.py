"""Main text of web pages from a stream of standard-library parser events.

A page is read event by event. Its text becomes lines, one for each block, with the tags met in it; each line's
text-to-tag ratio is smoothed over its neighbours with a Gaussian window, and a split of the smoothed ratios into two
clusters tells text-like lines from others. Lines belong to regions (the nearest sectioning element or container), and
regions are chosen by their lines:

* of articles and main elements, those that hold a text-like line (all, where none does); on pages that have neither, the
  smallest container that holds the regions whose text is mostly in text-like lines and not in links;
* of the regions below, those are left out whose text is mostly in links and mostly not in text-like lines;
* a region that a header element, a hidden attribute or a name such as "related" or "share" makes doubtful is left out
  where its text is mostly not in text-like lines and it has no heading.

Menus, footers, asides, forms, adverts, cookie notices, reader comments, scripts and styles are no content anywhere, nor
are headers outside articles. A chosen region's lines all stay, short ones too.

Cases: a null, empty or tagless page is read as text in one region; unclosed and crossing tags are closed by their
ancestors; a cut-off character reference stays as it is; repeated rows are read each for itself; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .pieces import text_groups
from .work import columns

CHUNK = 65536
#: Elements that are no content, that end a line, that have no end tag, and that are regions.
BOILERPLATE = frozenset("nav footer aside form script style noscript template iframe select button textarea svg dialog menu head title object canvas".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
REGIONS = frozenset("article main section div body td".split())
CLOSED_BY = {"p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Parts of class names and ids that are no content, and those that are doubtful.
NO_CONTENT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|sidebar|cookie\w*|consent|gdpr|popup|comments?|disqus|replies|breadcrumbs?|newsletter|subscribe)(?:$|[\s_-])", re.I)
DOUBTFUL = re.compile(r"(?:^|[\s_-])(?:notice|notification|banner|modal|overlay|respond|menu|nav\w*|footer|header|masthead|share|sharing|social|related|widget)(?:$|[\s_-])", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPACE = re.compile(r"\s+")


class Line:
    __slots__ = ("heading", "linked", "region", "tags", "text")

    def __init__(self, text: str, tags: int, linked: int, region: int, heading: bool) -> None:
        self.text, self.tags, self.linked, self.region, self.heading = text, tags, linked, region, heading


class PageReader(HTMLParser):
    """Collects lines and regions."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.regions: list[int] = [0]  # of a region: number of the article it lies in, 0 for none
        self.parents: list[int] = [0]  # of a region: the region around it
        self.doubts: list[int] = [0]  # of a region: the outermost doubtful region that it is or lies in, 0 for none
        self.articles = 0
        self.open: list[tuple[str, bool, bool, int]] = []  # tag, whether it is boilerplate, whether it parts lines, region
        self.depth: dict[str, int] = {}  # open tags by name
        self.parts: list[str] = []
        self.tags = self.linked = self.hidden = self.links = 0

    def _region(self) -> int:
        return self.open[-1][3] if self.open else 0

    def _flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            heading = any(self.depth.get(h) for h in HEADINGS)
            self.lines.append(Line(text, self.tags, self.linked, self._region(), heading))
            self.tags = 0
        self.parts, self.linked = [], 0

    def _pop(self) -> None:
        tag, boilerplate, parting, _ = self.open[-1]
        if parting:
            self._flush()
        self.open.pop()
        self.depth[tag] -= 1
        self.hidden -= boilerplate
        self.links -= tag == "a"

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += not self.hidden
        while self.open and tag in CLOSED_BY.get(self.open[-1][0], ()):
            self._pop()
        if tag in BLOCKS:
            for depth in range(len(self.open) - 1, -1, -1):  # an open paragraph ends even where inline tags in it didn't
                name = self.open[depth][0]
                if name == "p":
                    while len(self.open) > depth:
                        self._pop()
                elif name in BLOCKS:
                    break
            self._flush()
        if tag in VOID:
            return
        given = dict(attrs)
        named = f"{given.get('class') or ''} {given.get('id') or ''}"
        outer = tag in ("html", "body", "article", "main")
        region = self._region()
        boilerplate = tag in BOILERPLATE or (given.get("role") or "").lower() in ROLES or (tag == "header" and not self.regions[region])
        boilerplate = boilerplate or (not outer and bool(NO_CONTENT.search(named)))
        doubtful = not outer and (tag == "header" or "hidden" in given or (given.get("aria-hidden") or "").lower() == "true" or bool(DOUBTFUL.search(named)))
        if boilerplate or doubtful:
            self._flush()
        if tag in REGIONS or doubtful:
            self.parents.append(region)
            if tag in ("article", "main"):
                self.articles += 1
                self.regions.append(self.articles if tag == "article" or not self.regions[region] else self.regions[region])
            else:
                self.regions.append(self.regions[region])
            self.doubts.append(self.doubts[region] or (len(self.regions) - 1 if doubtful else 0))
            region = len(self.regions) - 1
        self.open.append((tag, boilerplate, boilerplate or doubtful or tag in BLOCKS, region))
        self.depth[tag] = self.depth.get(tag, 0) + 1
        self.hidden += boilerplate
        self.links += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        self.tags += not self.hidden
        if self.depth.get(tag):
            while self.open[-1][0] != tag:
                self._pop()
            self._pop()
        elif tag in BLOCKS:
            self._flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    def finished(self) -> list[Line]:
        self.close()
        self._flush()
        return self.lines


def text_like(lines: list[Line], radius: int = 2, sigma: float = 1.0) -> np.ndarray:
    """Which lines the clusters of the smoothed text-to-tag ratios call text."""
    ratio = np.log1p([len(x.text) / max(1, x.tags) for x in lines])
    window = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    smooth = np.convolve(ratio, window, "full")[radius : radius + len(ratio)] / np.convolve(np.ones(len(ratio)), window, "full")[radius : radius + len(ratio)]
    low, high = float(smooth.min()), float(smooth.max())
    if high - low < 0.5:  # one kind of line only
        return np.ones(len(lines), bool)
    for _ in range(50):
        cut = (low + high) / 2
        new = float(smooth[smooth <= cut].mean()), float(smooth[smooth > cut].mean())
        if new == (low, high):
            break
        low, high = new
    return smooth > (low + high) / 2


def within(parents: list[int], held: set[int]) -> set[int]:
    """The regions of the smallest container that holds the given ones; of one alone, the container around it."""
    below = [int(r in held) for r in range(len(parents))]
    for r in range(len(parents) - 1, 0, -1):  # parents have smaller numbers
        below[parents[r]] += below[r]
    top = max(r for r, n in enumerate(below) if n == len(held))
    if len(held) == 1:
        top = parents[top]
    inside = [False] * len(parents)
    for r in range(len(parents)):
        inside[r] = r == top or (r > 0 and inside[parents[r]])
    return {r for r, x in enumerate(inside) if x}


class _Sums:
    """Of a region's lines: characters, those in text-like lines, those in links, and whether one is a heading."""

    __slots__ = ("heading", "linked", "like", "n")

    def __init__(self) -> None:
        self.n = self.like = self.linked = 0
        self.heading = False

    def add(self, line: Line, like: bool) -> None:
        self.n += len(line.text)
        self.like += len(line.text) * like
        self.linked += line.linked
        self.heading |= line.heading


def content_lines(reader: PageReader) -> list[str]:
    lines = reader.finished()
    if not lines:
        return []
    like = [bool(t) for t in text_like(lines)]
    own: dict[int, _Sums] = {}
    doubted: dict[int, _Sums] = {}
    for x, t in zip(lines, like, strict=True):
        own.setdefault(x.region, _Sums()).add(x, t)
        doubted.setdefault(reader.doubts[x.region], _Sums()).add(x, t)
    left_out = {d for d, s in doubted.items() if d and 2 * s.like < s.n and not s.heading}
    menus = {r for r, s in own.items() if 2 * s.linked >= s.n and 2 * s.like < s.n}
    articles = {reader.regions[x.region] for x in lines} - {0}
    if articles:
        good = {reader.regions[x.region] for x, t in zip(lines, like, strict=True) if t} - {0} or articles
        # an article's own region is never a menu
        top = {r for r, a in enumerate(reader.regions) if a and a != reader.regions[reader.parents[r]]}
        chosen = {r for r in own if reader.regions[r] in good and (r not in menus or r in top)}
    else:
        linked = {r for r, s in own.items() if 2 * s.linked >= s.n}
        held = {r for r, s in own.items() if 2 * s.like >= s.n} - linked or {max(own, key=lambda r: own[r].n)}
        chosen = within(reader.parents, held) - (linked - held)
    return [x.text for x in lines if x.region in chosen and reader.doubts[x.region] not in left_out]


def main_text(html: str | None) -> str:
    reader = PageReader()
    html = html or ""
    for k in range(0, len(html), CHUNK):
        reader.feed(html[k : k + CHUNK])
    return "\n".join(content_lines(reader))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its length in code points; no shuffle."""

    def run(batches):
        def pairs():
            for batch in batches:
                rest = pa.StructArray.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string())], ["page_id", "url"])
                yield pa.RecordBatch.from_arrays([rest, batch.column(2)], names=["rest", "html"])

        for rest, found in text_groups(pairs()):
            texts = [main_text(h) for h in found]
            yield pa.RecordBatch.from_arrays([pa.array([x["page_id"] for x in rest], pa.int64()), pa.array([x["url"] for x in rest], pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return columns(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_text_to_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
