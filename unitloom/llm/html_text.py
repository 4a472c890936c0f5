"""Main text of web pages from the standard library's streaming parser.

Parser events build logical lines: the text of one block element, with the number of tags met since the line before. The
text-to-tag ratio of each line is smoothed with a Gaussian and lines at or above the spread of the smoothed ratios form
clusters; a region (an article or main element or, on pages without one, a run of lines in one container) is content if it
holds such a line, and then all its lines are, short ones too. Menus, notices, adverts, forms and the like are known by
element, role or the words of class and id, and are never content, though their lines count in the smoothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitloom.llm.common import table

SIGMA = 1.5

#: Fixed values of HTML: elements without content, those that break a line, those whose text is never read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
UNREAD = frozenset("applet audio button canvas datalist head iframe map math meter noembed noframes noscript object progress script select style svg template textarea title video".split())
APART = frozenset("aside dialog footer form menu nav search".split())
CLOSES_PARAGRAPH = BLOCKS - {"option", "optgroup"}
#: An element of the first kind ends an open one of the second, unless one of the third lies between.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class and id that mark what is not the article.
MARKS = frozenset(
    "ad ads adsense advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus donate footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification pager pagination paywall popup promo promoted promotion recommended related replies reply responses share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: These mark a site's head outside an article; inside one they often hold its title.
MARKS_OUTSIDE = frozenset("alert header topbar search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WORDS = re.compile(r"[a-z]+")


class _Lines(HTMLParser):
    """Collects ``(text, tags, region, read)`` for each line; region -1: outside any article or main element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, int]] = []
        # Of each open element: name, apart (not content), unread, region, container
        self.stack: list[tuple[str, bool, bool, int, int]] = [("", False, False, -1, 0)]
        self.open: Counter = Counter()
        self.text: list[str] = []
        self.tags = 0
        self.regions = 0
        self.containers = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            _, apart, _, region, container = self.stack[-1]
            self.lines.append((text, self.tags, region, not apart, container))
            self.tags = 0

    def _pop(self, to: int) -> None:
        for name, *_ in self.stack[to:]:
            self.open[name] -= 1
        del self.stack[to:]

    def _close(self, names: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> None:
        if any(self.open[n] for n in names):
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] in until:
                    return
                if self.stack[i][0] in names:
                    self._pop(i)
                    return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS or tag in UNREAD:
            self.flush()
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        if tag in CLOSES_PARAGRAPH:
            self._close({"p"}, {"td", "th", "table", "button", "object", "caption"})
        if tag in SIBLINGS:
            self._close(*SIBLINGS[tag])
        _, apart, unread, region, container = self.stack[-1]
        if tag in ("article", "main") and not apart and region < 0:
            region = self.regions
            self.regions += 1
        if tag in BLOCKS:
            self.containers += 1
            if tag not in ("p", "li", "pre", "blockquote", "ul", "ol") and tag not in HEADINGS:
                container = self.containers
        self.stack.append((tag, apart or self._apart(tag, dict(attrs), region), unread or tag in UNREAD, region, container))
        self.open[tag] += 1

    @staticmethod
    def _apart(tag: str, attrs: dict, region: int) -> bool:
        if tag in ("html", "body", "main"):
            return False
        if tag in APART or tag == "header" and region < 0 or (attrs.get("role") or "").lower() in ROLES or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
            return True
        if re.search(r"display\s*:\s*none", attrs.get("style") or "", re.I):
            return True
        marks = set(_WORDS.findall(f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()))
        if tag == "article":
            return bool(marks & {"comment", "comments", "reply"})
        return bool(marks & MARKS) or region < 0 and tag not in HEADINGS and bool(marks & MARKS_OUTSIDE)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # in HTML the slash means nothing

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in UNREAD:
            self.flush()
        self.tags += 1
        if self.open[tag]:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] == tag:
                    self._pop(i)
                    break

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][2]:
            self.text.append(data)


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """A Gaussian mean over neighbours up to three sigma away, with the borders' weights renewed."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    whole = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return whole / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def main_text(html: str | None) -> str:
    """The page's article, one block to a line; '' for null, empty and blank pages and those without any text."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    ratios = smooth(np.array([len(text) / max(1, tags) for text, tags, *_ in lines]))
    read = np.array([r for *_, r, _ in lines])
    if parser.regions and any(r and region >= 0 for _, _, region, r, _ in lines):
        region = np.array([region for _, _, region, _, _ in lines])
    else:  # runs of lines in one container
        container = np.array([c for *_, c in lines])
        region = np.concatenate(([0], np.cumsum((container[1:] != container[:-1]) | (read[1:] != read[:-1]))))
    eligible = read & (region >= 0)
    if not eligible.any():
        return ""
    spread = ratios.std()
    dense = eligible & ((ratios >= spread) | (ratios == ratios[eligible].max()))
    content = eligible & np.isin(region, region[dense])
    return "\n".join(text for (text, *_), c in zip(lines, content, strict=True) if c)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Every row of ``pages``, its other columns packed in ``row``, with ``text``. Null pages have an empty text; repeated
    rows stay; an empty table gives no rows."""
    others = [F.col(f"`{c}`") for c in pages.columns if c != html_col]
    packed = pages.select(F.struct(*others).alias("row"), F.col(html_col).cast("string").alias("html"))
    row_type = packed.schema["row"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([main_text(h.as_py()) for h in batch.column(1)], pa.string())], ["row", "text"])

    return packed.mapInArrow(of, f"row {row_type}, text string")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op1_html_text": op1_html_text}
SQL: dict[str, str] = {}
