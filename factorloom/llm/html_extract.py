"""Main text of web pages by text density.

A page goes through the standard library's event parser once.  Events become lines, one for each
block of the page: its text, and how many tags it took.  The text-to-tag ratio of the lines is
smoothed with a Gaussian along the page, and two-means clustering of the smoothed ratios gives the
threshold that divides content from the rest.  Lines inside elements that never hold the article
(menus, headers, footers, forms, scripts) are left out whatever their ratio.

A class, id or role can also name an element as outside (sidebar, notice, advert, comments).  It is
left out too if the page has a dense line of an article outside all such elements, if it holds no
dense line itself, or if it holds neither a dense line of an article nor most of the page's text.
The others are wrappers of the content, and their names count for nothing.

Where content lines lie in an element that the page marks as an article, the whole of
that element is the content region, with its short lines; teasers without a content line are not.

Null, empty or textless page: empty text.  Broken markup: elements that are never closed end with the
block that holds them.  Repeated rows each get their own result; an empty table gives none.  Very long
pages are parsed in one pass in memory in proportion to the page.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by their role.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre"
    " section select summary table tbody td tfoot th thead title tr ul".split()
)
SKIPPED = frozenset(
    "applet aside audio button canvas dialog embed footer form head header iframe input math menu nav noscript"
    " object script select style svg template textarea title video".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
#: Words of class, id and role that mark regions outside the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments"
    " cookie cookies consent disclaimer dialog footer form header login masthead menu modal nav navbar navigation newsletter"
    " notice notices pager pagination popup promo promoted promotion related reply replies respond"
    " search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget"
    " complementary contentinfo disqus".split()
)
ARTICLE = frozenset({"article", "main"})
_PART = re.compile(r"[-_]+")
_SPACE = re.compile(r"\s+")
#: Elements that an opening block element closes, as in ``<p><b>text<p>``.
_P_ENDS = BLOCKS - {"html", "body"}

SIGMA = 1.0


def is_mark(token: str, marks: frozenset = MARKS) -> bool:
    """Whether a class, id or role consists of marks: ``cookie-notice``, but not ``has-sidebar``."""
    parts = [part for part in _PART.split(token) if part]
    return bool(parts) and marks.issuperset(parts)


#: The text of a line in pieces (text, number of the innermost marked element around it or 0), its
#: tags, and the number of its article or 0.
Line = tuple[list[tuple[str, int]], int, int]


class _Lines(HTMLParser):
    """Lines of a page; nothing of skipped elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.text: list[tuple[str, int]] = []
        self.tags = 0
        self.open: list[tuple[str, bool, int]] = []
        self.names = Counter()  # of the open tags
        self.skipped = 0
        # the innermost marked element, and for each the one around it
        self.marked = 0
        self.around = [0]
        self.articles = 0
        self.n_articles = 0

    def end_line(self) -> None:
        if any(not piece.isspace() for piece, _ in self.text):
            self.lines.append((self.text, self.tags, self.n_articles if self.articles else 0))
            self.tags = 0
        self.text = []

    def outside(self, tag: str, attrs: list) -> bool:
        # the header of an article holds its headline
        if tag in SKIPPED and not (tag == "header" and self.articles):
            return True
        if tag in ("html", "body", "article", "main"):
            return False
        return any(name == "hidden" or name == "aria-hidden" and value == "true" for name, value in attrs)

    def named_outside(self, tag: str, attrs: list) -> bool:
        if tag in ("html", "body", "article", "main"):
            return False
        marks = MARKS - {"header"} if self.articles else MARKS
        return any(
            is_mark(token, marks)
            for name, value in attrs
            if name in ("class", "id", "role") and value
            for token in value.lower().split()
        )

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
            if tag in _P_ENDS:
                self.close_paragraph(tag)
        if tag == "br":
            self.text.append((" ", self.marked))
        if tag in VOID:
            return
        skip = self.outside(tag, attrs)
        self.open.append((tag, skip, self.marked))
        self.names[tag] += 1
        self.skipped += skip
        if not self.skipped and self.named_outside(tag, attrs):
            self.around.append(self.marked)
            self.marked = len(self.around) - 1
        if tag in ARTICLE and not self.skipped:
            self.n_articles += not self.articles
            self.articles += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def close_paragraph(self, tag: str) -> None:
        """An open paragraph, or item before an item, ends where the next block begins."""
        ends = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}.get(tag, {"p"})
        if not any(self.names[name] for name in ends):
            return
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name in ends:
                self.pop_to(i)
                return
            if name in BLOCKS:
                return

    def pop_to(self, i: int) -> None:
        for tag, skip, before in reversed(self.open[i:]):
            self.names[tag] -= 1
            self.articles -= tag in ARTICLE and not self.skipped
            self.skipped -= skip
            self.marked = before
        del self.open[i:]

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        if not self.names[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.pop_to(i)
                return
            # inline elements end inside their block
            if self.open[i][0] in BLOCKS and tag not in BLOCKS:
                return

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A section of an unknown kind is a comment, as in browsers."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.text.append((data, self.marked))

    def finish(self) -> list[Line]:
        self.close()
        self.end_line()
        return self.lines


def smoothed(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing along the page; weights beyond the ends are left out."""
    reach = max(1, math.ceil(3 * sigma))
    weights = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(reach + 1)]
    out = []
    for i in range(len(ratios)):
        near = range(max(0, i - reach), min(len(ratios), i + reach + 1))
        total = sum(weights[abs(i - j)] for j in near)
        out.append(sum(ratios[j] * weights[abs(i - j)] for j in near) / total)
    return out


def threshold(values: list[float]) -> float:
    """Middle between the two means that k-means finds from the extremes."""
    low, high = min(values), max(values)
    for _ in range(50):
        cut = (low + high) / 2
        under = [v for v in values if v < cut]
        over = [v for v in values if v >= cut]
        if not under:
            return cut
        new = sum(under) / len(under), sum(over) / len(over)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def without(lines: list[Line], outside: list[bool]) -> list[tuple[str, int, int]]:
    """Lines as (text, tags, article) without the pieces in elements that are ``outside``.

    The tags of a line that is gone count for the next one, as those of skipped elements do.
    """
    out, more = [], 0
    for pieces, tags, article in lines:
        text = _SPACE.sub(" ", "".join([piece for piece, marked in pieces if not outside[marked]])).strip()
        more += tags
        if text:
            out.append((text, more, article))
            more = 0
    return out


def dense(lines: list[tuple[str, int, int]]) -> list[bool]:
    """Whether each line is content by its smoothed ratio."""
    ratios = smoothed([len(text) / max(tags, 1) for text, tags, _ in lines])
    # all lines alike: one cluster, and the whole page is content
    cut = min(ratios) if max(ratios) < 2 * min(ratios) else threshold(ratios)
    return [r >= cut for r in ratios]


def left_out(lines: list[Line], around: list[int]) -> list[bool]:
    """Whether each marked element is outside the content; ``around`` has the one around each."""
    n = len(around)
    outside = [False] + [True] * (n - 1)
    if n == 1:
        return outside
    # size of the text, and whether there is a dense line, and one of an article
    size, has_dense, has_article = [0] * n, [False] * n, [False] * n
    for (pieces, _, article), kept in zip(lines, dense(without(lines, [False] * n))):
        for piece, i in pieces:
            if here := len(piece.strip()):
                size[i] += here
                has_dense[i] = has_dense[i] or kept
                has_article[i] = has_article[i] or kept and article > 0
    direct = has_article.copy()
    # an element has a larger number than the one around it
    for i in range(n - 1, 0, -1):
        size[around[i]] += size[i]
        has_dense[around[i]] |= has_dense[i]
        has_article[around[i]] |= has_article[i]
    found = direct[0]
    for i in range(1, n):
        if not found and not outside[around[i]] and has_dense[i] and (has_article[i] or 2 * size[i] > size[0]):
            outside[i] = False
            found = direct[i]
    return outside


def main_text(html: str | None) -> str:
    """Content lines of one page, joined by line feeds."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    found = parser.finish()
    lines = without(found, left_out(found, parser.around))
    if not lines:
        return ""
    content = dense(lines)
    regions = {article for (_, _, article), kept in zip(lines, content) if kept} - {0}
    if regions:
        content = [article in regions for _, _, article in lines]
    return "\n".join(text for (text, _, _), kept in zip(lines, content) if kept)


def _main_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pd.Series([main_text(page) for page in pages], index=pages.index, dtype=object)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    return pages.select("page_id", "url", F.pandas_udf(_main_texts, "string")("html").alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("long")
    )
