"""Operator 6, HTML extraction: the main text of a page from the events of the standard parser.

Events are folded into lines, one for each block of text, with the tags and links met on the way.
Each line gets its text-to-tag ratio; the ratios are smoothed by a Gaussian and cut in two clusters.
The lines of the upper cluster vote for the element that holds the content region, and all blocks of
that element are the text, short ones too, without the parts that are never content.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
#: Elements that can be the content region.
REGIONS = frozenset("article body center div main section table td".split())
#: Never content, with all they hold.
SKIPPED = frozenset(
    "script style noscript template title nav aside footer form button select textarea iframe object "
    "svg canvas audio video dialog menu".split()
)
SKIPPED_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search "
    "toolbar".split()
)
#: Words in a class or id that tell menus, notices, adverts and the like.
SKIPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs consent "
    "cookie cookies dialog disclaimer footer gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice notices notification pager pagination popup promo promotion share "
    "sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: As above, and an article inside is one of theirs.
SKIPPED_LISTS = frozenset(
    "comment comments commentlist disqus discussion reader recommended recommendations related "
    "replies reply respond responses teaser teasers".split()
)
#: A start tag ends these, if they are still open above it.
IMPLIED = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
WORD = re.compile("[a-z0-9]+")


class Line:
    """A block of text: its pieces, the open elements around it, tags before it, text in links."""

    __slots__ = ("linked", "pieces", "tags", "text", "within")

    def __init__(self, within: tuple[int, ...]):
        self.within, self.pieces, self.tags, self.linked, self.text = within, [], 0, 0, ""


class Events(HTMLParser):
    """Collects the lines of a page that lie in no skipped element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, str]] = []  # tag, number, why it is skipped
        self.kinds: list[str] = ["page"]  # tag of each numbered element
        self.lines: list[Line] = []
        self.line: Line | None = None
        self.tags = 0

    def _break(self) -> None:
        if self.line is not None:
            self.line.text = " ".join("".join(self.line.pieces).split())
            if self.line.text:
                self.lines.append(self.line)
            else:
                self.tags += self.line.tags
            self.line = None

    def _why(self, tag: str, attrs: dict[str, str | None]) -> str:
        inside = any(t in ("article", "main") for t, _, _ in self.open)
        if tag in SKIPPED or (tag == "header" and not inside):
            return "part"
        if tag in ("html", "body", "main"):
            return ""
        style = (attrs.get("style") or "").replace(" ", "").lower()
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style:
            return "part"
        if (attrs.get("role") or "").lower() in SKIPPED_ROLES:
            return "part"
        words = set(WORD.findall(f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()))
        if words & SKIPPED_LISTS:
            return "list"
        return "part" if words & SKIPPED_WORDS and tag != "article" else ""

    def _close_to(self, depth: int) -> None:
        if any(t in BLOCKS for t, _, _ in self.open[depth:]):
            self._break()
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in ("html", "head"):
            return
        if tag in BLOCKS:
            self._break()
            if tag in ("article", "main"):
                # An advert or notice that was never closed does not hold the article.
                for depth, (_, _, why) in enumerate(self.open):
                    if why == "list":
                        break
                    if why:
                        self._close_to(depth)
                        break
            names = [t for t, _, _ in self.open]
            if "p" in names:
                self._close_to(len(names) - 1 - names[::-1].index("p"))
        if tag in IMPLIED and self.open:
            for depth in range(len(self.open) - 1, -1, -1):
                if self.open[depth][0] in IMPLIED[tag]:
                    self._close_to(depth)
                    break
                if self.open[depth][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        if tag in VOID:
            self._space()
            return
        if tag in ("td", "th"):
            self._space()
        self.kinds.append(tag)
        self.open.append((tag, len(self.kinds) - 1, self._why(tag, dict(attrs))))

    def _space(self) -> None:
        if self.line is not None:
            self.line.pieces.append(" ")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                self._close_to(depth)
                return
            # A stray end of an inline or inner element does not end what lies around it.
            if self.open[depth][0] in ("article", "main", "body", "table") and tag not in ("article", "main", "body", "html"):
                return

    def handle_data(self, data: str) -> None:
        if any(why for _, _, why in self.open):
            return
        if self.line is None:
            if not data.strip():
                return
            self.line = Line((0, *(n for t, n, _ in self.open)))
            self.line.tags, self.tags = self.tags, 0
        self.line.pieces.append(data)
        if any(t == "a" for t, _, _ in self.open):
            self.line.linked += len(data)

    def finished(self) -> list[Line]:
        self.close()
        self._break()
        return self.lines


def smoothed(ratios: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian mean of each ratio and its neighbours, up to three sigma away."""
    reach = math.ceil(3 * sigma)
    weights = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(reach + 1)]
    out = []
    for i in range(len(ratios)):
        near = range(max(0, i - reach), min(len(ratios), i + reach + 1))
        total = sum(weights[abs(j - i)] for j in near)
        out.append(sum(ratios[j] * weights[abs(j - i)] for j in near) / total)
    return out


def threshold(values: list[float]) -> float:
    """Border of two clusters of the values, by moving means."""
    low, high = min(values), max(values)
    for _ in range(50):
        cut = (low + high) / 2
        below = [v for v in values if v < cut]
        above = [v for v in values if v >= cut]
        means = (sum(below) / len(below) if below else low, sum(above) / len(above) if above else high)
        if means == (low, high):
            break
        low, high = means
    return (low + high) / 2


def main_text(html: str | None, share: float = 0.9) -> str:
    """Blocks of the main text, joined by an empty line; empty for a page without text."""
    events = Events()
    events.feed(html or "")
    lines = events.finished()
    if not lines:
        return ""
    ratios = [(len(x.text) - min(x.linked, len(x.text))) / (x.tags + 1) for x in lines]
    even = smoothed(ratios)
    cut = threshold(even)
    votes: dict[int, float] = {}
    for line, ratio in zip(lines, even, strict=True):
        if ratio >= cut:
            for element in line.within:
                votes[element] = votes.get(element, 0) + len(line.text)
    # From the page down to the smallest element that still holds the content region.
    chosen = 0
    for element in sorted(votes):
        kind = events.kinds[element]
        if kind in REGIONS and votes[element] >= share * votes[0]:
            chosen = element
            if kind in ("article", "main"):
                break
    return "\n\n".join(x.text for x in lines if chosen in x.within)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(text=[main_text(h) for h in batch["html"]]).drop(columns="html")


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page, in the order and number of the input rows.

    A null or empty page, or one without text, gives the empty text; null ids and addresses stay
    null. Repeated rows repeat; other columns are not read. A page is parsed whole, one at a time.
    """
    slim = pages.select("page_id", "url", "html")
    types = dict(slim.dtypes)
    text = slim.mapInPandas(_extract, f"page_id {types['page_id']}, url {types['url']}, text string")
    return text.withColumn("n_chars", F.length("text").cast("long"))
