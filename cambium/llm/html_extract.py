"""Main text of web pages by text-to-tag ratios of streamed parser events.

The standard library's parser streams a page's events into lines: a block
element starts a new one, inline elements count as tags within it. A line's
ratio is its characters outside links over its tags. Structure enters as a
weight of the ratio: 0 where an element is boilerplate by what it is
(navigation, headers and footers of the page, asides, forms) or by what its
class, id or role calls it (adverts, notices, sidebars, comments), ``WITHIN``
inside an article or main element, else 1.

The weighted ratios of all lines are smoothed with a Gaussian and clustered
into two around a threshold, so a short paragraph between long ones shares
their height. A container (the nearest article or main element, else the
nearest division, cell or body) is selected if one of its lines is in the upper
cluster both smoothed and by itself: a short line does not rise by its
neighbours in another container alone. The text is every line of the selected containers that
is not boilerplate by itself: nothing within the article is dropped for being short.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cambium.llm.words import in_small_batches, one_array, steps

#: Width of the Gaussian in lines, and how many of its widths are summed on either side.
SIGMA, REACH = 1.0, 2
#: Weight of a line in an article or main element.
WITHIN = 8.0
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("body div section td article main".split())
#: Elements without any text of the page, and elements that are boilerplate by what they are.
MUTE = frozenset("script style noscript template head title svg math iframe object button select textarea canvas audio video map datalist".split())
SKIP = frozenset("nav aside footer form menu dialog".split())
SKIP_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
SKIP_WORD = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup comment comments commentlist respond reply replies disqus discussion share sharing social related recommended footer masthead widget pagination pager toolbar skip".split())
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Lines(HTMLParser):
    """Collects a page's lines as (text, tags, characters in links, weight, container)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, float, int]] = []
        self.open: list[tuple[str, bool, bool, int]] = []  # element, whether it starts a muted or unwanted part, container outside it
        self.muted = self.skipped = self.container = self.containers = self.main = 0
        self.text: list[str] = []
        self.tags = self.linked = self.links = 0

    def end_line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append((text, self.tags, self.linked, 0.0 if self.skipped else WITHIN if self.main else 1.0, self.container))
        self.text, self.tags, self.linked = [], 0, 0

    def unwanted(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in SKIP:
            return True
        if tag == "header":
            return not self.main
        if tag in ("html", "body", "article", "main"):
            return False
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and (value or "").lower() in SKIP_ROLE:
                return True
            if name in ("class", "id") and not SKIP_WORD.isdisjoint(_WORD.findall((value or "").lower())):
                return True
            if name == "style" and "display:none" in (value or "").replace(" ", "").lower():
                return True
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag in BLOCK:
                self.end_line()
            self.tags += 1
            if tag == "br" and not self.muted:
                self.text.append(" ")
            return
        if tag in ("article", "main") and (self.skipped or self.muted):
            self.end_line()
            self.close_down(0)  # an element left open before the article does not hide it
        mute, skip = tag in MUTE, tag not in MUTE and self.unwanted(tag, attrs)
        if tag in BLOCK or skip:
            self.end_line()
        self.open.append((tag, mute, skip, self.container))
        self.muted += mute
        self.skipped += skip
        self.links += tag == "a"
        self.tags += 1
        if tag in CONTAINER and not (self.main and tag not in ("article", "main")):
            self.containers += 1
            self.container = self.containers
        if tag in ("article", "main") and not self.skipped:
            self.main += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def close_down(self, depth: int) -> None:
        while len(self.open) > depth:
            tag, mute, skip, outside = self.open.pop()
            if skip:
                self.end_line()
            if tag in ("article", "main") and not self.skipped:
                self.main -= 1
            self.muted -= mute
            self.skipped -= skip
            self.links -= tag == "a"
            self.container = outside

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_line()
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                self.close_down(depth)
                return
            if tag not in BLOCK and self.open[depth][0] in CONTAINER:
                return  # a stray end of an inline element

    def handle_data(self, data: str) -> None:
        if not self.muted:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def smoothed(x: np.ndarray) -> np.ndarray:
    """Gaussian smoothing; the kernel is renormalised at the ends."""
    reach = int(REACH * SIGMA)
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    at = slice(reach, reach + len(x))
    return np.convolve(x, k)[at] / np.convolve(np.ones(len(x)), k)[at]


def threshold(x: np.ndarray) -> float:
    """The border between two clusters on a line, by Lloyd's steps from the extremes."""
    low, high = float(x.min()), float(x.max())
    for _ in range(32):
        border = (low + high) / 2
        upper = x >= border
        if upper.all() or not upper.any():
            return border
        new = float(x[~upper].mean()), float(x[upper].mean())
        if new == (low, high):
            return border
        low, high = new
    return (low + high) / 2


def selected(lines: list[tuple[str, int, int, float, int]]) -> set[int]:
    """The containers with a line in the upper cluster of ratios, by itself and among its neighbours."""
    ratio = np.array([weight * max(0, len(t) - linked) / max(1, tags) for t, tags, linked, weight, _ in lines])
    height = smoothed(ratio)
    border = threshold(height)
    return {line[4] for line, r, h in zip(lines, ratio.tolist(), height.tolist(), strict=True) if h >= border and r >= border and line[3]}


def main_text(html: str | None) -> str:
    """The article's blocks in page order, one to a line; empty if there is none.

    Within a block white space is one space; character references are
    decoded. Null and empty pages give an empty text, markup without a body
    is read as if it stood in one, and unclosed elements end with the page.
    Where no line is in the upper cluster by itself, lines within an article or main element are the text.
    """
    page = Lines()
    page.feed(html or "")
    page.close()
    page.end_line()
    lines = page.lines
    if not lines:
        return ""
    chosen = selected(lines) or {line[4] for line in lines if line[3] > 1}
    return "\n".join(line[0] for line in lines if line[4] in chosen and line[3])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, from its whole html.

    Rows keep their number: equal rows give equal rows, null ids and urls stay null, an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "html", 2 << 20):
            texts = [main_text(h) for h in one_array(b, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays([one_array(b, "page_id"), one_array(b, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return in_small_batches(pages.select("page_id", "url", "html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
