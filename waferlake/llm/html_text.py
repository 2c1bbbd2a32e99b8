"""Main text of web pages by text-to-tag ratios over parser events."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: element names of HTML
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("aside button canvas datalist dialog fieldset footer form head iframe input label math menu nav noscript object script select style svg template textarea title".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NOISE = re.compile(r"(?<![a-z])(ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|header|masthead|menu|modal|nav\w*|newsletter|notice|popup|promo\w*|related|replies|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?![a-z])", re.I)
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
SPACES = re.compile(r"\s+")


class Events(HTMLParser):
    """Blocks of a page in order: text, tags met, number of the article or 0. Text and tags inside boilerplate,
    block or inline, are dropped where they stand."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool]] = []
        self.blocks: list[tuple[str, int, int]] = []
        self.buffer: list[str] = []
        self.tags = 0
        self.article = 0
        self.articles = 0

    def _state(self):
        return self.stack[-1] if self.stack else ("", False, False)

    def flush(self):
        text = SPACES.sub(" ", "".join(self.buffer)).strip()
        if text:
            self.blocks.append((text, self.tags, self.article))
            self.tags = 0
        self.buffer.clear()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            # a block that starts ends an open paragraph or item of its kind, also across inline elements
            shut = CLOSES.get(tag, {"p"} if tag not in ("td", "th", "tr", "li") else set())
            for i in range(len(self.stack) - 1, -1, -1):
                name = self.stack[i][0]
                if name in shut:
                    self._pop(i)
                    break
                if name in BLOCKS or name in SKIPPED:
                    break
        _, noisy, inside = self._state()
        if tag in VOID:
            self.tags += not noisy
            if tag == "br":
                self.buffer.append(" ")
            return
        a = {k: v or "" for k, v in attrs}
        own = tag in SKIPPED or (tag == "header" and not inside) or a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true"
        if tag not in ("html", "body", "article", "main"):
            own = own or bool(NOISE.search(f"{a.get('class', '')} {a.get('id', '')}"))
        self.tags += not (noisy or own)
        enters = tag in ("article", "main")
        if enters and not inside:
            self.articles += 1
            self.article = self.articles
        self.stack.append((tag, noisy or own, inside or enters))

    def _pop(self, i):
        if tag_in := self.stack[i][2]:
            tag_in = bool(i and self.stack[i - 1][2])
            self.article = self.article if tag_in else 0
        del self.stack[i:]

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.tags += not self._state()[1]
        limit = 0
        for i in range(len(self.stack) - 1, limit - 1, -1):
            name = self.stack[i][0]
            if name == tag:
                self._pop(i)
                return
            if name in ("article", "main", "nav", "footer", "aside", "table") and tag not in ("body", "html", "article", "main", "nav", "footer", "aside", "table", "div", "section"):
                return

    def handle_data(self, data):
        if not self._state()[1]:
            self.buffer.append(data)


def clustered(sizes: np.ndarray, tags: np.ndarray, area: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Which blocks are content: text-to-tag ratios, smoothed up to the bounds of articles, clustered at one
    standard deviation or the mean, whichever is lower."""
    ratio = (sizes / np.maximum(tags, 1)).astype(float)
    reach = np.arange(-3, 4)
    kernel = np.exp(-(reach**2) / (2 * sigma**2))
    kernel /= kernel.sum()
    runs = np.split(ratio, np.flatnonzero(np.diff(area)) + 1)
    smooth = np.concatenate([np.convolve(np.pad(r, 3, mode="edge"), kernel, "valid") for r in runs])
    return smooth >= min(smooth.std(), smooth.mean())


def regions(sizes: np.ndarray, tags: np.ndarray, area: np.ndarray) -> tuple[np.ndarray, str]:
    """Which blocks lie in content regions, and what decided. "articles": every article that holds a clustered
    block is a region whole, and nothing else is, unless the clustered blocks outside hold more text. Then, and
    on pages without such an article, "clusters": all from the first clustered block to the last."""
    chosen = clustered(sizes, tags, area)
    inside = np.isin(area, area[chosen & (area > 0)])
    if inside.any() and sizes[inside].sum() >= sizes[chosen & (area == 0)].sum():
        return inside, "articles"
    at = np.flatnonzero(chosen)
    out = np.zeros(len(sizes), bool)
    if len(at):
        out[at[0] : at[-1] + 1] = True
    return out | inside, "clusters"


def decide(html: str | None) -> tuple[str, str]:
    """Main text of one page and what decided it: "articles", "clusters", or "none" for a page without text.

    A page without markup keeps its whole text, a null page gives an empty one. Blocks of menus, footers, forms,
    adverts and the like never count. On every page the text-to-tag ratios of the blocks are smoothed and
    clustered; where the page marks articles, every article that holds a clustered block is kept whole.
    """
    parser = Events()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    blocks = parser.blocks
    if not blocks:
        return "", "none"
    keep, by = regions(*(np.array(x) for x in ([len(b[0]) for b in blocks], [b[1] for b in blocks], [b[2] for b in blocks])))
    return "\n".join(b[0] for b, k in zip(blocks, keep) if k), by


def extract(html: str | None) -> str:
    """Main text of one page."""
    return decide(html)[0]


def main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds `text` and `n_chars` (code points) to every page."""

    @F.pandas_udf("string")
    def run(html: pd.Series) -> pd.Series:
        return html.map(extract, na_action=None)

    made = pages.drop("text", "n_chars").withColumn("text", run(html_col))
    return made.withColumn("n_chars", F.length("text").cast("long"))
