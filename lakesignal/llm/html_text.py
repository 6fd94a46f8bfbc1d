"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one a block element. Each line weighs its
characters outside links; lines of menus, forms, adverts and the like weigh
nothing, nor do those outside of article and main elements where a page has
such elements. Edges of layout blocks leave empty lines. Weights are summed over
sliding windows of lines: where the sums surge a run of text begins, where they
dive to nothing it ends, and the lines between these points are the main text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines in a window; empty lines that the edge of a container leaves.
WINDOW, EDGE = 3, 2
#: A window with this much text is a surge, or with half of the page's fullest window.
SURGE = 80
NAME = re.compile(r"[^\s/>]+")
STOP = re.compile(r">|=\s*([\"'])?")
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.S)
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "title", "xmp")
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
DROPPED = frozenset("head nav footer aside form button select dialog menu object canvas map".split())
CONTAINERS = frozenset(
    "body div section article main nav header footer aside form ul ol dl table tbody thead tr td th figure blockquote"
    " details fieldset center head button select dialog menu object canvas map figcaption address p h1 h2 h3 h4 h5 h6 li"
    " dt dd pre".split()
)
#: Containers inside a text: their edges end a line, but leave no empty ones.
INNER = frozenset("section ul ol dl table tbody thead tr td th figure blockquote details figcaption address".split())
#: Elements whose end tag may be missing: a block of the same group, or the end of what holds them, ends them.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre".split())
ITEMS = frozenset("li dt dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LINES = PARAGRAPHS | ITEMS
BLOCKS = CONTAINERS | frozenset("hr caption summary legend option label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline captcha comment comments"
    " commentlist consent cookie cookies disclaimer discussion disqus footer gdpr header login masthead menu modal nav"
    " navbar navigation newsletter notice notices outbrain overlay pager pagination paywall popup promo promoted"
    " promotion reactions recommended related replies reply respond search share sharing sidebar signup social sponsor"
    " sponsored subscribe taboola tags toolbar tooltip topbar trending widget".split()
)
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
SPACE = re.compile(r"\s+")


def _dropped(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("body", "html", "main"):
        return False
    named = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(attributes)}
    if "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", ""):
        return True
    if named.get("role") in ROLES:
        return True
    names = f"{named.get('class', '')} {named.get('id', '')}"
    words = set(names.split() if in_article else re.split(r"[^a-z]+", names))  # whole names inside an article
    if in_article or tag == "article" or tag in LINES:  # parts of an article are often named after it
        words -= {"header", "tags", "banner"}
    return bool(words & WORDS)


def tokens(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text before, closing, tag, attributes) of each tag; the last has no tag.

    Takes time in proportion to the page: a quote without its end, or a tag
    without one, makes all later tags end at their first '>', quoted or not.
    """
    at = start = 0
    quoted, n = True, len(page)

    def tag_end(i: int) -> int:
        nonlocal quoted
        j = i
        while quoted:
            m = STOP.search(page, j)
            if m is None:
                break
            if m[0] == ">":
                return m.start()
            j = m.end()
            if m[1]:
                j = page.find(m[1], j) + 1
                if not j:
                    break
        quoted = False
        return page.find(">", i)

    while (at := page.find("<", at)) >= 0:
        nxt = page[at + 1 : at + 2]
        closing = nxt == "/"
        begin = at + 1 + closing
        first = page[begin : begin + 1]
        if nxt in ("!", "?"):
            mark = "-->" if page.startswith("<!--", at) else ">"
            end = page.find(mark, at + 2)
            yield page[start:at], False, "", ""
            at = start = end + len(mark) if end >= 0 else n
            continue
        if not (first.isascii() and first.isalpha()):
            at += 1
            continue
        name = NAME.match(page, begin)
        end = tag_end(name.end())
        yield page[start:at], closing, name[0].lower(), page[name.end() : end] if end >= 0 else ""
        at = start = end + 1 if end >= 0 else n
        if name[0].lower() in RAW and not closing:
            stop = RAW_END[name[0].lower()].search(page, at)
            at = start = stop.end() if stop else n
    yield page[start:], False, "", ""


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """Lines (text, characters outside links, zone); the zone is 1 in article and main, -1 in what is dropped, else 0."""
    lines: list[tuple[str, int, int]] = []
    parts: list[str] = []
    plain = links = 0
    stack: list[tuple[str, bool, bool]] = []
    is_open: Counter[str] = Counter()
    dropped = articles = headings = 0

    def close_line(empty: int = 0) -> None:
        nonlocal plain
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
        zone = -1 if dropped else int(articles > 0)
        if text:
            lines.append((text, plain, zone))
        lines.extend([("", 0, zone)] * empty)
        parts.clear()
        plain = 0

    def pop() -> str:
        nonlocal dropped, articles, headings
        tag, drop, article = stack.pop()
        is_open[tag] -= 1
        dropped -= drop
        articles -= article
        headings -= tag in HEADINGS
        return tag

    for text, closing, tag, attributes in tokens(page):
        if text:
            parts.append(text)
            if not links or headings:
                plain += len(text) - text.count(" ")
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        if tag not in BLOCKS:
            continue
        close_line(EDGE if tag in CONTAINERS and tag not in INNER and tag not in LINES and not articles else 0)
        links = 0
        if tag not in CONTAINERS or tag in VOID:
            continue
        if closing:
            if is_open[tag]:
                while pop() != tag:
                    pass
        elif not attributes.endswith("/"):
            while stack and (stack[-1][0] in PARAGRAPHS or stack[-1][0] in ITEMS and tag in ITEMS):
                pop()
            drop = _dropped(tag, attributes, articles > 0)
            article = tag in ("article", "main") and not drop
            stack.append((tag, drop, article))
            is_open[tag] += 1
            dropped += drop
            articles += article
            headings += tag in HEADINGS
    close_line()
    return lines


def weights_of(lines: list[tuple[str, int, int]]) -> tuple[list[int], float]:
    """Each line's weight, and the least window sum that is a surge."""
    if any(zone > 0 and text for text, _, zone in lines):  # what stands in an article is text, however short, links too
        return [len(text) if zone > 0 else 0 for text, _, zone in lines], 1
    weights = [n if zone >= 0 else 0 for _, n, zone in lines]
    return weights, min(SURGE, max(window_sums(weights), default=0) / 2)


def window_sums(weights: list[int]) -> list[int]:
    """For each line the sum over it and the WINDOW - 1 lines after it."""
    sums = [0, *accumulate(weights)]
    n = len(weights)
    return [sums[min(i + WINDOW, n)] - sums[i] for i in range(n)]


def runs(weights: list[int], surge: float) -> list[tuple[int, int]]:
    """(first, end) of the stretches of lines between a surge of the window sums and their dive to nothing.

    A stretch begins with its first line of any weight.
    """
    sums, out, i = window_sums(weights), [], 0
    while i < len(sums):
        end = i
        while end < len(sums) and sums[end]:
            end += 1
        if end > i and max(sums[i:end]) >= surge:
            while not weights[i]:
                i += 1
            out.append((i, end))
        i = max(end, i + 1)
    return out


def main_text(page: str | None) -> str:
    """The lines between surges and dives, without those of dropped containers, joined by spaces."""
    lines = lines_of(page or "")
    weights, surge = weights_of(lines)
    least = 1 if any(zone > 0 and text for text, _, zone in lines) else 0
    return " ".join(t for s, e in runs(weights, surge) for t, _, zone in lines[s:e] if t and zone >= least)


def extract(pages: Column) -> Column:
    """The main text of each whole page; null and pages without text give an empty string."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([main_text(p) for p in b.to_pylist()], pa.string())

    return run(pages)


def html_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row.

    Null and empty pages, and pages without text, give an empty text of 0
    characters. Pages of any length are read whole, in time in proportion to
    their length, broken markup too. Rows are judged one by one, so repeated
    rows and ids each give a row; null ids and urls stay null, extra columns
    are ignored. An empty table gives an empty table.
    """
    out = pages.select(id_col, url_col, extract(F.col(html_col)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from .common import table

    return html_text(table(spark, sf_dir, "pages"))
