"""Main text of web pages by line-block distribution.

Markup is stripped to lines: block-level tags and line ends of preformatted text start a new line, character
references are decoded, white space within a line becomes one blank. Lines inside containers that hold
no article text (menus, headers and footers of the page, sidebars, notices, adverts, forms,
scripts, styles, reader comments) are stripped, and outside of marked articles, lines that are links for the most part
count as empty. Forms, headers, and containers known by a whole name of their class or id alone are not stripped if
they hold a marked article or more than half of the page's text, or if nothing else has text.

The distribution is the sum of the text lengths of `WINDOW` lines, for every line from itself on. Text
surges where the distribution rises from zero, and dives where a whole window is empty again; what lies
between surge and dive is a region. Stripped containers leave no lines, so they part no regions. Heavy are the
regions that reach `LEAST_MASS`, and that of greatest mass. Kept are they, all regions between the first and the last of
them, and however short, all regions that share a container (`_CONTAINERS`) with a heavy one: those that lie in it, or
if it is the whole page, those between its first and its last own line. If the page marks articles that hold text, lines
outside of them count as empty, and all regions are kept. Lines between surge and dive that count as empty are left out.

Defined results: null, empty and blank pages, and pages without text, give the empty string. Unclosed
containers end where their parent ends; unclosed comments, scripts and styles at the end of the page. A `<`
that starts no tag is text. Equal rows get equal texts. Other columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
LEAST_MASS = 200
# A line with a greater share of link text counts as empty.
MOST_LINKED = 0.6

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|object|svg|math|select|canvas)\b[^<>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>[^<>]*+)(?:>|\Z)",
    re.S | re.I)
_ATTRIBUTE = re.compile(r"""(?P<name>[^\s"'<>/=]+)(?:\s*=\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[^\s>]+)))?""")
_SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead tr ul".split())
_BOILERPLATE_TAGS = frozenset("head nav footer aside button menu dialog search".split())
_LOOSE_TAGS = frozenset("form fieldset".split())
_BOILERPLATE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Class names and ids of these words, and of any of `_BOX_WORDS`, mark a container without article text.
_BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar side aside footer cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments "
    "disqus reply replies respond widget pagination pager skip masthead toolbar".split())
_BOX_WORDS = frozenset(
    "area bar block body bottom box btn button buttons center col column container content footer header holder icon icons inner item "
    "items label left link links list module outer panel posts right row section site slot text top unit wrap wrapper zone".split())
# Names that end in one of these, as article-comments, are what readers wrote, unless they only tell whether there is any.
_COMMENT_WORDS = frozenset("comment comments replies respond disqus".split())
_TELLING_WORDS = frozenset("no has with without".split())
_ARTICLE_TAGS = frozenset(("article", "main"))
# Elements that hold the parts of a text, where others are its parts.
_CONTAINERS = frozenset("article body center dialog div html main section td th".split())
# These end an open one of their own kind.
_CLOSED_BY_NEXT = frozenset("p li dt dd tr td th option".split())


def _named(value: str) -> bool:
    """Whether a name of a class or id as a whole says that there is no article text."""
    for token in value.split():
        names = [w for w in _SPLIT.split(token) if w and not w.isdigit()]
        names = [w.lower() for w in names]
        if names and names[-1] in _COMMENT_WORDS and names[0] not in _TELLING_WORDS:
            return True
        if not _BOILERPLATE_WORDS.isdisjoint(names) and all(w in _BOILERPLATE_WORDS or w in _BOX_WORDS for w in names):
            return True
    return False


def _boilerplate(tag: str, rest: str, in_article: bool) -> str:
    """Why an element holds no article text: "" if it may, "loose" if a wrapper of the text can look like this, or "sure"."""
    if tag in _LOOSE_TAGS or (tag == "header" and not in_article):
        why = "loose"
    elif tag in _BOILERPLATE_TAGS:
        return "sure"
    else:
        why = ""
    if not rest.strip(" /") or tag in ("html", "body", "article", "main"):
        return why
    for m in _ATTRIBUTE.finditer(rest):
        name, value = m["name"].lower(), m["a"] or m["b"] or m["c"] or ""
        if name == "role" and value.strip().lower() in _BOILERPLATE_ROLES or name == "hidden":
            return "sure"
        if name == "aria-hidden" and value.strip().lower() == "true":
            return "sure"
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return "sure"
        if name in ("class", "id") and _named(value):
            why = "loose"
    return why


def lines(html: str) -> tuple[list[tuple[str, int, bool, int]], list[list[int]]]:
    """Lines and containers, without what looks like boilerplate but holds an article or most of the page's text."""
    rows, containers, loose, mass = _lines(html, frozenset())
    wraps = frozenset(at for at, n, articles in loose if articles or 2 * n > mass)
    if wraps:
        rows, containers, loose, mass = _lines(html, wraps)
    if loose and not any(r[1] for r in rows):
        # The page's text is dealt to containers that all look like boilerplate.
        rows, containers, *_ = _lines(html, wraps | {at for at, *_ in loose})
    return rows, containers


def _lines(html: str, wraps: frozenset[int]) -> tuple[
        list[tuple[str, int, bool, int]], list[list[int]], list[tuple[int, int, int]], int]:
    """Lines as (text, length that counts, in an article, container), in page order, and the containers.

    Containers are (parent, line where it ends); number 0 is the page, and so are its html and body. Then come the elements
    that are loosely taken for boilerplate, as (place, length of their text, articles in them), and the length of all text.
    wraps: places of elements that are not to be taken for it.
    """
    loose: list[tuple[int, int, int]] = []
    seen = marked = 0
    out: list[tuple[str, int, bool, int]] = []
    containers = [[0, 0]]
    inside = 0
    parts: list[str] = []
    linked = 0
    # Open elements that matter: containers, and links.
    stack: list[tuple[str, bool, bool, bool, tuple[int, int, int] | None]] = []
    # Skipped elements that are open, and those of them that are surely boilerplate.
    skipping = hidden = articles = links = 0

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            counts = 0 if linked > MOST_LINKED * len(text) and not articles else len(text)
            out.append((text, counts, articles > 0, inside))
        parts.clear()
        linked = 0

    def text(raw: str) -> None:
        nonlocal linked, seen
        if raw and not hidden:
            decoded = unescape(raw)
            length = len(_SPACE.sub(" ", decoded).strip())
            seen += length
            if not skipping:
                parts.append(decoded)
                if links:
                    linked += length

    def close(depth: int) -> None:
        nonlocal skipping, articles, links, inside, hidden
        while len(stack) > depth:
            tag, skipped, article, container, start = stack.pop()
            skipping -= skipped
            if start:
                loose.append((start[0], seen - start[1], marked - start[2]))
            elif skipped:
                hidden -= 1
            articles -= article
            links -= tag == "a"
            if container:
                containers[inside][1] = len(out)
                inside = containers[inside][0]

    at = 0
    for m in _TOKEN.finditer(html):
        text(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in _BLOCK:
            flush()
        if m["end"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
                # An end tag does not reach beyond the container that it is in, unless it ends the page.
                if stack[depth][0] in ("nav", "aside", "footer", "form", "table", "article", "main") and tag not in ("body", "html"):
                    if not any(s[0] == tag for s in stack[:depth]) or tag in ("p", "b", "i", "span", "a", "li"):
                        break
        elif tag not in _VOID:  # a slash at the end closes nothing in HTML, and may belong to a value
            if tag == "body" and stack and stack[0][0] == "head":
                close(0)
            if tag in _CLOSED_BY_NEXT and stack and stack[-1][0] == tag:
                close(len(stack) - 1)
            article = tag in _ARTICLE_TAGS
            why = _boilerplate(tag, m["rest"], articles > 0)
            skipped = bool(why) and m.start() not in wraps
            if skipped and not skipping:
                flush()
            if tag in _BLOCK or skipped or tag == "a":
                container = tag in _CONTAINERS and tag not in ("html", "body")
                stack.append((tag, skipped, article, container, (m.start(), seen, marked) if skipped and why == "loose" else None))
                hidden += why == "sure"
                marked += article and not hidden
                if container:
                    containers.append([inside, 0])
                    inside = len(containers) - 1
                skipping += skipped
                articles += article
                links += tag == "a"
    text(html[at:])
    flush()
    close(0)
    containers[0][1] = len(out)
    return out, containers, loose, seen


def _of_text(regions: list[list[int]], heavy: list[bool], rows: list[tuple[str, int, bool, int]],
             containers: list[list[int]]) -> list[bool]:
    """Which regions belong to the text of the heavy ones."""
    kept = list(heavy)

    def fill(fits: list[bool]) -> None:
        if any(fits):
            low, high = fits.index(True), len(fits) - fits[::-1].index(True)
            kept[low:high] = [True] * (high - low)

    fill(heavy)
    homes = set()
    for r, h in zip(regions, heavy):
        if h:
            # The least container that holds the first and the last line.
            c = rows[r[0]][3]
            while c and containers[c][1] <= r[-1]:
                c = containers[c][0]
            homes.add(c)
    if 0 in homes:
        fill([any(rows[i][3] == 0 for i in r) for r in regions])
    within = [c in homes and c > 0 for c in range(len(containers))]
    for c in range(1, len(containers)):
        within[c] |= within[containers[c][0]]
    return [k or any(within[rows[i][3]] for i in r) for k, r in zip(kept, regions)]


def main_text(html: str | None) -> str:
    """The text between surges and dives of the line-block distribution."""
    rows, containers = lines(html) if html else ([], [])
    marked = any(n and article for _, n, article, _ in rows)
    counts = [n if article or not marked else 0 for _, n, article, _ in rows]
    blocks = [sum(counts[i : i + WINDOW]) for i in range(len(rows))]
    regions: list[list[int]] = []
    for i, n in enumerate(counts):
        surge = blocks[i] > 0 and (i == 0 or not regions or regions[-1][-1] + WINDOW <= i)
        if n and surge:
            regions.append([i])
        elif n:
            regions[-1].append(i)
    masses = [sum(counts[i] for i in r) for r in regions]
    greatest = max(masses, default=0)
    heavy = [marked or m >= LEAST_MASS or m == greatest for m in masses]
    kept = heavy if marked else _of_text(regions, heavy, rows, containers)
    return "\n".join(rows[i][0] for r, k in zip(regions, kept) if k for i in r)


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """Pages with their main text in another column, in place of one of that name."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield html.map(main_text, na_action=None)

    return pages.withColumn(into, texts(F.col(html).cast("string")))
