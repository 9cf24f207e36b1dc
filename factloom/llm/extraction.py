"""Main text of HTML pages by the distribution of text over lines.

Markup is stripped into lines: every block element begins one, every other container leaves an empty line where it begins
and ends, and what is no article by its element, its role or its names (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, comments) leaves an empty line in its place. A line weighs its code points outside links.
Where a page marks its article (`article`, else `main`), lines outside weigh nothing. The weights are summed over windows
of three lines. Text surges where a window comes to a fifth of the page's highest (to anything, in a marked article) and
dives where the windows stay below that; both points are moved out to the next empty line, as a headline or a short last
paragraph belongs to the lines that it touches. Lines between the first surge and the last dive are kept, but for list
items and cells that are nothing but links, where no article is marked.

Character references are decoded once, after markup is taken out, as browsers do (`&amp` without its semicolon too).
White space (as Python's str.split has it, no-break spaces too) becomes one space; inline elements add none; blocks are
joined by one space. `<` that begins no tag is text. An unclosed comment, script or tag reaches to the end of the page, as
in browsers. Null and empty pages, and pages without a line of text, have empty texts. Repeated rows are rows of their
own, empty tables give no rows, and only the id, the address and the page are read. Memory is bounded by SLICE or the
longest page; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import slices

#: Bytes of pages that are taken in one go.
SLICE = 1 << 22
#: Lines of a window, and the share of the highest window at which text surges.
WINDOW, SURGE = 3, 0.2

# Elements of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe noembed noframes xmp template".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
#: Blocks that are lines of the container around them.
LINES = set("p br h1 h2 h3 h4 h5 h6 li dt dd pre hr blockquote figcaption caption address".split())
#: Elements that begin after the end of an open paragraph.
ENDS_PARAGRAPH = set(
    "address article aside blockquote details dialog div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li "
    "main menu nav ol p pre search section table ul".split()
)
#: Elements that hold no article text.
ASIDE = set("head nav footer aside form dialog menu button select label option svg math object audio video canvas".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in a class or an id that tell the same; and those of which a header's names consist.
NAMES = set(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "masthead menu menus modal nav navbar navigation newsletter notice notices pagination pager popup promo promotion related replies respond "
    "share sharing sidebar sidebars social sponsor sponsored subscribe toolbar widget widgets".split()
)

HEADER = set("global header page site top".split())

TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.DOTALL,
)
NAMED = re.compile(r"""\b(class|id|role|itemprop|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
CLOSING = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE) for name in RAW}

#: What an open element is for: no article; a mark of the article; a link; an item of a list or a cell.
HOLLOW, ARTICLE, MAIN, LINK, ITEM = range(5)


def _kinds(name: str, attributes: str, inside: Counter) -> list[int]:
    """What an element is for, by its name and attributes and by what it is in."""
    kinds = [LINK] if name == "a" else [ITEM] if name in ("li", "td", "th", "dd") else []
    if name in ASIDE or name == "header" and not inside[ARTICLE] and not inside[MAIN]:
        return [HOLLOW]
    marks = {"article": [ARTICLE], "main": [MAIN]}.get(name, [])
    if attributes:
        for m in NAMED.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "role" and value.lower() in ROLES:
                return [HOLLOW]
            if key == "role" and value.lower() == "main":
                marks = [MAIN]
            elif key == "itemprop" and value.lower() == "articlebody":
                marks = [ARTICLE]
            elif key in ("class", "id") and name not in ("body", "html", "main") and (name != "article" or inside[ARTICLE]):
                words = {w.lower() for w in WORDS.findall(value)}
                if words & NAMES or "header" in words <= HEADER and not inside[ARTICLE]:
                    return [HOLLOW]
            elif key == "hidden" and not (m[2] or m[3] or m[4]):
                return [HOLLOW]
    return kinds + marks


class Line:
    """A line: its text, its code points outside links, and whether it is in `article`, in `main`, and a list item or cell."""

    __slots__ = ("text", "weight", "article", "main", "item")

    def __init__(self, text: str = "", weight: int = 0, article: bool = False, main: bool = False, item: bool = False):
        self.text, self.weight, self.article, self.main, self.item = text, weight, article, main, item


def stripped(html: str) -> list[Line]:
    """The lines of a page; empty ones where containers and what is no article begin and end."""
    lines: list[Line] = []
    stack: list[tuple[str, list[int]]] = []
    count: Counter = Counter()  # open elements by name
    inside: Counter = Counter()  # open elements by kind
    said: list[str] = []
    linked = 0

    def end_line() -> None:
        nonlocal linked
        if said:
            text = " ".join("".join(said).split())
            if text:
                lines.append(Line(text, max(0, len(text) - linked), inside[ARTICLE] > 0, inside[MAIN] > 0, inside[ITEM] > 0))
            said.clear()
        linked = 0

    def gap() -> None:
        end_line()
        if lines and lines[-1].text:
            lines.append(Line())

    def pop() -> None:
        name, kinds = stack.pop()
        if name not in INLINE:
            end_line()
        if name not in INLINE and name not in LINES or HOLLOW in kinds:
            gap()
        count[name] -= 1
        for k in kinds:
            inside[k] -= 1

    def say(text: str) -> None:
        nonlocal linked
        if text and not inside[HOLLOW]:
            text = unescape(text) if "&" in text else text
            said.append(text)
            if inside[LINK]:
                linked += len(" ".join(text.split()))

    at = 0
    while m := TOKEN.search(html, at):
        say(html[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if count[name] > 0:
                while stack[-1][0] != name:
                    pop()
                pop()
            elif name not in INLINE:
                end_line()
            continue
        if name in ENDS_PARAGRAPH and count["p"] > 0:
            while stack[-1][0] != "p":
                pop()
            pop()
        if name == "li" and stack and stack[-1][0] == "li":
            pop()
        if name in RAW:
            close = CLOSING[name].search(html, at)
            at = close.start() if close else len(html)
            if name in ("script", "style", "template", "noscript"):
                continue
            gap()
            continue
        if name not in INLINE:
            end_line()
            if name not in LINES:
                gap()
        if name in VOID:
            continue
        kinds = _kinds(name, m[3] or m[6] or "", inside)
        if HOLLOW in kinds:
            gap()
        stack.append((name, kinds))
        count[name] += 1
        inside.update(kinds)
    say(html[at:])
    while stack:
        pop()
    end_line()
    return lines


def windows(weights: list[int]) -> list[int]:
    """The sum over each line and the WINDOW - 1 lines after it."""
    upto = [0]
    for w in weights:
        upto.append(upto[-1] + w)
    return [upto[min(k + WINDOW, len(weights))] - upto[k] for k in range(len(weights))]


def main_lines(lines: list[Line]) -> list[Line]:
    """The lines between surge and dive."""
    marked = next((m for m in ("article", "main") if any(getattr(x, m) and x.text for x in lines)), None)
    inside = [marked is None or getattr(x, marked) for x in lines]
    weights = [(len(x.text) if marked else x.weight) if own else 0 for x, own in zip(lines, inside)]
    sums = windows(weights)
    least = 1 if marked else max(1, SURGE * max(sums, default=0))
    high = [k for k, w in enumerate(sums) if w >= least]
    if not high:
        return []
    surge, dive = high[0], high[-1]
    while not weights[surge]:  # a window begins before the text that it holds
        surge += 1
    while surge and lines[surge - 1].text and inside[surge - 1]:
        surge -= 1
    while dive + 1 < len(lines) and lines[dive + 1].text and inside[dive + 1]:
        dive += 1
    kept = [x for x, own in zip(lines[surge : dive + 1], inside[surge : dive + 1]) if x.text and own]
    return kept if marked else [x for x in kept if not (x.item and not x.weight)]


def main_text(html: str | None) -> str:
    return " ".join(x.text for x in main_lines(stripped(html or "")))


def extracted(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page; n_chars in code points."""

    def run(batches):
        for batch in slices(batches, "html", SLICE):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    return plain.mapInArrow(run, "page_id long, url string, text string, n_chars long")
