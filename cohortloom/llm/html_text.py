"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one per block element. Menus, headers, footers, sidebars, notices, adverts, forms and comment
sections give no lines, so that none of them can end the text around it. What a class or id calls so is kept all the same
where it holds the larger part of the page's unlinked text and the headline, or, with a name of doubtful meaning, nearly all of it.

A line's weight is its text if most of that stands outside links. Where the page marks the main article, its lines are the
text, but for link lists; articles beside the heaviest one belong to it if they have paragraphs and a like weight. On other
pages weights are summed over windows of ``WINDOW`` lines. From the heaviest window the text goes on in both directions
until the sum is down to nothing twice in a row, or once and no like surge follows: the surge and the dive. Lines between
these points are the text, but for link lists."""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: Sums behind a gap are of like weight from this part of the heaviest on.
SURGE = 4
#: Articles beside the heaviest one are of like weight from this part of it on.
SIBLING = 5
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|object|select|title)\b.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*>""",
    re.S | re.I)
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
OUTSIDE = frozenset("nav footer aside menu dialog button".split())
MAIN = frozenset(("article", "main"))
CLOSERS = ("article", "main", "body", "html")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose lines are text even if all of it is a link.
TEXTUAL = HEADINGS | frozenset("p blockquote figcaption pre".split())
NAMED = re.compile(r"""(?<![^\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SIDE_NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo "
    "cookie cookies disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice "
    "pager pagination popup promo promoted recommended related reply respond search share sharing sidebar signup social "
    "sponsor sponsored subscribe toolbar widget".split())
#: First words of names that tell how an element is laid out, not what it is.
STATES = frozenset("has is js no not with without".split())
ARTICLES = frozenset("article content entry news post story".split())
#: Words that names of whole pages use beside others (search-results, content-form).
LAYOUT = frozenset("form header search".split())
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NOT_SHOWN = re.compile(r"(?:\A|;)\s*display\s*:\s*none\b", re.I)
#: A notice that no element marks, only looked at on the edges of the text.
EDGE = re.compile(r"\s*(?:©|\(c\)\s|copyright\b|all rights reserved\b)", re.I)


def _is_hidden(rest: str) -> bool:
    for found in ATTRIBUTE.finditer(rest):
        name, value = found[1].lower(), found[2] or found[3] or found[4] or ""
        if (name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true"
                or name == "style" and NOT_SHOWN.search(value)):
            return True
    return False


def _side_words(rest: str, in_main: bool) -> tuple[bool, bool]:
    """Whether the element's names make it a side element, and whether they do so beyond doubt: by a word that stands alone
    or is no ``LAYOUT`` word. The header of an article is none."""
    side = firm = False
    for names in NAMED.finditer(rest):
        for name in (names[1] or names[2] or names[3] or "").lower().split():
            words = [x for x in re.split(r"[^a-z]+", name) if x]
            if words and words[0] not in STATES:
                hits = SIDE_NAMES.intersection(words)
                if in_main or not ARTICLES.isdisjoint(words):
                    hits -= {"header"}
                side = side or bool(hits)
                firm = firm or bool(hits) and (len(words) == 1 or not hits <= LAYOUT)
    return side, firm


class _Side:
    """An open side element: depth of its own name and of the closing elements where it began, the side around it, and
    what it holds. ``fixed``: it stays one whatever it holds; ``firm``: only the headline makes it a wrapper."""

    def __init__(self, name: str, firm: bool, fixed: bool, depth: dict[str, int], outer: int):
        self.name, self.firm, self.fixed, self.outer = name, firm, fixed, outer
        self.depth, self.marks = depth[name], [depth.get(c, 0) for c in CLOSERS]
        self.weight, self.headline = 0, False


class _Page:
    """Lines of one page: text, weight, number of the outermost main element (0: none), kind of its block element, and the
    innermost side that holds it (-1: none). Sides are numbered as they open, so an outer one has the smaller number."""

    def __init__(self):
        self.lines: list[tuple[str, int, int, str, int]] = []
        self.sides: list[_Side] = []
        self.open: list[int] = []
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.main = self.mains = self.main_depth = 0
        self.kind = ""
        self.depth: dict[str, int] = {}
        self.places: dict[str, list[int]] = {}  # of open sides by name; may hold some that have ended

    def end(self) -> None:
        if self.parts:
            text = " ".join(html_module.unescape("".join(self.parts)).split())
            linked = " ".join(html_module.unescape("".join(self.linked)).split())
            side = self.open[-1] if self.open else -1
            if text and (side < 0 or not self.sides[side].fixed):
                self.lines.append((text, 0 if 2 * len(linked) > len(text) else len(text), self.main, self.kind, side))
            self.parts, self.linked = [], []

    def in_fixed(self) -> bool:
        return bool(self.open) and self.sides[self.open[-1]].fixed

    def cut_sides(self, place: int) -> None:
        """Ends the open sides from the given place of the stack on."""
        if place < len(self.open):
            self.end()
            del self.open[place:]

    def open_side(self, name: str, firm: bool, fixed: bool) -> None:
        self.end()
        self.places.setdefault(name, []).append(len(self.open))
        self.sides.append(_Side(name, firm, fixed, self.depth, self.open[-1] if self.open else -1))
        self.open.append(len(self.sides) - 1)

    def close_sides(self, name: str) -> None:
        """Sides that end with the closing tag ``name``, and those inside them."""
        at = self.depth.get(name, 0)
        if name in CLOSERS:
            rank, place = CLOSERS.index(name), len(self.open)
            while place and self.sides[self.open[place - 1]].marks[rank] >= at:
                place -= 1
            self.cut_sides(place)
            return
        own = self.places.get(name, [])
        while own and (own[-1] >= len(self.open) or self.sides[self.open[own[-1]]].name != name):
            own.pop()  # ended with a side around it
        if own and self.sides[self.open[own[-1]]].depth >= at:
            self.cut_sides(own.pop())

    def mark_headline(self, name: str) -> None:
        """Called at the page's first ``h1``, ``main`` and ``article``; comments may be articles of their own."""
        for number in self.open:
            side = self.sides[number]
            side.headline = side.headline or name != "article" or not side.firm


def lines_of(page: str) -> list[tuple[str, int, int, str]]:
    """(text, weight, main element, kind) of the lines outside side elements."""
    out = _Page()
    in_link, at, seen = False, 0, set()
    for t in TOKEN.finditer(page):
        if t.start() > at:
            text = page[at:t.start()]
            out.parts.append(text)
            if in_link:
                out.linked.append(text)
        at = t.end()
        if t["name"] is None:
            continue
        name, closing, rest = t["name"].lower(), bool(t["close"]), t["rest"]
        if name == "a":
            in_link = not closing
        if name in BLOCKS:
            out.end()
            if name != "br":
                out.kind = "" if closing else name
        if name in VOID or rest.endswith("/"):
            continue
        if closing:
            out.close_sides(name)
            out.depth[name] = max(0, out.depth.get(name, 0) - 1)
        else:
            if name in BLOCKS and out.open and out.sides[out.open[-1]].name == "p":
                out.cut_sides(len(out.open) - 1)
            out.depth[name] = out.depth.get(name, 0) + 1
            if not out.in_fixed() and name not in CLOSERS:
                fixed = name in OUTSIDE or name == "header" and not out.main or _is_hidden(rest)
                side, firm = (True, True) if name == "form" else _side_words(rest, bool(out.main)) if rest else (False, False)
                if fixed or side:
                    out.open_side(name, firm, fixed)
        if out.in_fixed():
            continue
        if name in MAIN:
            out.main_depth = max(0, out.main_depth + (-1 if closing else 1))
            if out.main_depth == 1 and not closing:
                out.mains += 1
                out.main = out.mains
            elif out.main_depth == 0:
                out.main = 0
        if not closing and name not in seen and (name in MAIN or name == "h1"):
            seen.add(name)
            out.mark_headline(name)
    out.parts.append(page[at:])
    out.end()
    return _outside(out)


def _outside(page: _Page) -> list[tuple[str, int, int, str]]:
    """Lines that no side holds, once the wrappers among the sides are known."""
    total = 0
    for _, weight, _, _, side in page.lines:
        total += weight
        if side >= 0:
            page.sides[side].weight += weight
    for side in reversed(page.sides):
        if side.outer >= 0:
            page.sides[side.outer].weight += side.weight
    gone: list[bool] = []
    for side in page.sides:
        most = 2 * side.weight > total and (side.headline or 10 * side.weight >= 9 * total and not side.firm)
        gone.append(side.fixed or not most or side.outer >= 0 and gone[side.outer])
    return [line[:4] for line in page.lines if line[4] < 0 or not gone[line[4]]]


def _is_text(line: tuple[str, int, int, str]) -> bool:
    return line[1] > 0 or line[3] in TEXTUAL


def _marked(lines: list[tuple[str, int, int, str]]) -> list[str]:
    by_main: dict[int, int] = {}
    paragraphs: set[int] = set()
    for _, weight, main, kind in lines:
        by_main[main] = by_main.get(main, 0) + weight
        if weight and kind == "p":
            paragraphs.add(main)
    marked = {m: w for m, w in by_main.items() if m and w}
    if not marked:
        return []
    best = max(marked, key=lambda m: (marked[m], -m))
    kept = {m for m, w in marked.items() if m == best or m in paragraphs and SIBLING * w >= marked[best]}
    return [line[0] for line in lines if line[2] in kept and _is_text(line)]


def _stretch(sums: list[int], at: int, step: int) -> int:
    """The last place of the text from the peak ``at`` on in one direction."""
    peak = sums[at]
    while 0 <= at + step < len(sums):
        if not sums[at + step]:
            behind = range(at + 2 * step, at + (2 + WINDOW) * step, step)
            found = [sums[i] for i in behind if 0 <= i < len(sums)]
            if not found or not found[0] or SURGE * max(found) < peak:
                break
        at += step
    return at


def main_text(page: str | None) -> str:
    """The page's main text; null, empty and text-free pages give the empty string. Of equal articles and windows the
    first is the heaviest."""
    lines = lines_of(page or "")
    marked = _marked(lines)
    if marked:
        return " ".join(marked)
    sums = [sum(line[1] for line in lines[i:i + WINDOW]) for i in range(len(lines))]
    if not any(sums):
        return ""
    peak = max(range(len(sums)), key=lambda i: (sums[i], -i))
    inside = range(_stretch(sums, peak, -1), min(len(lines), _stretch(sums, peak, 1) + WINDOW))
    heavy = [i for i in inside if lines[i][1]]
    first, last = heavy[0], heavy[-1]
    while first > inside[0] and lines[first - 1][3] in HEADINGS:  # a headline that is a link
        first -= 1
    kept = [line[0] for line in lines[first:last + 1] if _is_text(line)]
    while kept and EDGE.match(kept[-1]):
        kept.pop()
    while kept and EDGE.match(kept[0]):
        kept.pop(0)
    return " ".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array([main_text(x.as_py()) for x in batch.column(2)],
                                                                          pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html); repeated rows stay, other columns
    are ignored, no rows give no rows."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.col("html").alias("html"))
    found = rows.mapInArrow(_extract, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
