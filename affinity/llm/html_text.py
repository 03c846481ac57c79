"""Operator 6: main text of web pages by tag-path ratios.

A page is scanned into blocks of text, each under a root-to-leaf tag path (tag
names with their class and id). For every path the text outside links, the
punctuation and the number of blocks are added up; the ratios per block, on a
log scale, are a path's own evidence. A path's evidence is smoothed with that
of its parent container, so a short heading among long paragraphs is carried
by them, and fused with what the markup itself says: elements, roles and class
names of menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments count nothing. Class and id words alone never drop an element that holds most of the
page's text outside links, or that is or holds an `article` or `main` (the
latter not for words of comments and related pages). Paths above half of the page's best evidence are kept, with all of their
blocks, and so are blocks that are mostly no links and lie in the container of
the best path (below `body`) or between kept blocks of one container. Where a
page has an `article` or `main` with text, all of that and nothing else is
taken, unless a container outside holds more than twice as much text and a
notice's length besides; then the ratios alone decide.

Blocks are joined in page order by one line feed; white space inside a block,
`<br>` included, becomes one space.

Defined results: null or empty html, and pages without text, give an empty
string; broken markup (open comments, missing end tags) is read to its end;
repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML vocabulary.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg title textarea object canvas audio video annotation".split())
RAW_BLOCKS = frozenset("title textarea".split())       # the others stand in a line of text without ending it
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr "
    # formulas
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd semantics".split())
BOILERPLATE = frozenset("head nav header footer aside form button select fieldset dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar "
                  "toolbar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar rail aside widget widgets footer header masthead topbar cookie "
    "cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe signup login share "
    "sharing social related recommended recommendations comment comments reply replies respond discussion disqus "
    "pagination pager toolbar banner copyright alert warning disclaimer".split())
# Of these, also an element that holds an article is dropped, unless it holds most of the page's text.
ASIDE_WORDS = frozenset("comment comments reply replies respond discussion disqus related recommended recommendations".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# An open element of the first kind is closed by a start tag of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
          "th": {"td", "th", "tr"}, "option": {"option"}}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?。、，；：！？…]")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

PLAIN, DROPPED, CONTENT, HEADER = range(4)


class Element:
    """An open element: what it adds to the path and what it says about the text below it."""

    __slots__ = ("name", "path", "state", "link", "doubts", "outer", "block")

    def __init__(self, name: str, path: int, state: int, link: bool, doubts: tuple[int, ...] = (), outer: tuple[int, ...] = (),
                 block: int = 0):
        self.name, self.path, self.state, self.link = name, path, state, link
        self.block = block                           # where in the stack the nearest block element is, itself included
        self.doubts, self.outer = doubts, outer      # elements of boilerplate words around it; those around its article


def _judge(name: str, attributes: str, parent: int) -> tuple[int, str, set[str]]:
    """What an element is, given its parent, its label in the path, and its words of boilerplate."""
    found = {a.lower(): v.strip("\"'") for a, v in ATTRIBUTE.findall(attributes)} if attributes else {}
    label = f"{name}.{found.get('class', '')}#{found.get('id', '')}" if found else name
    words = {w.lower() for w in PARTS.findall(f"{found.get('class', '')} {found.get('id', '')}")}
    hidden = ("hidden" in found or found.get("aria-hidden") == "true"
              or re.search(r"display\s*:\s*none", found.get("style", ""), re.I))
    heading = name == "header" or words & {"header"}
    if parent == DROPPED or hidden:
        return DROPPED, label, set()
    if heading and parent in (CONTENT, HEADER):      # an article's own header: its headings are its text
        return HEADER, label, set()
    if name in BOILERPLATE or found.get("role", "").lower() in ROLES:
        return DROPPED, label, set()
    doubt = words & WORDS if name not in ("html", "body", "main") else set()
    if parent == HEADER:
        return (CONTENT if name in HEADINGS else HEADER), label, doubt
    return (CONTENT if parent == CONTENT or name in ("article", "main") else PLAIN), label, doubt


def _dropped_span(attributes: str) -> bool:
    state, _, words = _judge("span", attributes, PLAIN)
    return state == DROPPED or bool(words)


def blocks(page: str) -> tuple[list[tuple[int, int, int, str, int]], list[int]]:
    """(path, parent path, state, text, characters in links) of the page's blocks, in order; the parent of each path.

    Class and id words drop an element only if it neither holds an article or main nor most of the text outside links.
    """
    paths: dict[tuple[int, str], int] = {}
    parent_of = [0]
    stack = [Element("", 0, PLAIN, False)]
    out: list[tuple[int, int, int, str, int]] = []
    doubted: list[tuple[int, ...]] = []               # of each block
    words_of: list[set[str]] = []                     # of each doubted element
    holds_article: set[int] = set()
    text: list[str] = []
    links, filled = 0, False                          # filled: the text holds more than white space
    where = stack[0]
    opened: dict[str, int] = defaultdict(int)         # names of the elements of the stack

    def path_of(parent: int, label: str) -> int:
        key = (parent, label)
        if key not in paths:
            paths[key] = len(parent_of)
            parent_of.append(parent)
        return paths[key]

    def end_block() -> None:
        nonlocal text, links, filled
        joined = " ".join("".join(text).split())
        if joined:
            out.append((where.path, parent_of[where.path], where.state, joined, links))
            doubted.append(where.doubts)
            holds_article.update(where.outer)
        text, links, filled = [], 0, False

    def add(raw: str) -> None:
        nonlocal links, where, filled
        top = stack[-1]
        if top.state in (DROPPED, HEADER) or not raw:
            return
        raw = html.unescape(raw)
        if not raw.isspace():
            if not filled:
                where, filled = stack[top.block], True
            if top.link:
                links += len(" ".join(raw.split()))
        text.append(raw)

    def close(depth: int) -> None:
        if any(e.name not in INLINE for e in stack[depth:]):
            end_block()
        for e in stack[depth:]:
            opened[e.name] -= 1
        del stack[depth:]

    def push(element: Element) -> None:
        opened[element.name] += 1
        stack.append(element)

    at, n = 0, len(page)
    while at < n:
        token = TOKEN.search(page, at)
        if token is None:
            add(page[at:])
            break
        add(page[at:token.start()])
        at = token.end()
        name = (token["name"] or "").lower()
        if not name:
            continue
        if token["end"]:
            if not opened[name]:
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    close(depth)
                    break
                if name in INLINE and stack[depth].name not in INLINE:
                    break
            continue
        if name in RAW:
            if not token["attributes"].endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else n
            if name in RAW_BLOCKS:
                end_block()
            continue
        if name in VOID:
            if name == "br":
                text.append(" ")
            elif name not in INLINE:
                end_block()
            continue
        if name not in INLINE:
            end_block()
            nearest = stack[-1].block
            if nearest and (stack[nearest].name == "p" or name in CLOSES.get(stack[nearest].name, ())):
                close(nearest)
        top = stack[-1]
        if name in INLINE:
            hidden = name == "span" and _dropped_span(token["attributes"])
            push(Element(name, top.path, DROPPED if hidden else top.state, top.link or name == "a", top.doubts, top.outer, top.block))
        elif token["attributes"].endswith("/") and name not in ("p", "div", "li"):
            continue
        else:
            state, label, words = _judge(name, token["attributes"], top.state)
            doubts = top.doubts
            if words:
                doubts += (len(words_of),)
                words_of.append(words)
            outer = doubts if name in ("article", "main") and state == CONTENT else top.outer
            push(Element(name, path_of(top.path, label), state, top.link, doubts, outer, len(stack)))
    end_block()
    if words_of:
        held, total = [0] * len(words_of), 0
        for (_, _, _, joined, linked), doubts in zip(out, doubted):
            own = max(len(joined) - linked, 0)
            total += own
            for d in doubts:
                held[d] += own
        dropped = {d for d, words in enumerate(words_of) if 2 * held[d] <= total
                   and (d not in holds_article or words & ASIDE_WORDS)}
        out = [b for b, doubts in zip(out, doubted) if dropped.isdisjoint(doubts)]
    return out, parent_of


def _evidence(length: int, links: int, marks: int, count: int) -> float:
    return math.log1p(max(length - links, 0) / count) + math.log1p(marks / count)


# How many times the text of its article or main a container outside may hold, beyond a notice's length in characters,
# before the ratios alone decide.
ARTICLE_WEIGHT, NOTICE = 2, 300


def _of_article(found: list[tuple[int, int, int, str, int]]) -> bool:
    """Is the text in article and main elements the page's? Not if some container outside holds far more of it (a teaser)."""
    inside, outside = 0, defaultdict(int)
    for _, parent, state, text, links in found:
        if state == CONTENT:
            inside += max(len(text) - links, 0)
        else:
            outside[parent] += max(len(text) - links, 0)
    return any(b[2] == CONTENT for b in found) and ARTICLE_WEIGHT * inside + NOTICE >= max(outside.values(), default=0)


def main_text(page: str | None) -> str:
    """The main text of a page."""
    found, parent_of = blocks(page or "")
    if _of_article(found):
        # all that stands in the article is its text, lists of links too
        return "\n".join(b[3] for b in found if b[2] == CONTENT)
    if not found:
        return ""
    totals: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    for path, parent, _, text, links in found:
        marks = len(PUNCTUATION.findall(text))
        for key in (("path", path), ("container", parent)):
            for k, v in enumerate((len(text), links, marks, 1)):
                totals[key][k] += v
    score = {}
    for path, parent, *_ in found:
        score[path] = (_evidence(*totals["path", path]) + _evidence(*totals["container", parent])) / 2
    best = max(score.values())
    kept = [score[path] > 0.5 * best for path, *_ in found]
    if best > 0:
        kept = _with_short_blocks(found, kept, score, best, parent_of)
    return "\n".join(b[3] for b, k in zip(found, kept) if k)


def _with_short_blocks(found: list[tuple[int, int, int, str, int]], kept: list[bool], score: dict[int, float], best: float,
                       parent_of: list[int]) -> list[bool]:
    """Kept blocks, with those that aren't links inside the best path's container or between kept blocks of one container."""
    reach: dict[int, list[int]] = {}
    for k, (_, parent, *_) in enumerate(found):
        if kept[k]:
            reach.setdefault(parent, [k, k])[1] = k
    between = [0] * (len(found) + 1)
    for first, last in reach.values():
        between[first] += 1
        between[last] -= 1
    containers = {parent for path, parent, *_ in found if score[path] == best and parent_of[parent_of[parent]]}
    out, depth = [], 0
    for k, (path, parent, _, text, links) in enumerate(found):
        depth += between[k]
        inside = depth > 0
        while parent and not inside:
            inside = parent in containers
            parent = parent_of[parent]
        out.append(kept[k] or (inside and 2 * links < len(text)))
    return out


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                   pa.array([len(t) for t in texts], pa.int64())],
                                  ["page_id", "url", "text", "n_chars"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(
        run, f"{kinds}, text string, n_chars long")
