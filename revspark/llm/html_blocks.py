"""Main text of web pages by the distribution of text over lines.

The markup is stripped to lines of text, one for each block element; each line weighs its characters outside links, and
lines of page furniture (menus, headers, footers, side columns, notices, adverts, forms, comments of readers) weigh
nothing and are left out. Weights are summed over windows of `WINDOW` lines that slide down the page. The main text
surges where a window's sum passes `SURGE` and no text run is open, and dives at the next line from which the windows
weigh nothing; the text between surge and dive is kept. Where the page marks its article, the marks settle the surge
and dive points. On other pages the heaviest run, with those at least a third as heavy, tells which element holds the article:
every block of that element is kept, links and short lines too. If that is the page itself, its own paragraphs and
headings are kept, and what stands between the first surge and the last dive.

A class or id that names furniture, and a form, may also name a wrapper of the whole article. How much text an element holds
does not tell. It is a wrapper if it holds a first-level heading and prose, or if nothing beside it surges: then, and only then,
of such elements the one with the most prose is opened, and what is inside is judged anew. An article resets marks
around it, but not those of comments and related pieces.

Defined cases: null and empty pages, and pages without text, give an empty text; broken markup (tags never closed,
a page cut off inside a tag, script or comment) is read as browsers do, to the end; repeated rows and ids give a row
each; other columns of the input are not read.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revspark.llm.common import struct_array, texts

WINDOW = 3
SURGE = 80
JOIN_SHARE = 1 / 3

#: FIXED VALUES: element names.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "title")
FURNITURE = {"nav", "header", "footer", "aside", "menu", "dialog", "button", "select", "head"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt",
          "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr",
          "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td",
          "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that a new block ends if they are open: a paragraph by any block, items by their like.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}}
#: Blocks that hold a line of text; the others group blocks.
LINES = HEADINGS | {"address", "blockquote", "dd", "dl", "dt", "figcaption", "figure", "li", "ol", "p", "pre", "table", "tbody", "td", "tfoot",
                    "th", "thead", "tr", "ul"}
PAGE = {"", "html", "body"}
#: Words of class, id and role that mark page furniture.
FURNITURE_WORDS = {"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment",
                   "commentlist", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "menu", "modal", "nav",
                   "navbar", "navigation", "newsletter", "notice", "paywall", "popup", "promo", "promoted", "related",
                   "replies", "reply", "respond", "share", "sharing", "sidebar", "skip", "social", "sponsor", "sponsored",
                   "subscribe", "subscription", "teaser", "toolbar", "topbar", "widget", "complementary", "contentinfo",
                   "search", "alert", "alertdialog"}
#: Of these, words of what stands below an article; articles inside are readers' comments or teasers of other pages.
BELOW_WORDS = {"comment", "commentlist", "comments", "disqus", "related", "replies", "reply", "respond"}
#: Words after which a name says that the page has, or has not, such an element: `has-sidebar`.
SAYS_WORDS = {"has", "no", "with", "without"}

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)(?=[\s/>])[^>]*(?:>|\Z)|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(?P<close2>/)?(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)", re.S | re.I)
_MARK = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SPACE = re.compile(r"\s+")


def named(value: str) -> set[str]:
    """Words of a class, id or role, without those that follow one of SAYS_WORDS in the same name."""
    words: set[str] = set()
    for name in value.split():
        for w in _WORD.findall(name):
            if w.lower() in SAYS_WORDS:
                break
            words.add(w.lower())
    return words


#: Kinds of marks: hidden whatever it holds, furniture, what stands below an article.
HIDDEN, BESIDE, BELOW = range(3)


def mark_of(attrs: str, own: frozenset[str] = frozenset()) -> int | None:
    """The kind of mark of an element whose attributes hide it or name it as furniture; `own` are words that do not count."""
    words: set[str] = set()
    for m in _MARK.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return HIDDEN
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return HIDDEN
        if name in ("class", "id", "role"):
            words |= FURNITURE_WORDS & named(value) - own
    if not words:
        return None
    return BELOW if words & BELOW_WORDS else BESIDE


class _Marks:
    """A forest of marked elements: what is inside each, and whether it is furniture. Mark 0 is no mark."""

    def __init__(self):
        self.up, self.kind, self.prose, self.linked, self.title = [0], [HIDDEN], [0], [0], [False]

    def add(self, up: int, kind: int) -> int:
        self.up.append(up)
        self.kind.append(kind)
        self.prose.append(0)
        self.linked.append(0)
        self.title.append(False)
        return len(self.up) - 1

    def sum_up(self) -> None:
        for k in range(len(self.up) - 1, 0, -1):  # what is inside comes after
            self.prose[self.up[k]] += self.prose[k]
            self.linked[self.up[k]] += self.linked[k]
            self.title[self.up[k]] |= self.title[k]

    def holds_prose(self, k: int) -> bool:
        return self.kind[k] != HIDDEN and self.prose[k] > SURGE and self.prose[k] >= self.linked[k]

    def opened(self) -> set[int]:
        """Wrappers known by themselves: a title and prose."""
        return {k for k in range(1, len(self.up)) if self.title[k] and self.holds_prose(k)}

    def furniture(self, opened: set[int]) -> list[bool]:
        out = [False]
        for k in range(1, len(self.up)):
            out.append(out[self.up[k]] or k not in opened)
        return out


_OWN = frozenset({"header"})


class _Open:
    __slots__ = ("name", "mark", "below", "hard", "article", "link", "up")

    def __init__(self, name: str, mark: int, below: int, hard: bool, article: bool, link: bool, up: "_Open | None"):
        # hard: furniture by an element's name, not just by a class that a wrapper of the article may have too
        self.name, self.mark, self.below, self.hard, self.article, self.link, self.up = name, mark, below, hard, article, link, up

    def first(self, names: set[str], inside: bool) -> "_Open":
        """The nearest element, this one or around it, that is (or is not) one of `names`; else the page."""
        x = self
        while x.up is not None and (x.name in names) != inside:
            x = x.up
        return x

    def group(self) -> "_Open":
        """The nearest element that groups blocks."""
        x = self.first(BLOCKS, True)
        while x.up is not None and (x.name not in BLOCKS or x.name in LINES):
            x = x.up
        return x


def lines_of(page: str) -> list[tuple[str, int, bool, bool, _Open]]:
    """(text, characters in links, in an article, in page furniture, innermost element) of every line of text of the page."""
    lines: list[tuple[str, int, _Open]] = []
    marks, belows = _Marks(), _Marks()
    parts: list[str] = []
    linked = [0]
    stack = [_Open("", 0, 0, False, False, False, None)]

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                lines.append((text, min(len(text), linked[0]), stack[-1]))
            parts.clear()
        linked[0] = 0

    def close_to(k: int) -> None:
        if any(x.name in BLOCKS for x in stack[k:]):
            flush()
        del stack[k:]

    for m in _TOKEN.finditer(page):
        if m["text"] is not None:
            parts.append(m["text"])
            linked[0] += len(m["text"]) * stack[-1].link
            continue
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            parts.append("" if m["raw"] is None else " ")
            continue
        if m["close"] or m["close2"]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), 0)
            if k and not (name not in BLOCKS and any(x.name in BLOCKS for x in stack[k + 1:])):
                close_to(k)
            elif name in BLOCKS:
                flush()
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
            for k in range(len(stack) - 1, 0, -1):
                x = stack[k].name
                if x == "p" or x in ENDED_BY.get(name, ()):
                    del stack[k:]
                    break
                if x in BLOCKS:
                    break
        if name in VOID:
            continue
        top = stack[-1]
        attrs = m["attrs"] or m["attrs2"] or ""
        main = name in ("article", "main")
        # a header inside an article is the article's own
        hard = top.hard or name in FURNITURE and not (name == "header" and top.article)
        mark, below = 0 if main else top.mark, top.below
        found = None
        if attrs and name not in HEADINGS and name not in ("html", "body", "main"):
            found = mark_of(attrs, _OWN if top.article else frozenset())
        if main and found != BELOW:
            found = None  # an article itself is furniture only as a comment or a related piece
        if name == "form" and found is None:
            found = BESIDE
        if found == BELOW:
            below = belows.add(below, found)
        elif found is not None:
            mark = marks.add(mark, found)
        if not attrs.rstrip().endswith("/") or name in BLOCKS:
            if (mark, below, hard) != (top.mark, top.below, top.hard):
                flush()
            stack.append(_Open(name, mark, below, hard, (top.article or main) and not hard, top.link or name == "a", top))
    flush()
    for text, a, x in lines:
        head = x.first(HEADINGS, True).name
        for forest, k in ((marks, x.mark), (belows, x.below)):
            forest.prose[k] += 0 if x.hard or head else len(text) - a
            forest.linked[k] += 0 if x.hard else a
            forest.title[k] |= head == "h1" and not x.hard
    marks.sum_up()
    belows.sum_up()
    open_marks, open_belows = marks.opened(), belows.opened()
    while True:
        out, out_below = marks.furniture(open_marks), belows.furniture(open_belows)
        away = [x.hard or out[x.mark] or out_below[x.below] for _, _, x in lines]
        weights = np.array([len(t) - a for (t, a, _), gone in zip(lines, away, strict=True) if not gone], dtype=np.float64)
        if len(weights) and (np.convolve(weights, np.ones(WINDOW)) > SURGE).any():
            break
        # nothing surges: open the outermost mark with the most prose, pieces that stand below an article last
        shut = [(forest is belows, -forest.prose[k], k, own) for forest, own, gone in ((marks, open_marks, out), (belows, open_belows, out_below))
                for k in range(1, len(forest.up)) if gone[k] and not gone[forest.up[k]] and forest.holds_prose(k)]
        if not shut or any(x.article and not gone for (_, _, x), gone in zip(lines, away, strict=True)):
            break
        _, _, k, own = min(shut, key=lambda c: c[:3])
        own.add(k)
    return [(text, a, x.article, gone, x) for (text, a, x), gone in zip(lines, away, strict=True)]


def surge_and_dive(weights: np.ndarray, marked: np.ndarray) -> list[tuple[int, int]]:
    """Runs of lines [surge, dive) that hold the main text."""
    n = len(weights)
    if marked.any():
        # inside a marked article every line passes the threshold, outside of it none does
        weights = np.where(marked, weights + SURGE + 1, 0)
    sums = np.convolve(weights, np.ones(WINDOW))[WINDOW - 1:]  # over the lines k .. k + WINDOW - 1
    runs, k = [], 0
    while k < n:
        if sums[k] <= SURGE or not weights[k]:
            k += 1
            continue
        dive = k
        while dive < n and sums[dive] > 0:
            dive += 1
        runs.append((k, dive))
        k = dive
    if marked.any() or len(runs) < 2:
        return runs
    mass = [weights[a:b].sum() for a, b in runs]
    return [r for r, m in zip(runs, mass, strict=True) if m >= JOIN_SHARE * max(mass)]


def _held(groups: list[_Open], weights: np.ndarray, runs: list[tuple[int, int]]) -> _Open:
    """The innermost element around the lines that carry the runs: those that surge alone, or else by WINDOW of their like."""
    lines = [k for a, b in runs for k in range(a, b)]
    carry = next(own for own in ([k for k in lines if weights[k] > least] for least in (SURGE, SURGE / WINDOW, 0)) if own)
    around: list[_Open] | None = None
    for x in {id(groups[k]): groups[k] for k in carry}.values():
        path = []
        while x is not None:
            path.append(x)
            x = x.up
        path.reverse()
        around = path if around is None else [a for a, b in zip(around, path) if a is b]
    return around[-1]


def _inside(x: _Open, element: _Open) -> bool:
    while x is not None and x is not element:
        x = x.up
    return x is element


def main_text(page: str) -> str:
    kept = [(t, a, c, x) for t, a, c, out, x in lines_of(page) if not out]
    if not kept:
        return ""
    marked = np.array([c for _, _, c, _ in kept])
    weights = np.array([len(t) - a for t, a, _, _ in kept], dtype=np.float64)
    weights = np.where(marked, np.maximum(weights, 1), weights)
    runs = surge_and_dive(weights, marked)
    if not runs:  # a page of a few short lines: it never surges, and its lines outside links are all there is
        return "\n\n".join(t for t, a, _, _ in kept if len(t) > 2 * a)
    if marked.any():
        return "\n\n".join(t for a, b in runs for t, _, c, _ in kept[a:b] if c)
    groups = [x.group() for _, _, _, x in kept]
    body = _held(groups, weights, runs)
    if body.name in PAGE:
        first, last = runs[0][0], runs[-1][1]
        chosen = [x.name in PAGE or first <= k < last and weights[k] > 0 for k, x in enumerate(groups)]
    else:
        chosen = [_inside(x, body) for x in groups]
    return "\n\n".join(t for (t, _, _, _), own in zip(kept, chosen, strict=True) if own)


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
def _extract(page: pa.Array) -> pa.Array:
    got = [main_text(t.decode()) for t in texts(page)]
    return struct_array([("text", pa.string(), got), ("n_chars", pa.int64(), [len(t) for t in got])])


def extract_text(pages: DataFrame) -> DataFrame:
    """Per row of `pages`: page_id, url, text (empty if there is none), n_chars (its code points)."""
    return pages.select("page_id", "url", _extract("html").alias("x")).select("page_id", "url", "x.*")
