"""Main-text extraction by tag-path ratios.

What a page itself sets beside its text by element, role or an unmistakable name (nav, footer, aside, header, dialog, comments,
cookie banner, ...) is out, however long it is, as are head, forms and hidden elements. The other blocks are grouped by their
root-to-leaf path of block elements. For each path the text length and the punctuation per node are aggregated, smoothed over
the paths' order in the page, damped by the share of links, fused to one score and compared with a threshold: paths that reach
it hold content nodes. Where these nodes gather is the trunk, and all its blocks are the main text, short ones too, but for
paths of links, and paths under a doubtful name whose own score is low. article, main and telling names decide between trunks
only where the ratios leave the choice open. Of a header inside an article its headings stay, the rest (a byline, a date) goes.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_TAG = re.compile(r"</?([a-zA-Z][\w:-]*)")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_PUNCT = re.compile(r"[.,;:!?…。，、؟]")

# fixed values: element names of HTML by what they do, and words that class names use
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption"
    " address hr header footer nav aside form fieldset details summary center dialog menu hgroup search head legend".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLEANED = frozenset("head form button fieldset datalist label input legend svg select".split())
#: Elements whose content is no markup; without an end tag the first ones take the rest of the page, the others nothing.
CODE = frozenset("script style".split())
RAW = CODE | frozenset("noscript template textarea iframe title".split())
#: Elements that end where a block begins, whether closed or not.
INLINE = frozenset("svg select".split())
BESIDE = frozenset("nav footer aside dialog menu search".split())
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer"
    " cookie cookies consent gdpr notice notices banner popup modal overlay newsletter subscribe signup login comment comments commentlist disqus respond reply"
    " replies share sharing social related recommended widget pagination pager toolbar skip masthead topbar search".split()
)
#: Of those the ones that tell enough as a whole class name, whatever other classes an element has.
SURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsored navbar breadcrumb breadcrumbs sidebar cookie cookies gdpr newsletter comment comments"
    " commentlist disqus pager pagination toolbar".split()
)
#: Words that say nothing about what an element holds.
FILLERS = frozenset(
    "a area bar block body bottom box btn col column container cont element el group header heading head holder inner item items left link links list"
    " medium module new old outer panel right row section single slot small text thread title top unit user view wide wrap wrapper".split()
)
GOOD_NAMES = frozenset("content article post entry story articlebody maincontent".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
SCOPES = frozenset("ul ol dl table".split())
#: Elements that can be the trunk.
CONTAINERS = frozenset("html body main article section div center table thead tbody tr td".split())
#: Share of the content's weight with which a trunk is looked for further inside, and with which an element that is marked as content is the trunk.
GATHERED, MARKED, NESTED = 0.9, 0.25, 0.75
LINKED = 0.5
#: What becomes of an element's own text.
SHOWN, HEADER, OUT, CLEAN = range(4)


def _named(found: dict[str, str]) -> str:
    """'!': the names are those of something beside the main text; '-': they may be; '': neither."""
    tokens = f"{found.get('class', '')} {found.get('id', '')}".split()
    words = {w for t in tokens for w in _WORD.findall(t)}
    if not words & BAD_NAMES:
        return ""
    return "!" if SURE_NAMES & set(tokens) or words <= BAD_NAMES | FILLERS else "-"


def _mark(tag: str, attrs: str) -> str | None:
    """None: cleaned away; '!!' (by element or role) or '!' (by name): beside the main text; '-': perhaps so; '+': main text; '': neither."""
    if tag in CLEANED:
        return None
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTR.finditer(attrs)} if attrs.strip() else {}
    if found and tag not in ("html", "body"):
        if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
            return None
        if found.get("role") in BAD_ROLES:
            return "!!"
        if tag in CONTENT:
            return "!" if SURE_NAMES & set(found.get("class", "").split()) else "+"
        if found.get("role") == "main" or found.get("itemprop") == "articlebody":
            return "+"
        if tag not in BESIDE and tag not in HEADINGS and (named := _named(found)):
            return named
        if tag in ("div", "section") and set(_WORD.findall(found.get("class", "") + " " + found.get("id", ""))) & GOOD_NAMES:
            return "+"
    return "!!" if tag in BESIDE or tag == "header" else "+" if tag in CONTENT else ""


class Tags:
    """Tags of a page in order, found in time linear in its length."""

    def __init__(self, page: str):
        self.page = page
        self.quoted = True  # until a tag's quotes turn out not to close; from there on quotes mean nothing
        self.unclosed: set[str] = set()

    def _end(self, at: int) -> int:
        """Where the tag that begins at `at` ends, or -1."""
        k = at
        while self.quoted:
            m = _STOP.search(self.page, k)
            if m and m[0] == ">":
                return m.end()
            k = self.page.find(m[0], m.end()) + 1 if m else 0
            if not k:
                self.quoted = False
        return self.page.find(">", at) + 1 or -1

    def _after(self, name: str, at: int) -> int:
        """Where an element without markup inside ends, if it begins before `at`."""
        if name not in self.unclosed:
            if m := re.compile(rf"</{name}\s*>", re.I).search(self.page, at):
                return m.end()
            self.unclosed.add(name)
        return len(self.page) if name in CODE else at

    def __iter__(self):
        """(text before the tag, name, '/' for an end tag, attributes); the last one has no name."""
        page, at = self.page, 0
        text = 0  # begin of the text before the next tag
        while (at := page.find("<", at)) >= 0:
            after = page[at + 1 : at + 2]
            name = ""
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4) + 3
                end = end if end > 2 else len(page)
            elif after in ("!", "?") and after:
                end = self._end(at)
            elif m := _TAG.match(page, at):
                name, end = m[1].lower(), self._end(m.end())
            else:
                at += 1
                continue
            if end < 0:  # no '>' any more: what is left is text
                break
            before = page[text:at]
            if name in RAW and after != "/":
                end, name = self._after(name, end), ""
            yield before, name, "/" if after == "/" else "", page[m.end() : end - 1] if name else ""
            at = text = end
        yield page[text:], None, "", ""


class Page:
    """A page's elements as a tree, their paths as another, and the blocks of text."""

    def __init__(self, page: str, names: bool = True):
        """names: whether a name alone can set an element beside the main text (else it only makes it doubtful)."""
        # of each element that was opened: the one around it, its tag and whether it is marked as content, or is in such a one
        self.around, self.tag, self.content, self.within = [0], [""], [False], [False]
        # of each path: whether a doubtful name is in it
        self.doubtful = [False]
        self.known: dict[tuple[int, str, bool], int] = {}
        #: path, element, text, characters inside links; in page order
        self.blocks: list[tuple[int, int, str, int]] = []
        self.left_out = False  # by names
        self._read(page, names)

    def _path(self, above: int, tag: str, doubtful: bool) -> int:
        key = (above, tag, doubtful)
        if key not in self.known:
            self.known[key] = len(self.doubtful)
            self.doubtful.append(self.doubtful[above] or doubtful)
        return self.known[key]

    def _read(self, page: str, names: bool):
        # of each open block element: tag, path, element, what becomes of its text, the place in the stack of the next one below that is no heading (or itself)
        stack: list[tuple[str, int, int, int, int]] = [("", 0, 0, SHOWN, 0)]
        open_: Counter = Counter()
        parts: list[str] = []
        link, linked = 0, 0

        def flush():
            nonlocal linked
            if parts:
                text = _SPACE.sub(" ", "".join(parts)).strip()
                parts.clear()
                _, path, element, fate, _ = stack[-1]
                if text and fate == SHOWN:
                    self.blocks.append((path, element, text, min(linked, len(text))))
            linked = 0

        def cut(k: int):
            for tag, *_ in stack[k:]:
                open_[tag] -= 1
            del stack[k:]

        def push(tag: str, attrs: str):
            _, above, around, fate, base = stack[-1]
            mark = _mark(tag, attrs)
            if mark == "!" and not names:
                mark = "-"
            if mark is None or fate == CLEAN:
                fate = CLEAN
            elif tag == "header" and mark == "!!" and fate == SHOWN and self.within[around]:
                fate = HEADER
            elif mark in ("!", "!!"):
                self.left_out |= mark == "!"
                fate = OUT
            elif (fate == HEADER and tag in HEADINGS) or (fate == OUT and tag == "main"):
                fate = SHOWN
            self.around.append(around)
            self.tag.append(tag)
            self.content.append(mark == "+" and fate == SHOWN)
            self.within.append(self.content[-1] or self.within[around])
            stack.append((tag, self._path(above, tag, mark == "-"), len(self.tag) - 1, fate, base if tag in HEADINGS else len(stack)))
            open_[tag] += 1

        for text, tag, end, attrs in Tags(page):
            if text and stack[-1][3] == SHOWN:
                parts.append(html.unescape(text))
                if link:
                    linked += len(text)
            if not tag:
                continue
            if end:
                if tag in BLOCK:
                    flush()
                    if open_[tag]:
                        k = len(stack) - 1
                        while stack[k][0] != tag:
                            k -= 1
                        cut(k)
                elif tag == "a":
                    link = 0
                elif tag in CLEANED and stack[-1][0] == tag:
                    cut(len(stack) - 1)
            elif tag == "br":
                parts.append(" ")
            elif tag == "a":
                link = 1
            elif tag in BLOCK or tag in CLEANED:
                flush()
                if tag in BLOCK:
                    while stack[-1][0] in INLINE:
                        cut(len(stack) - 1)
                    closed = ("p", *CLOSES.get(tag, "").split())
                    while any(open_[c] for c in closed) and stack[k := stack[-1][4]][0] in closed:
                        cut(k)
                if tag != "hr":
                    push(tag, attrs)
        flush()


def path_scores(blocks: list[tuple[int, int, str, int]]) -> dict[int, float]:
    """Score of each path: text and punctuation per node, smoothed along the page, damped by links."""
    order: dict[int, int] = {}
    for path, *_ in blocks:
        order.setdefault(path, len(order))
    n = len(order)
    length, punct, nodes, linked = (np.zeros(n) for _ in range(4))
    for path, _, text, link in blocks:
        i = order[path]
        length[i] += len(text)
        punct[i] += len(_PUNCT.findall(text))
        nodes[i] += 1
        linked[i] += link

    def smooth(x):
        if n < 3:
            return x
        edge = np.concatenate([x[:1], x, x[-1:]])
        return 0.2 * edge[:-2] + 0.6 * edge[1:-1] + 0.2 * edge[2:]

    text_ratio, punct_ratio = smooth(length / nodes), smooth(punct / nodes)
    fused = text_ratio * (1 + punct_ratio) * (1 - linked / np.maximum(length, 1)) ** 2
    # a path of many nodes is the trunk of the page, one of few a twig
    return dict(zip(order, np.sqrt(fused * np.log1p(length)).tolist(), strict=True))


def trunks(page: Page, score: dict[int, float], chosen: set[int]) -> set[int]:
    """The elements in which content nodes (blocks on chosen paths, weighed by score and length) gather."""
    n = len(page.tag)
    weight = [0.0] * n
    for path, element, text, _ in page.blocks:
        if path in chosen:
            weight[element] += score[path] * len(text)
    outer, inner = [0] * n, [0] * n  # the heaviest child that can be a trunk; the heaviest element below that is marked as content
    for e in range(n - 1, 0, -1):  # children come after what is around them
        up = page.around[e]
        weight[up] += weight[e]
        if page.tag[e] in CONTAINERS and (not outer[up] or weight[e] >= weight[outer[up]]):
            outer[up] = e
        best = e if page.content[e] else inner[e]
        if best and (not inner[up] or weight[best] >= weight[inner[up]]):
            inner[up] = best
    heaviest = inner[0]
    if heaviest and weight[heaviest] >= MARKED * weight[0]:
        while (deeper := inner[heaviest]) and weight[deeper] >= NESTED * weight[heaviest]:
            heaviest = deeper
        over, up = set(), heaviest
        while up := page.around[up]:
            over.add(up)
        found, inside = {heaviest}, [False] * n
        for e in range(1, n):  # others that hold much of the content too, as parts of one article do
            if not inside[page.around[e]] and e not in over and page.content[e] and weight[e] * 3 >= weight[heaviest]:
                found.add(e)
            inside[e] = e in found or inside[page.around[e]]
        return found
    e = 0
    while weight[0] and outer[e] and weight[outer[e]] >= GATHERED * weight[0]:
        e = outer[e]
    return {e}


def main_text(page: str | None, threshold: float = 0.35) -> str:
    """The main text of one page; '' for a null or empty page or one without any. Takes time in proportion to the page's length.

    An element that isn't closed loses no text (but what follows an unclosed script, style or comment is part of it). If names set
    all text of a page aside, they are only held against it.
    """
    if not page:
        return ""
    read = Page(page)
    if not read.blocks and read.left_out:
        read = Page(page, names=False)
    if not read.blocks:
        return ""
    score = path_scores(read.blocks)
    best = max(score.values())
    chosen = {p for p, s in score.items() if s >= threshold * best}
    found = trunks(read, score, chosen)
    inside = [False] * len(read.tag)
    for e in range(len(inside)):
        inside[e] = e in found or (e > 0 and inside[read.around[e]])
    length, linked = Counter(), Counter()
    for path, _, text, link in read.blocks:
        length[path] += len(text)
        linked[path] += link

    def kept(path: int, element: int) -> bool:
        if not inside[element] or (read.doubtful[path] and score[path] < threshold / 2 * best):
            return False
        return path in chosen or read.tag[element] in HEADINGS or linked[path] <= LINKED * length[path]

    out = [(e, text) for path, e, text, _ in read.blocks if kept(path, e)]
    if not any(read.tag[e] in HEADINGS for e, _ in out):  # a headline right above the trunk
        over, first = set(), min(found)
        up = first
        while up:
            up = read.around[up]
            over.add(up)
        above = [(e, text) for _, e, text, _ in read.blocks if read.tag[e] == "h1" and e < first and read.around[e] in over]
        out = above[-1:] + out
    return "\n".join(text for _, text in out)


def extract(pages: DataFrame, markup: str = "html", into: str = "text", threshold: float = 0.35) -> DataFrame:
    """Adds the main text of every page as `into` (a column of that name is replaced). Null or empty pages give ''; very long ones are taken whole.

    Rows and other columns stay, repeated rows too.
    """

    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py(), threshold) for x in rows], pa.string())

    return pages.withColumn(into, run(F.coalesce(F.col(markup), F.lit(""))))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text").withColumn("n_chars", F.length("text").cast("long"))
