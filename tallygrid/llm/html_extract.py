"""Main text of web pages by tag-path ratios.

A page is read once, tag by tag, with the usual implied end tags. Every text node has a
root-to-leaf tag path. Per path the text length and the punctuation are summed over its nodes
and divided by their number; both ratios are smoothed along the page with a Gaussian, averaged
per path again and fused by multiplication. Paths whose fused ratio reaches a share of the
spread over the page are content paths. The content root is the deepest element that holds
nearly all text of content paths, within the main or article element if one holds most of it; the
result is every block below it (so that short paragraphs and headings come along), and beside it,
as far as that main or article element reaches, the other blocks of content paths and the headings
and paragraphs around it. What is page furniture is left out: menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments. Headings are furniture by no name, and
paragraphs only by that of an advert. What is furniture by a class or id only, but holds most of a
page's text, is taken for a wrapper, and what it wraps is judged anew, however deep.

Character references are decoded, white space within a block becomes one space, blocks are
trimmed and joined by a line feed in page order.

Edge cases: null, empty and textless pages give the empty text; pages cut off anywhere, unclosed
and stray tags are read as browsers do; time and memory are linear in the page; repeated rows get
equal results; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import heapq
import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

#: A comment, declaration or tag. Quotes may hold ">"; an unclosed quote ends with the tag.
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：«»\"“”„'’()–—-]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, up to their end tag.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span "
    "strike strong sub sup time tt u var wbr".split())
#: Starting one of these ends an open paragraph.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section table ul".split())
#: Starting the first ends an open one of the others, unless an element of SCOPE is in between.
ENDS_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
                "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = frozenset("html body article section main aside nav header footer div ul ol dl table td th form blockquote figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROOTS = frozenset("html body main article".split())
#: Elements that hold a text rather than being a part of it.
HOLDERS = frozenset("div td form center".split())

FURNITURE = frozenset("head nav header footer aside form button select option menu dialog svg canvas object audio video datalist".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Class and id words that name page furniture.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar aside footer header masthead comment comments disqus respond replies cookie cookies consent gdpr notice "
    "notices notification popup modal overlay newsletter subscribe subscription signup social share sharing related recommended "
    "recommendations widget toolbar pagination pager login search alert copyright hidden".split())
NOT_OWN = frozenset("has with no without".split())

#: Weights of the two nodes on each side, and the share of the spread that content reaches.
SMOOTH = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
THRESHOLD = 0.5
#: Share of the content paths' text that the content root holds.
HOLDS = 0.9


#: How furniture is known: surely (tag, role, state, reader comments), by the words of a name only, or
#: only hinted at by one of several words, so that its text decides.
SURE, NAMED, HINTED = 3, 2, 1
READER_WORDS = frozenset("comment comments disqus respond replies hidden".split())
#: Words beside those above in the name of a part of a page.
PART_WORDS = frozenset(
    "area author bar block body bottom box button buttons cell col column container content entry form frame group icon inner item items "
    "js left link links list main meta outer panel region right row section side slot text thread title top unit wrap wrapper".split())
#: The only names that make a paragraph furniture.
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored copyright cookie cookies breadcrumb breadcrumbs share social".split())
#: With these a paragraph's name must have no other words.
OFFER_WORDS = ADVERT_WORDS | frozenset("promo promotion notice notices newsletter signup subscribe subscription gdpr consent".split())
#: What is hinted at is furniture unless so much of its text lies on content paths, in text nodes of
#: this share of the others' mean length.
PROSE, LONG = 0.5, 0.4
#: How a line begins that is no part of an article outside of one.
RIGHTS = re.compile(r"\W*(?:©|\(c\)|copyright\b)[^\n]{0,200}\Z", re.I)
#: An element that is furniture by its name only, but holds so many times the text of the rest, is a wrapper.
WRAPPER = 3.0
#: Share of the content paths' text by which a main or article element is taken for the page's.
MOST = 0.5


def named(name: str, key: str, word: str) -> int:
    """Whether one class or id names page furniture."""
    words = [w.lower() for w in NAME_PART.findall(word)]
    if not words or words[0] in NOT_OWN or name in HEADINGS or key == "id" and name in INLINE:
        return 0
    own = [w for w in words if w in FURNITURE_WORDS]
    whole = bool(own) and all(w in FURNITURE_WORDS or w in PART_WORDS or w.isdigit() for w in words)
    if name == "p":
        return NAMED if whole and ADVERT_WORDS.issuperset(own) or OFFER_WORDS.issuperset(words) else 0
    if name == "blockquote":
        return HINTED if own else 0
    if whole and (words[0] in READER_WORDS or words[-1] in READER_WORDS):
        return SURE
    # An id can be made from a heading's words, so all of it must name a part of a page.
    return NAMED if whole else HINTED if key == "class" and (words[0] in FURNITURE_WORDS or words[-1] in FURNITURE_WORDS) else 0


def furniture(name: str, attributes: str, in_article: bool) -> int:
    """Whether an element is page furniture, by its tag, role, state, class and id."""
    if name in ROOTS:
        return 0
    if name in FURNITURE and not (name == "header" and in_article):
        return SURE
    if "=" not in attributes and "hidden" not in attributes:
        return 0
    found = 0
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "role" and value.lower() in FURNITURE_ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return SURE
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return SURE
        if key in ("class", "id"):
            kinds = {named(name, key, one) for one in value.split()}
            if SURE in kinds:
                return SURE
            found = max(found, *kinds, 0)
    return found


class Page:
    """Text nodes of a page with their elements, paths and blocks."""

    def __init__(self, source: str):
        self.name, self.parent, self.path, self.article = ["#root"], [0], [0], [False]
        #: How each element is furniture itself, and whether it is surely, be it by an element around it.
        self.own, self.out = [0], [False]
        self.paths: dict[tuple[int, str], int] = {}
        self.stack = [0]
        #: Places in the stack of the open elements of each name.
        self.open: dict[str, list[int]] = {}
        self.nodes: list[tuple[int, str, int]] = []  # element, text, block
        self.block = 0
        at = 0
        lower = None
        n = len(source)
        while at < n:
            m = MARKUP.search(source, at)
            if not m:
                self.text(source[at:])
                break
            if m.start() > at:
                self.text(source[at:m.start()])
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                self.end(name)
                continue
            if name in RAW:
                lower = source.lower() if lower is None else lower
                if len(lower) != n:  # lower case can be longer, so look for the end tag itself
                    close = re.compile(rf"</{name}", re.I).search(source, at)
                    stop = close.start() if close else -1
                else:
                    stop = lower.find(f"</{name}", at)
                at = n if stop < 0 else stop
                self.stray(name)
                continue
            self.start(name, m[3] or "")

    def stray(self, name: str) -> None:
        if name not in INLINE and name not in ("script", "style", "noscript", "template"):
            self.block += 1

    def text(self, raw: str) -> None:
        element = self.stack[-1]
        if not self.out[element]:
            self.nodes.append((element, html.unescape(raw) if "&" in raw else raw, self.block))

    def nearest(self, names: set[str] | frozenset[str]) -> int:
        return max((places[-1] for name in names if (places := self.open.get(name))), default=0)

    def pop_to(self, names: set[str] | frozenset[str], scope: frozenset[str]) -> None:
        """Close the nearest open element of ``names``, unless ``scope`` is in between."""
        at = self.nearest(names)
        if at and self.nearest(scope - names) < at:
            for element in self.stack[at:]:
                self.open[self.name[element]].pop()
            del self.stack[at:]

    def start(self, name: str, attributes: str) -> None:
        if name not in INLINE:
            self.block += 1
        if name in ENDS_PARAGRAPH and self.open.get("p"):
            self.pop_to({"p"}, SCOPE)
        if name in ENDS_SIBLING:
            for _ in range(3):
                before = len(self.stack)
                self.pop_to(ENDS_SIBLING[name], SCOPE - ENDS_SIBLING[name] - {"div"})
                if len(self.stack) == before:
                    break
        if name in VOID:
            if name == "br":
                self.text(" ")
            return
        above = self.stack[-1]
        key = (self.path[above], name)
        in_article = self.article[above]
        in_header = self.name[above] == "header" and in_article
        self.name.append(name)
        self.parent.append(above)
        self.path.append(self.paths.setdefault(key, len(self.paths) + 1))
        # Of a header inside an article only the headings belong to it.
        own = furniture(name, attributes, in_article)
        if in_header and name not in HEADINGS and name not in INLINE and name not in ("div", "hgroup"):
            own = SURE
        self.own.append(own)
        self.out.append(self.out[above] or own == SURE)
        self.article.append(in_article or name in ("article", "main"))
        self.open.setdefault(name, []).append(len(self.stack))
        self.stack.append(len(self.name) - 1)

    def end(self, name: str) -> None:
        if name not in INLINE:
            self.block += 1
        if name == "br" or not self.open.get(name):
            return
        # An inline end tag does not close the blocks around it.
        self.pop_to({name}, SCOPE if name in INLINE or name == "p" else frozenset())


    def kept(self) -> list[bool]:
        """Whether each element is no furniture and in none. Of the outermost elements that are by
        name, the one with the most text is a wrapper if the rest is little; then those in it
        are outermost."""
        size, region, inside = [0] * len(self.name), list(range(len(self.name))), {}
        for e, t, _ in self.nodes:
            size[e] += len(t) - t.count(" ")
        for e in range(1, len(region)):
            if self.own[e] != NAMED:
                region[e] = region[self.parent[e]]
        direct = [0] * len(size)
        for e in range(len(size) - 1, -1, -1):
            direct[region[e]] += size[e]
        held = list(direct)
        for e in range(len(size) - 1, 0, -1):
            if region[e] == e:
                around = region[self.parent[e]]
                held[around] += held[e]
                inside.setdefault(around, []).append(e)
        wrappers, rest = {0}, direct[0]
        outermost = [(-held[e], e) for e in inside.get(0, ())]
        heapq.heapify(outermost)
        while outermost and -outermost[0][0] > WRAPPER * rest:
            e = heapq.heappop(outermost)[1]
            wrappers.add(e)
            rest += direct[e]
            for inner in inside.get(e, ()):
                heapq.heappush(outermost, (-held[inner], inner))
        keep = [True] * len(size)
        for e in range(1, len(keep)):
            keep[e] = keep[self.parent[e]] and not self.out[e] and region[e] in wrappers
        return keep


    def hinted_away(self, element: list[int], content: np.ndarray, length: np.ndarray) -> list[bool]:
        """Whether each element is, or is in, one that a name hints at and whose text is no prose."""
        region = [0] * len(self.name)  # the outermost element hinted at
        for e in range(1, len(region)):
            region[e] = region[self.parent[e]] or (e if self.own[e] == HINTED else 0)
        of = np.array([region[e] for e in element])
        sums = {key: np.bincount(of, x, len(region)) for key, x in (("all", length), ("prose", length * content), ("n", np.ones(len(of))))}
        rest = content & (of == 0)
        usual = length[rest].mean() if rest.any() else 0.0
        stays = (sums["prose"] >= PROSE * sums["all"]) & (sums["all"] >= LONG * usual * sums["n"])
        stays[0] = True
        return [not stays[r] for r in region]


def own_element(page: Page, sums: list[float]) -> int:
    """The outermost main, or else article, element that holds most of the text and nearly all
    that elements like it hold; the page as a whole if there is none."""
    for name in ("main", "article"):
        some = [e for e in range(1, len(sums)) if page.name[e] == name and sums[e] and not page.article[page.parent[e]]]
        best = max(some, key=sums.__getitem__, default=0)
        if best and sums[best] >= MOST * sums[0] and sums[best] >= HOLDS * sum(sums[e] for e in some):
            return best
    return 0


def content_nodes(page: Page, nodes: list[tuple[int, str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Which text nodes lie on content paths, by tag-path ratios, and the length of each."""
    path = np.array(page.path)[np.array([e for e, _, _ in nodes])]
    length = np.array([len(" ".join(t.split())) for _, t, _ in nodes], float)
    marks = np.array([len(PUNCTUATION.findall(t)) for _, t, _ in nodes], float)
    count = np.bincount(path)

    def per_path(x: np.ndarray) -> np.ndarray:
        return np.bincount(path, x) / np.maximum(count, 1)

    def smooth(x: np.ndarray) -> np.ndarray:
        return np.convolve(x, SMOOTH, "full")[2:-2] / np.convolve(np.ones(len(x)), SMOOTH, "full")[2:-2]

    fused = per_path(smooth(per_path(length)[path])) * (1 + per_path(smooth(per_path(marks)[path])))
    of_node = fused[path]
    return of_node >= min(THRESHOLD * of_node.std(), of_node.max()), length


def main_text(source: str | None) -> str:
    """The main text of one page."""
    if not source:
        return ""
    page = Page(source)
    keep = page.kept()
    page.nodes = [node for node in page.nodes if keep[node[0]]]
    nodes = [(e, t, b) for e, t, b in page.nodes if not t.isspace()]
    if HINTED in page.own and nodes:
        gone = page.hinted_away([e for e, _, _ in nodes], *content_nodes(page, nodes))
        page.nodes = [node for node in page.nodes if not gone[node[0]]]
        nodes = [node for node in nodes if not gone[node[0]]]
    if not nodes:
        return ""
    element = np.array([e for e, _, _ in nodes])
    content, length = content_nodes(page, nodes)

    # Text of content paths below every element; children come after their parents.
    held = np.zeros(len(page.name))
    np.add.at(held, element[content], length[content])
    parent = page.parent
    sums = held.tolist()
    for e in range(len(sums) - 1, 0, -1):
        sums[parent[e]] += sums[e]
    root = own_element(page, sums)
    best = HOLDS * sums[root]
    for e in range(root + 1, len(sums)):
        if sums[e] >= best and parent[e] == root and page.name[e] not in INLINE:
            root = e
    if not page.article[root] or page.name[root] not in ("article", "main"):
        up = root
        while up and page.name[up] not in ("article", "main"):
            up = parent[up]
        root = up or root
    while root and page.name[root] not in ROOTS and page.name[root] not in HOLDERS:
        root = parent[root]  # one long paragraph, quotation, list or table has its neighbours beside it
    below = [False] * len(page.name)
    below[root] = True
    for e in range(1, len(below)):
        below[e] = below[e] or below[parent[e]]

    # Of what stands beside the root, the article's are the content paths' blocks, and headings and
    # paragraphs directly in an element around it; where there is an article or main element, in that.
    around, bound = [], 0
    up = root
    while up:
        up = parent[up]
        around.append(up)
        if page.name[up] in ("article", "main"):
            bound = up
    inner = [False] * len(page.name)
    inner[0] = not bound and page.name[root] not in ("article", "main")
    beside = set(around[:around.index(bound) + 1] if bound else around if inner[0] else ())
    # Headings after the root, and paragraphs of the page as a whole, are rather of something else.
    for e in range(1, len(inner)):
        inner[e] = inner[parent[e]] or e == bound
        if not below[e] and parent[e] in beside and (
                page.name[e] in HEADINGS and e < root or page.name[e] == "p" and page.name[parent[e]] not in ("html", "body", "#root")):
            below[e] = True
        below[e] = below[e] or (parent[e] not in beside and below[parent[e]])
    following: dict[int, int] = {}  # the element after each, with the same parent
    for e in range(len(below) - 1, root, -1):
        after = following.get(parent[e], 0)
        if page.name[e] in HEADINGS and parent[e] in beside and not below[e] and below[after] and page.name[after] in ("p", *HEADINGS):
            below[e] = True  # a heading after the root that heads a paragraph of the article
            for inside in range(e + 1, after):
                below[inside] = True
        following[parent[e]] = e
    kept = {b for (e, _, b), own in zip(nodes, content.tolist(), strict=True) if own and inner[e]}

    blocks: dict[int, list[str]] = {}
    for e, t, b in page.nodes:
        if below[e] or b in kept:
            blocks.setdefault(b, []).append(t)
    in_article = {b for e, _, b in page.nodes if page.article[e]}
    lines = ((b, " ".join("".join(parts).split())) for b, parts in blocks.items())
    return "\n".join(line for b, line in lines if line and (b in in_article or not RIGHTS.match(line)))


def extract(source: Column) -> Column:
    """The main text of each page."""

    @pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pages.map(main_text, na_action=None)

    return of(source)
