"""Main text of a web page by scoring its tree.

A paragraph earns points for its length and its commas, less the share of its
text that is links, and passes them to its ancestors, less the farther up. The
container with the most points, discounted by the link density of all its text,
is kept with the siblings that belong to it; if it lies in an ``article`` or
``main`` element, all of that is kept, with the siblings that have enough points
of their own. Such elements start with the points of a long paragraph, and an
``article`` beside or below the container stays only with enough points. Menus,
headers, footers, side bars, notices, adverts, forms, comments and code never
count and never come out.

Null html is empty and gives empty text; a page without paragraphs gives what is
left of its body. Every row gives one row, repeated or not; null ids and urls
stay null. Other columns stay as they are.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var".split()
)
NEVER = frozenset(
    "script style noscript template head title nav footer aside form iframe svg canvas button select textarea object "
    "dialog menu audio video map datalist".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOT_CONTAINERS = HEADINGS | frozenset("p li dt dd pre td th tr caption figcaption html".split())
# A start tag of the key ends an open element of the value.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices alert newsletter subscribe subscription popup modal overlay sidebar widget widgets menu nav navbar "
    "navigation breadcrumb breadcrumbs header masthead footer comment comments disqus respond reply replies related "
    "recommended share sharing social pagination pager login signup search toolbar skip".split()
)
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
BONUS = 3.0  # points of an article or main element that has any: those of a long paragraph's length
SHARE = 0.2  # of the container's points, for what is kept beside it
LOOSE = frozenset("with has no without".split())
KEPT_ALWAYS = frozenset("html body article main".split())
_WORDS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)


def _unwanted(tag: str, attrs: list) -> bool:
    """Whether an element's name, role, class or id says that it is no part of the article."""
    if tag in NEVER:
        return True
    if tag in KEPT_ALWAYS and tag != "article":
        return False
    for name, value in attrs:
        value = value or ""
        if name in ("class", "id"):
            for token in value.split():
                words = [w.lower() for w in _WORDS.split(token) if w]
                if words and not LOOSE.intersection(words) and (words[-1] in BAD_WORDS or words[0] in BAD_WORDS and len(words) == 2):
                    return True
        elif name == "role":
            if value.lower() in BAD_ROLES:
                return True
        elif name == "hidden" or name == "style" and _HIDDEN.search(value):
            return True
    return False


class Tree(HTMLParser):
    """Flat lists of the elements in page order, and the text between them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.off, self.block, self.linked = ["#"], [0], [False], [0], [False]
        self.stack = [0]
        self.text: list[tuple[int, str | None]] = []  # (element, text); None is a break

    def handle_starttag(self, tag, attrs):
        if tag == "br" or tag == "hr":
            self.text.append((self.stack[-1], None))
        if tag in VOID:
            return
        if tag not in INLINE:
            self._end_open("p", ("table", "article", "section", "div", "td", "th", "li", "body"))
            for other in ENDS.get(tag, ()):
                self._end_open(other, SCOPES.get(tag, ()))
        up = self.stack[-1]
        bad = _unwanted(tag, attrs) or tag == "header" and not self._inside(up, ("article", "main"))
        here = len(self.tag)
        self.tag.append(tag)
        self.parent.append(up)
        self.off.append(self.off[up] or bad)
        self.block.append(self.block[up] if tag in INLINE else here)
        self.linked.append(self.linked[up] or tag == "a")
        self.stack.append(here)
        if tag not in INLINE:
            self.text.append((here, None))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, 0, -1):
            open_ = self.tag[self.stack[k]]
            if open_ == tag:
                if tag not in INLINE:
                    self.text.append((self.stack[k], None))
                del self.stack[k:]
                return
            if tag in INLINE and open_ not in INLINE:
                return  # an inline end tag closes no block

    def handle_data(self, data):
        self.text.append((self.stack[-1], data))

    def _end_open(self, tag, scopes):
        for k in range(len(self.stack) - 1, 0, -1):
            open_ = self.tag[self.stack[k]]
            if open_ == tag:
                del self.stack[k:]
                return
            if open_ in scopes:
                return

    def _inside(self, node, tags):
        while node:
            if self.tag[node] in tags:
                return True
            node = self.parent[node]
        return False


def main_text(html: str | None) -> str:
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    n = len(tree.tag)
    size, links, commas = [0] * n, [0] * n, [0] * n
    for node, text in tree.text:
        if text is not None and not tree.off[node]:
            chars = len(text.strip())
            if chars:
                block = tree.block[node]
                size[block] += chars
                commas[block] += text.count(",")
                if tree.linked[node]:
                    links[block] += chars
    points = [0.0] * n
    for node in range(n):
        if size[node] and not tree.off[node] and tree.tag[node] not in HEADINGS:
            mine = (1 + commas[node] + min(size[node] / 100, 3)) * (1 - links[node] / size[node])
            up, share = tree.parent[node] if tree.tag[node] in NOT_CONTAINERS else node, 1.0
            for level in range(1, 6):
                points[up] += mine * share
                if not up:
                    break
                up, share = tree.parent[up], 1 / (2 * level)
    all_size, all_links = size[:], links[:]
    for node in range(n - 1, 0, -1):
        all_size[tree.parent[node]] += all_size[node]
        all_links[tree.parent[node]] += all_links[node]
    density = [a / s if s else 0.0 for a, s in zip(all_links, all_size)]
    best, most = 0, 0.0
    for node in range(n):
        if not tree.off[node] and tree.tag[node] not in NOT_CONTAINERS and tree.tag[node] not in INLINE:
            bonus = BONUS if points[node] and tree.tag[node] in ("article", "main") else 0.0
            score = (points[node] + bonus) * (1 - density[node])
            if score > most:
                best, most = node, score
    kept, left_out = _kept_roots(tree, best, most, points, density, all_size)
    inside = [False] * n
    for node in range(n):
        inside[node] = node in kept or bool(node) and inside[tree.parent[node]] and node not in left_out
    parts = []
    for node, text in tree.text:
        if inside[node] and not tree.off[node]:
            parts.append(" " if text is None else text)
    return " ".join("".join(parts).split())


def _kept_roots(tree: Tree, best: int, most: float, points, density, all_size) -> tuple[set[int], set[int]]:
    """The elements whose text is the article, and elements inside them whose text is not."""
    if most == 0:
        for tag in ("article", "main", "body"):
            found = [k for k, t in enumerate(tree.tag) if t == tag and not tree.off[k]]
            if found:
                return {found[0]}, set()
        return {0}, set()
    score = [p * (1 - d) for p, d in zip(points, density)]
    path, root = [best], best
    while path[-1]:
        if tree.tag[path[-1]] in ("article", "main"):
            root = path[-1]
            break
        path.append(tree.parent[path[-1]])
    whole = tree.tag[root] in ("article", "main")
    kept, up = {root}, tree.parent[root]
    for k in range(len(tree.tag)):
        if tree.parent[k] != up or k in (root, 0) or tree.off[k] or not all_size[k]:
            continue
        tag = tree.tag[k]
        close = score[k] >= max(3.0, SHARE * score[best])
        # Beside an article or main element, and for one, only points count.
        loose = tag in HEADINGS or tag == "p" and density[k] < 0.25 or tag not in INLINE and density[k] < 0.1 and points[k] > 0
        if close or loose and not whole and tag != "article":
            kept.add(k)
    if tree.tag[root] == "article":
        return kept, set()
    teasers = {k for k, t in enumerate(tree.tag) if t == "article" and k not in kept and score[k] < SHARE * score[best]}
    return kept, teasers


def extract(html: Column) -> Column:
    """The main text of an html column, empty if there is none."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(h) for h in pages], dtype=object)

    return run(html.cast("string"))
