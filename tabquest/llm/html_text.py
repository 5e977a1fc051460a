"""Main text of web pages by tag-path ratios.

The text of a page is cut into blocks; each belongs to its path of block tags (with classes) from the
root.  For every path the page's text length, punctuation and links are added up; its ratio is the mean
text length of its blocks, links left out, times their mean punctuation.  Ratios are smoothed over neighbouring
blocks; a block's weight is its path's ratio times its text.  Weights are fused up the tree, and the lowest node
that holds most of them is the content node.  Beside it count: subtrees with a fair share of the weight, headings
right before it, and neighbouring paragraphs with a high ratio of their own.

Menus, headers, footers, sidebars, notices, adverts, forms and comments that say so by tag, role, class or id have
no weight, unless nearly all text of the page stands below: then the name belongs to a wrapper.  Unnamed ones fall by
their ratios.  Time and memory are linear in the length of the page, however deep its tags.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabquest.llm.shared import bounded, prepare

# Tags by the way HTML treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas video audio noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var br img wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}
# Subtrees that are not the article.
OTHER_TAGS = frozenset(
    "head nav footer aside form button select option input textarea fieldset legend dialog menu menuitem datalist search".split()
)
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
OTHER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion promotions "
    "banner cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay sidebar sidenav "
    "aside nav navbar navigation menu menus breadcrumb breadcrumbs footer footnotebar masthead topbar toolbar comment comments "
    "commentlist disqus reply replies respond discussion share sharing social related recommended recommendations newsletter "
    "subscribe subscription signup login register search searchbox pagination pager widget widgets taglist skip print hidden".split()
)
ARTICLE_NAMES = frozenset("article post entry content story body text main".split())
HEADER_NAMES = frozenset("header head topheader".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
# Names that also count on a paragraph or an inline tag, if they are a whole class.
STRONG_NAMES = frozenset("ad ads advert advertisement adsense adslot sponsored hidden cookie-notice sr-only visually-hidden".split())
# A class that starts with one of these says what a container has or lacks, not what it is.
OF_CONTAINERS = ("has", "have", "no", "with", "without", "is")
# Controls and hidden parts never count, whatever they hold.
CONTROLS = frozenset("head button select option input textarea datalist".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote dt figcaption caption address".split())
HEADINGS = frozenset("h1 h2 h3".split())
MAIN_TAGS = frozenset(("article", "main"))
# The content node holds this share of the weight; marked articles with that of the second one, or with the page's
# headline, are its text.
MOST = 0.7
MARKED = 0.3
# Other subtrees (paragraphs) count if their weight (ratio) is at least this share of all of it (of the highest one).
THRESHOLD = 0.1
# A named subtree with this many times the text outside of all named ones is a wrapper if it holds a headline or an
# article, and with WHOLE times in any case.
WRAPPER, WHOLE = 4, 20
# A path whose text stands in links to more than this share is a menu.
MOST_LINKED = 0.6
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、¿¡]")

_MARKUP = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"
_TOKEN = re.compile(_MARKUP + r"(?:((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|([^>]*)(?:>|\Z))", re.S)
# After a tag with a quote that nothing closes, quoted values reach up to the next tag at most; keeps the time linear.
_STRICT = re.compile(_MARKUP + r"(?:((?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*+)(?:>|\Z)|([^>]*)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")

# What a node's tag and names say about it.
PLAIN, NAMED, OUTER, COMMENTS, NEVER = range(5)


class Tree:
    """Block tags of a page in page order, parents first; node 0 is the page."""

    def __init__(self) -> None:
        self.parent, self.tag, self.path, self.says, self.inside = [-1], [""], [0], [PLAIN], [False]
        self._paths: dict[tuple[int, str], int] = {}

    def add(self, tag: str, named: str, says: int, parent: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.path.append(self._paths.setdefault((self.path[parent], named), len(self._paths) + 1))
        self.says.append(says)
        self.inside.append(self.inside[parent] or tag in MAIN_TAGS)
        return len(self.parent) - 1

    def summed(self, own: list[float]) -> list[float]:
        """Values of all nodes below each node, itself included."""
        total = list(own)
        for n in range(len(total) - 1, 0, -1):
            total[self.parent[n]] += total[n]
        return total


def _described(tag: str, attributes: str, in_article: bool) -> tuple[str, int]:
    """Name of the tag in a path (with its classes), and what its tag, role and names say."""
    values = {}
    if attributes.strip(" />\n\t\r"):
        for m in _ATTRIBUTE.finditer(attributes):
            values.setdefault(m[1].lower(), html.unescape((m[2] or "").strip("\"'")))
    classes = values.get("class", "").split()
    named = ".".join([tag, *sorted(classes)])
    style = values.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    labels = [*classes, *values.get("id", "").split()]
    if tag in CONTROLS or hidden:
        return named, NEVER
    if tag in PARAGRAPHS or tag in INLINE:
        return named, NAMED if any(c.lower() in STRONG_NAMES for c in labels) else PLAIN
    if tag in ("body", "html", *MAIN_TAGS):
        comment = tag == "article" and any(p.lower() in COMMENT_NAMES for c in labels for p in _NAME.findall(c))
        return named, COMMENTS if comment else PLAIN
    said = set()
    for label in labels:
        parts = [p.lower() for p in _NAME.findall(label)]
        if parts and parts[0] not in OF_CONTAINERS:
            said.update(p for p in parts if p in COMMENT_NAMES or not ARTICLE_NAMES.intersection(parts))
    if said & COMMENT_NAMES:
        return named, COMMENTS
    if tag == "form":
        return named, NAMED
    if tag in OTHER_TAGS or values.get("role", "").lower() in OTHER_ROLES or (tag == "header" and not in_article):
        return named, OUTER
    return named, NAMED if said & OTHER_NAMES or (said & HEADER_NAMES and not in_article) else PLAIN


def blocks(page: str) -> tuple[Tree, list[tuple[int, str, int]]]:
    """The tree, and (node, text, characters in links) of every block with text, in page order.

    Text of one block that inline tags cut is one block.
    """
    tree, made = Tree(), []
    stack: list[tuple[str, int, bool, bool]] = []  # tag, node, in a link, inside an article or section
    open_tags: dict[str, int] = {}
    texts: list[str] = []
    token = _TOKEN
    at, n, node, linked = 0, len(page), 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(texts).split())
        if text:
            made.append((node, text, min(linked, len(text))))
        texts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal node, linked
        if not text:
            return
        own, link = (stack[-1][1], stack[-1][2]) if stack else (0, False)
        if own != node:
            flush()
            node = own
        text = html.unescape(text)
        texts.append(text)
        linked += len(text.strip()) if link else 0

    def cut(depth: int) -> None:
        for tag, *_ in stack[depth:]:
            open_tags[tag] -= 1
        del stack[depth:]

    def close(names: tuple[str, ...], within: tuple[str, ...]) -> None:
        if not any(open_tags.get(t) for t in names):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                cut(i)
                return
            if stack[i][0] in within:
                return

    while at < n:
        m = token.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        if m[4] is not None:
            token = _STRICT
        tag = m[2].lower()
        if m[1]:
            if tag not in INLINE:
                flush()
                close((tag,), ())
            elif open_tags.get(tag):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        open_tags[tag] -= 1
                        del stack[i]
                        break
                    if stack[i][0] not in INLINE:
                        break
            continue
        if tag in RAW:
            if not m[0].endswith("/>"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            if tag not in ("svg", "math", "script", "style"):
                flush()
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P:
                close(("p",), ("article", "section", "div", "td", "th", "li", "blockquote", "body", "aside", "footer", "nav", "header", "main"))
            if tag in SIBLINGS:
                names, within = SIBLINGS[tag]
                close(tuple(names.split()), within)
        if tag in VOID:
            continue
        above, link, in_article = stack[-1][1:] if stack else (0, False, False)
        named, says = _described(tag, m[3] if m[4] is None else m[4], in_article)
        own = above if tag in INLINE and says == PLAIN else tree.add(tag, named, says, above)
        stack.append((tag, own, link or tag == "a", in_article or tag in ("article", "main", "section")))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    return tree, made


def outside(tree: Tree, found: list[tuple[int, str, int]]) -> list[bool]:
    """For every node whether it stands in a subtree that says it is no content and is no wrapper of the page."""
    size = len(tree.parent)
    near = [0] * size  # the nearest node at or above that says something; 0 for none
    for n in range(1, size):
        up = near[tree.parent[n]]
        near[n] = up if tree.says[up] == NEVER or tree.says[n] == PLAIN else n
    own = [0] * size
    for node, text, linked in found:
        if tree.says[near[node]] != NEVER:
            own[near[node]] += len(text) - linked
    below, lead, article = list(own), [False] * size, [False] * size
    for n in range(1, size):
        if tree.tag[n] in ("h1", "main"):
            lead[near[n]] = True
        elif tree.tag[n] == "article" and tree.says[n] == PLAIN:
            article[near[n]] = True
    marked_out = article[0]
    for n in range(size - 1, 0, -1):
        if near[n] == n:
            up = near[tree.parent[n]]
            below[up] += below[n] if up else 0
            lead[up], article[up] = lead[up] or lead[n], article[up] or (article[n] and tree.says[n] != COMMENTS)
    counts, out = [n == 0 for n in range(size)], own[0]
    named = [n for n in range(1, size) if near[n] == n and tree.says[n] != NEVER]
    for n in sorted(named, key=lambda n: (-below[n], n)):
        headed = lead[n] or (article[n] and tree.says[n] != COMMENTS)
        whole = tree.says[n] == NAMED and below[n] > WHOLE * out and not marked_out
        if counts[near[tree.parent[n]]] and ((headed and below[n] > WRAPPER * out) or whole):
            counts[n] = True
            out += own[n]
    return [not counts[k] for k in near]


def path_ratios(tree: Tree, found: list[tuple[int, str, int]]) -> tuple[dict[int, float], set[int]]:
    """The smoothed ratio of every path, and the paths that are menus."""
    sums: dict[int, list[int]] = {}
    for node, text, linked in found:
        own = sums.setdefault(tree.path[node], [0, 0, 0, 0])
        for k, value in enumerate((1, len(text), len(_PUNCTUATION.findall(text)), linked)):
            own[k] += value
    ratio = {p: (chars - linked) / n * (1 + marks / n) for p, (n, chars, marks, linked) in sums.items()}
    menus = {p for p, (_, chars, _, linked) in sums.items() if linked > MOST_LINKED * chars}
    raw = [0.0 if tree.path[b[0]] in menus else ratio[tree.path[b[0]]] for b in found]
    smooth = dict.fromkeys(ratio, 0.0)
    for i, (node, *_) in enumerate(found):
        near = raw[max(0, i - 1) : i + 2]
        smooth[tree.path[node]] += sum(near) / len(near)
    return {p: 0.0 if p in menus else (r + smooth[p] / sums[p][0]) / 2 for p, r in ratio.items()}, menus


def content_blocks(tree: Tree, found: list[tuple[int, str, int]]) -> list[bool]:
    """For every block whether it is content: weights by path ratios, fused up the tree, and cut."""
    ratio, menus = path_ratios(tree, found)
    weights = [ratio[tree.path[node]] * (len(text) - linked) for node, text, linked in found]
    total = sum(weights)
    marked = [tree.inside[node] for node, *_ in found]
    of_marked = sum(w for w, m in zip(weights, marked) if m)
    counts = [tree.path[node] not in menus for node, *_ in found]
    headed = any(m and tree.tag[node] == "h1" for (node, *_), m in zip(found, marked))
    restricted = of_marked > 0 and (headed or of_marked >= MARKED * total)
    if restricted:
        counts = [c and m for c, m in zip(counts, marked)]
        weights = [w if m else 0.0 for w, m in zip(weights, marked)]
        total = of_marked
    own, direct = [0.0] * len(tree.parent), [0.0] * len(tree.parent)
    container = [0] * len(tree.parent)
    for n in range(1, len(tree.parent)):
        container[n] = container[tree.parent[n]] if tree.tag[n] in PARAGRAPHS else n
    for (node, *_), weight in zip(found, weights):
        own[node] += weight
        direct[container[node]] += weight
    below = tree.summed(own)
    holds = [n for n, w in enumerate(below) if w >= MOST * total and tree.tag[n] not in PARAGRAPHS and tree.tag[n] not in INLINE]
    articles = [n for n in holds if tree.tag[n] in MAIN_TAGS] if restricted else []
    root = articles[0] if articles else holds[-1]

    chosen = [False] * len(tree.parent)  # nodes whose subtree counts
    chain = {root}
    n = root
    while n:
        n = tree.parent[n]
        chain.add(n)
    of_text = direct[root] >= THRESHOLD * below[root]
    of_page = tree.tag[root] in ("", "html", "body")  # all else of the page is below, so only its own paragraphs count at once
    chosen[root] = bool(articles) or (of_text and not of_page)
    first = max((below[n] for n in range(1, len(below)) if tree.parent[n] == root), default=0.0)
    paths = {tree.path[n] for n in range(1, len(below)) if tree.parent[n] == root and below[n] >= THRESHOLD * max(first, 1e-9)}
    highest = max(ratio.values())
    for n in range(1, len(below)):
        up = tree.parent[n]
        if n == root:
            continue
        if chosen[up]:
            chosen[n] = True
        elif tree.tag[n] in PARAGRAPHS:
            chosen[n] = up == root and of_text
        elif n not in chain and up in chain:
            chosen[n] = below[n] > 0 and (below[n] >= THRESHOLD * total or (up == root and tree.path[n] in paths))
    taken = [c and (chosen[node] or (node == root and of_text)) for c, (node, *_) in zip(counts, found)]
    candidates = [i for i, c in enumerate(counts) if c]
    for order, step in ((range(len(candidates) - 1, -1, -1), 1), (range(len(candidates)), -1)):  # lead-ins, then what follows
        for k in order:
            i = candidates[k]
            beside = 0 <= k + step < len(candidates) and taken[candidates[k + step]]
            node = found[i][0]
            if taken[i] or not beside or tree.parent[node] not in chain or tree.tag[node] not in PARAGRAPHS:
                continue
            taken[i] = (step == 1 and tree.tag[node] in HEADINGS) or ratio[tree.path[node]] >= THRESHOLD * highest
    return taken


def main_text(page: str) -> str:
    """The content blocks in page order, joined by one space.

    Where a page marks articles that hold a fair share of the weight or a first headline, only marked text counts (a
    marked teaser beside the text has neither).
    """
    tree, found = blocks(page)
    other = outside(tree, found)
    found = [b for b in found if not other[b[0]]]
    if all(linked == len(text) for _, text, linked in found):
        return ""
    return " ".join(b[1] for b, taken in zip(found, content_blocks(tree, found)) if taken)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    A null or empty page gives an empty text, and so does one without content.  Repeated rows and
    null ids stay; an empty table gives no rows; other columns are ignored.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded(whole, "html"):
                texts = [main_text(p) for p in batch.column("html").to_pylist()]
                columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
