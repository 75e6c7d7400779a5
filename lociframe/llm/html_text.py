"""Main text of web pages by tree scoring.

A page is read into a tree. Every paragraph-like block passes points (one, one for each comma, one for each 100
characters up to three) to its ancestors: all to the parent, half to the grandparent, less further up. A container's
points are discounted by its link density; the best container is kept, and its siblings that score well or read like
paragraphs. Menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are
out, by element, by the words of class, id and role, or as lists of links. Inside an article only a whole name of
BOILERPLATE, or a word of SURE, is enough; other words, such as that of `promotion-history`, need mostly links besides,
and lists of links stay: they are references.

All passes are loops over the nodes in page order, linear in the page, so that neither depth nor length matters.
Nulls: a null page has an empty text; so has a page without text. Broken mark-up is read as a browser would roughly:
an unclosed comment, script or style reaches to the end, an end tag without a start is skipped, a lone `<` is text.
Repeated rows give equal rows, an empty table none. Other columns are not looked at. White space is that of HTML;
no-break spaces are characters like others, but a block of nothing else is empty.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
SKIPPED = frozenset("head script style noscript template nav footer aside form button select option textarea input iframe svg math object "
                    "canvas audio video dialog menu title xmp noembed noframes map datalist".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
                   "tbody td tfoot th thead tr ul".split())
#: A start tag of these ends an open paragraph.
ENDS_P = BLOCKS - frozenset("html body caption td th tr tbody thead tfoot option optgroup legend".split())
#: A start tag ends the nearest open element of its group, unless an element of the second set is nearer.
SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
        "option": ({"option"}, {"select", "datalist"})}
#: Words of class, id or role that name what isn't the article.
BOILERPLATE = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments disqus "
                        "respond reply replies cookie cookies consent gdpr notice notices alert popup modal overlay subscribe newsletter signup "
                        "login sidebar sidebars aside menu menus nav navbar navigation navi topbar toolbar footer foot masthead social share sharing "
                        "related recommended recommendations promo promotion sponsor sponsored sponsors pager pagination widget widgets "
                        "copyright complementary contentinfo search skip".split())
#: Those that are enough as a part of a name, too.
SURE = frozenset("ad ads advert adverts advertisement advertising adsense adslot comment comments disqus cookie cookies gdpr newsletter sidebar sidebars".split())
HEADER_WORDS = frozenset({"header", "head"})
GOOD_TAGS = {"article": 30.0, "main": 15.0, "section": 3.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0}
BAD_TAGS = {"ul": -3.0, "ol": -3.0, "dl": -3.0, "li": -3.0, "address": -3.0, "th": -5.0, "table": -3.0}
GOOD_WORDS = frozenset("article body content entry main post story text blog hentry page".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6".split())
MIN_PARAGRAPH = 25
LINK_LIST = 0.8
#: Link density from which a part of a name decides inside an article.
MOSTLY_LINKS = 0.5

_NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
_PLAIN = re.compile(r"[^>\"']*")
_MARKS = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")


def one_space(text: str) -> str:
    """White space as one space, none at the ends; empty if nothing but spaces of any kind is left."""
    text = _SPACE.sub(" ", text).strip(" ")
    return text if text.strip() else ""


class Node:
    __slots__ = ("tag", "parent", "children", "marks", "order", "end", "score", "length", "link_length", "links", "holds", "dropped", "inside", "doubtful")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.children, self.marks = tag, parent, [], attrs
        self.order = self.end = 0
        self.score = 0.0
        self.length = self.link_length = self.links = 0
        self.holds = self.dropped = self.inside = self.doubtful = False


def _tag_end(page: str, at: int, lone: set[str]) -> int:
    """Index of the `>` that ends a tag, quotes respected; lone: quotes that have no partner from here on."""
    while True:
        at = _PLAIN.match(page, at).end()
        if at >= len(page) or page[at] == ">":
            return at
        quote = page[at]
        close = -1 if quote in lone else page.find(quote, at + 1)
        if close < 0:
            lone.add(quote)
            at += 1
        else:
            at = close + 1


def parse(page: str) -> list[Node]:
    """The nodes in page order, the root first; text children are strings with references decoded."""
    root = Node("#root", None)
    nodes, stack, opened = [root], [root], Counter()
    lone: set[str] = set()
    at, size = 0, len(page)

    def put(text: str) -> None:
        if text:
            stack[-1].children.append(html.unescape(text) if "&" in text else text)

    def pop_to(tags: set[str], barrier: set[str] | frozenset[str] = frozenset()) -> None:
        if not any(opened[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                for n in stack[i:]:
                    opened[n.tag] -= 1
                del stack[i:]
                return
            if stack[i].tag in barrier:
                return

    while at < size:
        start = page.find("<", at)
        if start < 0:
            put(page[at:])
            break
        follows = page[start + 1:start + 2]
        if page.startswith("<!--", start):
            put(page[at:start])
            close = page.find("-->", start + 4)
            at = size if close < 0 else close + 3
            continue
        if follows and follows in "!?":
            put(page[at:start])
            close = page.find(">", start)
            at = size if close < 0 else close + 1
            continue
        name = _NAME.match(page, start + 1)
        if not name:
            put(page[at:start + 1])
            at = start + 1
            continue
        put(page[at:start])
        tag = name[0].lower()
        end = _tag_end(page, name.end(), lone)
        attrs = page[name.end():end]
        at = end + 1
        if tag[0] == "/":
            tag = tag[1:]
            if tag == "p" and not opened["p"]:
                continue
            pop_to({tag}, {"table"} if tag not in ("table", "article", "body", "html", "main", "div", "section", "tr", "td", "tbody") else set())
            continue
        if tag in ENDS_P:
            pop_to({"p"}, {"td", "th", "table", "button", "caption"})
        if tag in SAME:
            pop_to(*SAME[tag])
        node = Node(tag, stack[-1], attrs)
        node.order = len(nodes)
        stack[-1].children.append(node)
        nodes.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|$)", re.I).search(page, at)
            inner = page[at:close.start() if close else size]
            if tag not in ("script", "style"):
                node.children.append(html.unescape(inner))
            at = size if not close else _tag_end(page, close.end(), lone) + 1
        elif tag not in VOID:
            stack.append(node)
            opened[tag] += 1
    for node in reversed(nodes):
        node.end = max([node.order, *(c.end for c in node.children if isinstance(c, Node))])
    return nodes


def _marks(attrs: str) -> tuple[set[str], set[str], bool]:
    """Lower-case words of class, id and role, their whole names, and whether the element is hidden."""
    words: set[str] = set()
    names: set[str] = set()
    hidden = False
    for key, value in _MARKS.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id", "role"):
            names.update(value.lower().split())
            for part in re.split(r"[\s_\-:]+", value):
                words.add(part.lower())
                words.update(w.lower() for w in _WORDS.findall(part))
        else:
            hidden |= key == "hidden" or key == "style" and bool(_HIDDEN.search(value)) or key == "aria-hidden" and value.lower() == "true"
    return words, names, hidden


def _drop(nodes: list[Node]) -> None:
    """Mark what can't be the article, by element and by name; hand marks down."""
    for node in reversed(nodes):
        if node.parent is not None and (node.holds or node.tag in ("article", "main")):
            node.parent.holds = True
    in_article = [False] * len(nodes)
    for node in nodes[1:]:
        up = node.parent
        in_article[node.order] = in_article[up.order] or up.tag == "article"
        words, names, hidden = _marks(node.marks) if node.marks.strip(" /") else (set(), set(), False)
        node.marks = words
        node.inside = in_article[node.order]
        node.dropped = up.dropped or node.tag in SKIPPED or hidden
        if not node.dropped and node.tag not in ("html", "body", "main") and not node.holds:
            outside = not in_article[node.order] and node.tag != "article"
            if node.tag == "header" and outside:
                node.dropped = True
            elif node.tag not in PARAGRAPHS or node.tag == "li" or words & {"comment", "comments", "ad", "advert", "notice"}:
                named = bool(words & BOILERPLATE)
                node.dropped = named and (outside or bool(names & BOILERPLATE or words & SURE)) or outside and bool(words & HEADER_WORDS)
                node.doubtful = named and not node.dropped


def _measure(nodes: list[Node]) -> None:
    """Text and link lengths of each subtree; then lists of links go, too, until nothing changes."""
    while True:
        for node in nodes:
            node.length = node.link_length = node.links = 0
        for node in reversed(nodes):
            if node.dropped:
                continue
            node.length += sum(len(c.strip()) for c in node.children if isinstance(c, str))
            if node.tag == "a":
                node.link_length, node.links = node.length, node.links + 1
            up = node.parent
            if up is not None:
                up.length += node.length
                up.link_length += node.link_length
                up.links += node.links
        gone = False
        for node in nodes[1:]:
            if node.parent.dropped:
                gone |= not node.dropped
                node.dropped = True
            elif not node.dropped and node.tag in ("ul", "ol", "dl", "div", "section", "table") and not node.inside and node.links > 1 and node.link_length >= LINK_LIST * node.length:
                node.dropped = gone = True
            elif not node.dropped and node.doubtful and node.links and node.link_length >= MOSTLY_LINKS * node.length:
                node.dropped = gone = True
        if not gone:
            return


def _own_text(node: Node) -> str:
    """Text of a block without the blocks in it."""
    out, todo = [], list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif not c.dropped and c.tag not in BLOCKS:
            todo.extend(reversed(c.children))
    return "".join(out)


def _density(node: Node) -> float:
    return node.link_length / node.length if node.length else 0.0


def best_container(nodes: list[Node]) -> list[Node]:
    """The best container and the siblings kept with it, in page order."""
    scored: dict[int, Node] = {}
    for node in nodes[1:]:
        if node.dropped or node.tag not in PARAGRAPHS and node.tag not in ("div", "section", "article", "main", "body"):
            continue
        text = one_space(_own_text(node))
        if len(text) < MIN_PARAGRAPH:
            continue
        points = 1.0 + text.count(",") + min(len(text) / 100, 3.0)
        up, level = node.parent if node.tag in PARAGRAPHS else node, 0
        while up is not None and up.tag != "#root" and level < 5:
            if up.order not in scored:
                scored[up.order] = up
                up.score = GOOD_TAGS.get(up.tag, BAD_TAGS.get(up.tag, 0.0)) + 25.0 * bool(up.marks and up.marks & GOOD_WORDS)
            up.score += points / (1 if level == 0 else 2 if level == 1 else level * 3)
            up, level = up.parent, level + 1
    if not scored:
        whole = [n for n in nodes if n.tag == "article" and not n.dropped] or [n for n in nodes if n.tag in ("main", "body") and not n.dropped] or nodes[:1]
        return whole[:1]
    final = {k: n.score * (1.0 - _density(n)) for k, n in scored.items()}
    best = scored[max(final, key=lambda k: (final[k], -k))]
    points = final[best.order]
    up = best
    while up is not None and up.tag != "article":
        up = up.parent
    best = up or best
    kept = []
    for node in best.parent.children if best.parent is not None else [best]:
        if not isinstance(node, Node) or node.dropped:
            continue
        text = node.length
        if (node is best or final.get(node.order, 0.0) >= max(10.0, 0.2 * points) or node.tag == best.tag == "article"
                or node.tag == "p" and (text > 80 and _density(node) < 0.25 or 0 < text <= 80 and not node.links and _own_text(node).rstrip().endswith("."))):
            kept.append(node)
    return kept


def blocks(node: Node) -> list[str]:
    """Texts of the blocks in page order, white space made one space, empty ones left out."""
    out: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        text = one_space("".join(buffer))
        buffer.clear()
        if text:
            out.append(text)

    todo: list = [node]
    while todo:
        c = todo.pop()
        if c is None:
            flush()
        elif isinstance(c, str):
            buffer.append(c)
        elif c.dropped:
            continue
        elif c.tag == "br":
            buffer.append(" ")
        else:
            if c.tag in BLOCKS:
                flush()
                todo.append(None)
            todo.extend(reversed(c.children))
    flush()
    return out


def extract(page: str | None) -> str:
    """Main text of one page: blocks joined by an empty line."""
    if not page:
        return ""
    nodes = parse(page)
    _drop(nodes)
    _measure(nodes)
    return "\n\n".join(b for n in best_container(nodes) for b in blocks(n))


def main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """The given rows' page_id and url with text and n_chars."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [extract(x) if isinstance(x, str) else "" for x in batch["__html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": text, "n_chars": [len(t) for t in text]})

    return (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(column).alias("__html"))
            .mapInPandas(run, "page_id long, url string, text string, n_chars long"))
