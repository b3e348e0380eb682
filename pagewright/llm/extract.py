"""Main text of web pages by tree scoring.

A page is read in one pass into a light tree of its elements.  Each text belongs
to the nearest block around it.  Paragraphs pass points for their length and
commas to their parent and, in smaller shares, to the ancestors above it; an
element's points are discounted by the share of its text that is in links.  The
element with the most points is the container; it is kept with those of its
siblings that score like it or are paragraphs of running text.  Menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
are left out: by element or role wherever they stand, by class or id outside an
article or main element.  Within one a name alone leaves nothing out: it lowers
the points of the part, and the part goes if its paragraphs then score too little.

Text of a block is one line: character references decoded, white space made one
space, ends trimmed; empty blocks go; blocks are joined by \\n in page order.
A line break element inside a block is white space.

Nulls and odd inputs: a null or empty page, and one without text, give an empty
text; broken markup never fails (an unclosed element ends with its parent, a
stray end tag is skipped, an unclosed comment or script takes the rest); page
length is not bounded; equal pages give equal rows; an empty table gives no
rows.  Columns other than id, url and html are not read.
"""

from __future__ import annotations

import html as references
import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch

#: Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
DROPPED = frozenset("script style textarea title noscript template iframe noembed noframes head nav footer aside form button select option datalist input svg canvas object embed video audio map dialog menu".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPH = frozenset("p pre td blockquote dd figcaption".split())
CONTAINER = frozenset("article main section div body td blockquote html center".split())
MENUS = frozenset("ul ol div section table tr dl p".split())
#: A start tag of the first ends an open element of the second, within the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Words of a class or id that mark what is not the article.
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense banner banners sponsor sponsored promo promoted promotion nav navbar navigation menu menus breadcrumb breadcrumbs "
    "header masthead topbar footer foot copyright sidebar aside rail widget widgets related recommended recommendations share sharing social newsletter subscribe subscription signup login "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay comment comments commentlist disqus reply replies respond discussion toolbar pagination pager skip tags form search".split()
)
#: Beside these a name of the words above still means the same: comment-list, site-footer.
NEUTRAL = frozenset("list box section area container wrapper wrap block item items body inner outer site page main top bottom left right global user reader post posts article articles entry content links text message bar btn button".split())
#: Share of its points that a part with such a name keeps within an article, and that a part for readers or sellers keeps; the mean points of a paragraph that it needs.
NAMED, FOREIGN, LEAST = 0.25, 0.05, 1.0
FOREIGN_NAMES = frozenset("ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promoted comment comments commentlist disqus reply replies respond cookie cookies consent gdpr".split())
#: A header of one of these is the article's own.
LIKELY = frozenset("article content main post entry story".split())
#: After one of these a name tells of another part of the page: has-sidebar.
ABOUT = frozenset("with without has no is not".split())

#: A tag from its "<" on.  Text outside quotes holds no "<", so a tag that never closes ends the search at the next one.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>""")
#: The same where a quote is never closed.
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)([^<>]*+)>")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?![\w-])""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
COMMAS = re.compile("[,،、，;]")


class Node:
    __slots__ = ("tag", "parent", "depth", "block", "paragraph", "article", "parts", "dropped", "share", "score", "chars", "linked", "links", "own", "own_linked", "points", "paragraphs", "full")

    def __init__(self, tag: str, parent: "Node | None"):
        self.tag, self.parent = tag, parent
        self.parts: list = []  # texts, decoded, and nodes in page order
        self.dropped, self.share = False, 1.0
        self.score = self.points = 0.0
        self.chars = self.linked = self.links = self.paragraphs = 0
        self.own: list[str] = []  # texts of a block that no other block within it holds
        self.own_linked = 0
        self.full = False  # holds a paragraph of its own
        if parent is None:
            self.depth, self.block, self.paragraph, self.article = 0, self, None, False
        else:
            self.depth = parent.depth + 1
            self.block = self if tag in BLOCK else parent.block
            # the open paragraph that a block's start ends
            self.paragraph = self if tag == "p" else None if tag in CONTAINER else parent.paragraph
            self.article = parent.article or tag in ("article", "main")


def _attributes(text: str) -> tuple[bool, list[str]]:
    """Whether role or hidden says that a part is not the article, and the names of its class and id."""
    names: list[str] = []
    for m in _ATTRIBUTE.finditer(text):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.strip().lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, []
        if name in ("class", "id"):
            names += value.split()
    return False, names


def _name_words(name: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(name)]


def _names_other(name: str) -> bool:
    """Whether a class or id names a part beside the article, by its first or last word: comment-list, site-footer."""
    words = _name_words(name)
    if not words or ABOUT & set(words[:-1]):
        return False
    found = {words[0], words[-1]} & UNLIKELY
    return bool(found) and not (found == {"header"} and LIKELY & set(words))


def _name_share(name: str) -> float:
    """The share of its points that a part keeps by its class or id within an article: only names without another word lower it."""
    words = set(_name_words(name))
    if not words & UNLIKELY or not words <= UNLIKELY | NEUTRAL or "header" in words:
        return 1.0
    return FOREIGN if words & FOREIGN_NAMES else NAMED


def _judge(node: Node, attributes: str) -> None:
    """What element, role and names say of a node."""
    tag = node.tag
    if tag in DROPPED:
        node.dropped = True
        return
    node.dropped, names = _attributes(attributes)
    if not names or tag in ("html", "body", "article", "main"):
        return
    if not node.article:
        node.dropped = node.dropped or any(map(_names_other, names))
    elif tag in BLOCK and tag not in HEADING:
        node.share = min(map(_name_share, names))


class Reader:
    """Makes the tree of a page; stacks of open elements by name make every step short, however deep the page."""

    def __init__(self) -> None:
        self.root = self.node = Node("#root", None)
        self.opened: dict[str, list[Node]] = {}

    def text(self, text: str) -> None:
        if text:
            self.node.parts.append(references.unescape(text))

    def _close(self, last: Node) -> None:
        """End an open element and all within it."""
        while True:
            node = self.node
            self.opened[node.tag].pop()
            self.node = node.parent
            if node is last:
                return

    def _nearest(self, tag: str) -> Node | None:
        found = self.opened.get(tag)
        return found[-1] if found else None

    def end(self, tag: str) -> None:
        """An end tag closes the nearest open element of its name; inline ones don't cross a block."""
        found = self._nearest(tag)
        if found is not None and (tag in BLOCK or found.depth > self.node.block.depth):
            self._close(found)

    def start(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag in BLOCK:
                self.node.parts.append(Node(tag, self.node))
            elif tag in ("br", "img", "input", "embed"):
                self.node.parts.append(" ")
            return
        if tag in BLOCK:
            if (paragraph := self.node.paragraph) is not None:
                self._close(paragraph)
            if tag in CLOSES:
                ends, within = CLOSES[tag]
                floor = max((n.depth for w in within if (n := self._nearest(w)) is not None), default=0)
                open_ones = [self.opened[e][at] for e in ends if self.opened.get(e) for at in (bisect_right(self.opened[e], floor, key=_depth),) if at < len(self.opened[e])]
                if open_ones:
                    self._close(min(open_ones, key=_depth))
        child = Node(tag, self.node)
        _judge(child, attributes)
        self.node.parts.append(child)
        if tag not in RAW and (tag in BLOCK or not attributes.rstrip().endswith("/")):
            self.opened.setdefault(tag, []).append(child)
            self.node = child


def _depth(node: Node) -> int:
    return node.depth


_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


def parse(page: str) -> Node:
    reader = Reader()
    at, n, done = 0, len(page), 0  # text up to done is in the tree
    closed = 0  # where the next ">" after "<!" is
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            reader.text(page[done:at])
            at = page.find("-->", at + 4)
            done = at = n if at < 0 else at + 3
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            if closed < at:
                closed = page.find(">", at)
                closed = n if closed < 0 else closed
            if closed < n:
                reader.text(page[done:at])
                done = at = closed + 1
            else:
                at += 1
            continue
        m = _TAG.match(page, at) or _PLAIN_TAG.match(page, at)
        if not m:
            at += 1
            continue
        reader.text(page[done:at])
        done = at = m.end()
        tag = m[2].lower()
        if m[1]:
            reader.end(tag)
            continue
        reader.start(tag, m[3])
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            done = at = end.end() if end else n
    reader.text(page[done:])
    return reader.root


def _walk(node: Node):
    """All nodes that are not left out, parents first; a header outside articles is the page's."""
    todo = [node]
    while todo:
        one = todo.pop()
        if one.dropped or one.tag == "header" and not one.article:
            one.dropped = True
            continue
        yield one
        todo.extend(reversed([p for p in one.parts if isinstance(p, Node)]))


def _clean(text: str) -> str:
    return " ".join(text.split())


def blocks(node: Node) -> list[str]:
    """Lines of a node: runs of text between the edges of blocks."""
    lines: list[str] = []
    run: list[str] = []

    def end() -> None:
        if run:
            if line := _clean("".join(run)):
                lines.append(line)
            run.clear()

    todo: list = [node]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            run.append(part)
        elif part is None:
            end()
        elif not part.dropped:
            if part.tag in BLOCK:
                end()
                todo.append(None)
            todo.extend(reversed(part.parts))
    end()
    return lines


def paragraph_points(text: str, linked: int) -> float:
    """Points of a paragraph's text, of which so many characters are in links."""
    points = min(len(text) / 25, 1.0) + len(COMMAS.findall(text)) + min(len(text) / 100, 3.0)
    return points * (1 - min(linked / max(len(text), 1), 1.0))


def _measure(nodes: list[Node]) -> None:
    """Sizes, links and own texts of nodes that are given parents first."""
    inside_link: set[int] = set()
    for node in nodes:
        link = node.tag == "a" or node.parent is not None and id(node.parent) in inside_link
        if link:
            inside_link.add(id(node))
        for part in node.parts:
            if isinstance(part, str):
                block = node.block
                block.own.append(part)
                if link:
                    block.own_linked += len(part.strip())
            elif part.tag in BLOCK:
                node.block.own.append(" ")
    for node in reversed(nodes):
        node.chars += sum(len(p) for p in node.parts if isinstance(p, str) and not p.isspace())
        node.links += node.tag == "a"
        if node.tag == "a":
            node.linked = node.chars
        if (up := node.parent) is not None:
            up.chars += node.chars
            up.linked += node.linked
            up.links += node.links
            up.full = up.full or node.tag in PARAGRAPH


def _judge_named(nodes: list[Node]) -> None:
    """Leave out the parts of articles whose points, lowered for their names, are too few a paragraph."""
    for node in reversed(nodes):
        if node.block is node and (text := _clean("".join(node.own))):
            node.points += paragraph_points(text, node.own_linked)
            node.paragraphs += 1
        if node.share < 1 and node.paragraphs and node.share * node.points < LEAST * node.paragraphs:
            node.dropped = True
            node.points, node.paragraphs = 0.0, 0
        if node.parent is not None:
            node.parent.points += node.points
            node.parent.paragraphs += node.paragraphs


def score(root: Node) -> list[Node]:
    """Points of every container; returns those that have any, in page order."""
    nodes = list(_walk(root))
    _measure(nodes)
    if any(node.share < 1 for node in nodes):
        _judge_named(nodes)
        nodes = list(_walk(root))
    for node in nodes:
        if node.tag not in PARAGRAPH and node.tag not in CONTAINER or node.tag in PARAGRAPH and node.full:
            continue
        text = _clean("".join(node.own))
        if not text:
            continue
        points = node.share * paragraph_points(text, node.own_linked)
        up = node.parent if node.tag in PARAGRAPH else node
        for share in (1.0, 0.5, 0.25, 0.125):
            if up is None:
                break
            up.score += points * share
            up = up.parent
    for node in nodes:
        if node.score:
            node.score *= 1 - node.linked / max(node.chars, 1)
            if node.tag in ("article", "main"):
                node.score = node.score * 1.5 + 5
    return [n for n in nodes if n.score > 0 and n.tag in CONTAINER]


def _drop_link_lists(container: Node) -> None:
    """Leave out blocks of three links or more that are little but links: menus without a name.

    Within an article or main element lists of links belong to the text.
    """
    todo = [container]
    while todo:
        for part in todo.pop().parts:
            if isinstance(part, Node) and not part.dropped and part.tag not in ("article", "main"):
                if part.tag in MENUS and part.chars and part.linked > 0.8 * part.chars and part.links >= 3:
                    part.dropped = True
                else:
                    todo.append(part)


def _article(node: Node) -> Node | None:
    """The nearest article or main element that a node is or lies in: all of it is text that is not dropped."""
    up: Node | None = node
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    return up


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    root = parse(page)
    found = score(root)
    if not found:
        return "\n".join(blocks(root))
    best = max(found, key=lambda n: n.score)  # the first of equals
    like = best.score * 0.2
    least = max(10.0, like)
    best = _article(best) or best
    if best.tag not in ("article", "main"):
        _drop_link_lists(best)
    if best.parent is None:
        return "\n".join(blocks(best))
    lines: list[str] = []
    for part in best.parent.parts:
        if part is best:
            lines += blocks(part)
        elif isinstance(part, Node) and not part.dropped and part.chars:
            density = part.linked / part.chars
            running = part.tag in PARAGRAPH and (part.chars > 80 and density < 0.25 or density == 0 and part.chars > 0 and best.tag not in ("article", "main"))
            similar = part.tag in CONTAINER and part.score >= (like if part.tag == best.tag == "article" else least) and density < 0.25
            if running or similar or part.tag in HEADING and density < 0.25:
                lines += blocks(part)
    return "\n".join(lines)


def extract_pages(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""

    def make():
        def work(batch):
            return {page_id: batch.column(0), url: batch.column(1), "text": [extract(h.as_py()) for h in batch.column(2)]}

        return work

    chosen = pages.select(page_id, F.col(url).cast("string").alias(url), F.col(html).cast("string").alias(html))
    kind = chosen.schema[0].dataType.simpleString()
    return by_batch(chosen, make, f"`{page_id}` {kind}, `{url}` string, text string")
