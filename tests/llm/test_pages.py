"""Main text: long pages, names within articles, and tree scoring against a plain version."""

import random
import time
from html.parser import HTMLParser

import pytest

from pagewright.llm import extract

#: A megabyte or so of what makes a careless parser slow.
LONG = {
    "open tags": "<a " * 340_000,
    "open quotes": "<a \"<a '" * 130_000,
    "nested spans": "<span>" * 160_000 + "x",
    "nested spans and blocks": "<span><div>" * 90_000 + "x",
    "stray end tags": "<span>" * 70_000 + "</b>" * 90_000,
    "items far from their list": "<span>" * 60_000 + "<li>x" * 80_000,
    "loose text in nested blocks": "<div>t, u" * 80_000,
    "nested menus": "<div><a>l</a>" * 60_000,
    "declarations without an end": "<!x" * 300_000,
    "nested headers": "<header><div>" * 60_000 + "x",
}


@pytest.mark.parametrize("name", LONG)
def test_long_pages_take_linear_time(name):
    page = LONG[name]
    start = time.perf_counter()
    extract.extract(page[: len(page) // 4])
    quarter = time.perf_counter() - start
    start = time.perf_counter()
    extract.extract(page)
    assert time.perf_counter() - start < 8 * quarter + 2  # a quadratic one takes 16 times a quarter's


PAGES = {
    '<article><div class="related-work"><p>Prior work, by others, is old and wide, as we know.</p></div></article>': "Prior work, by others, is old and wide, as we know.",
    '<article><p>It cost</p><p class="share-price">forty, in all</p><h2 id="notice">Notice</h2><p>And more, here.</p></article>': "It cost\nforty, in all\nNotice\nAnd more, here.",
    "<article>Hello</article><article>World</article>": "Hello\nWorld",
    "<article><p>a &am<b>p;</b> &amp;amp; <i>&lt;</i></p></article>": "a &amp; &amp; <",
    '<article><p>Long text of the article, with commas, and so on and on.</p><div class="comments"><p>Great article, thanks!</p></div><div class="newsletter">Subscribe now</div><section id="related-posts"><a>One</a> <a>Two</a></section></article>': "Long text of the article, with commas, and so on and on.",
    '<article><header><h1>T</h1></header><div><p>Many words, of many kinds, here.</p></div><ul><li>x</ul><table><tr><td>y</table><div><p>End.</p></div></article>': "T\nMany words, of many kinds, here.\nx\ny\nEnd.",
    '<body><div id="story" data-x="a > b"><p>Text, of a page, without an article.</p></div><div class="promo">Buy</div></body>': "Text, of a page, without an article.",
    "a < b and <3 but not <b": "a < b and <3 but not <b",
    "<p>one<p title='it's>two": "one\ntwo",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert extract.extract(page) == PAGES[page]


def test_of_equal_containers_the_first_is_taken():
    part = "<p>The same text, with commas, in each of the two, and it is long enough to stand for itself.</p>"
    page = f"<body><section><div><section>{part}</section></div><div><section>{part.replace('same', 'very')}</section></div></section></body>"
    assert extract.extract(page).startswith("The same text")


class Plain(HTMLParser):
    """Nested lists [tag, parts, parent] of a well-formed page."""

    def __init__(self, page):
        super().__init__()
        self.root = self.at = ["#root", [], None]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, [], self.at]
        self.at[1].append(node)
        self.at = node

    def handle_endtag(self, tag):
        self.at = self.at[2]

    def handle_data(self, data):
        self.at[1].append(data)


def text_of(node, *, own=False, links=False):
    """Text of a node; own: not that of blocks within it; links: only what stands in links."""
    out = []
    for part in node[1]:
        if isinstance(part, str):
            if not links or node[0] == "a":
                out.append(part)
        elif not (own and part[0] in extract.BLOCK):
            out.append(text_of(part, own=own, links=links and part[0] != "a"))
    return "".join(out)


def nodes_of(node):
    yield node
    for part in node[1]:
        if not isinstance(part, str):
            yield from nodes_of(part)


def solid(text):
    return " ".join(text.split())


def lines(node):
    """A line for each block's run of text."""
    out, run = [], []

    def go(one):
        for part in one[1]:
            if isinstance(part, str):
                run.append(part)
            else:
                if part[0] in extract.BLOCK:
                    end()
                go(part)
                if part[0] in extract.BLOCK:
                    end()

    def end():
        if solid("".join(run)):
            out.append(solid("".join(run)))
        run.clear()

    go(node)
    end()
    return out


def plain_extract(page):
    """Points of paragraphs passed to ancestors, discounted by links; the best container and siblings like it."""
    root = Plain(page).root
    every = list(nodes_of(root))
    points = {id(n): 0.0 for n in every}
    for n in every:
        own = solid(text_of(n, own=True))
        if n[0] not in ("p", "div", "section", "body") or not own:
            continue
        linked = len(text_of(n, own=True, links=True))
        worth = (min(len(own) / 25, 1) + own.count(",") + min(len(own) / 100, 3)) * (1 - linked / len(own))
        up = n[2] if n[0] == "p" else n
        for share in (1, 0.5, 0.25, 0.125):
            if up is not None:
                points[id(up)] += worth * share
                up = up[2]
    density = lambda n: len(text_of(n, links=True)) / max(len(text_of(n)), 1)
    score = {id(n): points[id(n)] * (1 - density(n)) for n in every}
    found = [n for n in every if score[id(n)] > 0 and n[0] in ("div", "section", "body")]
    if not found:
        return "\n".join(lines(root))
    best = max(found, key=lambda n: score[id(n)])
    out = []
    for part in best[2][1]:
        if part is best:
            out += lines(part)
        elif not isinstance(part, str) and text_of(part):
            if density(part) < 0.25 and (part[0] == "h2" or part[0] == "p" and (len(text_of(part)) > 80 or density(part) == 0) or part[0] in ("div", "section") and score[id(part)] >= max(10, 0.2 * score[id(best)])):
                out += lines(part)
    return "\n".join(out)


def test_scores_are_those_of_a_plain_version():
    """Pages without an article element, names or menus of links: what stays is decided by scores."""
    rng = random.Random(21)

    def words(n):
        return "".join(rng.choice(["a", "word,", "of", "the", "longest,", "kind"]) + "-" for _ in range(n)).strip("-") or "x"

    def part(depth):
        kind = rng.random()
        if kind < 0.45 or depth > 4:
            link = f"<a>{words(rng.randrange(1, 12))}</a>" if rng.random() < 0.25 else ""
            return f"<p>{words(rng.randrange(1, 40))}{link}</p>"
        if kind < 0.55:
            return f"<h2>{words(3)}</h2>"
        tag = rng.choice(["div", "section"])
        loose = words(rng.randrange(1, 20)) if rng.random() < 0.2 else ""
        return f"<{tag}>{loose}{''.join(part(depth + 1) for _ in range(rng.randrange(1, 5)))}</{tag}>"

    differ = 0
    for _ in range(400):
        page = f"<body>{''.join(part(0) for _ in range(rng.randrange(1, 6)))}</body>"
        differ += extract.extract(page) != plain_extract(page)
        if differ:
            print(page, "\n", extract.extract(page), "\n", plain_extract(page))
            break
    assert not differ
