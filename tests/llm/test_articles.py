"""All of an article is its text, however its parts are wrapped and scored."""

import pytest

from pagewright.llm import extract

LONG = "A long enough paragraph, with commas, and some more words, so that the wrapper beats what it lies in. " * 3
MANY = "".join(f"<p>{i} {LONG}</p>" for i in range(6))
PARTS = f"<header><h1>Title</h1></header><div>{MANY}</div><ul><li>one<li>two</ul><table><tr><td>cell</table><div><p>Short end.</p></div>"
LINES = ["Title", *[f"{i} {LONG.strip()}" for i in range(6)], "one", "two", "cell", "Short end."]


@pytest.mark.parametrize("tag", ["article", "main"])
def test_article_is_kept_whole(tag):
    page = f"<body><div class='nav-bar'><a>Home</a></div><{tag}>{PARTS}<aside>no</aside></{tag}><footer>f</footer></body>"
    assert extract.extract(page).split("\n") == LINES


def test_nested_wrappers_of_an_article():
    assert extract.extract(f"<article><div><section>{PARTS}</section></div><p>Last.</p></article>").split("\n") == [*LINES, "Last."]


def test_threshold_holds_outside_articles():
    page = f"<body><div><article>{PARTS}</article><div><p>Aside, short.</p></div></div></body>"
    assert extract.extract(page).split("\n") == LINES
