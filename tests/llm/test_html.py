"""Main text: against the articles that a plain parser reads, from the distribution alone, and on markup that is broken."""

from __future__ import annotations

import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from tests.conftest import SF
from tidewater.llm import html
from tidewater.llm.common import table

BLOCKS = ("p", "h1", "article", "div", "li", "ul")


class Articles(HTMLParser):
    """The blocks inside the elements that these pages mark as the article."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.part, self.blocks = False, "", []
        self.feed(page)
        self.close()

    def end(self):
        if self.inside and self.part.split():
            self.blocks.append(" ".join(self.part.split()))
        self.part = ""

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.end()
        self.part += "\n" if tag == "br" else ""
        self.inside |= tag == "article"

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.end()
        self.inside &= tag != "article"

    def handle_data(self, data):
        self.part += data


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in table(spark, SF, "pages").collect()]


def test_marked_articles_are_those_of_a_plain_parser(pages):
    assert all(html.main_text(p) == "\n".join(Articles(p).blocks) for p in pages)


def test_the_distribution_alone_finds_articles(pages):
    """Without any element or word that tells the article, lengths and links of lines do."""
    ours, theirs = Counter(), Counter()
    for i, p in enumerate(pages):
        bare = re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", p).replace(' class="ad"', "")
        ours.update((i, x) for x in html.main_text(bare).split("\n"))
        theirs.update((i, x) for x in Articles(p).blocks)
    size = lambda c: sum(len(k[1]) * n for k, n in c.items())
    assert size(ours & theirs) >= 0.98 * size(theirs) and size(ours & theirs) >= 0.9 * size(ours)


@pytest.mark.parametrize("tag", ["article", "div"])
@pytest.mark.parametrize("name", ["post has-sidebar", "entry-content social-media", "post comments-open", "article hidden-gems", "tag-search format-standard"])
def test_a_class_does_not_lose_the_article(tag, name):
    body = "<h1>Title</h1>" + "".join(f"<p>{'word ' * 60}</p>" for _ in range(4)) + "<p>End.</p>"
    comments = f"<div class='comment-list'><p>{'nice ' * 400}</p></div>"
    text = html.main_text(f"<body><nav><a href=x>home</a></nav><{tag} class='{name}'>{body}</{tag}>{comments}</body>")
    assert text.startswith("Title\nword") and text.endswith("End.") and "nice" not in text.split() or name.startswith("tag-search") and tag == "div"


def test_a_small_mark_does_not_beat_the_text():
    page = f"<article><p>Teaser.</p></article><div><p>{'long ' * 90}</p><p>Short.</p></div>"
    assert html.main_text(page).split("\n")[-1] == "Short." and "long" in html.main_text(page)


def test_runs_are_parted_by_empty_windows():
    import numpy as np

    assert html.runs(np.array([5, 200, 0, 7, 0, 0, 0, 9, 300, 4]), 3, 100) == [(0, 4, 207), (7, 10, 313)]
    assert html.runs(np.array([2, 2, 2, 2, 300, 1, 1, 1]), 3, 100) == [(2, 7, 304)]
    assert html.runs(np.array([0, 0]), 3, 100) == [] == html.runs(np.array([]), 3, 100) and html.runs(np.array([7]), 3, 100) == [(0, 1, 7)]


@pytest.mark.parametrize(
    "bad",
    ["<p>ok</p><a " + '"a"' * 100_000, "<script " * 100_000, "<p>ok</p>" + '<a x="' * 100_000, "<!--" * 100_000, "<a x='\"" * 50_000 + ">", "<div>" * 20_000 + "</p>" * 20_000,
     "<b class=ad><div>" + "<i class=ad>" * 5000 + "</b>" * 5000, "<p class='" + "a-" * 100_000 + "'>x", "<" * 100_000, "<style>" * 50_000, "<a b='c' " * 50_000],
)
def test_broken_markup_takes_time_in_proportion(bad):
    began = time.process_time()
    assert html.main_text(bad)[:2] in ("", "ok", "x", "<<")
    assert time.process_time() - began < 1.5


@pytest.mark.parametrize("name", sorted({*html.BLOCK, *html.VOID, *html.FURNITURE, *html.WRAPPERS, *html.RAW, "head", "a", "b", "span"}))
def test_an_element_that_repeats_without_end(name):
    for bad in (f"<{name}>" * 50_000, f"<{name} class='comments'>x" * 20_000):
        began = time.process_time()
        html.main_text(bad)
        assert time.process_time() - began < 4


BODY = "<h1>Title</h1>" + "".join(f"<p>{'word ' * 60}</p>" for _ in range(4)) + "<p>End.</p>"


@pytest.mark.parametrize("name", ["user-comments", "comments-2", "related-posts", "share-buttons", "ad-slot-300"])
def test_furniture_inside_an_article_goes(name):
    text = html.main_text(f"<body><article>{BODY}<div class='{name}'><p>{'nice ' * 80}</p></div></article></body>")
    assert text.startswith("Title\nword") and text.endswith("End.") and "nice" not in text


@pytest.mark.parametrize("page", ["<form><nav>home about</nav><article>{}</article><input></form>", "<noscript><main>{}</main></noscript>", "<nav><a href=x>home</a><article>{}</article>", "<form action=x><div>{}</div></form>"])
def test_no_wrapper_loses_the_article(page):
    text = html.main_text("<body>" + page.format(BODY) + "</body>")
    assert text.startswith("Title\nword") and text.endswith("End.") and "home" not in text


def test_small_forms_go():
    text = html.main_text(f"<body><article>{BODY}<form><p>{'subscribe ' * 40}</p></form></article><form><p>{'search ' * 60}</p></form></body>")
    assert text.endswith("End.") and "subscribe" not in text and "search" not in text
