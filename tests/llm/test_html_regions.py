"""What the clusters decide, pages that crash or starve a parser, and whole articles of the given pages."""

import html
import re
import time

import numpy as np
import pyarrow.parquet as pq
import pytest

from folio.llm.html_text import dense, extract

LONG = "word " * 80
ALL = lambda chars, tags: np.ones(len(chars), bool)


def test_clusters_decide_what_a_frame_is():
    rows = "".join(f"<p><b>{k}</b> <i>short</i> <u>line</u></p>" for k in range(200))
    page = f"<body><div>{rows}</div><div class='share'><p>{LONG}</p><p>{LONG}</p></div></body>"
    assert LONG.strip() in extract(page) and LONG.strip() not in extract(page, clusters=ALL)


@pytest.mark.parametrize("text", [f"<main><div class='post-content share-story'><p>{LONG}</p></div></main>", f"<nav><a href=/>x</a></nav><section class='social-policy'><p>{LONG}</p></section>", f"<form><p>{LONG}</p><input></form>"])
def test_articles_with_words_of_frames(text):
    assert extract(f"<body>{text}<footer>f</footer></body>") == LONG.strip()


@pytest.mark.parametrize("name", ["ad", "side-bar sidebar", "cookieBanner", "page-footer", "comments", "newsletter-signup-form", "share-buttons"])
def test_frames_by_class(name):
    assert extract(f"<body><article><p>{LONG}</p></article><div class='{name}'><p>{LONG * 3}</p></div></body>") == LONG.strip()


def test_headings_of_an_articles_header_stay():
    assert extract(f"<body><header><h1>Site</h1></header><article><header><h1>Title</h1><p>by me</p></header><p>{LONG}</p></article></body>") == f"Title {LONG.strip()}"


@pytest.mark.parametrize("page, text", [("<p>a</p><![foo[bar]]><p>hello", "a hello"), ("<p>a<![CDATA[x]]>b", "ab"), ("<p>a</p><?php x ?><!ELEMENT y><p>b", "a b"), ("<![", "<!["), ("\x00<p>a", "\x00 a"), ("<>a</>b", "<>ab")])
def test_odd_markup(page, text):
    assert extract(page) == text


def test_deep_pages():
    began = time.process_time()
    assert extract("<div>" * 20_000 + "".join(f"<p>line {k} of text</p>" for k in range(2_000))).startswith("line 0 of text line 1")
    assert time.process_time() - began < 5


def test_clusters_of_equal_lines():
    assert dense([10, 10, 10], [1, 1, 1]).all() and dense([5], [3]).all()


def test_whole_articles_of_the_given_pages():
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        if page and (m := re.search(r"(?s)<article>(.*?)</article>", page)):
            assert extract(page) == " ".join(html.unescape(re.sub(r"</?(?:p|br|h1)[^>]*>", " ", m[1]).replace("<b>", "").replace("</b>", "")).split())


SHORT = "A line of a few words"
BESIDE = {
    "advert": f"<div>{SHORT}</div>",
    "discussion": f"<div id='discussion'><p>{SHORT}</p><p>I agree</p></div>",
    "rail": f"<div class='rail'><a href='/x'>Teaser</a> {SHORT}</div>",
    "slot": f"<div class='ad-slot-42x'>{SHORT}</div>",
}


@pytest.mark.parametrize("name", BESIDE)
@pytest.mark.parametrize("frame", ["main", "article", "div", "div><div"])
def test_short_regions_beside_the_text_go(name, frame):
    text = f"<h1>Head</h1><p>{LONG}</p><p>Short.</p><ul><li>one</li><li>two</li></ul><p>{LONG}</p>"
    close = "</div></div>" if "><" in frame else f"</{frame}>"
    for page in (f"<body><{frame}>{text}{close}{BESIDE[name]}</body>", f"<body>{BESIDE[name]}<{frame}>{text}{close}</body>"):
        assert extract(page) == f"Head {LONG.strip()} Short. one two {LONG.strip()}"


def given():
    return [page for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist() if page]


def test_other_clusters_give_other_texts():
    random, pages = np.random.default_rng(7), given()
    texts = [extract(page) for page in pages]
    share = lambda clusters: sum(extract(p, clusters) != t for p, t in zip(pages, texts)) / len(pages)
    assert share(ALL) > 0.9
    assert share(lambda ratios, sizes: ~dense(ratios, sizes)) > 0.9
    assert share(lambda ratios, sizes: random.random(len(ratios)) < 0.5) > 0.4


def test_without_words_of_frames(monkeypatch):
    pages = given()
    texts = [extract(page) for page in pages]
    monkeypatch.setattr("folio.llm.html_text.HINTS", frozenset())
    assert sum(extract(p) != t for p, t in zip(pages, texts)) <= len(pages) / 10


@pytest.mark.parametrize("page", ["<div></b>" * 20_000 + "</i>" * 20_000 + "x", "<b>" * 20_000 + "x<br>" * 20_000, "<p><button>" + "<b>" * 20_000 + "<hr>" * 20_000 + "x"])
def test_stray_tags_are_linear(page):
    began = time.process_time()
    extract(page)
    assert time.process_time() - began < 4
