"""HTML extraction: what attributes may and may not leave out."""

from __future__ import annotations

import pytest

from pairloom.llm import html_extract

STORY = "<p>The story goes on.</p>"


def text_of(page: str) -> str:
    return html_extract.extract(page, html_extract.slots(html_extract.shape(page)))


@pytest.mark.parametrize("attributes", [
    'style="overflow-x:hidden"', 'aria-hidden="false"', 'class="post overflow-hidden"', 'class="content has-sidebar"',
    'id="no-sidebar"', 'data-id="ad"', 'title="not hidden"', "data-x='class=\"ad\"'",
])
@pytest.mark.parametrize("tag", ["body", "main", "article", "div"])
def test_loose_words_leave_nothing_out(tag, attributes):
    assert text_of(f"<html><{tag} {attributes}>{STORY}</{tag}></html>") == "The story goes on."


@pytest.mark.parametrize("attributes", [
    "hidden", 'hidden=""', 'aria-hidden="true"', 'class="ad"', 'class="x sidebar"', 'id="main-nav"', 'class="cookie-notice"',
    'class="sidebar_left"', 'class="ad-300x250"', 'class="related-posts"', 'role="navigation"', 'itemprop="comment"', 'class="hidden"',
])
def test_names_and_listed_compounds_are_left_out(attributes):
    assert text_of(f"<body><div {attributes}>Other</div><div>{STORY}</div></body>") == "The story goes on."


@pytest.mark.parametrize("attributes", ['<div class="page sidebar">', "<div hidden>", "<form>", '<div class="notice"><div class="x widget">'])
@pytest.mark.parametrize("container", ["article", "main", "div itemprop=articleBody"])
def test_what_encloses_the_container_stays(attributes, container):
    page = f"<body><div class=ad>Buy</div>{attributes}<{container}>{STORY}<div class=ad>More</div></{container.split()[0]}>"
    assert text_of(page) == "The story goes on."


@pytest.mark.parametrize("around", ["<div class=comments>", "<aside>", "<div class=related-posts>"])
def test_other_articles_stay_out(around):
    assert text_of(f"<body><div>{STORY}</div>{around}<article>Other</article><article>Another</article>") == "The story goes on."
    assert text_of(f"<body><article>{STORY}</article><div class=sidebar><article>Other</article></div>") == "The story goes on."


def test_math_and_custom_elements_keep_their_text():
    page = "<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds.</p><svg-box>Seen</svg-box><svg>no</svg></article>"
    assert text_of(page) == "So x=1 holds. Seen"
