"""Wrapper inference decides what the article is: by text that varies, names only break ties."""

from __future__ import annotations

import os
import random
import re
import time
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from pairloom.llm import html_extract as H
from tests.llm.helpers import CLASHES

SF = "/root/testdata/sf0.1"


def host_texts(pages: list[str]) -> list[str]:
    """The pages of one host, extracted without Spark."""
    wrapper = H.shape(pages[0])
    for page in pages[1:]:
        H.merge(wrapper, H.shape(page))
    found = H.slots(wrapper)
    return [H.extract(p, found) for p in pages]


def by_host(rows: list[tuple[str, str]]) -> dict[int, str]:
    hosts = defaultdict(list)
    for i, (url, page) in enumerate(rows):
        hosts[re.sub(r"^.*?://", "", url).split("/")[0].lower()].append((i, page))
    return {i: text for pages in hosts.values() for (i, _), text in zip(pages, host_texts([p for _, p in pages]))}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("box", ["<div>", '<div class="x">'])
def test_neutral_names_leave_the_text_as_it_is(box):
    rows = duckdb.sql(f"SELECT url, html FROM '{SF}/pages.parquet'").fetchall()

    def neutral(page: str) -> str:
        page = re.sub(r"<(?:article|main)\b[^>]*>", box, re.sub(r"</(?:article|main)>", "</div>", page))
        return re.sub(r'\b(class|id)="[^"]*"', r'\1="x"', page)

    plain, renamed = by_host(rows), by_host([(u, neutral(p)) for u, p in rows])
    # What the article elements of these pages hold, read apart from the wrappers.
    articles = {}
    for i, (_, page) in enumerate(rows):
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        articles[i] = " ".join(H.html.unescape(re.sub(r"</?(?:p|h\d|br)[^>]*>", "\n", inner).replace("<b>", "").replace("</b>", "")).split())
    same = sum(plain[i] == re.sub(r"<[^>]*>", "", articles[i]) or "<" in articles[i] for i in plain)
    assert same >= 0.99 * len(rows)
    assert sum(plain[i] == renamed[i] for i in plain) >= 0.95 * len(rows)


def test_a_constant_article_is_kept():
    pages = [f"<body><div>The story stays the same and is long enough to matter.</div><span>{i}</span><p>{i}</p></body>" for i in range(5)]
    assert all(t.startswith("The story stays the same") for t in host_texts(pages))
    assert host_texts(["<body><div><p>One and the same.</p></div></body>"] * 4) == ["One and the same."] * 4


def test_what_a_template_repeats_goes():
    pages = [
        f"<body><div class=c><h2>Title {i}</h2><p>Text of page {i} that goes on and on.</p><div class=z>Read by many people</div></div></body>"
        for i in range(5)
    ]
    assert host_texts(pages) == [f"Title {i} Text of page {i} that goes on and on." for i in range(5)]
    assert "Read by many people" in host_texts(pages[:2])[0]  # two pages are no template


def test_the_larger_part_is_the_article_and_names_break_ties():
    links = "".join(f"<a href=/{i}>link number {i} of the whole site</a> " for i in range(20))
    pages = [
        f"<body><div class=a>{links}</div><div class=b>Teaser {i}.</div><div class=c><div class=d><h1>Head {i}</h1>"
        f"<p>{' '.join(f'word{i}x{k}' for k in range(30))}</p></div></div></body>"
        for i in range(4)
    ]
    assert all(t.startswith(f"Head {i} word{i}x0") and "Teaser" not in t and "link" not in t for i, t in enumerate(host_texts(pages)))
    tied = [f"<body><div class=a><p>First text {i} here.</p></div><div class=content><p>Other text {i} here.</p></div></body>" for i in range(4)]
    assert host_texts(tied) == [f"Other text {i} here." for i in range(4)]


def common(x: list, y: list) -> int:
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("limit", [1 << 18, 0])
def test_alignment(monkeypatch, limit):
    """Against the longest common subsequence; beyond the limit only order and completeness hold."""
    monkeypatch.setattr(H, "ALIGNED_PAIRS", limit)
    rng = random.Random(limit)
    for _ in range(200):
        x, y = ([rng.choice("abcdefgh") for _ in range(rng.randrange(12))] for _ in range(2))
        a, b = ([[n] for n in seq] for seq in (x, y))
        pairs = H.align(a, b)
        assert [p[0] for p in pairs] != [None] or not a
        assert [n for n, _ in pairs if n] == a and [n for _, n in pairs if n] == b
        assert all(m[0] == n[0] for m, n in pairs if m and n)
        matched = sum(bool(m and n) for m, n in pairs)
        assert matched == common(x, y) if limit else matched <= common(x, y)


@pytest.mark.parametrize("attribute", ['id="a{i}q{k}z"', 'class="{c}"'])
def test_very_many_siblings(attribute):
    rng = random.Random(1)
    pages = []
    for k in range(2):
        names = ["".join(rng.choices("abcdefgh", k=8)) for _ in range(20_000)]
        pages.append("<body>" + "".join(f"<p {attribute.format(i=chr(97 + i % 26) + str(i), k=k, c=n)}>word {i}</p>" for i, n in enumerate(names)) + "</body>")
    start = time.perf_counter()
    texts = host_texts(pages)
    assert time.perf_counter() - start < 60
    assert texts == [" ".join(f"word {i}" for i in range(20_000))] * 2


def test_wrappers_of_many_tasks(spark, monkeypatch):
    """As many levels of merging as it takes, the same wrapper as in one task."""
    monkeypatch.setattr(H, "BLOCK", 2)
    rows = [(i, f"http://h{i % 2}.net/", f"<body><div class=ad>Ad {i}</div><div><h1>T{i}</h1><p>Text {i}</p>{'<p>more</p>' * (i % 3)}</div></body>") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(c) for c in CLASHES if c != "text"})
    got = {r["page_id"]: r["text"] for r in H.main_text(df.repartition(9)).collect()}
    assert got == {i: f"T{i} Text {i}" + " more" * (i % 3) for i in range(40)}
