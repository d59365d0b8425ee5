"""Operators that judge each row alone: quality rules, URL filter, token counts, HTML extraction."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairloom.llm import html_extract, quality_rules, token_counts, url_filter
from tests.llm.helpers import CLASHES, awkward, frame, prose, words


def base_counts(text):
    w = words(text)
    windows = [" ".join(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    hit = {p for i, x in enumerate(windows) if often[x] > 1 for p in range(i, i + 8)}
    full = [line for line in (text or "").split("\n") if words(line)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(full) - len(set(full)), "n_repeat_words": len(hit),
    }


def test_quality_base_matches_brute_force(spark):
    rows = awkward() + [(200, "a b c d e f g h i " * 5 + "x\nx\n\nx", "en", "s", 1), (201, "a b c d e f g\n" * 9, "en", "s", 1)]
    found = quality_rules.evaluate(frame(spark, rows, clashes=True), into="quality").collect()
    assert len(found) == len(rows)
    for r in found:
        assert {k: r["quality"][k] for k in base_counts(r["text"])} == base_counts(r["text"])
        q = r["quality"]
        assert q["base_failed"] == (q["n_words"] < 20 or 100 * q["n_repeat_words"] > 30 * q["n_words"])
        assert not (q["kept"] and q["base_failed"])
        assert all(r[c] == f"<{c}>" for c in CLASHES)


def test_quality_line_rules(spark):
    good = prose(1, 60)
    junk = " ".join(f"w{i}###" for i in range(60))
    shout = " ".join(f"WORD{i}!!" for i in range(60))
    menu = " | ".join(f"item{i}" for i in range(60))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([
        good, good + "\n" + junk, shout + "\n" + good, menu + "\n" + good, good + "\nAll rights reserved.", good + "\nHome",
        "Read more\n" + good + "\nsee our privacy policy, which says: " + prose(2, 40).replace("\n", " "),
    ])]
    out = {r["doc_id"]: r for r in quality_rules.evaluate(frame(spark, rows)).collect()}
    assert [out[i]["quality"]["kept"] for i in range(7)] == [True, False, False, False, True, True, True]
    assert out[0]["quality"]["clean_text"] == good
    assert all(out[i]["quality"]["clean_text"] == good for i in (1, 2, 3, 4, 5))
    assert out[6]["quality"]["clean_text"] == rows[6][1].split("\n", 1)[1]
    kept = {r["doc_id"]: r["text"] for r in quality_rules.keep_clean(frame(spark, rows, clashes=True)).collect()}
    assert kept == {i: out[i]["quality"]["clean_text"] for i in (0, 4, 5, 6)}


def test_quality_empty_table(spark):
    empty = frame(spark, [])
    assert quality_rules.evaluate(empty).count() == 0 and quality_rules.keep_clean(empty).count() == 0


URLS = [
    "http://a.example.org/en/1x", "https://Example.ORG/es/?q", "https://x.org", "https://x.org/", "ftp://b.com/fr/a#x", "http://b.com/de/",
    "http://bcom/de/", "no scheme casino", None, "", "://", "http://h?://casino/x", "http://casino.net/", "http://casinos.net/",
    "http://cheap-pills.net/", "http://cheap.net/cheap/", "http://free.net/a/bets?x=casino", "http://xn--casino1.net/", "http://a\nb.net/casino",
    "http://x.net/go?cat=casino", "http://x.net/#PORN", "casino.net/porn", "http://x.net/free%20bet", "http://x.net/%63asino", "http://x.net/%FFcasino",
    "http://x.net/%zzcasino%", "http://x.org/?casino", "http://x.net/a?b=" + "y" * 50_000 + "&casino",
]


def test_url_rules_and_terms(spark):
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(URLS)] * 2, "page_id long, url string, d string")
    got = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    assert df.count() == url_filter.judge(df).count()
    hosts = [got[i]["host"] for i in range(len(URLS))]
    assert hosts[:6] == ["a.example.org", "example.org", "x.org", "x.org", "b.com", "b.com"]
    assert hosts[7:12] == ["", "", "", "", "h"]
    assert [got[i]["path"] for i in (0, 1, 2, 3, 4, 11, 16)] == ["/en/1x", "/es/", "", "/", "/fr/a", "", "/a/bets"]
    assert [got[i]["rule"] for i in range(7)] == ["example.org/en/1", "example.org/es/", None, "org/", "com/fr/", "com/de/", None]
    assert [got[i]["verdict"] for i in range(19)] == (
        ["block", "block", "allow", "allow", "allow", "block", "allow", "block", "allow", "allow", "allow", "block"]
        + ["block", "allow", "block", "allow", "block", "allow", "block"]
    )
    assert [got[i]["verdict"] for i in range(19, 28)] == ["block"] * 5 + ["allow", "allow", "allow", "block"]


def reference_tokenizer():
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, models

    m = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    vocab = [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]
    return Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))


def test_token_counts_are_the_tokenizers(spark):
    tokenizer = reference_tokenizer()
    extra = ["  two  spaces ", "日本語テキスト", "😀😀 x", "a\nb\n\nc", "\n", " ", "é́", "▁▁a", "aaaa" * 30, "<0x0A>", "<s>", "x" * 3000]
    rows = awkward() + [(300 + i, t, "en", "s", 0) for i, t in enumerate(extra)]
    out = token_counts.count_tokens(frame(spark, rows, clashes=True)).collect()
    assert len(out) == len(rows)
    for r in out:
        text = r["text"] or ""
        expected = len(tokenizer.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0
        assert r["n_tokens"] == expected, text[:50]
    assert token_counts.count_tokens(frame(spark, [])).count() == 0


def test_token_ties_and_unknown_runs():
    counter = token_counts.UnigramCounter({"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -2.0, "c▁": -9.0}, byte_pieces=False)
    assert not counter.by_word
    assert counter.count("ab") == 2  # ▁, ab: as good as ▁, a, b, and starts first
    assert counter.count("xyz") == 2  # one unknown run
    assert counter.count("axxb") == 4


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><nav><ul>{menu}</ul></nav>
<!-- ad --><div class="ad">Buy {n}</div><div class="cookie-notice">We use cookies</div><article><h1>Title {n}</h1>{body}
<form><input name=q>Search</form><section class="comments"><p>Reader {n}</p></section></article><aside>Side {n}</aside>
<footer>&copy; host</footer><script>var t = "</p><p>no</p>";</script></body></html>"""


def page(n: int) -> tuple[str, str]:
    body = "".join(f"<p><b>Par {n}.{i}</b> a &amp; b&nbsp;c<br>d" + ("</p>" if i % 2 else "") for i in range(n % 4 + 1))
    text = f"Title {n} " + " ".join(f"Par {n}.{i} a & b c d" for i in range(n % 4 + 1))
    return PAGE.format(n=n, body=body, menu="".join(f"<li><a href=/>m{i}</a></li>" for i in range(n % 3 + 1))), text


def test_html_main_text(spark):
    pages = [page(n) for n in range(12)]
    rows = [(n, f"http://h{n % 2}.net/{n}", p) for n, (p, _) in enumerate(pages)]
    rows += [(100, None, None), (101, "", ""), (102, "x", "plain text < 3 &lt; 4"), (103, "http://h0.net/", "<p>unclosed <div"), (0, *rows[0][1:])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(c) for c in ("d", "host", "of", "slots")})
    out = html_extract.main_text(df).collect()
    assert len(out) == len(rows)
    got = {r["page_id"]: r["text"] for r in out}
    assert [got[n] for n in range(12)] == [t for _, t in pages]
    assert got[100] == got[101] == "" and got[102] == "plain text < 3 < 4"
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_html_without_a_container(spark):
    def bare(n):
        links = "".join(f"<a href=/{i}>link {i} of {n}</a> " for i in range(5))
        return f"<body><div>Site name</div><div class=x>{links}</div><div class=y>Story {n} goes on and on.</div><table><tr><td>Cell {n}</table></body>"

    df = spark.createDataFrame([(n, "http://b.net/", bare(n)) for n in range(5)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(df).collect()}
    assert got == {n: f"Story {n} goes on and on. Cell {n}" for n in range(5)}


def test_wrappers_fold_and_align():
    a = html_extract.shape("<ul><li>1<li>2<li>3</ul><p>x</p>")
    b = html_extract.shape("<ul><li>9</ul><h2>t</h2><p>y</p>")
    html_extract.merge(a, b)
    names = [(k[html_extract.NAME], k[html_extract.OPTIONAL]) for k in a[html_extract.KIDS]]
    assert names == [("ul", 0), ("h2", 1), ("p", 0)]
    ul = a[html_extract.KIDS][0]
    assert [(k[html_extract.NAME], k[html_extract.REPEATED], k[html_extract.VARIES]) for k in ul[html_extract.KIDS]] == [("li", 1, 1)]
    tables = html_extract.shape("<dl>" + "<dt>a<dd>b" * 4 + "</dl>")
    assert [k[html_extract.NAME] for k in tables[html_extract.KIDS][0][html_extract.KIDS]] == ["dt", "dd"]


@pytest.mark.parametrize("junk", ["<" * 2000, "<a b='" * 500, "<!--" + "x" * 1000, "<div>" * 3000 + "deep", "</p>" * 500, "<script>" * 300])
def test_html_survives_junk(junk):
    wrapper = html_extract.shape(junk)
    assert isinstance(html_extract.extract(junk, html_extract.slots(wrapper)), str)
    assert not re.search(r"<script>", html_extract.extract(junk, html_extract.slots(wrapper)))
