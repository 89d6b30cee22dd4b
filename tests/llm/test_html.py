"""Main text of pages: fixtures with known main texts, and the generated pages against their article element."""

from __future__ import annotations

import html
import re
from collections import Counter

from citeloom import ship
from citeloom.llm import htmltext

SF = "/root/testdata/sf0.001"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><article>no</article>";</script></head><body class="post">
<header class="site-header"><a href="/">Home</a></header><nav><ul><li>One<li>Two</ul></nav><div id="cookie-notice"><p>We use cookies</p></div>
<main><article class="post"><header><h1>Title &amp; more {n}</h1></header><p>First   <b>bold</b>&nbsp;text {n}.<br>Same block<p>Second &lt;tag&gt; para<ul><li>item a<li>item b</ul>
<aside>Related things</aside><div class="ad-banner">Buy</div><form><label>Name</label><input name=x></form><table><tr><td>c1<td>c2</table><pre>code
 line</pre><section class="comments"><article class="comment"><p>nice!</p></article></section></article></main><div class="sidebar"><p>side</p></div><footer>&copy; x<p>foot"""
EXPECTED = "Title & more {n}\nFirst bold text {n}. Same block\nSecond <tag> para\nitem a\nitem b\nc1\nc2\ncode line"


def test_fixture_pages(spark):
    ship(spark)
    rows = [(i, f"https://Host.example/{i}", PAGE.format(n=i)) for i in range(6)]
    rows += [(90, None, None), (91, "", ""), (92, "nonsense", "just text & more"), (93, "http://h/", "<article>open <b>never closed"), (94, "http://h/", "<!-- <article>x</article> --><p>a<p>b"), (95, "http://h/", '<p title="a>b">q</p><' + "p" * 50)]
    rows += [(None, "http://h/", "<main>m</main>"), (0, "https://Host.example/0", PAGE.format(n=0)), (96, "http://big/", "<article>" + "<p>w &eacute;</p>" * 20_000 + "</article>")]
    pages = spark.createDataFrame([(*r, "clash", 1, []) for r in rows], "page_id long, url string, html string, page string, row int, template array<int>")
    got = {}
    for r in htmltext.extract(pages).collect():
        assert r["n_chars"] == len(r["text"])
        got.setdefault(r["page_id"], []).append(r["text"])
    assert all(got[i] == [EXPECTED.format(n=i)] * (2 if i == 0 else 1) for i in range(6))
    assert got[90] == [""] and got[91] == [""] and got[92] == ["just text & more"]
    assert got[93] == ["open never closed"] and got[94] == ["a\nb"] and got[None] == ["m"]
    assert got[95][0].startswith("q") and got[96] == ["\n".join(["w é"] * 20_000)]
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_template_text_goes_without_article(spark):
    ship(spark)
    page = "<html><body><div><p>Welcome to our site</p></div><div><p>Content number {n} of this page</p></div><div><p>All rights reserved</p></div></body></html>"
    rows = [(i, f"http://plain.example/{i}", page.format(n=i)) for i in range(8)]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {f"Content number {i} of this page" for i in range(8)}


def test_generated_pages(spark):
    ship(spark)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in htmltext.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]
        blocks = re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))
        assert got[r["page_id"]] == "\n".join(x for b in blocks if (x := " ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split())))


def _texts(spark, rows):
    return {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_template_text_goes_inside_article(spark):
    ship(spark)
    page = '<html><body><article id="post-{n}"><h1>Title {n}</h1><div class="zz-box"><p>Get our weekly letter</p></div><p>{own} of page {n}.</p></article></body></html>'
    rows = [(i, f"http://inside.example/{i}", page.format(n=i, own="Own words and more words")) for i in range(12)]
    assert _texts(spark, rows) == {i: f"Title {i}\nOwn words and more words of page {i}." for i in range(12)}


def test_near_copies_keep_their_article(spark):
    ship(spark)
    page = "<html><body><article><h1>One title</h1>" + "".join(f"<p>Paragraph {k} of one article.</p>" for k in range(12)) + "<p>Visit {n}</p></article></body></html>"
    got = _texts(spark, [(i, f"http://near.example/{i}", page.format(n=i)) for i in range(12)])
    assert all(t.count("\n") == 13 and t.startswith("One title\nParagraph 0") for t in got.values())


def test_copies_count_once_without_article(spark):
    ship(spark)
    page = "<html><body><div><p>{a}</p></div><div><p>{b}</p></div></body></html>"
    rows = [(i, f"http://mirror.example/{i}", page.format(a="The copied article", b="has two parts")) for i in range(5)]
    rows += [(9, "http://mirror.example/9", page.format(a="Another", b="page"))]
    got = _texts(spark, rows)
    assert {got[i] for i in range(5)} == {"The copied article\nhas two parts"} and got[9] == "Another\npage"


def test_templates_are_per_layout(spark):
    ship(spark)
    page = '<html><body><div class="{w}"><p>Greetings from {w}</p><p>Text number {n} stands on this page only</p></div></body></html>'
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    rows = [(i, f"http://many.example/{i}", page.format(w=words[i % 5], n=i)) for i in range(20)]
    assert _texts(spark, rows) == {i: f"Text number {i} stands on this page only" for i in range(20)}


def test_slots_decide_without_landmarks_and_names(spark):
    """The generated pages with all their landmark elements renamed to div and without names: classes and slots alone."""
    ship(spark)
    rename = re.compile(r"<(/?)(?:article|nav|footer|header|aside|main)\b")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    hosts = Counter(re.match(r"https?://([^/]+)", u)[1] for _, u, _ in rows)
    bare = [(i, u, re.sub(r'class="ad"', "", rename.sub(r"<\1div", h))) for i, u, h in rows if hosts[re.match(r"https?://([^/]+)", u)[1]] >= 3]
    got = _texts(spark, bare)
    wrong = 0
    for i, _, h in rows:
        if i in got:
            article = re.search(r"(?s)<article>(.*?)</article>", h)[1]
            blocks = re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))
            wrong += got[i] != "\n".join(x for b in blocks if (x := " ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split())))
    assert len(got) > 150 and wrong == 0


def test_slot_of_three_pages(spark):
    ship(spark)
    page = '<html><body><div><a href="/">Home</a> <a href="/x">News {n}</a></div><div><div><p>Words of the article {n}, long enough to be most of it.</p><p>And more of {n}</p></div></div><div><p>Made by us {n}</p></div></body></html>'
    assert _texts(spark, [(i, f"http://three.example/{i}", page.format(n=i)) for i in range(3)]) == {i: f"Words of the article {i}, long enough to be most of it.\nAnd more of {i}" for i in range(3)}


def test_common_names_inside_an_article_stay(spark):
    ship(spark)
    inside = '<h1>T {n}</h1><div class="related-work"><p>Earlier work {n}</p></div><p class="search">We search {n}</p><p class="note-header">Note {n}</p><p>Let <math><mi>x</mi><mo>=</mo><mn>{n}</mn></math> be</p>'
    page = "<html><body><nav>menu</nav><article>" + inside + '</article><article class="teaser"><p>Other</p></article></body></html>'
    for hosts in (1, 4):
        rows = [(i, f"http://n{i % hosts}.example/{i}", page.format(n=i)) for i in range(4)]
        assert _texts(spark, rows) == {i: f"T {i}\nEarlier work {i}\nWe search {i}\nNote {i}\nLet x={i} be" for i in range(4)}


def test_names_count_where_the_host_repeats_them(spark):
    ship(spark)
    page = '<html><body><article><p>Own text number {n} of the page</p>{box}</article></body></html>'
    box = '<div class="share"><p>Box {n}</p></div>'
    rows = [(i, f"http://names.example/{i}", page.format(n=i, box=box.format(n=i))) for i in range(4)] + [(9, "http://names.example/9", page.format(n=9, box='<div class="comments"><p>About comments</p></div>'))]
    assert _texts(spark, rows) == {i: f"Own text number {i} of the page" for i in range(4)} | {9: "Own text number 9 of the page\nAbout comments"}


def test_deep_paths_stay_apart(spark):
    ship(spark)
    deep = "".join(f'<div class="level{"abcdefghij"[k % 10]}{"klmnopqrst"[k // 10]}">' for k in range(60))
    page = "<html><body><div>{deep}<p>Same line</p>{shut}</div><div><p>Own text of page {n}, which is the longer one here</p></div></body></html>"
    rows = [(i, f"http://deep.example/{i}", page.format(deep=deep, shut="</div>" * 60, n=i)) for i in range(4)]
    assert _texts(spark, rows) == {i: f"Own text of page {i}, which is the longer one here" for i in range(4)}
