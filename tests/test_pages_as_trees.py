"""Parsed pages: what a reader sees, what pages state and declare, and what nothing names."""

import json

import pytest

from sitelode.operators import markup
from sitelode.operators import readable as op
from sitelode.sources import dom, structured
from sitelode.sources.dom import Page

PAGES = "page_id long, html string, lang string"


def read(html):
    page = Page(html)
    whole, root = "".join(t for _, t in page.pieces), page.content_root()
    text = lambda i: whole[page.start[i] : page.stop[i]].strip(" ")
    return text(root), page.paragraphs(root), {t: [text(i) for i, (x, s) in enumerate(zip(page.tag, page.shown, strict=True)) if x == t and s] for t in page.tag}


@pytest.mark.parametrize(
    ("html", "copy", "paragraphs"),
    [
        ("<h1>foo<br>bar</h1><p>a</p><p>b</p>", "foo bar a b", ["a", "b"]),
        ("<main>kept</main><div>noise</div>", "kept", ["kept"]),
        ("<article>one</article><aside>between</aside><article>two</article>", "one", ["one"]),
        ("<div><article>a<article>inner</article>b</article>c</div>", "a inner b", ["a inner b"]),
        ("<p>x<script>var s = '<p>no</p>';</script><style>p{}</style><noscript><p>no</p></noscript><svg><title>no</title></svg>y", "xy", ["xy"]),
        ("<nav hidden>menu</nav><nav class=hidden>shown</nav>", "shown", ["shown"]),
        ("<div hidden id='S:0'><main><p>streamed</p></main></div><template id='B:0'>no</template>", "streamed", ["streamed"]),
        ("<div hidden id='TABS:2'>no</div><section><div hidden id='S:1'>no</div></section>yes", "yes", ["yes"]),
        ("<ul><li>outer<ul><li>a</li><li>b</li></ul></li></ul>", "outer a b", ["outer", "a", "b"]),
        ("<div>x<div>y</div>z</div>", "x y z", ["x z", "y"]),
        ("<dl><dt>t<dd>d<dd>e</dl><table><tr><td>1<td>2<tr><th>3</table>", "t d e 1 2 3", ["t", "d", "e"]),
        ("<details><summary>Q</summary>A</details>", "Q A", ["Q"]),
        ("<div class='a main-content b'>in</div><div id=content>out</div>", "in", ["in"]),
        ("<div role=main>r</div>", "r", ["r"]), ("just words", "just words", ["just words"]), ("", "", []), (" \n ", "", []), ("<p></p><p> </p>", "", []),
        ("<p>a<p>b<div>c</p>d", "a b c d", ["a", "b"]), ("a &amp; b&nbsp;&lt;c&gt; < d <3 &#8364;", "a & b <c> < d <3 €", ["a & b <c> < d <3 €"]),
        ("<p title='x > y' data-z=\"</p>\">t</p><!-- <p>no</p> --><p>u<!-- open", "t u", ["t", "u"]), ("<b><p>x</b>y</p>z", "x y z".replace("x y", "xy"), ["xy"]), ("<p>cut <a href='", "cut", ["cut"]),
    ],
)
def test_what_a_reader_sees(html, copy, paragraphs):
    assert read(html)[:2] == (copy, paragraphs)


def test_trees_are_ranges():
    page = Page("<html lang=es><head><title>T &amp; t</title><meta name=a content='1'></head><body class=x><ul><li><a href=1>l</a><li>m</ul><p>n</body><body id=y><html dir=ltr>")
    assert page.attrs[0] == {"lang": "es", "dir": "ltr"} and page.attrs[page.body] == {"class": "x", "id": "y"}
    for i, up in enumerate(page.parent):
        assert i <= page.last[i] and (up < 0 or up < i <= page.last[i] <= page.last[up])
    assert read("<title>T &amp; t</title><h2>A<h3>B</h3>")[2] == {"html": ["T & t A B"], "head": ["T & t"], "title": ["T & t"], "body": ["A B"], "h2": ["A"], "h3": ["B"]}


def test_no_page_takes_long():
    for html in ("<a title='x " * 50_000, "<div><p>" * 50_000, "<!-- " * 50_000, "<script>" * 50_000, "<a b=" * 50_000, "<" * 50_000, '<x y="><' * 50_000, "<li><ul>" * 20_000, "</p>" * 50_000):
        Page(html)


def test_signals(spark):
    rows = [
        (1, '<nav><h2>What nav?</h2></nav><main><h2>How <i>so</i></h2><p>It is a soup, 12%.</p></main><footer><h3>Why?</h3></footer><meta content="March 5, 2024" property="article:published_time">', "en"),
        (2, "<article>short</article><div>" + "long " * 80 + "</div><script>var x={\"datePublished\":\"2024-01-01\"}</script><ol><li>1<li>2<li>3</ol>", "de"),
        (3, '<script type="application/ld+json">{"@graph":[{"@type":"A","dateModified":"2023-01-05T10:00:00+02:00"}]}</script><script type="application/ld+json">{broken</script><h2><b>7 best</b> soups</h2><p class="Key-Takeaways">x</p>', None),
        (4, None, None),
    ]
    got = {r.page_id: r for r in op.landing_signals(dom.parsed(spark.createDataFrame(rows, PAGES), keep=("page_id", "lang")), "2024-06-01").collect()}
    assert tuple(got[1])[1:] == (False, True, True, False, False, True, True, True, False, 7)
    assert tuple(got[2])[1:] == (False, False, False, False, True, None, False, None, True, 1)
    assert tuple(got[3])[1:] == (True, False, False, True, False, False, True, False, False, 4)
    assert tuple(got[4])[1:] == (False, False, False, False, False, False, False, None, False, 0)
    assert op.copy(dom.parsed(spark.createDataFrame([], PAGES))).count() == 0


def test_microdata_and_rdfa():
    def items(html, nested=False):
        return [(form, item) for form, item in structured._items(Page(html), nested)]

    html = (
        '<div itemscope itemtype="https://schema.org/Product" itemref="more"><span itemprop="name">A<b> &amp; b</b></span><meta itemprop="image" content="1"><img itemprop="image" src="2"><a itemprop="image" href="3">t</a><i itemprop="sku"> </i>'
        '<div itemprop="offers" itemscope itemtype="http://schema.org/Offer"><meta itemprop="price" content="5">five</div></div><p id="more" itemprop="color">red</p>'
    )
    flat = {"@type": "Product", "name": "A & b", "image": ["1", "2", "3"], "offers": "five", "price": "5"}
    assert items(html) == [("microdata", flat), ("microdata", {"@type": "Offer", "price": "5"})]
    nested = {"@type": "Product", "name": "A & b", "image": ["1", "2", "3"], "offers": {"@type": "Offer", "price": "5"}, "color": "red"}
    assert items(html, nested=True)[0] == ("microdata", nested)
    assert items('<p typeof="https://schema.org/Person"><a property="name" href="">N</a><i property=""></i></p><p typeof>') == [("rdfa", {"@type": "Person", "name": "N"}), ("rdfa", {"@type": "Unknown"})]
    graph = json.dumps([{"@type": "WebSite", "publisher": {"@id": "#o", "@type": "Organization"}, "other": {"@type": "No"}}, {"@type": ["Organization", "X"], "@id": "#o", "name": "O"}, {"@id": "#gone", "@type": "Y"}, {"name": "untyped"}])
    found = items(f'<script type="application/ld+json">{graph}</script><script type="application/ld+json">{{"a": NaN}}</script><script type="application/json">{{"@type": "No"}}</script>')
    assert [None if n is None else n["@type"] for _, n in found] == [None, "WebSite", ["Organization", "X"], "Y"]


def test_items_are_judged(spark):
    html = '<div itemscope itemtype="https://schema.org/Organization"><b itemprop="name">O</b></div><p itemscope></p><script type="application/ld+json">{"@type":"Person","name":"P"}</script><script type="application/ld+json">[</script>'
    got = op.structured_items(spark.createDataFrame([(1, html, "x"), (2, None, "x"), (3, "<p>", "x")], PAGES)).collect()
    assert sorted((r.format, r.type, r.valid, r.errors) for r in got) == [
        ("json-ld", "Invalid", False, ["Invalid JSON syntax"]), ("json-ld", "Person", True, []), ("microdata", "Organization", False, ["Missing required field: url"]), ("microdata", "Unknown", True, []),
    ]


def test_operability(spark):
    html = (
        '<button> <svg><title>no, yet text</title></svg></button><button><img></button><a href="">x</a><a href="/"><img alt=" "><img alt="late"></a><a><img></a><div role=button aria-label=" "></div><button aria-labelledby=any></button>'
        '<label for=a>A</label><input id=a><input id=b placeholder=P name=n><label><select></select></label><select aria-hidden=true></select><textarea id="q"></textarea><input type=SUBMIT>'
    )
    rows = [(1, html, "x"), (2, "<main></main>", "x"), (3, "<div role=main><input type=password title=t></div>", "x"), (4, None, "x")]
    got = op.operability(dom.parsed(spark.createDataFrame(rows, PAGES))).collect()
    assert sorted((r.page_id, r.reason, r.markup) for r in got) == [
        (1, "no label", "<textarea #q>"), (1, "no main landmark", "<body>"), (1, "no name", "<a>"), (1, "no name", "<button>"), (1, "no name", "<div>"), (1, "placeholder only", "<input name=n #b>"),
        (3, "no label", "<input type=password>"), (4, "no main landmark", "<body>"),
    ]


def test_facts(spark):
    html = (
        '<html lang=" en "><meta charset=UTF-8><title> T </title><meta name=description content=" D "><link rel="nofollow canonical" href=" /c "><link rel=alternate hreflang=es href=/es><meta property="og:x" content="1"><meta property="og:x" content="2"><meta property="og:y" content="">'
        '<a href="/in">1</a><a href="//WWW.x.example:80/p">2</a><a href="https://x.example/">3</a><a href="tel:1">4</a><a href="">5</a><img><img alt=""><img alt=" "><h1>a</h1><h1> </h1><h2 hidden>b</h2>'
    )
    pages = spark.createDataFrame([(1, "http://www.x.example/y", html), (2, None, None)], "page_id long, url string, html string")
    one, none = op.facts(dom.parsed(pages, keep=("page_id", "url"))).orderBy("page_id").collect()
    assert (one.title, one.description, one.canonical, one.charset, one.lang, one.h1, one.h2) == ("T", "D", "/c", "utf-8", "en", 1, 0)
    assert (one.internal, one.external, one.images, one.images_without_alt, one.og) == (2, 2, 3, 2, {"og:x": "2"}) and [tuple(h) for h in one.hreflang] == [("es", "/es")]
    assert (none.title, none.internal, none.images, none.og, none.hreflang) == (None, 0, 0, {}, [])


def test_alternates_of_three_sources(spark):
    html = '<link rel="Alternate stylesheet" hreflang=es href="../es"><link rel=alternate hreflang=de><link rel=canonical hreflang=fr href=/fr><a rel=alternate hreflang=it href=/it>'
    link = '<https://y.example>; rel="alternate"; hreflang="x-default", <?q=1>;REL=alternate;hreflang=pt, </z>; rel=next'
    pages = spark.createDataFrame([("https://x.example/a/b?c", html, link), ("https://x.example/n", None, None)], "url string, html string, link string")
    body = '<urlset><url><loc>https://x.example/s</loc><xhtml:link rel="alternate" hreflang="en" href="/en"/><xhtml:link rel=\'alternate\' hreflang=\'fr\' href=\'https://f.example/\'></xhtml:link><link hreflang="no" href="/no"/></url></urlset>'
    got = markup.alternates_of(dom.parsed(pages, keep=("url", "link")), spark.createDataFrame([(body,), (None,), ("x",)], "body string")).collect()
    assert sorted((r.source, r.url.rsplit("/", 1)[1], r.lang, r.href) for r in got) == [
        ("header", "b?c", "pt", "https://x.example/a/b?q=1"), ("header", "b?c", "x-default", "https://y.example/"), ("html", "b?c", "es", "https://x.example/es"),
        ("sitemap", "s", "en", "https://x.example/en"), ("sitemap", "s", "fr", "https://f.example/"),
    ]


def test_content_analysis(spark):
    easy = "<h1>Cats</h1><p>The cat sat on the mat. The dog ran to the cat. A cow is big and red.</p><a href='/x'>a</a><a href='https://y.example'>b</a>"
    hard = "<h2>a</h2><h5>b</h5><h3> </h3><p>" + "Institutional considerations notwithstanding, organizational responsibilities necessitate comprehensive reconsideration " * 30 + ".</p><a href='https://y.example'>b</a>"
    rows = [(1, "https://x.example/p", easy), (2, "https://x.example/p", hard), (3, "https://x.example/p", None), (4, "https://x.example/p", "<h1>a</h1><h1>b</h1>" + "word " * 50)]
    got = {r.page_id: r for r in op.content_analysis(dom.parsed(spark.createDataFrame(rows, "page_id long, url string, html string"), keep=("page_id", "url"))).collect()}
    assert got[1].issues == [] and (got[1].sentences, got[1].paragraphs, got[1].links, got[1].internal) == (4, 1, 2, 1) and got[1].per_thousand == round(2000 / got[1].words)
    assert got[2].issues == ["very difficult", "no H1", "H2 to H5", "no internal links", "few different words"]
    assert got[3].issues == ["very difficult", "no H1", "no links", "few different words"] and (got[3].words, got[3].density, got[3].per_thousand) == (0, 0.0, 0)
    assert got[4].issues[-3:] == ["several H1", "no links", "few different words"]
