"""What pages declare against what they show."""

import json
from datetime import date

from pyspark.sql import functions as F

from sitelode.operators import declarations as op
from sitelode.operators import history, markup
from sitelode.sources import dom


def block(value):
    return f'<script type="application/ld+json">{json.dumps(value)}</script>'


def pages(spark, *htmls):
    rows = [(i, "https://x.example/a/b" if i else "https://x.example/es", h) for i, h in enumerate(htmls)]
    return dom.parsed(spark.createDataFrame(rows, "page_id long, url string, html string"), keep=("page_id", "url"))


def test_mismatches(spark):
    faq, how = block({"@type": "FAQPage"}), block([{"@type": "HowTo"}])
    whole = {"@type": "Product", "offers": {"price": "1"}, "gtin": "g"}
    htmls = [
        faq, faq + "<details><p><summary>q</summary></details>", faq + "<dl><dt>q<dd>a</dl>", faq + "<summary>q</summary><dt>q</dt>", faq + '<div id="FAQs">', faq + "<h2>¿Cómo va</h2>", how, how + "<h2> Step 2: x</h2>", how + "<ol><b>x</b></ol>", how + "<i class=steps>",
        block(whole), block(whole) + "<p>$5</p>", block(whole) + "<a data-x='Buy now'>b</a>", block({"@type": "Product"}) + "<p>€5</p>", block({**whole, "offers": [], "price": 3}) + "<p>1.50 EUR</p>", None,
    ]
    got = sorted((r.page_id, r.type, r.severity, r.lacks) for r in op.mismatches(pages(spark, *htmls)).collect())
    none: list[str] = []
    assert got == [(0, "FAQPage", "warning", none), (3, "FAQPage", "warning", none), (6, "HowTo", "warning", none), (8, "HowTo", "warning", none), (10, "Product", "info", none), (13, "Product", "warning", ["offers", "price", "identifier"])]


def test_expected_types(spark):
    found = op.expected_types(pages(spark, block([{"@type": "WebSite"}, {"@type": "Product"}]), block({"@type": "TechArticle", "publisher": {"@type": "OnlineBusiness"}}), block({"@type": "ProductGroup"}) + '<nav aria-label="Breadcrumb">', None)).collect()
    got = {i: {r.label: r.state for r in found if r.page_id == i} for i in range(4)}
    assert got[0] == {"Organization": "missing", "WebSite": "present", "Article": "exempt", "BreadcrumbList": "exempt"}
    assert got[1] == {"Organization": "present", "Article": "present", "BreadcrumbList": "missing"}
    assert got[2] == {"Organization": "missing", "Article": "exempt", "Product": "present", "BreadcrumbList": "missing"}
    assert got[3] == {"Organization": "missing", "Article": "exempt", "BreadcrumbList": "missing"}


def test_publishing_entities(spark):
    htmls = [
        block([{"@type": "Person", "name": "P"}, {"@type": ["X", "NGO"], "name": " N "}]) + "<title>T</title>", block({"@type": "Person", "name": 5}) + '<meta content=" S " property="OG:site_name"><title>T</title>',
        "<title> Soup - a dish | Shop</title>", "<title>Self-made</title>", "<title>| x</title>", None,
    ]
    assert [(r.name, r.source) for r in op.publishing_entities(pages(spark, *htmls)).orderBy("page_id").collect()] == [("N", "schema"), ("S", "og"), ("Soup", "title"), ("Self", "title"), (None, None), (None, None)]


def test_lists_for_language_models(spark):
    full = "# Site\n> About\n- [a](https://x/1)\n  - [b](https://x/2): b\n- [c](HTTP://x/3)\n- [a](https://x/1)\n- [r](/r)\n## OPTIONAL\n"
    files = spark.createDataFrame([(1, full), (2, full.replace("x/", "y/")), (3, full.replace("x/", "z/")), (4, "#Site\n>\n* [a](https://x/1)"), (5, None), (6, "- [a](https://x/2)")], "site_id long, text string")
    audit = spark.createDataFrame([("https://x/1", "resolves"), ("https://x/2", "broken"), ("HTTP://x/3", "unreachable"), ("https://y/1", "unreachable"), ("unasked", "resolves")], "url string, outcome string")
    got = {r.site_id: (r.earned, r.applicable, r.not_applicable, r.not_evaluated, r.grade) for r in op.list_scores(files, audit).collect()}
    assert got == {1: (90, 100, 0, 0, "Excellent"), 2: (80, 80, 0, 20, "Excellent"), 3: (80, 80, 20, 0, "Excellent"), 4: (0, 80, 20, 0, "Poor"), 5: (0, 80, 20, 0, "Poor"), 6: (8, 100, 0, 0, "Poor")}


def test_complete_months_are_those_of_a_day(spark):
    days = [date(2024, 3, 2), date(2024, 3, 31), date(2023, 12, 4), date(2024, 1, 3), date(2024, 1, 4)]
    for count in (1, 12, 40):
        got = {r.d: r.m for r in spark.createDataFrame([(d,) for d in days], "d date").select("d", history.complete_months(F.col("d"), count).alias("m")).collect()}
        assert got == {d: history.calendar_months(d, count) for d in days}


def test_windows_are_those_of_a_day(spark):
    days = [date(2024, 3, 2), date(2023, 12, 31)]
    for n, retention in ((28, 480), (90, 60)):
        for r in spark.createDataFrame([(d,) for d in days], "d date").select("d", history.window_at(F.col("d"), n, retention=retention).alias("w")).collect():
            window = history.window_of(r.d, n, retention=retention)
            assert tuple(r.w) == (*window, *history.preceding(window))


def test_crawlability(spark):
    url = "https://x.example/a"
    rows = [
        (1, url, "/a", f'<{url}>; rel="canonical"', None, None, True), (2, url, "https://y.example/", '<https://x.example/a>; rel="canonical"', "Index", None, None), (3, url, "#top", None, "NOINDEX", "none", False),
        (4, url, None, '<b>; rel="canonical"', "max-snippet:-1", None, False), (5, url, "https:///", None, None, "googlebot: noindex", None), (6, None, None, None, None, None, None), (7, url, "https://x.example/b", None, None, None, True),
    ]
    got = markup.crawlability(spark.createDataFrame(rows, "page_id long, url string, canonical string, link string, robots string, x_robots_tag string, allowed boolean")).collect()
    assert sorted((r.page_id, r.kind) for r in got) == [(1, "relative"), (2, "cross_domain"), (2, "html_vs_http"), (3, "invalid"), (3, "noindex"), (3, "noindex_unseen"), (3, "none"), (4, "relative"), (5, "invalid"), (5, "noindex")]
