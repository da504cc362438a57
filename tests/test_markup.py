"""Literal cases of what pages declare and services answer, and odd inputs."""

import json

from pyspark.sql import functions as F

from sitelode.operators import inspection, markup, signals
from sitelode.sources import payloads


def nodes_of(spark, *blocks):
    df = spark.createDataFrame([(1, list(blocks)), (2, None), (3, ["", "{", "[]", "7"])], "page_id long, blocks array<string>")
    return {r.page_id: [json.loads(n) for n in r.nodes] for r in markup.declared_nodes(df).collect()}


def test_pointers_go_if_what_they_point_at_is_there(spark):
    menu = {"@type": "Menu", "@id": "#m", "name": "Soups", "offers": [{"@type": "Offer", "price": 3}, {"price": 4}], "other": {"@type": "Hidden"}}
    got = nodes_of(spark, json.dumps({"@graph": [menu, {"@type": "WebPage", "about": {"@type": "Menu", "@id": "#m"}, "author": {"@type": "Person", "@id": "#nobody"}}]}), json.dumps([{"@type": ["A", "B"]}]))
    assert sorted(str(n["@type"]) for n in got[1]) == sorted(["Menu", "Offer", "WebPage", "Person", "['A', 'B']"])
    assert got[2] == got[3] == []


def test_validation(spark):
    rows = [(1, json.dumps({"@context": "https://schema.org", "@type": "Event", "name": " ", "startDate": "2024", "location": []})), (2, json.dumps({"@type": "Unheard"})), (3, json.dumps({"@type": "Article", "author": "Ann", "publisher": {"@type": "Organization", "name": "P"}, "headline": "h", "datePublished": "d"}))]
    got = {r.k: r for r in markup.validate(spark.createDataFrame(rows, "k long, node string"), "k").collect()}
    assert got[1].errors == ["Missing required field: name", "Missing required field: location"] and not got[1].valid
    assert got[1].warnings == [f"Missing recommended field: {f}" for f in ("endDate", "organizer", "performer")]
    assert got[2].valid and got[2].warnings == ["Missing @context field"]
    assert got[3].valid and "publisher missing logo" in got[3].warnings


def test_hreflang(spark):
    tags = [("https://k.test/", "en", "https://k.test/", "html"), ("https://k.test/", "de", "https://k.test/de", "html"), ("https://k.test/de", "de", "https://k.test/de/", "html"), ("https://k.test/", "xx", "https://k.test/gone", "html"), ("https://k.test/x", "fr", "https://k.test/", "html")]
    pages = spark.createDataFrame([("https://k.test/", 200), ("https://k.test/de", 200), ("https://k.test/gone", 410)], "url string, status int")
    got = {(r.url, r.kind, r.lang) for r in markup.hreflang_issues(spark.createDataFrame(tags, "url string, lang string, href string, source string"), pages).collect()}
    assert got == {
        ("https://k.test/", "invalid-code", "xx"), ("https://k.test/", "no-x-default", None), ("https://k.test/", "not-found", "xx"), ("https://k.test/", "no-link-back", "de"),
        ("https://k.test/x", "no-self-reference", None), ("https://k.test/x", "no-link-back", "fr"),
    }
    assert markup.hreflang_issues(spark.createDataFrame([], "url string, lang string, href string, source string"), pages).count() == 0


def test_headings(spark):
    df = spark.createDataFrame([(1, "<h1>a</h1><h3>b</h3><H2 x=1>c <i>d</i></h2><h3>e</h3>"), (2, None), (3, "<p>")], "page_id long, html string")
    got = [(r.page_id, r.at, r.level, r.text, r.skipped, r.parent) for r in markup.headings(df).orderBy("page_id", "at").collect()]
    assert got == [(1, 0, 1, "a", False, None), (1, 1, 3, "b", True, 0), (1, 2, 2, "c d", False, 0), (1, 3, 3, "e", False, 2)]


def test_security_without_https(spark):
    names = ["strict_transport_security", "content_security_policy", "x_frame_options", "x_content_type_options", "referrer_policy", "permissions_policy", "x_xss_protection"]
    best = ("max-age=31536000; includeSubDomains; preload", "default-src x; script-src y; object-src 'none'; base-uri z", "DENY", "nosniff", "no-referrer", "geolocation=(), camera=(), microphone=(), payment=()", "0")
    df = spark.createDataFrame([(1, True, *best), (2, False, *best), (3, True, *[None] * 7)], "k long, https boolean, " + ", ".join(f"{n} string" for n in names))
    assert [(r.score, r.max, r.grade) for r in markup.security(df, "k").orderBy("k").collect()] == [(94.0, 94.0, "A+"), (74.0, 74.0, "A+"), (0.0, 94.0, "F")]


def test_mentions(spark):
    df = spark.range(1)
    assert df.select(signals.mentions(F.lit("We like SOUP_1, soup!"), "soup").alias("x"), signals.mentions(F.lit("soups soup_"), "soup").alias("y")).first() == (True, False)


def test_answers_that_are_none(spark):
    bad = spark.createDataFrame([(1, None), (2, ""), (3, "[]"), (4, "{"), (5, '"x"'), (6, "{}")], "k long, body string")
    for read in (payloads.captures, payloads.report_rows, payloads.field_vitals, payloads.pageviews):
        assert read(bad, "k").count() == 0, read.__name__
    assert payloads.sitemap_entries(bad.select(F.col("k").cast("string").alias("url"), "body"), bad.select(F.col("k").cast("string").alias("url"))).count() == 0


def test_sitemaps_are_followed_three_deep_and_loops_end(spark):
    index = lambda *c: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in c) + "</sitemapindex>"
    urls = lambda *c: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in c) + "</urlset>"
    files = [("0", index("1", "a", "0")), ("1", index("2")), ("2", index("3")), ("3", urls("deep")), ("a", urls("p", "q", "p")), ("b", urls("lost"))]
    got = payloads.sitemap_entries(spark.createDataFrame(files, "url string, body string"), spark.createDataFrame([("0",)], "url string")).collect()
    assert sorted((r["loc"], r.sitemap) for r in got) == [("deep", "3"), ("p", "a"), ("q", "a")]


def test_property_match(spark):
    asked = spark.createDataFrame([("kiosk.test",), ("https://kiosk.test/",), ("www.other.test",), ("",)], "input string")
    properties = spark.createDataFrame([("https://m.kiosk.test/", 1), ("sc-domain:kiosk.test", 2), ("https://other.test/", 3), ("https://x.other.test/", 4)], "property string, position int")
    got = {r.input: r.property for r in inspection.match_property(asked, properties).collect()}
    assert got == {"kiosk.test": "sc-domain:kiosk.test", "https://kiosk.test/": "https://kiosk.test/", "www.other.test": "https://other.test/", "": None}


def test_every_query_has_its_sql():
    from sitelode import plans

    assert set(plans.queries()) == set(plans.oracles())
