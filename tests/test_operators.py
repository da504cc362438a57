"""Literal cases of operators, and empty inputs."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from sitelode.operators import history, joins, pages, search, sessions

S = "query string, page string, clicks double, impressions double, position double"


def rows(spark, data, schema=S):
    return spark.createDataFrame(data, schema)


def test_totals(spark):
    t = search.totals(rows(spark, [("a", "p", 2.0, 300.0, 2.0), ("b", "p", 1.0, 100.0, 10.0)])).first()
    assert tuple(t) == (3.0, 400.0, 0.0075, 4.0)  # a position weighs what it was shown
    assert tuple(search.totals(rows(spark, [])).first()) == (0.0, 0.0, 0.0, 0.0)


def test_quick_wins(spark):
    data = [("leek soup", "p", 4.0, 600.0, 5.5), ("far down", "p", 4.0, 600.0, 22.0), ("on top", "p", 90.0, 600.0, 1.0), ("hardly shown", "p", 0.0, 9.0, 5.0)]
    got = search.quick_wins(rows(spark, data), "query").collect()
    assert [(r.query, r.potential_clicks) for r in got] == [("leek soup", 26)]


def test_cannibalization(spark):
    data = [("soup", "/1", 3.0, 80.0, 6.0), ("soup", "/2", 1.0, 120.0, 8.0), ("bread", "/3", 5.0, 60.0, 2.0), ("tea", "/1", 0.0, 1.0, 70.0), ("tea", "/2", 0.0, 1.0, 71.0)]
    got = search.cannibalization(rows(spark, data)).collect()
    assert [(r.query, r.pages, r.best_position, r.lead_page) for r in got] == [("soup", 2, 6.0, "/2")]


def test_compare_keeps_absent_apart_from_zero(spark):
    m = search.compare(rows(spark, [("rising", "p", 2.0, 40.0, 6.0), (None, "p", 1.0, 9.0, 1.0)]), rows(spark, [("fallen", "p", 3.0, 70.0, 2.0), (None, "q", 4.0, 9.0, 3.0)]), "query")
    got = {r.query: r for r in m.collect()}
    assert set(got) == {"rising", "fallen", "(none)"} and got["fallen"].clicks_now == 0 and got["fallen"].position_change is None
    assert (got["(none)"].clicks_change, got["(none)"].position_change) == (-3.0, -2.0)  # null keys meet
    assert [r.query for r in search.lost(m).collect()] == ["fallen"]
    assert search.compare(rows(spark, []), rows(spark, []), "query").count() == 0


def test_anomalies_need_days_and_spread(spark):
    schema = "date date, clicks double, impressions double, position double"
    day = lambda i, c: (date(2024, 1, 1 + i), c, 10.0, 1.0)
    assert search.anomalies(rows(spark, [day(i, 5.0) for i in range(20)], schema)).count() == 0
    assert search.anomalies(rows(spark, [day(i, float(i == 5)) for i in range(13)], schema)).count() == 0
    assert [r.date.day for r in search.anomalies(rows(spark, [day(i, 100.0 if i == 5 else 5.0) for i in range(20)], schema)).collect()] == [6]


def test_branded_split_has_both_rows(spark):
    got = {r.branded: r for r in search.branded_split(rows(spark, [("leekly menu", "p", 1.0, 2.0, 1.0), ("leeklymenu", "p", 1.0, 2.0, 1.0)]), ["Leekly"]).collect()}
    assert got[True].queries == 1 and got[False].queries == 1
    assert {r.branded for r in search.branded_split(rows(spark, []), ["x"]).collect()} == {True, False}


def landing(spark, data):
    return spark.createDataFrame(data, "landing_page string, sessions double, engaged double, key_events double")


def found(spark, s, a):
    sdf = spark.createDataFrame([(u, c, c * 10, 3.0) for u, c in s], "page string, clicks double, impressions double, position double")
    return joins.page_join(sdf, landing(spark, a))


def test_page_join(spark):
    got = {r.bucket: r for r in found(spark, [("http://kiosk.test/soup/", 12.0), ("http://kiosk.test/tea", 7.0)], [("/soup", 8.0, 2.0, 1.0), ("/bread", 3.0, 3.0, 0.0)]).collect()}
    assert got["joined"].path == "/soup" and got["joined"].engagement_rate == 0.25 and got["search_only"].path == "/tea" and got["analytics_only"].path == "/bread"
    one = found(spark, [("http://kiosk.test/soup", 4.0), ("http://kiosk.test/soup?d=1", 3.0)], [("/soup", 6.0, 1.0, 1.0), ("/soup/", 2.0, 1.0, 2.0)]).first()
    assert (one.bucket, one.clicks, one.sessions, one.engagement_rate, one.key_events) == ("joined", 7.0, 8.0, 0.25, 3.0)


def test_page_join_ambiguous_and_unreadable(spark):
    got = found(spark, [("http://kiosk.test/faq", 3.0), ("http://m.kiosk.test/faq", 1.0), (None, 1.0)], [("/faq", 4.0, 2.0, 0.0), ("none", 9.0, 0.0, 0.0)]).collect()
    assert sorted((r.bucket, r.host or "", r.sessions) for r in got) == [("ambiguous", "kiosk.test", None), ("ambiguous", "m.kiosk.test", None), ("unreadable_landings", "", 9.0), ("unreadable_search", "", None)]


def test_value_lists(spark):
    s = [("http://k.test/read", 90.0), ("http://k.test/order", 70.0), ("http://k.test/gift", 2.0), ("http://k.test/map", 25.0)]
    a = [("/read", 60.0, 6.0, 0.0), ("/order", 65.0, 50.0, 9.0), ("/gift", 2.0, 2.0, 1.0), ("/map", 20.0, 15.0, 0.0)]
    j = found(spark, s, a)
    assert sorted(r.path for r in joins.clicks_without_value(j).collect()) == ["/map", "/read"]
    assert [r.path for r in joins.value_without_reach(j).collect()] == ["/gift"]


def test_windows_and_months():
    as_of = date(2024, 3, 31)
    assert history.window_of(as_of, days=7) == (date(2024, 3, 22), date(2024, 3, 28))
    assert history.preceding((date(2024, 3, 22), date(2024, 3, 28))) == (date(2024, 3, 15), date(2024, 3, 21))
    assert history.calendar_months(as_of, 4) == ["2023-11", "2023-12", "2024-01", "2024-02"]
    assert len(history.calendar_months(as_of, 40)) < 40


def test_upsert_and_movement(spark):
    schema = "site_id long, refresh_id long, captured_at timestamp, metric string, value double"
    at = lambda d: f"2024-01-{d:02d} 00:00:00"
    df = spark.createDataFrame([(1, i, at(i), "m", v) for i, v in ((1, 5.0), (2, None), (3, 7.0), (4, None))], "site_id long, refresh_id long, captured_at string, metric string, value double")
    df = df.withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    reg = spark.createDataFrame([("m", False)], "metric string, up_is_better boolean")
    r = history.movement(df, reg).first()
    assert (r.latest, r.previous, r.change, r.improved) == (7.0, 5.0, 2.0, False)
    m = history.monthly(df).first()
    assert (m["last"], m["min"], m["max"], m.readings) == (7.0, 5.0, 7.0, 4)
    new = df.where("refresh_id = 1").withColumn("value", F.lit(9.0))
    assert {r.refresh_id: r.value for r in history.upsert(df, new, "refresh_id", "metric").collect()} == {1: 9.0, 2: None, 3: 7.0, 4: None}
    assert history.movement(spark.createDataFrame([], schema), reg).count() == 0


def test_runs_take_null_as_a_status(spark):
    df = spark.createDataFrame([("u", i, s) for i, s in enumerate(["a", "a", None, None, "a"])], "key string, i int, s string")
    assert [(r.s, r.length) for r in history.runs(df, "key", ["i"], "s").orderBy("run").collect()] == [("a", 2), (None, 2), ("a", 1)]


def test_funnel_order(spark):
    e = spark.createDataFrame([("u", "click", "2024-01-01 00:00:01"), ("u", "view", "2024-01-01 00:00:02"), ("v", "view", "2024-01-01 00:00:01"), ("v", "click", "2024-01-01 00:00:02")], "user_id string, event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [(r.event, r.users, r.abandoned) for r in sessions.funnel(e, ["view", "click"], "2024-01-01", "2024-01-02").collect()] == [("view", 2, 0), ("click", 1, 1)]


def test_ai_referrers(spark):
    df = spark.createDataFrame([("Claude.AI", "referral"), ("eu.you.com", "referral"), ("foryou.com", "referral"), ("kiosk", "AI-Assistant"), ("you.com", "email")], "s string, m string")
    assert [r.x for r in df.select(sessions.classify_ai(F.col("s"), F.col("m")).alias("x")).collect()] == ["host-list", "host-list", None, "google", None]


@pytest.mark.parametrize(
    ("rules", "path", "want"),
    [
        ("Disallow: /menu\nAllow: /menu/today", "/menu/2020", False), ("Disallow: /menu\nAllow: /menu/today", "/menu/today/soup", True),
        ("Disallow: /tea\nAllow: /tea", "/tea", True), ("Disallow:", "/any", True), ("Disallow: /*.csv", "/x/y.csv", False), ("Disallow: /*.csv", "/x/y.txt", True), ("Disallow: /map$", "/maps", True), ("Disallow: /map$ # only", "/map", False),
    ],
)
def test_robots(spark, rules, path, want):
    parsed = pages.robots_rules(spark.createDataFrame([("h", f"User-agent: *\n{rules}")], "host string, text string"))
    assert pages.allowed(spark.createDataFrame([("h", path)], "host string, path string"), parsed, "SomeBot").first().allowed is want


def test_robots_longest_agent(spark):
    parsed = pages.robots_rules(spark.createDataFrame([("h", "User-agent: crow\nUser-agent: *\nDisallow: /\n\nuser-agent: crow-photo\nDisallow: /map")], "host string, text string"))
    p = spark.createDataFrame([("h", "/y")], "host string, path string")
    assert pages.allowed(p, parsed, "Crow-Photo").first().allowed and not pages.allowed(p, parsed, "Crow").first().allowed and not pages.allowed(p, parsed, "other").first().allowed


def test_tally_leaves_out_what_was_not_judged(spark):
    df = spark.createDataFrame([("k", 10, 5, None), ("k", 5, None, None), ("k", 7, None, "not-applicable"), ("k", 3, None, "not-evaluated"), ("z", 4, None, "not-evaluated")], "key string, points int, earned int, status string")
    got = {r.key: r for r in pages.tally(df, "key").collect()}
    assert tuple(got["k"])[1:] == (5, 15, 7, 3, 33) and got["z"].percent is None


def test_rules_and_facts(spark):
    html = '<html><head><title>' + "t" * 80 + '</title><meta name="description" content="d"></head><body><img src=x><h1>a</h1><h1>b</h1></body></html>'
    r = pages.rules(pages.facts(spark.createDataFrame([(1, "u", html), (2, "u", None)], "page_id long, url string, html string"))).orderBy("page_id").first()
    assert r.issues == ["title-long", "h1-multiple", "canonical-missing", "viewport-missing", "lang-missing", "images-alt"]


def test_depth_of_a_graph_with_a_loop(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (9, 8)], "src long, dst long")
    got = {r.node: r.depth for r in pages.crawl_depth(e, spark.createDataFrame([(0,)], "node long")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3}


def test_crawl_depth_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(65)] + [(65, 3)], "src long, dst long").coalesce(1)
    got = {r.node: r.depth for r in pages.crawl_depth(e, spark.createDataFrame([(0,)], "node long")).collect()}
    assert got == {i: i for i in range(66)}


def test_crawl_issues_of_unreadable_pages(spark):
    rows_ = [(1, 0, 9, 9, None, None, 0, True), (2, 503, 9, 9, None, None, 0, True), (3, 404, 0, 1, None, None, 0, False), (4, 200, 4, 5, "t" * 71, "d", 0, True), (5, 200, 3, 3, "t", "d", 1, False), (6, 200, 0, 6, None, None, 1, None)]
    df = spark.createDataFrame(rows_, "page_id long, status int, redirects int, depth int, title string, description string, h1 int, noindex boolean")
    got = {}
    for r in pages.crawl_issues(df).collect():
        got.setdefault(r.page_id, []).append((r.type, r.severity))
    assert got == {
        1: [("fetch_error", "critical")], 2: [("server_error", "critical")], 3: [("broken_link", "critical")],
        4: [("long_title", "warning"), ("missing_h1", "warning"), ("redirect_chain", "warning"), ("noindex", "warning"), ("deep_page", "warning")],
        6: [("missing_title", "critical"), ("missing_description", "warning"), ("very_deep_page", "critical")],
    }


def test_identity(spark):
    rows_ = [("http://k.test/en", None, None, 0), ("http://k.test/INDEX.php", None, None, 0), ("http://k.test/blog/faqs/1", None, None, 0), ("http://k.test/shop/x", None, "article", 0), ("http://k.test/x", ["ItemList"], None, 9), ("http://k.test/x", None, None, 3), ("http://k.test/collections/x", None, None, 0)]
    df = spark.createDataFrame([(i, u, t, o, False, c) for i, (u, t, o, c) in enumerate(rows_)], "page_id long, url string, types array<string>, og_type string, dated_article boolean, calls int")
    got = [(r.kind, r.is_root, r.depth) for r in pages.identity(df).orderBy("page_id").collect()]
    assert got == [("homepage", True, 0), ("homepage", True, 0), ("faq", False, 3), ("product", False, 2), ("collection", False, 1), ("landing", False, 1), ("generic", False, 2)]


def test_numeric_entities_stay_in_their_word(spark):
    df = spark.createDataFrame([("<p>it&#39;s hot&nbsp;soup</p><script>a b</script>",)], "html string")
    assert df.select(pages.word_count(F.col("html")).alias("n")).first().n == 3
