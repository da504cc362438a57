"""Readers of services' answers on whole, odd and unreadable bodies, and what sites say of themselves."""

import json

from pyspark.sql import functions as F

from sitelode.operators import pages, phrases, sessions
from sitelode.sources import payloads as op


def answers(spark, *bodies):
    return spark.createDataFrame([(i, b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "k long, body string")


ODD = (None, "", "[]", "{", '"x"', "{}", "null")


def test_unreadable_bodies_give_nothing(spark):
    for read in (op.report_totals, op.vitals_history, op.domain_scores, op.domain_score_history, op.entities):
        assert read(answers(spark, *ODD), "k").count() == 0, read.__name__


def test_history_keeps_gaps(spark):
    body = {"record": {"collectionPeriods": [{"lastDate": {"year": 2024, "month": 2, "day": 29}}, {"lastDate": {"year": 2023, "month": 2, "day": 29}}], "metrics": {
        "interaction_to_next_paint": {"percentilesTimeseries": {"p75s": [100, None, "NaN"]}, "histogramTimeseries": [{"densities": ["0.5"]}, {"densities": [0.9]}]}, "cumulative_layout_shift": {}, "unknown": {"percentilesTimeseries": {"p75s": [1]}}}}}
    got = op.vitals_history(answers(spark, body), "k").orderBy("at").collect()
    assert [(r.metric, str(r.period_end), r.p75, r.good) for r in got] == [("inp", "2024-02-29", 100.0, 0.5), ("inp", "None", None, None), ("inp", "None", None, None)]


def test_scores_are_on_their_scale(spark):
    body = {"as_of": "d", "results": [{"domain": "A.b", "found": True, "open_page_rank": 10.5}, {"domain": "c", "found": True, "open_page_rank": 0, "rank": -1, "referring_domains": 7, "history": [{"date": "x", "open_page_rank": 10}, {"date": "y"}, {"open_page_rank": 1}, {"date": "z", "open_page_rank": -1}]}, {"domain": None}, {}]}
    assert sorted(tuple(r)[2:] for r in op.domain_scores(answers(spark, body), "k").collect()) == [("a.b", False, None, None, None), ("c", True, 0.0, None, 7)]
    assert [tuple(r) for r in op.domain_score_history(answers(spark, body), "k").collect()] == [(0, "c", "x", 10.0, False)]


def test_entities_feed_the_ranking(spark):
    body = {"entities": [{"name": "low", "salience": 0.1}, {"name": " High ", "salience": 0.9, "mentions": [{"text": {"content": "Hi"}, "type": "PROPER"}, {"text": {"content": "Hi"}}, {"text": {}}, {}]}, {"name": "", "salience": 1}, {"name": "none"}]}
    found = op.entities(answers(spark, body), "k")
    assert sorted((r.place, r.name, r.type, r.mentions, r.proper) for r in found.collect()) == [(0, "low", "UNKNOWN", [], False), (1, "High", "UNKNOWN", ["Hi"], True)]
    ranked = phrases.ranked_entities(found.withColumnRenamed("k", "page_id")).orderBy("rank").collect()
    assert [(r["rank"], r.name, r.forms) for r in ranked] == [(1, "High", ["hi", "high"]), (2, "low", ["low"])]


def test_totals_are_the_reports(spark):
    body = {"metricHeaders": [{"name": "a"}, {"name": "b"}, {"name": "c"}], "totals": [{"metricValues": [{"value": "12.5"}, {"value": "-"}]}]}
    assert sorted(map(tuple, op.report_totals(answers(spark, body, {"metricHeaders": [{"name": "a"}]}), "k").collect())) == [(0, "a", 12.5), (0, "b", None), (0, "c", None)]


def test_addresses_are_first_captures(spark):
    rows = [(1, "b", "20200102000000", "u2", "text/html", 200, "x", 1), (1, "b", "20200101000000", "u1", "text/html", 404, "y", 1), (1, "a", "20200103000000", "u3", "image/png", 200, "z", 1), (2, "b", "20200101000000", "u4", "text/html", 200, "x", 1)]
    df = spark.createDataFrame(rows, "k long, urlkey string, timestamp string, original string, mimetype string, status long, digest string, length long")
    urls = lambda **how: sorted((r.k, r.original) for r in op.addresses(df, "k", **how).collect())
    assert urls() == [(1, "u1"), (1, "u3"), (2, "u4")] and urls(status=200) == [(1, "u2"), (1, "u3"), (2, "u4")]
    assert urls(mimetype="text/html", status=200) == [(1, "u2"), (2, "u4")] and urls(limit=1) == [(1, "u3"), (2, "u4")]


def test_roots_and_sources(spark):
    origins = spark.createDataFrame([("a",), ("b/",), ("c",), ("c",)], "origin string")
    named = spark.createDataFrame([("a", "x", "robots.txt"), ("a", "y", "search-console"), ("a", "z", "search-console"), ("a", "z", "search-console"), ("b/", "", "argument"), ("c", None, "robots.txt"), ("d", "x", "argument"), ("c", "q", "rumour")], "origin string, url string, source string")
    assert sorted(map(tuple, op.sitemap_roots(origins, named).collect())) == [("a", "y", "search-console"), ("a", "z", "search-console"), ("b/", "b/sitemap.xml", "convention"), ("c", "c/sitemap.xml", "convention")]
    urls = spark.createDataFrame([("p",), ("q",), ("r",), ("s",), ("t",)], "url string")
    records = spark.createDataFrame([("p", "record", 1.0), ("q", "no-data", None), ("r", "refused", None), ("s", "refused", None)], "url string, state string, p75 double")
    lab = spark.createDataFrame([("p", 9.0), ("q", 9.0), ("r", 9.0), ("t", 9.0)], "url string, p75 double")
    assert sorted(map(tuple, op.field_source(urls, records, lab).collect())) == [("p", "record", 1.0), ("q", "none", None), ("r", "lab", 9.0), ("s", "none", None), ("t", "none", None)]


def test_robots_access(spark):
    files = [("a", "User-agent: *\nDisallow: /\nAllow: /x"), ("b", "User-agent: GPTBot\nDisallow:\n\nUser-agent: *\nDisallow: /q\nDisallow: /p"), ("c", "nothing")]
    rules = pages.robots_rules(spark.createDataFrame(files, "host string, text string"))
    got = pages.robots_access(rules, spark.createDataFrame([("GPTBot",), ("Other",)], "crawler string")).collect()
    assert sorted(map(tuple, got)) == [("a", "GPTBot", True, ["/"]), ("a", "Other", True, ["/"]), ("b", "GPTBot", False, []), ("b", "Other", False, ["/p", "/q"])]
    states = spark.createDataFrame([(s,) for s in (200, 299, 404, 410, 403, 500, 0, None)], "s int").select(pages.robots_status(F.col("s")).alias("r")).collect()
    assert [r.r for r in states] == ["read", "read", "absent", "absent", "unavailable", "unavailable", "unavailable", "unavailable"]


def test_presence_and_order(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("a", None), ("b", None)], "brand string, found boolean")
    assert sorted(map(tuple, pages.presence(df, "brand").collect())) == [("a", 2, 1, 1), ("b", 0, 0, 1)]
    rows = spark.createDataFrame([("x", 5, 1), ("y", 9, 1), ("z", 1, 2), (None, 9, 1)], "landing_page string, sessions long, key_events long")
    assert [r.landing_page for r in sessions.busiest_landings(rows, 3).collect()] == ["z", "y", None]


def test_robots_files_line_by_line(spark):
    text = "Allow: /x\nSITEMAP: a\n\nUser-agent: A # one\nuser-agent:\nUser-Agent: B\nSitemap:\nbroken\nContent-Signal: search=yes, ai-train=no,search = no, ads=no, ai-input\n# c\nUser-agent: C\nDisallow:\ncontent-signal: AI-Input=YES"
    files = spark.createDataFrame([("h", text), ("large", "#" * 600_000), ("empty", ""), ("none", None)], "host string, text string")
    assert sorted(map(tuple, pages.robots_issues(files).collect())) == [("h", 1, "before any user-agent"), ("h", 5, "empty value"), ("h", 7, "empty value"), ("h", 8, "no colon"), ("large", 0, "too large")]
    assert [tuple(r) for r in pages.robots_sitemaps(files).collect()] == [("h", 2, "a")]
    assert sorted(map(tuple, pages.robots_uses(files).collect())) == [("h", "a", "ai-train", "no"), ("h", "a", "search", "no"), ("h", "b", "ai-train", "no"), ("h", "b", "search", "no"), ("h", "c", "ai-input", "yes")]
