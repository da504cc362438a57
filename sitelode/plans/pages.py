"""Page, check, robots and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelode.operators import pages as op
from sitelode.sources.tables import SQL, page_keys, table



def _p():
    return F.col("page_id")

_ROBOTS = [("a", "User-agent: *\nDisallow: /en/4\nAllow: /en/45\nDisallow: /*.html$\n\nUser-agent: GPTBot\nUser-agent: CCBot\nDisallow: /"), ("b", "# none\nUser-agent: *\nDisallow:")]


def _facts(s, d):
    return op.facts(table(s, d, "pages"))


def _crawled(s, d):
    status = F.when(_p() % 11 == 0, 404).when(_p() % 29 == 0, 500).when(_p() % 37 == 0, 0).otherwise(200)
    return _facts(s, d).select("page_id", status.alias("status"), (_p() % 5).alias("redirects"), (_p() % 8).alias("depth"), "title", "description", "h1", (_p() % 13 == 0).alias("noindex"))


def _checks(s, d):
    status = F.when(F.col("event_id") % 11 == 0, "not-applicable").when(F.col("event_id") % 13 == 0, "not-evaluated")
    points = (F.col("event_id") % 5 + 1).cast("int")
    return table(s, d, "events").select("user_id", points.alias("points"), F.when(F.col("event_id") % 3 != 0, points).alias("earned"), status.alias("status"))


def _vitals(s, d):
    metric = F.element_at(F.array(*map(F.lit, ["lcp", "inp", "cls", "fcp"])), (F.col("event_id") % 4 + 1).cast("int"))
    scale = F.when(metric == "lcp", 100.0).when(metric == "inp", 10.0).when(metric == "cls", 0.01).otherwise(80.0)
    rows = table(s, d, "events").where("user_id % 3 <> 0 OR event_id % 4 <> 1").groupBy("user_id", metric.alias("metric")).agg(F.min(F.col("value") * scale + F.col("user_id")).alias("value"))
    return rows


def _paths(s, d):
    return page_keys(s, d).select(F.when(_p() % 2 == 0, "a").otherwise("b").alias("host"), F.col("path_key").alias("path")).distinct()


def _robots(s):
    return op.robots_rules(s.createDataFrame(_ROBOTS, "host string, text string"))


def _crawlers(s, d):
    """The verdict on each page for each crawler: all in one pass."""
    agents = s.createDataFrame(list(op.AI_CRAWLERS.items()), "crawler string, purpose string")
    return op.allowed_for(_paths(s, d), _robots(s), agents).groupBy("host", "crawler", "purpose").agg(F.count_if(~F.col("allowed")).alias("blocked"), F.count("*").alias("paths"))


def _identified(s, d):
    """Pages with what they declare made from their ids: types and og:type of some."""
    n = _p() % 12
    types = F.when(n == 1, F.array(F.lit("FAQPage"))).when(n == 2, F.array(F.lit("Product"), F.lit("WebPage"))).when(n == 3, F.array(F.lit("ItemList"))).when(n == 4, F.array(F.lit("AboutPage")))
    og = F.when(n == 5, "Article").when(n == 6, "product").when(n == 7, " profile ")
    return table(s, d, "pages").select("page_id", "url", types.alias("types"), og.alias("og_type"), (n == 8).alias("dated_article"), (_p() % 5).alias("calls"))


def _edges(s, d):
    """Links from a page to the next ones by id, as the nav links of the table lead to no page of it."""
    p = table(s, d, "pages").select(_p())
    n = p.agg(F.max("page_id").alias("n"))
    to = F.array(_p() * 2 + 1, _p() * 2 + 2, F.lit(0).cast("long"))
    return p.crossJoin(F.broadcast(n)).select(_p().alias("src"), F.explode(to).alias("dst"), "n").where("dst <= n AND src % 7 <> 3").drop("n")


def _signals(s, d):
    rows = _facts(s, d).withColumn("group", F.when(_p() % 3 == 0, "ai").otherwise("organic"))
    return op.prevalence(rows.select("group", (F.col("words") > 500).alias("long"), F.when(_p() % 5 != 0, F.col("h2") > 0).alias("h2"), F.when(_p() < 2, True).alias("few")), "group", ["long", "h2", "few"])


QUERIES = {
    "html_word_count": lambda s, d: table(s, d, "pages").select("page_id", op.word_count(F.col("html")).alias("words")),
    "page_identity": lambda s, d: op.identity(_identified(s, d)),
    "onpage_rules": lambda s, d: op.rules(_facts(s, d)).select("page_id", F.array_join("issues", ",").alias("issues")),
    "onpage_facts": lambda s, d: _facts(s, d).select("page_id", "title", "lang", "h1", "h2", "images", F.size("links").alias("links")),
    "duplicate_titles": lambda s, d: op.duplicates(_facts(s, d), "title"),
    "short_pages": lambda s, d: op.short_pages(_facts(s, d).join(_crawled(s, d).select("page_id", "status", "noindex"), "page_id")),
    "crawl_issues": lambda s, d: op.crawl_issues(_crawled(s, d)),
    "issue_counts": lambda s, d: op.issue_counts(op.crawl_issues(_crawled(s, d))),
    "tally_checks": lambda s, d: op.tally(_checks(s, d), "user_id"),
    "check_grades": lambda s, d: op.tally(_checks(s, d), "user_id").select("user_id", op.grade(F.col("percent"), [(75, "A"), (60, "B"), (40, "C")], "D").alias("grade")),
    "rate_vitals": lambda s, d: _vitals(s, d).select("user_id", "metric", op.rate_vital(F.col("metric"), F.col("value")).alias("rating")),
    "assess_vitals": lambda s, d: op.assess_vitals(_vitals(s, d), "user_id"),
    "signal_prevalence": _signals,
    "robots_allowed": lambda s, d: op.allowed(_paths(s, d), _robots(s), "SomeBot"),
    "robots_crawlers": _crawlers,
    "crawl_depth": lambda s, d: op.crawl_depth(_edges(s, d), s.createDataFrame([(0,)], "node long")),
    "broken_links": lambda s, d: op.broken_links(_edges(s, d), _crawled(s, d).select(_p().alias("node"), "status")),
}

_WC = r"""len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '(?i)&[a-z]+;', ' ', 'g'), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::INT"""
_F = rf"""f AS (SELECT page_id, url, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, nullif(regexp_extract(html, '(?is)<html[^>]*\blang=["'']([^"'']*)["'']', 1), '') AS lang,
  nullif(trim(regexp_extract(html, '(?is)<meta[^>]*\bname=["'']description["''][^>]*\bcontent=["'']([^"'']*)["'']', 1)), '') AS description, nullif(regexp_extract(html, '(?is)<meta[^>]*\bname=["'']viewport["''][^>]*\bcontent=["'']([^"'']*)["'']', 1), '') AS viewport,
  nullif(regexp_extract(html, '(?is)<link[^>]*\brel=["'']canonical["''][^>]*\bhref=["'']([^"'']*)["'']', 1), '') AS canonical,
  len(regexp_extract_all(html, '(?i)<h1\b'))::INT AS h1, len(regexp_extract_all(html, '(?i)<h2\b'))::INT AS h2, len(regexp_extract_all(html, '(?is)<img\b[^>]*>'))::INT AS images,
  len(list_filter(regexp_extract_all(html, '(?is)<img\b[^>]*>'), lambda i: NOT regexp_matches(i, '(?i)\balt=')))::INT AS noalt,
  len(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref=["'']([^"''#]+)'))::INT AS links, {_WC} AS words FROM pages)"""
_C = f"""{_F}, c AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 404 WHEN page_id % 29 = 0 THEN 500 WHEN page_id % 37 = 0 THEN 0 ELSE 200 END AS status, page_id % 5 AS redirects, page_id % 8 AS depth, title, description, h1, page_id % 13 = 0 AS noindex FROM f),
i AS (SELECT page_id, unnest(CASE WHEN status = 0 THEN ['fetch_error critical'] WHEN status >= 500 THEN ['server_error critical'] WHEN status NOT BETWEEN 200 AND 299 THEN ['broken_link critical'] ELSE list_filter([
  CASE WHEN title IS NULL THEN 'missing_title critical' WHEN length(title) > 70 THEN 'long_title warning' END, CASE WHEN description IS NULL THEN 'missing_description warning' END,
  CASE WHEN h1 = 0 THEN 'missing_h1 warning' END, CASE WHEN redirects > 3 THEN 'redirect_chain warning' END, CASE WHEN noindex THEN 'noindex warning' END,
  CASE WHEN depth >= 6 THEN 'very_deep_page critical' WHEN depth >= 4 THEN 'deep_page warning' END], lambda x: x IS NOT NULL) END) AS x FROM c)"""
_K = """k AS (SELECT user_id, (event_id % 5 + 1)::INT AS points, CASE WHEN event_id % 3 <> 0 THEN (event_id % 5 + 1)::INT END AS earned, CASE WHEN event_id % 11 = 0 THEN 'not-applicable' WHEN event_id % 13 = 0 THEN 'not-evaluated' END AS status FROM events),
t AS (SELECT user_id, coalesce(sum(coalesce(earned, 0)) FILTER (status IS NULL), 0)::BIGINT AS score, coalesce(sum(points) FILTER (status IS NULL), 0)::BIGINT AS max, coalesce(sum(points) FILTER (status = 'not-applicable'), 0)::BIGINT AS not_applicable, coalesce(sum(points) FILTER (status = 'not-evaluated'), 0)::BIGINT AS not_evaluated FROM k GROUP BY 1),
g AS (SELECT *, floor(score * 100 / nullif(max, 0) + 0.5)::BIGINT AS percent FROM t)"""
_V = """m AS (SELECT user_id, ['lcp', 'inp', 'cls', 'fcp'][(event_id % 4 + 1)::INT] AS metric, value, [100.0::DOUBLE, 10.0, 0.01, 80.0][(event_id % 4 + 1)::INT] AS scale FROM events WHERE user_id % 3 <> 0 OR event_id % 4 <> 1),
v AS (SELECT user_id, metric, min(value * scale + user_id) AS value FROM m GROUP BY ALL),
r AS (SELECT user_id, metric, CASE WHEN value <= good THEN 'good' WHEN value > poor THEN 'poor' ELSE 'needs improvement' END AS rating FROM v JOIN (VALUES ('lcp', 2500, 4000), ('cls', 0.1, 0.25), ('inp', 200, 500), ('fcp', 1800, 3000)) l(metric, good, poor) USING (metric))"""
_E = "e AS (SELECT * FROM (SELECT page_id AS src, unnest([page_id * 2 + 1, page_id * 2 + 2, 0]) AS dst FROM pages) WHERE dst <= (SELECT max(page_id) FROM pages) AND src % 7 <> 3)"
ORACLES = {
    "html_word_count": f"SELECT page_id, {_WC} AS words FROM pages",
    "page_identity": rf"""WITH u AS (SELECT page_id, page_id % 12 AS n, page_id % 5 AS calls, regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1) AS path FROM pages),
p AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM u),
q AS (SELECT *, CASE WHEN len(s) = 1 AND regexp_matches(s[1], '(?i)^index\.(html?|php|aspx?)$') THEN [] ELSE s END AS t FROM p),
r AS (SELECT *, len(t) = 0 OR (len(t) = 1 AND regexp_matches(t[1], '(?i)^[a-z]{{2}}(?:[-_][a-z]{{2,4}})?$')) AS is_root FROM q)
SELECT page_id, CASE WHEN is_root THEN 'homepage' WHEN regexp_matches(path, '{op.FAQ_PATH}') OR n = 1 THEN 'faq' WHEN n IN (2, 6) OR regexp_matches(path, '{op.PRODUCT_PATH}') THEN 'product'
  WHEN n IN (5, 8) OR regexp_matches(path, '{op.ARTICLE_PATH}') THEN 'article' WHEN n = 3 THEN 'collection' WHEN n IN (4, 7) THEN 'profile' WHEN calls >= 3 THEN 'landing' ELSE 'generic' END AS kind,
  is_root, CASE WHEN is_root THEN 0 ELSE len(t) END::INT AS depth FROM r""",
    "onpage_rules": f"""WITH {_F} SELECT page_id, array_to_string(list_filter([CASE WHEN title IS NULL THEN 'title-missing' END, CASE WHEN length(title) > 70 THEN 'title-long' END, CASE WHEN description IS NULL THEN 'description-missing' END, CASE WHEN length(description) > 165 THEN 'description-long' END,
  CASE WHEN h1 = 0 THEN 'h1-missing' END, CASE WHEN h1 > 1 THEN 'h1-multiple' END, CASE WHEN canonical IS NULL THEN 'canonical-missing' END, CASE WHEN viewport IS NULL THEN 'viewport-missing' END, CASE WHEN lang IS NULL THEN 'lang-missing' END, CASE WHEN noalt > 0 THEN 'images-alt' END], lambda x: x IS NOT NULL), ',') AS issues FROM f""",
    "onpage_facts": f"WITH {_F} SELECT page_id, title, lang, h1, h2, images, links FROM f",
    "duplicate_titles": f"WITH {_F} SELECT title, count(*) AS n, min(page_id) AS first_page FROM f WHERE title IS NOT NULL GROUP BY title HAVING count(*) > 1",
    "short_pages": f"WITH {_F} SELECT page_id, words FROM f WHERE words > 0 AND words < 300 AND page_id % 11 <> 0 AND page_id % 29 <> 0 AND page_id % 13 <> 0",
    "crawl_issues": f"WITH {_C} SELECT page_id, split_part(x, ' ', 1) AS type, split_part(x, ' ', 2) AS severity FROM i",
    "issue_counts": f"WITH {_C} SELECT split_part(x, ' ', 1) AS type, count(*) AS n FROM i GROUP BY 1",
    "tally_checks": f"WITH {_K} SELECT * FROM g",
    "check_grades": f"WITH {_K} SELECT user_id, CASE WHEN percent >= 75 THEN 'A' WHEN percent >= 60 THEN 'B' WHEN percent >= 40 THEN 'C' WHEN percent IS NOT NULL THEN 'D' END AS grade FROM g",
    "rate_vitals": f"WITH {_V} SELECT user_id, metric, rating FROM r",
    "assess_vitals": f"WITH {_V} SELECT user_id, CASE WHEN count(*) FILTER (rating <> 'good') > 0 THEN 'fails' WHEN count(DISTINCT metric) < 3 THEN 'unassessable' ELSE 'passes' END AS assessment FROM r WHERE metric IN ('lcp', 'inp', 'cls') GROUP BY 1",
    "signal_prevalence": f"""WITH {_F}, s AS (SELECT page_id % 3 = 0 AS ai, unnest([{{'signal': 'long', 'yes': words > 500}}, {{'signal': 'h2', 'yes': CASE WHEN page_id % 5 <> 0 THEN h2 > 0 END}}, {{'signal': 'few', 'yes': CASE WHEN page_id < 2 THEN true END}}], recursive := true) FROM f),
a AS (SELECT ai, signal, CASE WHEN count(yes) >= 3 THEN count(*) FILTER (yes) * 100 / count(yes) END AS share FROM s GROUP BY ALL), p AS (SELECT signal, max(share) FILTER (ai) AS ai, max(share) FILTER (NOT ai) AS organic FROM a GROUP BY 1)
SELECT *, ai - organic AS gap, coalesce(abs(ai - organic) >= 25, false) AS notable FROM p""",
    "robots_allowed": f"""WITH {SQL['pk']}, p AS (SELECT DISTINCT CASE WHEN page_id % 2 = 0 THEN 'a' ELSE 'b' END AS host, path_key AS path FROM pk)
SELECT host, path, CASE WHEN host = 'b' THEN true WHEN regexp_matches(path, '^/.*\\.html$') AND NOT (regexp_matches(path, '^/en/45') AND length('/en/45') >= length('/*.html$')) THEN false WHEN regexp_matches(path, '^/en/45') THEN true WHEN regexp_matches(path, '^/en/4') THEN false ELSE true END AS allowed FROM p""",
    "crawl_depth": f"""WITH RECURSIVE {_E}, w(node, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT dst, depth + 1 FROM w JOIN e ON src = node WHERE depth < 20) SELECT node, min(depth) AS depth FROM w GROUP BY node""",
    "broken_links": f"WITH {_C}, {_E} SELECT dst AS node, status, count(DISTINCT src) AS found_on FROM e JOIN c ON page_id = dst WHERE status >= 400 OR status = 0 GROUP BY ALL",
    "robots_crawlers": f"""WITH {SQL['pk']}, p AS (SELECT DISTINCT CASE WHEN page_id % 2 = 0 THEN 'a' ELSE 'b' END AS host, path_key AS path FROM pk),
c(crawler, purpose) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in op.AI_CRAWLERS.items())})
SELECT host, crawler, purpose, count(*) FILTER (host = 'a' AND (crawler IN ('GPTBot', 'CCBot') OR ((path LIKE '/en/4%' OR path LIKE '/%.html') AND NOT (path LIKE '/en/45%' AND path NOT LIKE '/%.html')))) AS blocked, count(*) AS paths
FROM p, c GROUP BY ALL""",
}
