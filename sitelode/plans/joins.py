"""Queries that join sources."""

from __future__ import annotations

from pyspark.sql import functions as F


from sitelode.operators import joins as op
from sitelode.sources.tables import SQL, page_keys, product_rows, table



def _p():
    return F.col("page_id")



def _search(s, d):
    """Pages of two ids in three, with measures made from the id and the html's length."""
    p = page_keys(s, d).where(_p() % 3 != 0)
    return p.select("page_id", F.col("url").alias("page"), "url_key", "host_key", (_p() % 50).cast("double").alias("clicks"), (_p() % 50 * 10 + 1).cast("double").alias("impressions"), (_p() % 9 + 1).cast("double").alias("position"))


def _landings(s, d):
    p = page_keys(s, d).where(_p() % 4 != 0)
    return p.select(F.when(_p() % 25 == 1, "(not set)").otherwise(F.regexp_extract("url", r"^[^:]+://[^/]+(/[^#]*)", 1)).alias("landing_page"), (_p() % 30 + 1).cast("double").alias("sessions"), (_p() % 10).cast("double").alias("engaged"), (_p() % 3).cast("double").alias("key_events"))


def _crawled(s, d):
    p = page_keys(s, d).where(_p() % 5 != 0)
    return p.select("page_id", "url_key", "host_key", F.when(_p() % 11 == 0, 404).otherwise(200).alias("status"), (_p() % 13 == 0).alias("noindex"), F.when(_p() % 7 == 0, F.lit("example.com/")).alias("canonical_key"))


def _sitemap(s, d):
    p = page_keys(s, d).where(_p() % 2 == 0)
    mod = F.when(_p() % 8 == 0, F.concat(F.lit("2024-01-"), F.lpad((_p() % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:00"))).when(_p() % 10 == 2, "soon").when(_p() % 10 == 4, "2024-1-9").when(_p() % 10 == 6, "2024-01").otherwise(F.concat(F.lit("2024-01-"), F.lpad((_p() % 28 + 1).cast("string"), 2, "0")))
    return p.groupBy("url_key").agg(F.min_by(mod, "page_id").alias("lastmod"))


def _bucket(name):
    return lambda s, d: op.page_join(_search(s, d), _landings(s, d)).where(F.col("bucket") == name)


def _risk(s, d):
    ops = s.createDataFrame([("one", "example.com", True), ("two", "example.org", False), ("three", "example.edu", True)], "assistant string, host string, blocked boolean")
    return op.crawler_risk(ops, page_keys(s, d).select(F.col("host_key").alias("source"), F.lit(1).alias("sessions")))


def _lastmod(s, d):
    search = _search(s, d).groupBy("url_key").agg(F.sum("impressions").alias("impressions"))
    crawls = page_keys(s, d).where(_p() % 5 != 0).groupBy("url_key").agg(F.max(F.make_timestamp(F.lit(2024), F.lit(1), (_p() % 20 + 5).cast("int"), F.lit(9), F.lit(0), F.lit(0))).alias("crawled_at"))
    return op.lastmod(_sitemap(s, d), search, crawls)


def _vitals(s, d):
    search = _search(s, d).groupBy("url_key", "host_key").agg(F.sum("clicks").alias("clicks"))
    readings = [F.max(F.expr(f"CASE WHEN page_id % 8 <> {gap} THEN page_id % {n} * {step} END").cast("double")).alias(name) for name, n, step, gap in (("lcp", 40, 100, 1), ("inp", 30, 10, 3), ("cls", 25, 0.01, 5))]
    own = page_keys(s, d).where(_p() % 2 == 1).groupBy("url_key").agg(*readings)
    origin = page_keys(s, d).where(_p() % 3 == 0).groupBy("host_key").agg(*readings)
    rows = op.vitals_by_traffic(search, own, origin)
    return rows.select("url_key", "clicks", "basis", *[F.coalesce(F.round(c, 6), F.lit(-1.0)).alias(c) for c in ("lcp", "inp", "cls", "distance", "impact")])


def _spans(s, d):
    start = F.to_date("o_orderdate")
    return table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 17 != 0, start).alias("start"), F.when(F.col("o_orderkey") % 17 != 0, F.date_add(start, (F.col("o_orderkey") % 10).cast("int"))).alias("end"))


def _titles(s, d):
    """Titles made of pages' addresses, in English, Spanish, German or no declared language."""
    rows = product_rows(s, d).groupBy("page", "query").agg(F.sum("impressions").alias("impressions"))
    brand, kind = F.element_at(F.split("page", "[/-]"), -2), F.length("page") % 4
    title = F.concat(F.lit("The Best Réd-Widgets, blúe, greens & Golden things of "), brand, F.lit(": "), F.substring_index("page", "/", -1))
    titles = rows.select("page").distinct().select("page", title.alias("title"), F.when(kind == 0, "en-GB").when(kind == 1, "es").when(kind == 2, "de").alias("lang"))
    return op.title_fit(rows, titles)


QUERIES = {
    "url_keys": lambda s, d: page_keys(s, d).select("page_id", "host_key", "url_key", "path_key"),
    "page_value_join": _bucket("joined"),
    "page_value_search_only": _bucket("search_only"),
    "page_value_ambiguous": _bucket("ambiguous"),
    "page_value_analytics_only": _bucket("analytics_only"),
    "orphan_pages": lambda s, d: op.orphans(_search(s, d), _crawled(s, d)).select("url_key", "host_key", "clicks", "impressions"),
    "zombie_pages": lambda s, d: op.zombies(_sitemap(s, d), _crawled(s, d), _search(s, d)),
    "sitemap_crawl_overlap": lambda s, d: op.overlap(_sitemap(s, d), _crawled(s, d)),
    "landing_groups": lambda s, d: op.landing_groups(page_keys(s, d).where(_p() % 6 == 1).withColumn("sessions", _p() % 30), page_keys(s, d).where(_p() % 6 != 1).withColumn("sessions", _p() % 40)),
    "crawler_traffic_risk": _risk,
    "lastmod_accuracy": _lastmod,
    "vitals_by_traffic": _vitals,
    "title_query_fit": _titles,
    "interval_overlap": lambda s, d: op.overlapping(_spans(s, d), "1997-03-01", "1997-03-31"),
    "asof_year_ago": lambda s, d: op.year_ago(table(s, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice", "1998-05-20"),
}

_SE = f"""{SQL['pk']}, se AS (SELECT page_id, url AS page, url_key, host_key, path_key AS path, (page_id % 50)::DOUBLE AS clicks, (page_id % 50 * 10 + 1)::DOUBLE AS impressions, (page_id % 9 + 1)::DOUBLE AS position FROM pk WHERE page_id % 3 <> 0)"""
_CR = "cr AS (SELECT page_id, url_key, host_key, CASE WHEN page_id % 11 = 0 THEN 404 ELSE 200 END AS status, page_id % 13 = 0 AS noindex, CASE WHEN page_id % 7 = 0 THEN 'example.com/' END AS canonical_key FROM pk WHERE page_id % 5 <> 0)"
_SM = "sm AS (SELECT url_key, arg_min(CASE WHEN page_id % 8 = 0 THEN '2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') || 'T10:00:00' WHEN page_id % 10 = 2 THEN 'soon' WHEN page_id % 10 = 4 THEN '2024-1-9' WHEN page_id % 10 = 6 THEN '2024-01' ELSE '2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') END, page_id) AS lastmod FROM pk WHERE page_id % 2 = 0 GROUP BY url_key)"
_PV = f"""WITH {_SE}, la AS (SELECT CASE WHEN page_id % 25 = 1 THEN NULL ELSE path_key END AS path, (page_id % 30 + 1)::DOUBLE AS sessions, (page_id % 10)::DOUBLE AS engaged, (page_id % 3)::DOUBLE AS key_events FROM pk WHERE page_id % 4 <> 0),
pp AS (SELECT path, count(DISTINCT host_key) AS hosts, sum(clicks) AS clicks, sum(impressions) AS impressions, sum(position * impressions) / sum(impressions) AS position FROM se GROUP BY path),
pl AS (SELECT path, sum(sessions) AS sessions, sum(engaged) AS engaged, sum(key_events) AS key_events FROM la WHERE path IS NOT NULL GROUP BY path)"""
_COLS = "path, NULL::VARCHAR AS host, clicks, impressions, position, sessions, engaged, key_events"
ORACLES = {
    "url_keys": f"WITH {SQL['pk']} SELECT page_id, host_key, url_key, path_key FROM pk",
    "page_value_join": f"{_PV} SELECT 'joined' AS bucket, {_COLS}, engaged / sessions AS engagement_rate FROM pp JOIN pl USING (path) WHERE hosts = 1",
    "page_value_search_only": f"{_PV} SELECT 'search_only' AS bucket, {_COLS}, NULL::DOUBLE AS engagement_rate FROM pp LEFT JOIN pl USING (path) WHERE hosts = 1 AND sessions IS NULL",
    "page_value_ambiguous": f"""{_PV} SELECT 'ambiguous' AS bucket, path, host_key AS host, sum(clicks) AS clicks, sum(impressions) AS impressions, sum(position * impressions) / sum(impressions) AS position,
NULL::DOUBLE AS sessions, NULL::DOUBLE AS engaged, NULL::DOUBLE AS key_events, NULL::DOUBLE AS engagement_rate FROM se WHERE path IN (SELECT path FROM pp WHERE hosts > 1) GROUP BY path, host_key""",
    "page_value_analytics_only": f"{_PV} SELECT 'analytics_only' AS bucket, {_COLS}, NULL::DOUBLE AS engagement_rate FROM pl LEFT JOIN pp USING (path) WHERE hosts IS NULL",
    "orphan_pages": f"WITH {_SE}, {_CR} SELECT url_key, host_key, clicks, impressions FROM se WHERE impressions > 0 AND host_key IN (SELECT host_key FROM cr) AND url_key NOT IN (SELECT url_key FROM cr)",
    "zombie_pages": f"""WITH {_SE}, {_CR}, {_SM}, w AS (SELECT url_key FROM sm UNION SELECT url_key FROM cr WHERE status < 400 AND NOT noindex AND (canonical_key IS NULL OR canonical_key = url_key))
SELECT url_key FROM w WHERE url_key NOT IN (SELECT url_key FROM se)""",
    "sitemap_crawl_overlap": f"WITH {SQL['pk']}, {_CR}, {_SM}, c AS (SELECT DISTINCT url_key AS u FROM cr) SELECT count(*) FILTER (u IS NOT NULL AND url_key IS NOT NULL) AS in_both, count(*) FILTER (u IS NULL) AS sitemap_only, count(*) FILTER (url_key IS NULL) AS crawl_only FROM sm FULL JOIN c ON u = url_key",
    "landing_groups": f"""WITH {SQL['pk']}, a AS (SELECT url_key, sum(page_id % 30)::BIGINT AS sessions FROM pk WHERE page_id % 6 = 1 GROUP BY 1), o AS (SELECT url_key, sum(page_id % 40)::BIGINT AS sessions FROM pk WHERE page_id % 6 <> 1 AND url_key NOT IN (SELECT url_key FROM a) GROUP BY 1)
(SELECT url_key, sessions, 'ai' AS "group" FROM a ORDER BY sessions DESC, url_key LIMIT 10) UNION ALL (SELECT url_key, sessions, 'organic' FROM o ORDER BY sessions DESC, url_key LIMIT 10)""",
    "crawler_traffic_risk": f"""WITH {SQL['pk']}, ops(assistant, host, blocked) AS (VALUES ('one', 'example.com', true), ('two', 'example.org', false), ('three', 'example.edu', true)), src AS (SELECT host_key AS source, count(*) AS sessions FROM pk GROUP BY 1),
k AS (SELECT assistant, blocked, coalesce(sum(sessions), 0)::BIGINT AS sessions FROM ops LEFT JOIN src ON source = host OR source LIKE '%.' || host GROUP BY 1, 2),
o AS (SELECT sum(sessions)::BIGINT AS sessions FROM src WHERE NOT EXISTS (SELECT 1 FROM ops WHERE source = host OR source LIKE '%.' || host))
SELECT assistant, blocked, sessions, blocked AND sessions > 0 AS at_risk FROM k UNION ALL SELECT NULL, NULL, sessions, CASE WHEN sessions > 0 THEN NULL ELSE false END FROM o WHERE sessions IS NOT NULL""",
    "lastmod_accuracy": f"""WITH {_SE}, {_SM}, i AS (SELECT url_key, sum(impressions) AS impressions FROM se GROUP BY 1), c AS (SELECT url_key, max(make_timestamp(2024, 1, (page_id % 20 + 5)::INT, 9, 0, 0)) AS crawled_at FROM pk WHERE page_id % 5 <> 0 GROUP BY 1)
SELECT url_key, lastmod, impressions, crawled_at, CASE WHEN crawled_at IS NULL THEN 'never crawled' WHEN read_as IS NULL THEN 'malformed'
  WHEN CASE WHEN contains(lastmod, 'T') THEN read_as > crawled_at ELSE read_as::DATE > crawled_at::DATE END THEN 'pending' ELSE 'consistent' END AS state
FROM (SELECT *, CASE WHEN length(lastmod) = 7 THEN try_cast(lastmod || '-01' AS TIMESTAMP) WHEN lastmod <> '2024-1-9' THEN try_cast(lastmod AS TIMESTAMP) END AS read_as FROM sm) LEFT JOIN i USING (url_key) LEFT JOIN c USING (url_key)""",
    "vitals_by_traffic": f"""WITH {_SE}, s AS (SELECT url_key, host_key, sum(clicks) AS clicks FROM se GROUP BY ALL),
v AS (SELECT page_id, url_key, host_key, CASE WHEN page_id % 8 <> 1 THEN (page_id % 40 * 100)::DOUBLE END AS l, CASE WHEN page_id % 8 <> 3 THEN (page_id % 30 * 10)::DOUBLE END AS i, CASE WHEN page_id % 8 <> 5 THEN page_id % 25 * 0.01::DOUBLE END AS c FROM pk),
p AS (SELECT url_key, max(l) AS l, max(i) AS i, max(c) AS c FROM v WHERE page_id % 2 = 1 GROUP BY 1), o AS (SELECT host_key, max(l) AS l, max(i) AS i, max(c) AS c FROM v WHERE page_id % 3 = 0 GROUP BY 1),
d AS (SELECT s.url_key, clicks, CASE WHEN p.url_key IS NOT NULL THEN 'page' WHEN o.host_key IS NOT NULL THEN 'origin' ELSE 'not measured' END AS basis, CASE WHEN p.url_key IS NOT NULL THEN [p.l, p.i, p.c] ELSE [o.l, o.i, o.c] END AS x,
  CASE WHEN p.url_key IS NOT NULL THEN greatest(coalesce(p.l, 0) - 2500, 0) / 2500 + greatest(coalesce(p.i, 0) - 200, 0) / 200 + greatest(coalesce(p.c, 0) - 0.1, 0) / 0.1 END AS distance FROM s LEFT JOIN p USING (url_key) LEFT JOIN o ON o.host_key = s.host_key)
SELECT url_key, clicks, basis, round(coalesce(x[1], -1), 6) AS lcp, round(coalesce(x[2], -1), 6) AS inp, round(coalesce(x[3], -1), 6) AS cls, round(coalesce(distance, -1), 6) AS distance, CASE WHEN round(distance, 9) > 0 THEN round(clicks * distance, 6) ELSE -1 END AS impact FROM d""",
    "title_query_fit": f"""WITH {SQL['search']}, t AS (SELECT page, query, sum(impressions) AS i FROM search GROUP BY ALL), r AS (SELECT page, query, (row_number() OVER (PARTITION BY page ORDER BY i DESC, query))::INT AS rank, length(page) % 4 AS kind FROM t QUALIFY rank <= 3),
w AS (SELECT *, list_filter(regexp_split_to_array('the best red widgets blue greens golden things of ' || string_split(replace(page, '-', '/'), '/')[-2] || ' ' || replace(string_split(page, '/')[-1], '-', ' '), '[^a-z0-9]+'), lambda x: x <> '') AS title, list_distinct(list_filter(string_split(query, ' '), lambda x: x <> '')) AS asked FROM r),
m AS (SELECT *, list_filter(list_filter(string_split(query, ' '), lambda x: x <> ''), lambda q: len(list_filter(title, lambda t: t = q OR (length(q) >= 3 AND t IN (q || 's', q || 'es')) OR (length(t) >= 3 AND q IN (t || 's', t || 'es')))) = 0) AS lost FROM w)
SELECT page, query, rank, CASE WHEN kind <> 2 THEN array_to_string(lost, ' ') END AS missing, CASE WHEN kind <> 2 THEN CASE WHEN len(lost) = 0 THEN 'all' WHEN len(lost) < len(asked) THEN 'some' ELSE 'none' END END AS fit FROM m""",
    "interval_overlap": """WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate::DATE END AS start, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate::DATE + (o_orderkey % 10)::INT END AS "end" FROM orders)
SELECT *, CASE WHEN start IS NULL THEN 'undated' ELSE 'overlaps' END AS state FROM s WHERE start IS NULL OR (start <= DATE '1997-03-31' AND "end" >= DATE '1997-03-01')""",
    "asof_year_ago": "SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_totalprice)) AS score, max(o_orderdate) AS at FROM orders WHERE o_orderdate::DATE <= DATE '1997-05-01' GROUP BY 1",
}
