"""Queries on inspections, archives, sitemaps, properties, dates and small measures, over tables made of the driver's by
expressions that Spark's SQL and DuckDB's share."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelode.functions import dates, measures
from sitelode.operators import history, inspection as op
from sitelode.sources.tables import SQL, page_keys, product_rows, readings, table

_VERDICT = "CASE WHEN page_id % 3 = 0 THEN 'PASS' WHEN page_id % 3 = 1 THEN 'NEUTRAL' END"
_COVERAGE = "CASE WHEN page_id % 5 = 0 THEN 'Crawled - currently not indexed' WHEN page_id % 5 < 3 THEN 'Discovered - currently not indexed' WHEN page_id % 5 = 3 THEN 'Excluded by noindex' END"
_GOOGLE = "CASE WHEN page_id % 4 = 0 THEN url WHEN page_id % 4 = 1 THEN 'https://example.com/' WHEN page_id % 4 = 2 THEN '' END"
#: What is detected and declared, as names in a row.
_DETECTED = "CASE WHEN page_id % 6 = 0 THEN 'Breadcrumbs|Product snippets' WHEN page_id % 6 = 1 THEN 'Q&A' WHEN page_id % 6 = 2 THEN 'Review snippets|Breadcrumbs|Unheard of' WHEN page_id % 6 = 3 THEN 'Breadcrumbs' WHEN page_id % 6 = 4 THEN 'Merchant listings|Local business' END"
_DECLARED = "CASE WHEN page_id % 7 = 0 THEN 'BreadcrumbList|Product|FAQPage' WHEN page_id % 7 = 1 THEN 'QAPage|HowTo' WHEN page_id % 7 = 2 THEN 'AggregateRating|Event' WHEN page_id % 7 = 3 THEN 'ProductGroup|WebPage' WHEN page_id % 7 = 4 THEN 'Organization|Recipe' END"


def _inspected(s, d):
    names = lambda e: F.split(F.expr(e), r"\|")
    return table(s, d, "pages").select(
        F.col("page_id").alias("page"), F.expr(_VERDICT).alias("verdict"), F.expr(_COVERAGE).alias("coverage"), F.expr(_GOOGLE).alias("google"), F.col("url").alias("user"),
        names(_DETECTED).alias("detected"), names(_DECLARED).alias("declared"), (F.col("page_id") % 11 != 0).alias("crawled"),
    )


#: Captures of an archive, made of an order: its customer's page, of several kinds of address.
_KEY = "o_custkey"
_ADDRESS = "concat('https://old.example.com/', CASE WHEN o_custkey % 7 = 0 THEN 'img/' ELSE 'a/' END, o_custkey, CASE WHEN o_custkey % 5 = 0 THEN '.html' WHEN o_custkey % 5 = 1 THEN '.png' WHEN o_custkey % 5 = 2 THEN '?q=1' WHEN o_custkey % 5 = 3 THEN '' ELSE CASE WHEN o_custkey % 2 = 0 THEN '/%22x' ELSE '.v2/' END END)"


def _captures(s, d, gone):
    stamp = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("120000"))
    return table(s, d, "orders").where(F.col("o_orderkey") % 3 == (0 if gone else 1)).select(F.col("o_custkey").alias("urlkey"), F.expr(_ADDRESS).alias("original"), stamp.alias("timestamp"))


_ENTRY = "CASE WHEN page_id % 9 = 0 THEN '' WHEN page_id % 9 = 1 THEN '24-1-1' WHEN page_id % 9 = 2 THEN '2024-03-05T09:58:00' WHEN page_id % 9 = 3 THEN '2025-01-01' WHEN page_id % 9 = 4 THEN '2024-03-06T11:00:00' WHEN page_id % 9 < 7 THEN '2024-03-05' ELSE '2024-02-01' END"


def _health(s, d):
    return op.sitemap_health(page_keys(s, d).select("host_key", F.expr(_ENTRY).alias("lastmod")).select(F.col("host_key").alias("host"), "lastmod", F.lit("2024-03-05 10:00:00").cast("timestamp").alias("fetched_at")))


_PROPERTY = "CASE WHEN s_suppkey % 4 = 0 THEN concat('sc-domain:shop', s_suppkey % 20, '.example') WHEN s_suppkey % 4 = 1 THEN concat('https://www.shop', s_suppkey % 20, '.example/') ELSE concat('https://m.shop', s_suppkey % 20, '.example/de/') END"
_ASKED = "CASE WHEN c_custkey % 4 = 0 THEN concat('shop', c_custkey % 30, '.example') WHEN c_custkey % 4 = 1 THEN concat('https://blog.shop', c_custkey % 30, '.example/post?x=1') WHEN c_custkey % 4 = 2 THEN concat('sc-domain:shop', c_custkey % 30, '.example') ELSE 'no host' END"


def _properties(s, d):
    asked = table(s, d, "customer").select(F.expr(_ASKED).alias("input")).distinct()
    return op.match_property(asked, table(s, d, "supplier").select(F.expr(_PROPERTY).alias("property"), F.col("s_suppkey").alias("position")))


_WHEN = "CASE WHEN o_orderkey % 6 = 0 THEN 'today' WHEN o_orderkey % 6 = 1 THEN ' yesterday' WHEN o_orderkey % 6 = 2 THEN concat(o_orderkey % 90, 'daysAgo') WHEN o_orderkey % 6 = 3 THEN '2024-02-29' WHEN o_orderkey % 6 = 4 THEN 'tomorrow' ELSE '2024-2-9' END"


def _dates(s, d):
    rows = table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"), F.to_date("o_orderdate").alias("day"), F.expr(_WHEN).alias("asked"))
    rows = rows.withColumn("ts", F.timestamp_seconds(F.unix_timestamp("ts") + F.col("o_orderkey") % 86400))
    today = dates.today_in(dates.PACIFIC, F.col("ts"))
    key = F.when(F.col("o_orderkey") % 5 == 0, "2024-05-05 10").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("o_orderkey") % 5 == 1, "Z").when(F.col("o_orderkey") % 5 == 2, "").otherwise("-07:00")))
    hour, window = dates.hour_key(key), dates.hourly_window(F.col("o_orderkey") % 14, today)
    as_of, dated = F.lit("1998-08-02").cast("date"), F.when(F.col("o_orderkey") % 9 != 0, F.col("day"))
    text = lambda c: c.cast("string")
    return rows.select(
        "o_orderkey", text(today).alias("today"), text(window["first"]).alias("first_day"), text(dates.resolve(F.col("asked"), today)).alias("resolved"), hour["date"].alias("hour_date"), hour["hour"].alias("hour"),
        F.coalesce(F.unix_timestamp(hour["instant"]), F.lit(-1)).alias("instant"), dates.capture_date(F.date_format("ts", "yyyyMMddHHmmss")).alias("captured"), dates.age_tier(dated, as_of).alias("age"), dates.freshness_tier(dated, as_of).alias("freshness"),
    )


def _measures(s, d):
    n, x = F.col("event_id"), F.col("value")
    part = lambda k: F.when(n % (k + 5) != 0, F.round(x * (k + n % 3)))
    parts = {"ttfb": part(1), "load delay": part(2), "load time": part(3), "render delay": part(4)}
    odd = F.when(n % 10 == 0, F.lit(float("nan"))).when(n % 10 == 1, F.lit(float("inf"))).otherwise(x * 7 / 3)
    return table(s, d, "events").select(
        "event_id", measures.largest_part(parts).alias("largest"), F.coalesce(measures.hit_share(F.when(n % 7 != 0, n % 5), n % 4), F.lit(-1.0)).alias("cache_share"),
        F.coalesce(measures.stored(odd), F.lit(-1.0)).alias("stored"), F.coalesce(measures.earned(F.lit(10), n % 7, n % 8), F.lit(-1)).cast("long").alias("earned"),
    )


def _text_units(s, d):
    rows = table(s, d, "documents")
    t = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", measures.billing_units(t).cast("long").alias("units"), measures.token_estimate(t).cast("long").alias("tokens"), (measures.token_estimate(t) > measures.TOKEN_BUDGET).alias("over"))


def _audits(s, d, later):
    """Three labelled values of each customer, now and then."""
    labels = ["Title", "Canonical", "Security headers", "Gone"]
    label = F.element_at(F.array(*map(F.lit, labels)), (F.col("k") + 1).cast("int"))
    n = F.col("c_custkey") + (F.col("c_custkey") % 3 * F.col("k") if later else F.lit(0))
    value = F.when((F.col("k") == 2) & (F.col("c_custkey") % 4 == (0 if later else 1)), history.UNREAD).otherwise(F.concat(F.lit("v"), n.cast("string")))
    rows = table(s, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    return (rows.where("k < 3 OR c_custkey % 5 = 0") if later else rows.where("k <> 1 OR c_custkey % 2 = 0")).select("c_custkey", label.alias("label"), value.alias("value"))


_FIELD = {"name": "p_name", "description": "CASE WHEN p_partkey % 3 <> 0 THEN p_type END"}

QUERIES = {
    "coverage_reasons": lambda s, d: op.coverage_reasons(_inspected(s, d)),
    "canonical_disagreements": lambda s, d: _inspected(s, d).where(op.canonical_disagrees(F.col("google"), F.col("user"))).select("page", "google", "user"),
    "rich_result_index": lambda s, d: op.rich_result_index(_inspected(s, d)),
    "schema_detection_gap": lambda s, d: op.detection_gap(_inspected(s, d)),
    "archive_lost_pages": lambda s, d: op.lost_pages(_captures(s, d, False), _captures(s, d, True)),
    "sitemap_health": _health,
    "property_match": _properties,
    "properties_by_account": lambda s, d: op.by_account(table(s, d, "supplier").select(F.expr("CASE WHEN s_nationkey % 6 <> 0 THEN concat('account ', s_nationkey) END").alias("account"), F.expr(_PROPERTY).alias("name"))).withColumn("properties", F.array_join("properties", ",")),
    "field_search": lambda s, d: op.search_fields(table(s, d, "part").select(*[F.expr(e).alias(k) for k, e in _FIELD.items()]), "Red"),
    "field_list": lambda s, d: op.search_fields(table(s, d, "part").select(*[F.expr(e).alias(k) for k, e in _FIELD.items()]).distinct(), None),
    "hour_filter": lambda s, d: op.matching(product_rows(s, d), query="blue bolt").groupBy("date").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions")),
    "report_page": lambda s, d: op.report_page(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), F.desc("o_totalprice"), F.col("o_orderkey"), offset=100, limit=50),
    "scores_nulls_last": lambda s, d: op.report_page(readings(s, d).groupBy("site_id").agg(F.max(F.when(F.col("site_id") % 3 != 0, F.col("value"))).alias("score")).withColumn("scored", F.col("score").isNotNull()).fillna(0.0), F.desc("scored"), F.desc("score"), F.col("site_id"), limit=200),
    "sitemap_sample": lambda s, d: op.page_sample(page_keys(s, d).groupBy("url_key").agg(F.min("page_id").alias("position")), page_keys(s, d).where("page_id % 3 = 0").groupBy("url_key").agg(F.sum(F.col("page_id") % 50).cast("double").alias("impressions")), 40),
    "date_forms": _dates,
    "small_measures": _measures,
    "text_units": _text_units,
    "metric_series": lambda s, d: history.series(readings(s, d), 7, "view", "2024-01-05"),
    "series_ends": lambda s, d: history.series_ends(readings(s, d)).na.fill(-1.0),
    "audit_diff": lambda s, d: history.audit_diff(_audits(s, d, False), _audits(s, d, True), "c_custkey"),
    "median_words": lambda s, d: table(s, d, "documents").groupBy("source").agg(measures.rounded_median(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))).cast("long").alias("median_words")),
}

_I = f"i AS (SELECT page_id AS page, {_VERDICT} AS verdict, {_COVERAGE} AS coverage, {_GOOGLE} AS google, url AS \"user\", coalesce(string_split({_DETECTED}, '|'), []) AS detected, coalesce(string_split({_DECLARED}, '|'), []) AS declared, page_id % 11 <> 0 AS crawled FROM pages)"
_MAP = "m(words, types, sure) AS (VALUES " + ", ".join(f"(string_split('{w.replace(' ', '|').replace('_', ' ')}', '|'), string_split('{t}', ' '), {str(e).lower()})" for w, t, e in op.RICH_RESULTS) + ")"
_P = "flatten((SELECT coalesce(list(types), []) FROM m WHERE len(list_filter(words, lambda w: contains(lower({x}), w))) > 0))"
_C = lambda name, r: f"{name} AS (SELECT o_custkey AS urlkey, max(strftime(o_orderdate, '%Y%m%d') || '120000') AS t FROM orders WHERE o_orderkey % 3 = {r} GROUP BY 1)"
_PART = lambda k: f"CASE WHEN event_id % {k + 5} <> 0 THEN round(value * ({k} + event_id % 3)) END"
ORACLES = {
    "coverage_reasons": f"WITH {_I} SELECT coalesce(coverage, 'no coverage state reported') AS reason, count(*) AS pages, min(page) AS first_page FROM i WHERE verdict IS DISTINCT FROM 'PASS' GROUP BY 1",
    "canonical_disagreements": f"WITH {_I} SELECT page, google, \"user\" FROM i WHERE google <> '' AND google <> \"user\"",
    "rich_result_index": f"WITH {_I} SELECT type, count(*) AS pages FROM (SELECT page, unnest(list_distinct(detected)) AS type FROM i) GROUP BY 1",
    "schema_detection_gap": f"""WITH {_I}, {_MAP}, dt AS (SELECT page, unnest(detected) AS type FROM i), dc AS (SELECT page, crawled, unnest(declared) AS type FROM i),
pr AS (SELECT DISTINCT page, dt.type AS rich, unnest(types) AS t FROM dt JOIN m ON len(list_filter(words, lambda w: contains(lower(dt.type), w))) > 0)
SELECT page, 'not detected' AS kind, type FROM dc WHERE crawled AND type NOT IN ('FAQPage', 'HowTo') AND EXISTS (SELECT 1 FROM m WHERE sure AND list_contains(types, dc.type)) AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.page = dc.page AND t = dc.type)
UNION ALL SELECT page, 'retired', type FROM dc WHERE type IN ('FAQPage', 'HowTo')
UNION ALL SELECT page, 'unmapped', type FROM dt WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.page = dt.page AND rich = dt.type)
UNION ALL SELECT page, 'no longer declared', type FROM dt WHERE EXISTS (SELECT 1 FROM pr WHERE pr.page = dt.page AND rich = dt.type) AND NOT EXISTS (SELECT 1 FROM pr JOIN dc ON dc.page = pr.page AND dc.type = pr.t WHERE pr.page = dt.page AND rich = dt.type)""",
    "archive_lost_pages": f"""WITH {_C('l', 1)}, {_C('g', 0)}, a AS (SELECT DISTINCT o_custkey AS urlkey, {_ADDRESS} AS original FROM orders)
SELECT urlkey, original, l.t AS last_live, CASE WHEN g.t > l.t THEN g.t END AS died_at FROM l JOIN a USING (urlkey) LEFT JOIN g USING (urlkey) WHERE urlkey % 5 IN (0, 3) OR (urlkey % 5 = 4 AND urlkey % 2 = 1)""",
    "sitemap_health": f"""WITH {SQL['pk']}, e AS (SELECT host_key AS host, {_ENTRY} AS m, page_id % 9 AS n FROM pk),
t AS (SELECT host, count(*) AS urls, count(*) FILTER (n > 1) AS dated, count(*) FILTER (n = 0) AS missing, count(*) FILTER (n = 1) AS malformed, count(*) FILTER (n IN (3, 4)) AS future, count(DISTINCT m) FILTER (n > 1) AS dates, count(*) FILTER (n IN (2, 5, 6)) AS stamped FROM e GROUP BY 1)
SELECT *, dated >= 2 AND dates = 1 AS one_date, dated >= 2 AND stamped / dated >= 0.8 AS generated FROM t""",
    "property_match": f"""WITH p AS (SELECT {_PROPERTY} AS property, s_suppkey AS position, 'shop' || s_suppkey % 20 || '.example' AS dom FROM supplier), a AS (SELECT DISTINCT {_ASKED} AS input FROM customer),
b AS (SELECT dom, property FROM p QUALIFY row_number() OVER (PARTITION BY dom ORDER BY starts_with(property, 'sc-domain:') DESC, position) = 1)
SELECT input, CASE WHEN starts_with(input, 'sc-domain:') THEN input ELSE property END AS property FROM a LEFT JOIN b ON dom = nullif(regexp_extract(input, 'shop[0-9]+\\.example'), '')""",
    "properties_by_account": f"SELECT CASE WHEN s_nationkey % 6 <> 0 THEN 'account ' || s_nationkey ELSE '(no account)' END AS account, string_agg({_PROPERTY}, ',' ORDER BY {_PROPERTY}) AS properties, count(*) AS n FROM supplier GROUP BY 1",
    "field_search": "SELECT p_name AS name, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS description FROM part WHERE p_name ILIKE '%red%' OR (p_partkey % 3 <> 0 AND p_type ILIKE '%red%')",
    "field_list": "SELECT name, description FROM (SELECT DISTINCT p_name AS name, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS description FROM part) ORDER BY name, description NULLS FIRST LIMIT 40",
    "hour_filter": f"WITH {SQL['search']} SELECT date, sum(clicks) AS clicks, sum(impressions) AS impressions FROM search WHERE query = 'blue bolt' GROUP BY 1",
    "report_page": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100",
    "scores_nulls_last": f"WITH {SQL['readings']}, t AS (SELECT site_id, max(value) FILTER (site_id % 3 <> 0) AS score FROM readings GROUP BY 1) SELECT site_id, coalesce(score, 0) AS score, score IS NOT NULL AS scored FROM t ORDER BY t.score DESC NULLS LAST, site_id LIMIT 200",
    "sitemap_sample": f"WITH {SQL['pk']}, e AS (SELECT url_key, min(page_id) AS position, coalesce(sum(page_id % 50) FILTER (page_id % 3 = 0), 0)::DOUBLE AS impressions FROM pk GROUP BY 1) SELECT * FROM e ORDER BY impressions DESC, position LIMIT 40",
    "date_forms": f"""WITH r AS (SELECT o_orderkey, o_orderdate::DATE AS day, o_orderdate::TIMESTAMP + to_seconds(o_orderkey % 86400) AS ts, trim({_WHEN}) AS asked FROM orders),
t AS (SELECT *, timezone('America/Los_Angeles', timezone('UTC', ts))::DATE AS today FROM r)
SELECT o_orderkey, today::VARCHAR AS today, (today - (least(10, greatest(1, o_orderkey % 14))::INT - 1))::VARCHAR AS first_day,
  CASE WHEN asked = 'today' THEN today WHEN asked = 'yesterday' THEN today - 1 WHEN asked LIKE '%daysAgo' THEN today - (o_orderkey % 90)::INT WHEN asked = '2024-02-29' THEN DATE '2024-02-29' END::VARCHAR AS resolved,
  CASE WHEN o_orderkey % 5 IN (1, 3, 4) THEN strftime(ts, '%Y-%m-%d') END AS hour_date, CASE WHEN o_orderkey % 5 IN (1, 3, 4) THEN strftime(ts, '%H') END AS hour,
  CASE WHEN o_orderkey % 5 IN (1, 3, 4) THEN epoch(ts)::BIGINT + CASE WHEN o_orderkey % 5 = 1 THEN 0 ELSE 25200 END ELSE -1 END AS instant, strftime(ts, '%Y-%m-%d') AS captured,
  CASE WHEN o_orderkey % 9 = 0 THEN 'unknown' WHEN greatest(0, DATE '1998-08-02' - day) >= 548 THEN 'legacy' ELSE 'new' END AS age,
  CASE WHEN o_orderkey % 9 = 0 THEN 'unknown' WHEN DATE '1998-08-02' - day <= 60 THEN 'fresh' WHEN DATE '1998-08-02' - day <= 180 THEN 'aging' ELSE 'stale' END AS freshness FROM t""",
    "small_measures": f"""WITH p AS (SELECT event_id, value, {_PART(1)} AS a, {_PART(2)} AS b, {_PART(3)} AS c, {_PART(4)} AS d FROM events)
SELECT event_id, CASE WHEN a IS NULL OR b IS NULL OR c IS NULL OR d IS NULL THEN NULL WHEN a >= b AND a >= c AND a >= d THEN 'ttfb' WHEN b >= c AND b >= d THEN 'load delay' WHEN c >= d THEN 'load time' ELSE 'render delay' END AS largest,
  coalesce(CASE WHEN event_id % 7 <> 0 AND event_id % 5 + event_id % 4 > 0 THEN (event_id % 5) / (event_id % 5 + event_id % 4) END, -1)::DOUBLE AS cache_share,
  CASE WHEN event_id % 10 < 2 THEN -1 ELSE floor(value * 7 / 3 * 100 + 0.5::DOUBLE) / 100 END AS stored, CASE WHEN event_id % 8 = 0 THEN -1 ELSE floor(10 * (event_id % 7) / (event_id % 8) + 0.5::DOUBLE) END::BIGINT AS earned FROM p""",
    "text_units": "SELECT doc_id, ceil(length(coalesce(text, '')) / 1000)::BIGINT AS units, ceil(length(coalesce(text, '')) / 4)::BIGINT AS tokens, ceil(length(coalesce(text, '')) / 4) > 30000 AS \"over\" FROM documents",
    "metric_series": f"WITH {SQL['readings']} SELECT captured_at, refresh_id, value FROM readings WHERE site_id = 7 AND metric = 'view' AND captured_at >= TIMESTAMP '2024-01-05'",
    "series_ends": f"WITH {SQL['readings']} SELECT site_id, metric, coalesce(arg_min(value, (captured_at, refresh_id)) FILTER (value IS NOT NULL), -1) AS first, coalesce(arg_max(value, (captured_at, refresh_id)) FILTER (value IS NOT NULL), -1) AS last FROM readings GROUP BY ALL",
    "audit_diff": f"""WITH k AS (SELECT c_custkey, k, ['Title', 'Canonical', 'Security headers', 'Gone'][k + 1] AS label FROM customer, range(4) t(k)),
b AS (SELECT c_custkey, label, CASE WHEN k = 2 AND c_custkey % 4 = 1 THEN '{history.UNREAD}' ELSE 'v' || c_custkey END AS was FROM k WHERE k <> 1 OR c_custkey % 2 = 0),
a AS (SELECT c_custkey, label, CASE WHEN k = 2 AND c_custkey % 4 = 0 THEN '{history.UNREAD}' ELSE 'v' || (c_custkey + c_custkey % 3 * k) END AS now FROM k WHERE k < 3 OR c_custkey % 5 = 0)
SELECT c_custkey, label, was, now, CASE WHEN now IS NULL THEN 'not compared' ELSE 'changed' END AS state FROM b LEFT JOIN a USING (c_custkey, label) WHERE was <> '{history.UNREAD}' AND now IS DISTINCT FROM was""",
    "median_words": r"SELECT source, floor(median(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) + 0.5::DOUBLE)::BIGINT AS median_words FROM documents GROUP BY 1",
}
