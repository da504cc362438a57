"""More queries on services' answers and on what sites say of themselves; bodies as in `sitelode.plans.payloads`."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelode.operators import pages as on_page
from sitelode.operators import sessions
from sitelode.plans.payloads import _answers, _captures
from sitelode.sources import payloads as op
from sitelode.sources.tables import table

_TOTALS = """CASE WHEN o_orderkey % 4 = 0 THEN '{"metricHeaders":[{"name":"sessions"}]}' ELSE concat('{"metricHeaders":[{"name":"sessions"},{"name":"rate"}],"totals":[{"metricValues":[{"value":"', o_orderkey % 1000, '"},{"value":"', CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE '0.5' END, '"}]}]}') END"""
_HISTORY = """CASE WHEN p_partkey % 8 = 0 THEN '{"error":{}}' ELSE concat('{"record":{"collectionPeriods":[{"lastDate":{"year":2024,"month":1,"day":', p_partkey % 28 + 1, '}},{"lastDate":{"year":2024,"month":2,"day":30}},{}],"metrics":{"largest_contentful_paint":{"percentilesTimeseries":{"p75s":[', p_size, ',null,"', p_size * 2, '"]},"histogramTimeseries":[{"densities":[0.5,"NaN"]},{"densities":[0.1]}]},"other":{"percentilesTimeseries":{"p75s":[1]}}}}}') END"""
_RANKS = """concat('{"as_of":"2024-01-01","results":[{"domain":"A', s_suppkey, '.Example","found":true,"open_page_rank":', s_suppkey % 15, ',"rank":', s_suppkey - 3, ',"history":[{"date":"2023-01","open_page_rank":', s_suppkey % 12, '},{"date":"2023-02","open_page_rank":null},{"open_page_rank":3},{"date":"2023-03","open_page_rank":4.5,"estimated":true}]},{"domain":"b.example","found":false,"open_page_rank":1.5},{"found":true}]}')"""
_ENTITIES = """concat('{"entities":[{"name":" Soup ","type":"OTHER","salience":0.', c_custkey % 9 + 1, ',"mentions":[{"text":{"content":"soup"},"type":"COMMON"},{"text":{"content":"Soup"},"type":"PROPER"},{"text":{"content":"soup"}},{"text":{"content":" "}}]},{"name":"x"},{"name":" ","salience":0.5},{"name":"N', c_custkey % 4, '","salience":0.25}]}')"""


def _roots(s, d):
    p = table(s, d, "supplier").select("s_suppkey", F.expr("concat('https://s', s_suppkey % 40, '.example')").alias("origin"))
    source = F.expr("CASE s_suppkey % 5 WHEN 0 THEN 'robots.txt' WHEN 1 THEN 'search-console' WHEN 2 THEN 'elsewhere' WHEN 3 THEN 'argument' END")
    named = p.select("origin", F.expr("CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE concat(origin, '/m', s_suppkey % 3) END").alias("url"), source.alias("source"))
    return op.sitemap_roots(p.select("origin"), named)


def _field(s, d):
    p = table(s, d, "pages").select("page_id", F.expr("concat('u', page_id)").alias("url"))
    records = p.where("page_id % 5 < 4").select("url", F.expr("CASE page_id % 3 WHEN 0 THEN 'record' WHEN 1 THEN 'no-data' ELSE 'refused' END").alias("state"), F.expr("CASE WHEN page_id % 3 = 0 THEN double(page_id) END").alias("p75"))
    return op.field_source(p, records, p.where("page_id % 2 = 0").select("url", F.expr("-1.0 - page_id").cast("double").alias("p75"))).withColumn("p75", F.coalesce("p75", F.lit(0.5)))


#: A host's rules by its number: some for all crawlers, some for one.
_ROBOTS = """concat('User-agent: *', chr(10), CASE s_suppkey % 4 WHEN 0 THEN 'Disallow: /' WHEN 1 THEN concat('Disallow:', chr(10), 'Disallow: /b', s_suppkey % 3, chr(10), 'Disallow: /a') WHEN 2 THEN concat('Disallow: /', chr(10), 'Allow: /$') ELSE 'Allow: /' END, chr(10), chr(10),
  CASE WHEN s_suppkey % 3 = 0 THEN concat('User-agent: GPTBot', chr(10), 'Disallow: /*', chr(10)) ELSE '' END)"""


def _access(s, d):
    rules = on_page.robots_rules(table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("host"), F.expr(_ROBOTS).alias("text")))
    return on_page.robots_access(rules, s.createDataFrame([("GPTBot",), ("Other",)], "crawler string")).withColumn("restrictions", F.array_join("restrictions", " "))


_FILE = """concat('# Sitemap: none', chr(10), CASE WHEN s_suppkey % 2 = 0 THEN 'Disallow: /early' ELSE 'Sitemap:https://x.example/1 # one' END, chr(10), 'User-Agent: A', chr(10), 'User-agent : b', chr(10), 'no colon here', chr(10), 'Content-Signal: search=yes, ai-train = ', CASE s_suppkey % 3 WHEN 0 THEN 'no' WHEN 1 THEN 'maybe' ELSE 'YES' END, chr(10),
  'Allow:', chr(10), CASE WHEN s_suppkey % 5 = 0 THEN 'User-agent: c' ELSE 'Crawl-delay: 5' END, chr(10), 'Content-signal: search=no,ads=yes', chr(10), 'sitemap: s', s_suppkey)"""


def _files(s, d):
    return table(s, d, "supplier").select("s_suppkey", F.col("s_suppkey").alias("host"), F.expr(_FILE).alias("text"))


def _landings(s, d):
    rows = table(s, d, "events").groupBy(F.expr("concat('/', user_id % 50)").alias("landing_page")).agg(F.count("*").alias("sessions"), F.count_if(F.col("event_type") == "purchase").alias("key_events"))
    return sessions.busiest_landings(rows, 20)


QUERIES = {
    "archive_addresses": lambda s, d: op.addresses(_captures(s, d), "c_custkey", status=200),
    "report_totals": lambda s, d: op.report_totals(_answers(s, d, "orders", "o_orderkey", _TOTALS), "o_orderkey").na.fill(-1.0),
    "vitals_history": lambda s, d: op.vitals_history(_answers(s, d, "part", "p_partkey", _HISTORY), "p_partkey").withColumn("period_end", F.coalesce(F.col("period_end").cast("string"), F.lit("unknown"))).na.fill(-1.0),
    "domain_scores": lambda s, d: op.domain_scores(_answers(s, d, "supplier", "s_suppkey", _RANKS), "s_suppkey").na.fill(-1, ["rank", "referring_domains"]).na.fill(-1.0, ["score"]),
    "domain_score_history": lambda s, d: op.domain_score_history(_answers(s, d, "supplier", "s_suppkey", _RANKS), "s_suppkey"),
    "service_entities": lambda s, d: op.entities(_answers(s, d, "customer", "c_custkey", _ENTITIES), "c_custkey").withColumn("mentions", F.array_join("mentions", ",")),
    "sitemap_roots": _roots,
    "field_source": _field,
    "robots_access": _access,
    "robots_issues": lambda s, d: on_page.robots_issues(_files(s, d)),
    "robots_sitemaps": lambda s, d: on_page.robots_sitemaps(_files(s, d)),
    "robots_uses": lambda s, d: on_page.robots_uses(_files(s, d)),
    "robots_status": lambda s, d: table(s, d, "events").select("event_id", on_page.robots_status((F.col("event_id") % 600).cast("int")).alias("state")),
    "offsite_presence": lambda s, d: on_page.presence(table(s, d, "events").select("user_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type") == "view").alias("found")), "user_id"),
    "busiest_landings": _landings,
}

ORACLES = {
    "archive_addresses": """SELECT c_custkey, 'k' || c_custkey AS urlkey, CASE WHEN c_custkey % 2 = 0 THEN '20200101000000' ELSE '20200201000000' END AS timestamp, CASE WHEN c_custkey % 2 = 0 THEN 'http://a.example/' || c_custkey ELSE 'http://b.example/' END AS original, CASE WHEN c_custkey % 2 = 0 THEN 'D1' ELSE 'D2' END AS digest
FROM customer WHERE c_custkey % 9 > 1""",
    "report_totals": "SELECT o_orderkey, 'sessions' AS metric, (o_orderkey % 1000)::DOUBLE AS total FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, 'rate', CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 0.5 END FROM orders WHERE o_orderkey % 4 <> 0",
    "vitals_history": """SELECT p_partkey, 'lcp' AS metric, i AS "at", CASE i WHEN 0 THEN '2024-01-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') ELSE 'unknown' END AS period_end, CASE i WHEN 0 THEN p_size WHEN 1 THEN -1 ELSE p_size * 2 END::DOUBLE AS p75, CASE i WHEN 0 THEN 0.5 ELSE -1 END::DOUBLE AS good
FROM part, unnest([0, 1, 2]) AS t(i) WHERE p_partkey % 8 <> 0""",
    "domain_scores": """SELECT s_suppkey, '2024-01-01' AS as_of, 'a' || s_suppkey || '.example' AS domain, s_suppkey % 15 <= 10 AS found, CASE WHEN s_suppkey % 15 <= 10 THEN s_suppkey % 15 ELSE -1 END::DOUBLE AS score, greatest(s_suppkey - 3, -1)::BIGINT AS rank, -1::BIGINT AS referring_domains FROM supplier
UNION ALL SELECT s_suppkey, '2024-01-01', 'b.example', false, 1.5, -1, -1 FROM supplier""",
    "domain_score_history": """SELECT s_suppkey, 'a' || s_suppkey || '.example' AS domain, '2023-01' AS date, (s_suppkey % 12)::DOUBLE AS score, false AS estimated FROM supplier WHERE s_suppkey % 12 <= 10 UNION ALL SELECT s_suppkey, 'a' || s_suppkey || '.example', '2023-03', 4.5, true FROM supplier""",
    "service_entities": """SELECT c_custkey, 0 AS place, 'Soup' AS name, 'OTHER' AS type, ('0.' || (c_custkey % 9 + 1))::DOUBLE AS salience, 'soup,Soup' AS mentions, true AS proper FROM customer UNION ALL SELECT c_custkey, 3, 'N' || c_custkey % 4, 'UNKNOWN', 0.25, '', false FROM customer""",
    "sitemap_roots": """WITH p AS (SELECT s_suppkey AS k, 'https://s' || s_suppkey % 40 || '.example' AS origin FROM supplier),
n AS (SELECT DISTINCT origin, origin || '/m' || k % 3 AS url, CASE k % 5 WHEN 3 THEN 1 WHEN 1 THEN 2 WHEN 0 THEN 3 END AS r FROM p WHERE k % 7 <> 0 AND k % 5 IN (0, 1, 3)), b AS (SELECT * FROM n QUALIFY r = min(r) OVER (PARTITION BY origin))
SELECT DISTINCT p.origin, coalesce(url, p.origin || '/sitemap.xml') AS url, coalesce(['argument', 'search-console', 'robots.txt'][r], 'convention') AS source FROM p LEFT JOIN b ON b.origin = p.origin""",
    "field_source": """SELECT 'u' || page_id AS url, CASE WHEN page_id % 5 = 4 THEN 'none' WHEN page_id % 3 = 0 THEN 'record' WHEN page_id % 3 = 2 AND page_id % 2 = 0 THEN 'lab' ELSE 'none' END AS source,
  CASE WHEN page_id % 5 = 4 THEN 0.5 WHEN page_id % 3 = 0 THEN page_id WHEN page_id % 3 = 2 AND page_id % 2 = 0 THEN -1.0 - page_id ELSE 0.5 END::DOUBLE AS p75 FROM pages""",
    "robots_access": """SELECT s_suppkey::VARCHAR AS host, crawler, CASE WHEN crawler = 'GPTBot' AND s_suppkey % 3 = 0 THEN true ELSE s_suppkey % 4 = 0 END AS blocked,
  CASE WHEN crawler = 'GPTBot' AND s_suppkey % 3 = 0 THEN '/*' ELSE CASE s_suppkey % 4 WHEN 0 THEN '/' WHEN 1 THEN '/a /b' || s_suppkey % 3 WHEN 2 THEN '/' ELSE '' END END AS restrictions FROM supplier, (VALUES ('GPTBot'), ('Other')) AS c(crawler)""",
    "robots_issues": """SELECT s_suppkey AS host, 2 AS line, 'before any user-agent' AS issue FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 5, 'no colon' FROM supplier UNION ALL SELECT s_suppkey, 7, 'empty value' FROM supplier""",
    "robots_sitemaps": "SELECT s_suppkey AS host, 2 AS line, 'https://x.example/1' AS url FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT s_suppkey, 10, 's' || s_suppkey FROM supplier",
    "robots_uses": """WITH s AS (SELECT s_suppkey AS host, s_suppkey % 3 AS t, s_suppkey % 5 = 0 AS own FROM supplier)
SELECT host, agent, 'search' AS use, CASE WHEN own THEN 'yes' ELSE 'no' END AS preference FROM s, (VALUES ('a'), ('b')) AS v(agent) UNION ALL SELECT host, agent, 'ai-train', CASE t WHEN 0 THEN 'no' ELSE 'yes' END FROM s, (VALUES ('a'), ('b')) AS v(agent) WHERE t <> 1
UNION ALL SELECT host, 'c', 'search', 'no' FROM s WHERE own""",
    "robots_status": "SELECT event_id, CASE WHEN event_id % 600 IN (404, 410) THEN 'absent' WHEN event_id % 600 // 100 = 2 THEN 'read' ELSE 'unavailable' END AS state FROM events",
    "offsite_presence": "SELECT user_id, count(*) FILTER (event_id % 3 > 0) AS answered, count(*) FILTER (event_id % 3 > 0 AND event_type = 'view') AS found, count(*) FILTER (event_id % 3 = 0) AS unchecked FROM events GROUP BY 1",
    "busiest_landings": "SELECT '/' || user_id % 50 AS landing_page, count(*) AS sessions, count(*) FILTER (event_type = 'purchase') AS key_events FROM events GROUP BY 1 ORDER BY key_events DESC, sessions DESC, landing_page LIMIT 20",
}
