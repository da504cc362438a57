"""Queries on services' answers. Their bodies are made of the driver's tables by expressions that Spark's SQL and DuckDB's share."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelode.sources import payloads as op
from sitelode.sources.tables import table

_CDX = """CASE WHEN c_custkey % 9 = 0 THEN '[]' WHEN c_custkey % 9 = 1 THEN 'sorry' ELSE concat(CASE WHEN c_custkey % 2 = 0 THEN '[["urlkey","timestamp","original","mimetype","statuscode","digest","length"]' ELSE '[["timestamp","urlkey","original","mimetype","statuscode","digest","length"]' END,
 CASE WHEN c_custkey % 2 = 0 THEN concat(',["k', c_custkey, '","20200101000000","http://a.example/', c_custkey, '","text/html","200","D1","120"],["k', c_custkey, '","20200301000000","http://a.example/","text/html","-","D', c_custkey % 3, '","x"],["k","2020","u","m","404","D9","1"]')
  ELSE concat(',["20200101000000","k', c_custkey, '","http://b.example/","text/html","404","D1","7"],["20200201000000","k', c_custkey, '","http://b.example/","text/html","200","D2"]') END, ']') END"""
#: A sitemap's files: an index of indexes, of which each names the lists of some suppliers, one of them twice and one that is none.
_FILE = """CASE WHEN s_suppkey % 10 = 1 THEN concat('<sitemapindex><sitemap><loc>f', s_suppkey + 1, '</loc></sitemap><sitemap> <loc> f', s_suppkey + 2, ' </loc></sitemap><sitemap><loc>f', s_suppkey + 3, '</loc></sitemap></sitemapindex>')
 WHEN s_suppkey % 10 < 5 THEN concat('<urlset><url><loc>u', s_suppkey, '</loc><lastmod>2024-01-0', s_suppkey % 9 + 1, '</lastmod></url><url><loc>u', s_suppkey % 3, '</loc></url><url><lastmod>x</lastmod></url></urlset>') ELSE '<html>no</html>' END"""
_REPORT = """concat('{"dimensionHeaders":[{"name":"page"},{"name":"device"}],"metricHeaders":[{"name":"sessions"},{"name":"rate"}],"rows":[', CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('{"dimensionValues":[{"value":"/', o_custkey, '"},{"value":"mobile"}],"metricValues":[{"value":"', o_orderkey % 100, '"},{"value":"n/a"}]},{"dimensionValues":[{"value":"/x"},{}],"metricValues":[{"value":"2"},{"value":"0.5"}]}') END,
 '],"rowCount":', o_orderkey % 5, ',"metadata":{"subjectToThresholding":', CASE WHEN o_orderkey % 3 = 0 THEN 'true' ELSE 'false' END, CASE WHEN o_orderkey % 4 = 0 THEN ',"emptyReason":"none","samplingMetadatas":[{"a":1}]' ELSE '' END, '}}')"""
_VITALS = """CASE WHEN p_partkey % 8 = 0 THEN '{"error":{}}' ELSE concat('{"record":{"metrics":{"largest_contentful_paint":{"percentiles":{"p75":', p_size * 100, '},"histogram":[{"density":0.5},{"density":0.25},{"density":0.25}]},"cumulative_layout_shift":{"percentiles":{"p75":"0.', p_size, '"}},"navigation_types":{"fractions":{"reload":0.1}}}}}') END"""
_VIEWS = """concat('{"items":[{"timestamp":"2023', CASE WHEN c_custkey % 2 = 0 THEN '0100' ELSE '' END, '","views":5},{"timestamp":"2023020100","views":', c_custkey % 50 - 5, '},{"timestamp":"20230301","views":', c_custkey % 7, '}]}')"""


def _answers(s, d, name, key, body):
    return table(s, d, name).select(key, F.expr(body).alias("body"))


def _captures(s, d):
    return op.captures(_answers(s, d, "customer", "c_custkey", _CDX), "c_custkey")


def _sitemaps(s, d):
    files = table(s, d, "supplier").select(F.expr("concat('f', s_suppkey)").alias("url"), F.expr(_FILE).alias("body"))
    return op.sitemap_entries(files, files.where("url LIKE '%1'").select("url"))


def _rows(s, d):
    rows = op.report_rows(_answers(s, d, "orders", "o_orderkey", _REPORT), "o_orderkey")
    return rows.select("o_orderkey", "at", F.col("dimensions")["page"].alias("page"), F.col("dimensions")["device"].alias("device"), F.col("metrics")["sessions"].alias("sessions"), F.col("metrics")["rate"].alias("rate"))


QUERIES = {
    "archive_captures": lambda s, d: _captures(s, d).withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("status", "length")}),
    "archive_versions": lambda s, d: op.versions(_captures(s, d), "c_custkey").select("c_custkey", "timestamp", "digest"),
    "sitemap_entries": _sitemaps,
    "report_rows": _rows,
    "report_caveats": lambda s, d: op.report_caveats(_answers(s, d, "orders", "o_orderkey", _REPORT), "o_orderkey").withColumn("caveats", F.array_join("caveats", ",")),
    "field_vitals": lambda s, d: op.field_vitals(_answers(s, d, "part", "p_partkey", _VITALS), "p_partkey").na.fill(-1.0),
    "pageviews": lambda s, d: op.pageviews(_answers(s, d, "customer", "c_custkey", _VIEWS), "c_custkey"),
}

_C = """c AS (
  SELECT c_custkey, 'k' || c_custkey AS urlkey, unnest([{'timestamp': '20200101000000', 'original': 'http://a.example/' || c_custkey, 'status': 200, 'digest': 'D1', 'length': 120}, {'timestamp': '20200301000000', 'original': 'http://a.example/', 'status': NULL, 'digest': 'D' || c_custkey % 3, 'length': NULL}], recursive := true)
  FROM customer WHERE c_custkey % 9 > 1 AND c_custkey % 2 = 0 UNION ALL
  SELECT c_custkey, 'k' || c_custkey, unnest([{'timestamp': '20200101000000', 'original': 'http://b.example/', 'status': 404, 'digest': 'D1', 'length': 7}, {'timestamp': '20200201000000', 'original': 'http://b.example/', 'status': 200, 'digest': 'D2', 'length': NULL}], recursive := true) FROM customer WHERE c_custkey % 9 > 1 AND c_custkey % 2 = 1)"""
ORACLES = {
    "archive_captures": f"WITH {_C} SELECT c_custkey, urlkey, timestamp, original, 'text/html' AS mimetype, coalesce(status, -1)::BIGINT AS status, digest, coalesce(length, -1)::BIGINT AS length FROM c",
    "archive_versions": f"WITH {_C} SELECT c_custkey, timestamp, digest FROM c QUALIFY digest IS DISTINCT FROM lag(digest) OVER (PARTITION BY c_custkey ORDER BY timestamp)",
    "sitemap_entries": """WITH f AS (SELECT s_suppkey AS k FROM supplier), e AS (
  SELECT 'f' || k AS sitemap, 0 AS n, 'u' || k AS loc, '2024-01-0' || (k % 9 + 1) AS lastmod FROM f WHERE k % 10 IN (2, 3, 4) UNION ALL SELECT 'f' || k, 1, 'u' || k % 3, NULL FROM f WHERE k % 10 IN (2, 3, 4))
SELECT loc, nullif(arg_min(coalesce(lastmod, ''), (sitemap, n)), '') AS lastmod, arg_min(sitemap, (sitemap, n)) AS sitemap FROM e GROUP BY loc""",
    "report_rows": """WITH o AS (SELECT * FROM orders WHERE o_orderkey % 7 <> 0)
SELECT o_orderkey, 0 AS "at", '/' || o_custkey AS page, 'mobile' AS device, (o_orderkey % 100)::DOUBLE AS sessions, 0.0::DOUBLE AS rate FROM o UNION ALL SELECT o_orderkey, 1, '/x', '', 2.0, 0.5 FROM o""",
    "report_caveats": """WITH n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 2 END AS n FROM orders)
SELECT k AS o_orderkey, n AS rows, (k % 5)::BIGINT AS row_count, array_to_string(list_filter([CASE WHEN k % 5 > n THEN 'truncated' END, CASE WHEN k % 4 = 0 THEN 'sampled' END, CASE WHEN k % 3 = 0 THEN 'thresholded' END, CASE WHEN k % 4 = 0 AND n = 0 THEN 'empty: none' END], lambda x: x IS NOT NULL), ',') AS caveats FROM n""",
    "field_vitals": """SELECT p_partkey, 'lcp' AS metric, (p_size * 100)::DOUBLE AS p75, 0.5::DOUBLE AS good, 0.25::DOUBLE AS middling, 0.25::DOUBLE AS poor FROM part WHERE p_partkey % 8 <> 0
UNION ALL SELECT p_partkey, 'cls', ('0.' || p_size)::DOUBLE, -1, -1, -1 FROM part WHERE p_partkey % 8 <> 0""",
    "pageviews": """SELECT c_custkey, '2023-01' AS month, 5.0::DOUBLE AS views FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, '2023-02', (c_custkey % 50 - 5)::DOUBLE FROM customer WHERE c_custkey % 50 >= 5
UNION ALL SELECT c_custkey, '2023-03', (c_custkey % 7)::DOUBLE FROM customer""",
}
