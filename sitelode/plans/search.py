"""Search-performance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelode.operators import search as op
from sitelode.sources.tables import SQL, product_rows, search_rows

T = """coalesce(sum(clicks), 0) AS clicks, coalesce(sum(impressions), 0) AS impressions, coalesce(sum(clicks) / nullif(sum(impressions), 0), 0) AS ctr,
  coalesce(sum(position * impressions) / nullif(sum(impressions), 0), 0) AS position"""
NOW, BEFORE = ("2001-01-01", "2001-06-30"), ("2000-07-04", "2000-12-31")
_MONTHS = [f"2000-{m:02d}" for m in range(1, 7)]
_WATCHED = ["A rich result", "N snippet", "FAQ", "Video"]


def _between(df, window):
    return df.where(F.col("date").between(F.lit(window[0]).cast("date"), F.lit(window[1]).cast("date")))


def _compared(spark, d):
    rows = product_rows(spark, d).withColumn("key", F.concat_ws(" | ", "query", "page"))
    return op.compare(_between(rows, NOW), _between(rows, BEFORE), "key")


def _uneven(spark, d):
    """Rows of which those of one device and two countries have a fraction of their clicks."""
    c = F.col("clicks")
    return search_rows(spark, d).withColumn("clicks", F.when(F.col("country").isin("NATION_3", "NATION_7"), F.floor(c / 4)).when(F.col("device") == "1-URGENT", F.floor(c / 2)).otherwise(c).cast("double"))


_UNEVEN = "uneven AS (SELECT * REPLACE (CASE WHEN country IN ('NATION_3', 'NATION_7') THEN floor(clicks / 4) WHEN device = '1-URGENT' THEN floor(clicks / 2) ELSE clicks END AS clicks) FROM search)"
_W = f"""WITH {SQL['search']}, k AS (SELECT *, concat_ws(' | ', query, page) AS key FROM search),
a AS (SELECT key, {T} FROM k WHERE date BETWEEN DATE '{NOW[0]}' AND DATE '{NOW[1]}' GROUP BY key),
b AS (SELECT key, {T} FROM k WHERE date BETWEEN DATE '{BEFORE[0]}' AND DATE '{BEFORE[1]}' GROUP BY key),
c AS (SELECT key, coalesce(a.clicks, 0) AS clicks_now, coalesce(b.clicks, 0) AS clicks_before, coalesce(a.impressions, 0) AS impressions_now, coalesce(b.impressions, 0) AS impressions_before,
  coalesce(a.clicks, 0) - coalesce(b.clicks, 0) AS clicks_change, coalesce(a.impressions, 0) - coalesce(b.impressions, 0) AS impressions_change, a.position - b.position AS position_change
  FROM a FULL JOIN b USING (key))"""
_SHARES = lambda key: f"""WITH {SQL['search']}, t AS (SELECT {key}, {T} FROM search GROUP BY {key}), w AS (SELECT sum(impressions) AS i, sum(clicks) / sum(impressions) AS c FROM search),
s AS (SELECT {key}, clicks, impressions, ctr, position, impressions / i AS share, ctr / c AS ctr_ratio FROM t, w WHERE impressions > 0)"""  # noqa: E731
_OF_UNEVEN = lambda key: _SHARES(key).replace(", t AS (", f", {_UNEVEN}, t AS (", 1).replace(f"FROM search GROUP BY {key}", f"FROM uneven GROUP BY {key}").replace("AS c FROM search)", "AS c FROM uneven)")

QUERIES = {
    "search_totals": lambda s, d: op.totals(search_rows(s, d), "country", "device"),
    "quick_wins": lambda s, d: op.quick_wins(search_rows(s, d), "query", "page", "country"),
    "under_clicked": lambda s, d: op.under_clicked(search_rows(s, d), "query", "page", "device"),
    "cannibalization": lambda s, d: op.cannibalization(product_rows(s, d)),
    "window_compare": _compared,
    "lost_queries": lambda s, d: op.lost(_compared(s, d)),
    "biggest_movers": lambda s, d: op.movers(_compared(s, d)),
    "trends": lambda s, d: op.trends(_compared(s, d), "key"),
    "anomalies": lambda s, d: op.anomalies(product_rows(s, d)),
    "branded_split": lambda s, d: op.branded_split(product_rows(s, d), ["red", "blue"]),
    "segment_shares": lambda s, d: op.segment_shares(search_rows(s, d), "device"),
    "device_gap": lambda s, d: op.weak_segments(_uneven(s, d), "device"),
    "country_opportunity": lambda s, d: op.weak_segments(_uneven(s, d), "country", max_ratio=0.5, min_share=0.01, inclusive=True),
    "featured_snippets": lambda s, d: op.featured_snippets(product_rows(s, d), "query", "page"),
    "busiest_pages": lambda s, d: op.busiest(product_rows(s, d)),
    "page_query_map": lambda s, d: op.page_query_map(product_rows(s, d)),
    "appearance_gap": lambda s, d: op.appearance_gap(product_rows(s, d), _WATCHED),
    "sites_health": lambda s, d: op.health(search_rows(s, d), s.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("country"), (F.col("n_nationkey") % 5 != 0).alias("verified")), "country"),
    "monthly_clicks": lambda s, d: op.monthly_clicks(product_rows(s, d), _MONTHS),
}

ORACLES = {
    "search_totals": f"WITH {SQL['search']} SELECT country, device, {T} FROM search GROUP BY ALL",
    "quick_wins": f"""WITH {SQL['search']}, t AS (SELECT query, page, country, {T} FROM search GROUP BY ALL)
SELECT *, greatest(0, floor(impressions * 5.0 / 100 - clicks + 0.5))::BIGINT AS potential_clicks FROM t WHERE impressions >= 50 AND ctr * 100 <= 2 AND position BETWEEN 4 AND 10""",
    "under_clicked": f"WITH {SQL['search']}, t AS (SELECT query, page, device, {T} FROM search GROUP BY ALL) SELECT * FROM t WHERE impressions >= 50 AND ctr * 100 <= 2 AND position >= 4",
    "cannibalization": f"""WITH {SQL['search']}, t AS (SELECT query, page, {T} FROM search GROUP BY ALL)
SELECT query, count(*) AS pages, min(position) AS best_position, sum(impressions) AS impressions, first(page ORDER BY impressions DESC, page) AS lead_page FROM t WHERE impressions >= 10 GROUP BY query HAVING count(*) > 1""",
    "window_compare": f"{_W} SELECT * FROM c",
    "lost_queries": f"{_W} SELECT * FROM c WHERE impressions_before >= 20 AND impressions_now = 0",
    "biggest_movers": f"{_W} SELECT * FROM c WHERE greatest(clicks_now, clicks_before) >= 5 AND clicks_change <> 0",
    "trends": f"""{_W}, m AS (SELECT *, CASE WHEN clicks_change > 0 THEN 'up' ELSE 'down' END AS direction FROM c WHERE greatest(clicks_now, clicks_before) >= 5 AND clicks_change <> 0)
SELECT *, (row_number() OVER (PARTITION BY direction ORDER BY abs(clicks_change) DESC, key))::INT AS rank FROM m QUALIFY rank <= 15""",
    "anomalies": f"""WITH {SQL['search']}, t AS (SELECT date, sum(clicks) AS clicks FROM search GROUP BY date), s AS (SELECT avg(clicks) AS mean, stddev_pop(clicks) AS sd, count(*) AS n FROM t)
SELECT date, clicks, mean, (clicks - mean) / sd AS z FROM t, s WHERE n >= 14 AND sd > 0 AND abs((clicks - mean) / sd) >= 2""",
    "branded_split": f"""WITH {SQL['search']}, t AS (SELECT regexp_matches(lower(query), '(^|[^a-z0-9])(red|blue)([^a-z0-9]|$)') AS branded, query, {T} FROM search GROUP BY ALL)
SELECT branded, count(*) AS queries, {T} FROM t GROUP BY branded""",
    "segment_shares": f"{_SHARES('device')} SELECT * FROM s",
    "device_gap": f"{_OF_UNEVEN('device')} SELECT * FROM s WHERE ctr_ratio > 0 AND ctr_ratio < 0.7 AND share > 0.1",
    "country_opportunity": f"{_OF_UNEVEN('country')} SELECT * FROM s WHERE ctr_ratio > 0 AND ctr_ratio < 0.5 AND share >= 0.01",
    "featured_snippets": f"""WITH {SQL['search']}, t AS (SELECT query, page, {T} FROM search GROUP BY ALL)
SELECT *, CASE WHEN position <= 1.5 AND ctr >= 0.35 THEN 'holder' ELSE 'contender' END AS role FROM t WHERE (position <= 1.5 AND ctr >= 0.35) OR (position > 1.5 AND position <= 5 AND ctr <= 0.08 AND impressions >= 100)""",
    "busiest_pages": f"WITH {SQL['search']}, t AS (SELECT page, {T} FROM search GROUP BY page) SELECT * FROM t WHERE clicks > 0 ORDER BY clicks DESC, impressions DESC, page LIMIT 25",
    "page_query_map": f"""WITH {SQL['search']}, t AS (SELECT page, query, {T} FROM search GROUP BY ALL)
SELECT *, (row_number() OVER (PARTITION BY page ORDER BY clicks DESC, impressions DESC, query))::INT AS rank FROM t QUALIFY rank <= 10""",
    "appearance_gap": "SELECT w.appearance FROM (VALUES ('A rich result'), ('N snippet'), ('FAQ'), ('Video')) w(appearance) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE contains(lower(split_part(l_returnflag, ' ', 1)), lower(split_part(w.appearance, ' ', 1))))",
    "sites_health": f"""WITH {SQL['search']}, t AS (SELECT country, {T} FROM search GROUP BY country)
SELECT n_name AS country, CASE WHEN n_nationkey % 5 = 0 THEN 'unverified' WHEN coalesce(impressions, 0) = 0 THEN 'silent' ELSE 'active' END AS state,
  CASE WHEN n_nationkey % 5 <> 0 THEN coalesce(clicks, 0) END AS clicks, CASE WHEN n_nationkey % 5 <> 0 THEN coalesce(impressions, 0) END AS impressions FROM nation LEFT JOIN t ON country = n_name""",
    "monthly_clicks": f"WITH {SQL['search']} SELECT page, " + ", ".join(f"coalesce(sum(clicks) FILTER (strftime(date, '%Y-%m') = '{m}'), 0) AS \"{m}\"" for m in _MONTHS) + " FROM search GROUP BY page",
}
