"""Time-series queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from sitelode.operators import history as op
from sitelode.sources.tables import SQL, event_rows, product_rows, readings, table

_DECAY = [f"{y}-{m:02d}" for y in (2000, 2001) for m in range(1, 13)][7:22]
_CUT = "2024-01-30 20:00:00"
_MONTHS = [f"2000-{m:02d}" for m in range(1, 13)]


def _cells(s, d):
    return table(s, d, "events").groupBy(F.to_date("ts").alias("date"), F.hour("ts").alias("hour")).agg(F.sum("value").alias("clicks"))


def _page_month(s, d, months=None):
    rows = product_rows(s, d).groupBy("page", F.date_format("date", "yyyy-MM").alias("month")).agg(F.sum("clicks").alias("clicks"))
    return rows.where(F.col("month").isin(months)) if months else rows


def _registry(s):
    return s.createDataFrame([("view", True), ("click", True), ("signup", True), ("purchase", True), ("error", False)], "metric string, up_is_better boolean")


def _rated(s, d):
    rating = F.when(F.col("k") >= 70, "good").when(F.col("k") >= 40, "needs improvement").when(F.col("k") >= 10, "poor")
    return event_rows(s, d).select("user_id", "ts", "event_id", rating.alias("rating"))


def _corrections(s, d):
    rows = readings(s, d)
    return op.upsert(rows, rows.where("refresh_id % 10 = 0").withColumn("value", F.col("value") + 1), "refresh_id", "metric")


QUERIES = {
    "hourly_baseline": lambda s, d: op.hourly_baseline(_cells(s, d), _CUT),
    "hourly_change": lambda s, d: op.hourly_baseline(_cells(s, d), _CUT).select("date", "hour", *[F.coalesce(F.round(op.change_shown(F.col("clicks"), F.col(c), 200.0), 6), F.lit(-999.0)).alias(f"against_{c}") for c in ("baseline", "week_ago")]),
    "report_windows": lambda s, d: table(s, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().select("day", op.window_at(F.col("day"), 90, retention=60).alias("w")).select("day", "w.*"),
    "content_decay": lambda s, d: op.content_decay(_page_month(s, d), _DECAY, min_peak=5.0),
    "metric_movement": lambda s, d: op.movement(readings(s, d), _registry(s)),
    "metric_monthly": lambda s, d: op.monthly(readings(s, d)),
    "metric_upsert": _corrections,
    "status_runs": lambda s, d: op.runs(event_rows(s, d), "user_id", ["ts", "event_id"], "event_type"),
    "rating_changes": lambda s, d: op.last_change(_rated(s, d), "user_id", ["ts", "event_id"], "rating"),
    "half_trend": lambda s, d: op.half_trend(_page_month(s, d, _MONTHS), "page", "month", "clicks"),
    "peaks": lambda s, d: op.peaks(_page_month(s, d), "page", "month", "clicks"),
    "missing_months": lambda s, d: op.missing(_page_month(s, d), "page", "month", [f"{y}-{m:02d}" for y in range(1994, 2002) for m in range(1, 13)]),
    "year_over_year": lambda s, d: op.year_over_year(_page_month(s, d), "page", "month", "clicks"),
    "calendar_months": lambda s, d: table(s, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().select("day", F.explode(op.complete_months(F.col("day"), 20)).alias("month")),
    "events_by_hour": lambda s, d: table(s, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("hour"), "event_type", "n", "value"),
    "crawl_freshness": lambda s, d: op.freshness(event_rows(s, d), "event_type", "ts", "2024-02-10", 30),
}

_PM = f"{SQL['search']}, pm AS (SELECT page, strftime(date, '%Y-%m') AS month, sum(clicks) AS clicks FROM search GROUP BY ALL)"
ORACLES = {
    "hourly_baseline": f"""WITH c AS (SELECT ts::DATE AS date, hour(ts)::INT AS hour, sum(value) AS clicks FROM events GROUP BY ALL),
p AS (SELECT *, date::TIMESTAMP + to_hours(hour) >= TIMESTAMP '{_CUT}' AS partial FROM c)
SELECT date, hour, clicks, partial, (SELECT avg(clicks) FROM p b WHERE b.hour = a.hour AND b.date < a.date AND NOT b.partial) AS baseline,
  (SELECT count(*) FROM p b WHERE b.hour = a.hour AND b.date < a.date AND NOT b.partial) AS days,
  (SELECT max(clicks) FROM p b WHERE b.hour = a.hour AND b.date = a.date - 7 AND NOT b.partial) AS week_ago FROM p a""",
    "report_windows": "SELECT DISTINCT o_orderdate::DATE AS day, o_orderdate::DATE - 60 AS first, o_orderdate::DATE - 3 AS last, o_orderdate::DATE - 118 AS first_before, o_orderdate::DATE - 61 AS last_before FROM orders",
    "hourly_change": f"""WITH c AS (SELECT ts::DATE AS date, hour(ts)::INT AS hour, sum(value) AS clicks FROM events GROUP BY ALL),
p AS (SELECT *, date::TIMESTAMP + to_hours(hour) >= TIMESTAMP '{_CUT}' AS partial FROM c),
b AS (SELECT date, hour, clicks, (SELECT avg(clicks) FROM p b WHERE b.hour = a.hour AND b.date < a.date AND NOT b.partial) AS baseline, (SELECT max(clicks) FROM p b WHERE b.hour = a.hour AND b.date = a.date - 7 AND NOT b.partial) AS week_ago FROM p a)
SELECT date, hour, coalesce(CASE WHEN baseline >= 200 THEN round(100 * (clicks / baseline - 1), 6) END, -999) AS against_baseline, coalesce(CASE WHEN week_ago >= 200 THEN round(100 * (clicks / week_ago - 1), 6) END, -999) AS against_week_ago FROM b""",
    "content_decay": f"""WITH {_PM}, spine AS (SELECT unnest({_DECAY!r}) AS month, unnest(range({len(_DECAY)}))::INT AS i),
g AS (SELECT p.page, s.month, s.i, coalesce(pm.clicks, 0) AS clicks FROM (SELECT DISTINCT page FROM pm) p CROSS JOIN spine s LEFT JOIN pm ON pm.page = p.page AND pm.month = s.month),
m AS (SELECT *, avg(clicks) OVER (PARTITION BY page ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS mean3 FROM g),
pk AS (SELECT page, mean3 AS peak, month AS peak_from FROM m WHERE i <= {len(_DECAY) - 6} AND mean3 > 0 QUALIFY row_number() OVER (PARTITION BY page ORDER BY mean3 DESC, i) = 1),
rc AS (SELECT page, avg(clicks) AS recent FROM g WHERE i >= {len(_DECAY) - 3} GROUP BY page),
yo AS (SELECT a.page, sum(a.clicks) AS n, sum(b.clicks) AS y FROM g a JOIN g b ON a.page = b.page AND b.i = a.i - 12 WHERE a.i >= {len(_DECAY) - 3} GROUP BY a.page)
SELECT page, peak, recent, peak - recent AS lost, peak_from, CASE WHEN coalesce(y, 0) <= 0 THEN 'unknown' WHEN n / y >= 0.8 THEN 'seasonal' ELSE 'decay' END AS reading
FROM pk JOIN rc USING (page) LEFT JOIN yo USING (page) WHERE peak >= 5 AND (peak - recent) / peak >= 0.4""",
    "metric_movement": f"""WITH {SQL['readings']}, r AS (SELECT *, row_number() OVER (PARTITION BY site_id, metric ORDER BY captured_at DESC, refresh_id DESC) AS nth FROM readings WHERE value IS NOT NULL),
p AS (SELECT site_id, metric, max(value) FILTER (nth = 1) AS latest, max(value) FILTER (nth = 2) AS previous FROM r WHERE nth <= 2 GROUP BY ALL)
SELECT *, latest - previous AS change, CASE WHEN previous IS NOT NULL THEN CASE WHEN metric = 'error' THEN latest < previous ELSE latest > previous END END AS improved FROM p""",
    "metric_monthly": f"""WITH {SQL['readings']} SELECT site_id, strftime(captured_at, '%Y-%m') AS month, metric, arg_max(value, (captured_at, refresh_id)) FILTER (value IS NOT NULL) AS last,
min(value) AS min, max(value) AS max, count(DISTINCT captured_at) AS readings FROM readings GROUP BY ALL""",
    "metric_upsert": f"WITH {SQL['readings']} SELECT refresh_id, metric, site_id, captured_at, CASE WHEN refresh_id % 10 = 0 THEN value + 1 ELSE value END AS value FROM readings",
    "status_runs": """WITH a AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, (sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM a)
SELECT user_id, run, event_type, count(*) AS length, min(ts) AS first, max(ts) AS last FROM b GROUP BY ALL""",
    "rating_changes": f"""WITH {SQL['ev']}, r AS (SELECT user_id, ts, event_id, CASE WHEN k >= 70 THEN 'good' WHEN k >= 40 THEN 'needs improvement' WHEN k >= 10 THEN 'poor' END AS rating FROM ev),
p AS (SELECT *, lag(rating) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM r WHERE rating IS NOT NULL)
SELECT user_id, ts AS since, was, rating AS now FROM p WHERE was <> rating QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "half_trend": f"""WITH {_PM}, s AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY month) AS i, count(*) OVER (PARTITION BY page) AS n FROM pm WHERE month LIKE '2000-%'),
t AS (SELECT page, sum(clicks) FILTER (i <= n // 2) AS first_half, sum(clicks) FILTER (i > n - n // 2) AS second_half FROM s WHERE n >= 4 GROUP BY page),
c AS (SELECT *, (second_half - first_half) / nullif(first_half, 0) AS change FROM t)
SELECT *, CASE WHEN change IS NULL THEN 'from zero' WHEN abs(change) <= 0.1 THEN 'flat' WHEN change > 0 THEN 'up' ELSE 'down' END AS trend FROM c""",
    "peaks": f"""WITH {_PM}, m AS (SELECT page, median(clicks) AS median FROM pm GROUP BY page), r AS (SELECT *, (row_number() OVER (PARTITION BY page ORDER BY clicks DESC, month))::INT AS rank FROM pm QUALIFY rank <= 3)
SELECT page, month, clicks, rank, median, clicks / nullif(median, 0) AS times, coalesce(clicks / nullif(median, 0) >= 2, false) AS spike FROM r JOIN m USING (page)""",
    "missing_months": f"""WITH {_PM}, spine AS (SELECT strftime(unnest(generate_series(DATE '1994-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)), '%Y-%m') AS month)
SELECT p.page, s.month FROM (SELECT DISTINCT page FROM pm) p CROSS JOIN spine s WHERE NOT EXISTS (SELECT 1 FROM pm WHERE pm.page = p.page AND pm.month = s.month)""",
    "year_over_year": f"""WITH {_PM}, m AS (SELECT *, month[1:4]::INT * 12 + month[6:7]::INT AS m, max(month[1:4]::INT * 12 + month[6:7]::INT) OVER (PARTITION BY page) AS top FROM pm),
t AS (SELECT page, max(clicks) FILTER (m = top) AS latest, max(clicks) FILTER (m = top - 12) AS year_ago, sum(clicks) FILTER (m > top - 12) AS s1, count(*) FILTER (m > top - 12) AS n1,
  sum(clicks) FILTER (m BETWEEN top - 23 AND top - 12) AS s2, count(*) FILTER (m BETWEEN top - 23 AND top - 12) AS n2 FROM m GROUP BY page)
SELECT page, latest, year_ago, (latest - year_ago) / nullif(year_ago, 0) AS change, CASE WHEN n1 = 12 AND n2 = 12 THEN s1 END AS last_12, CASE WHEN n1 = 12 AND n2 = 12 THEN s2 END AS prior_12 FROM t""",
    "calendar_months": """WITH m AS (SELECT DISTINCT o_orderdate::DATE AS day, date_trunc('month', o_orderdate::DATE - 3) - n * INTERVAL 1 MONTH AS first FROM orders, unnest(range(1, 21)) AS k(n))
SELECT day, strftime(first, '%Y-%m') AS month FROM m WHERE first >= day - 480""",
    "events_by_hour": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, sum(value) AS value FROM events GROUP BY ALL",
    "crawl_freshness": """WITH a AS (SELECT event_type, (DATE '2024-02-10' - ts::DATE)::INT AS age FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY age) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM a)
SELECT event_type, min(age) AS youngest, max(age) FILTER (i = n // 2 + 1) AS median_age, max(age) AS oldest, count(*) FILTER (age > 30) AS stale, count(*) AS rated FROM r GROUP BY event_type""",
}
