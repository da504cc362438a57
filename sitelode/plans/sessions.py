"""Session, funnel and traffic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelode.operators import sessions as op
from sitelode.sources.tables import SQL, event_rows, table

_FUNNEL = ["view", "click", "purchase"]


def _traffic(s, d):
    """A row per session with a source and medium by its first event's number."""
    rows = op.landings(op.sessions(event_rows(s, d)))
    source = F.when(F.col("k") % 4 == 0, "google").when(F.col("k") % 4 == 1, "chatgpt.com").when(F.col("k") % 4 == 2, "www.perplexity.ai").otherwise("news.example.com")
    medium = F.when(F.col("k") % 4 == 0, "organic").when((F.col("k") % 4 == 1) & (F.col("k") >= 50), "ai-assistant").otherwise("referral")
    landing = F.when(F.col("k") < 5, "(not set)").otherwise(F.col("landing_page"))
    return rows.withColumns({"source": source, "medium": medium, "landing_page": landing})


_SESSIONS = f"""{SQL['ev']}, o AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM ev),
n AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sn FROM o),
sess AS (SELECT user_id, sn, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events, sum(value) AS value, count(*) FILTER (event_type IN ('purchase', 'signup')) AS key_events,
  CASE WHEN count(*) >= 2 OR bool_or(event_type = 'purchase') THEN 1 ELSE 0 END AS engaged, arg_min(event_type, (ts, event_id)) AS first_event, arg_min(k, (ts, event_id)) AS k FROM n GROUP BY ALL)"""
_TRAFFIC = f"""{_SESSIONS}, tr AS (SELECT CASE WHEN k < 5 THEN '(not set)' ELSE '/' || first_event END AS landing_page, 1 AS sessions, engaged, key_events, k,
  CASE k % 4 WHEN 0 THEN 'google' WHEN 1 THEN 'chatgpt.com' WHEN 2 THEN 'www.perplexity.ai' ELSE 'news.example.com' END AS source,
  CASE WHEN k % 4 = 0 THEN 'organic' WHEN k % 4 = 1 AND k >= 50 THEN 'ai-assistant' ELSE 'referral' END AS medium FROM sess)"""
_ROLL = "sum(sessions)::BIGINT AS sessions, sum(engaged)::BIGINT AS engaged, sum(key_events)::BIGINT AS key_events, sum(engaged) / sum(sessions) AS engagement_rate"

QUERIES = {
    "ai_landings": lambda s, d: op.ai_landings(_traffic(s, d)),
    "sessions": lambda s, d: op.sessions(event_rows(s, d)),
    "landing_rollup": lambda s, d: op.landing_rollup(op.landings(op.sessions(event_rows(s, d)))),
    "organic_landings": lambda s, d: op.organic_landings(_traffic(s, d)),
    "ai_traffic": lambda s, d: op.ai_sources(_traffic(s, d).groupBy("source", "medium").agg(F.sum("sessions").alias("sessions"), F.count("*").alias("users"))),
    "users_by_grain": lambda s, d: op.users_by_grain(table(s, d, "events")),
    "key_events": lambda s, d: op.key_events(table(s, d, "events"), ["purchase", "signup"]),
    "active_users_30m": lambda s, d: op.active_users(table(s, d, "events"), "2024-01-15 12:00:00"),
    "funnel": lambda s, d: op.funnel(table(s, d, "events"), _FUNNEL, "2024-01-05", "2024-01-08"),
    "pivot_report": lambda s, d: table(s, d, "events").groupBy(F.to_date("ts").alias("date")).pivot("event_type", ["view", "click", "signup", "purchase", "error"]).agg(F.count(F.lit(1))).na.fill(0),
}

ORACLES = {
    "ai_landings": f"WITH {_TRAFFIC} SELECT nullif(landing_page, '(not set)') AS page, sum(sessions)::BIGINT AS sessions FROM tr WHERE medium = 'ai-assistant' OR (medium = 'referral' AND source IN ('chatgpt.com', 'www.perplexity.ai')) GROUP BY 1",
    "sessions": f'WITH {_SESSIONS} SELECT user_id, start, "end", events, value, key_events, engaged, first_event, k FROM sess',
    "landing_rollup": f"WITH {_SESSIONS}, l AS (SELECT '/' || first_event AS landing_page, 1 AS sessions, engaged, key_events FROM sess) SELECT landing_page, {_ROLL} FROM l GROUP BY landing_page",
    "organic_landings": f"WITH {_TRAFFIC} SELECT CASE WHEN landing_page LIKE '/%' THEN landing_page END AS landing_page, {_ROLL} FROM tr WHERE source = 'google' AND medium = 'organic' GROUP BY 1",
    "ai_traffic": f"""WITH {_TRAFFIC}, g AS (SELECT source, medium, sum(sessions) AS sessions, count(*) AS users FROM tr GROUP BY ALL)
SELECT source, sum(sessions)::BIGINT AS sessions, sum(CASE WHEN medium = 'referral' THEN sessions ELSE 0 END)::BIGINT AS from_host_list, sum(users)::BIGINT AS users, count(*) > 1 AS users_upper_bound
FROM g WHERE medium = 'ai-assistant' OR (medium = 'referral' AND source IN ('chatgpt.com', 'www.perplexity.ai')) GROUP BY source""",
    "users_by_grain": "SELECT ts::DATE AS date, event_type, count(DISTINCT user_id) AS users, count(*) AS events FROM events GROUP BY ROLLUP (ts::DATE, event_type)",
    "key_events": "WITH p AS (SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1) SELECT * FROM p UNION ALL SELECT '(total)', coalesce(sum(n), 0)::BIGINT FROM p",
    "active_users_30m": "SELECT event_type, count(DISTINCT user_id) AS active_users FROM events WHERE ts > TIMESTAMP '2024-01-15 11:30:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "funnel": """WITH e AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08'),
a AS (SELECT user_id, min(ts) AS t FROM e WHERE event_type = 'view' GROUP BY 1), b AS (SELECT e.user_id, min(ts) AS t FROM e JOIN a USING (user_id) WHERE event_type = 'click' AND ts > a.t GROUP BY 1),
c AS (SELECT e.user_id, min(ts) AS t FROM e JOIN b USING (user_id) WHERE event_type = 'purchase' AND ts > b.t GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM a) AS n0, (SELECT count(*) FROM b) AS n1, (SELECT count(*) FROM c) AS n2)
SELECT 1 AS step, 'view' AS event, n0 AS users, n0 / n0 AS completion, n0 - n0 AS abandoned, n0 / n0 AS end_to_end FROM n UNION ALL
SELECT 2, 'click', n1, n1 / n0, n0 - n1, n1 / n0 FROM n UNION ALL SELECT 3, 'purchase', n2, n2 / n1, n1 - n2, n2 / n0 FROM n""",
    "pivot_report": "SELECT ts::DATE AS date, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in ("view", "click", "signup", "purchase", "error")) + " FROM events GROUP BY 1",
}
