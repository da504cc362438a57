"""Queries on graphs of pages, their links and answers made from ids and addresses; the SQL walks step by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelode.operators import graphs as op
from sitelode.sources.tables import table

#: Chains go down by one id to the next multiple of 60, or round in a loop from there; some say not where to, some are relative.
_MOVES = [
    "concat('https://x.example/p/', page_id) AS url", "CASE WHEN page_id % 120 = 0 THEN 200 WHEN page_id % 60 = 37 THEN 307 ELSE 301 END AS status",
    """CASE WHEN page_id % 60 = 37 THEN NULL WHEN page_id % 120 = 60 THEN concat('/p/', page_id + 7) WHEN page_id % 3 = 0 THEN concat('  ', page_id - 1) WHEN page_id % 3 = 1 THEN concat('HTTPS://x.example/p/', page_id - 1) ELSE concat('//X.example/p/', page_id - 1) END AS location""",
]
_BUDGET = 120
_ANSWERS = ["page_id AS node", "page_id % 6 <> 5 AS allowed", "CASE WHEN page_id % 11 = 7 THEN 404 WHEN page_id % 13 = 4 THEN 302 ELSE 200 END AS status"]


def _redirects(s, d):
    rows = table(s, d, "pages").selectExpr(*_MOVES)
    return op.redirect_chains(rows.withColumn("location", op.resolved(F.col("location"), F.col("url"))))


def _crawl(s, d):
    p = table(s, d, "pages")
    edges = p.select(F.col("page_id").alias("src"), F.posexplode(F.expr("array(page_id * 3 + 1, page_id * 2 + 2, 0, page_id * 7 % 101, page_id + 1)")).alias("pos", "dst"))
    seen, cut_off = op.crawl(edges, p.selectExpr(*_ANSWERS), s.createDataFrame([(0, 0)], "node long, pos int"), _BUDGET)
    return seen.select("node", "depth", "place", F.coalesce("found_on", F.lit(-1)).alias("found_on"), "state", F.lit(cut_off).alias("truncated"))


QUERIES = {"redirect_chains": _redirects, "crawl_budget": _crawl}


def _levels(n: int) -> str:
    """The crawl's levels one by one, each numbered by a window."""
    out = ["""w0 AS MATERIALIZED (SELECT 0::BIGINT AS node, 0 AS depth, 0::BIGINT AS place, -1::BIGINT AS found_on)"""]
    for i in range(1, n):
        seen = " UNION ALL ".join(f"SELECT * FROM w{j}" for j in range(i))
        out.append(f"""s{i} AS MATERIALIZED ({seen}), w{i} AS MATERIALIZED (
  SELECT node, {i} AS depth, (SELECT count(*) FROM s{i}) + row_number() OVER (ORDER BY parent, pos) - 1 AS place, found_on
  FROM (SELECT e.dst AS node, w.place AS parent, e.pos, w.node AS found_on FROM w{i - 1} w JOIN a ON a.node = w.node AND a.allowed AND a.status < 400 JOIN e ON e.src = w.node WHERE e.dst NOT IN (SELECT node FROM s{i}) QUALIFY row_number() OVER (PARTITION BY e.dst ORDER BY w.place, e.pos) = 1)
  QUALIFY place < {_BUDGET})""")
    return ",\n".join(out)


_LAST = 16
ORACLES = {
    "redirect_chains": f"""WITH RECURSIVE r AS (SELECT page_id, {', '.join(_MOVES)} FROM pages),
n AS (SELECT url, CASE WHEN status < 400 AND status >= 300 AND location IS NOT NULL THEN 'https://x.example/p/' || regexp_extract(location, '(\\d+)\\s*$', 1) END AS next, status >= 300 AND location IS NULL AS missing FROM r),
w AS (
  SELECT url, url AS at_, [url] AS way, 0 AS hops, false AS loop FROM n
  UNION ALL SELECT w.url, n.next, list_append(way, n.next), hops + 1, list_contains(way, n.next) FROM w JOIN n ON n.url = w.at_ WHERE n.next IS NOT NULL AND NOT w.loop),
l AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY hops DESC) AS k FROM w)
SELECT l.url, hops::BIGINT AS hops, CASE WHEN loop THEN way[-2] ELSE at_ END AS final_url, loop, coalesce(n.missing AND NOT loop, false) AS missing, hops > 3 AS long, hops >= 10 AS exceeded
FROM l LEFT JOIN n ON n.url = at_ WHERE k = 1""",
    "crawl_budget": f"""WITH a AS (SELECT {', '.join(_ANSWERS)} FROM pages),
e AS (SELECT page_id AS src, unnest([page_id * 3 + 1, page_id * 2 + 2, 0, page_id * 7 % 101, page_id + 1]) AS dst, unnest([0, 1, 2, 3, 4]) AS pos FROM pages),
{_levels(_LAST)},
v AS ({" UNION ALL ".join(f"SELECT * FROM w{j}" for j in range(_LAST))})
SELECT v.node, depth, place, found_on, CASE WHEN NOT coalesce(allowed, true) THEN 'blocked' WHEN coalesce(status, 0) BETWEEN 200 AND 399 THEN 'crawled' ELSE 'failed' END AS state, (SELECT count(*) FROM v) >= {_BUDGET} AS truncated
FROM v LEFT JOIN a ON a.node = v.node""",
}
