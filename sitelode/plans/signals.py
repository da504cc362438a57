"""Queries on the signals of pages' copy. Pages get more markup by an expression that Spark's SQL and DuckDB's share."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelode.operators import signals as op
from sitelode.sources.tables import table

_MORE = """concat(replace(html, '</article>', ''), CASE page_id % 5 WHEN 0 THEN '<h2 id="q">How <b>does</b> it go</h2>' WHEN 1 THEN '<h3>Really?</h3><h2>Is</h2>' WHEN 2 THEN '<h2>Howitzer</h2>' WHEN 3 THEN '<h4>Why?</h4>' ELSE '' END,
 CASE page_id % 6 WHEN 0 THEN '<div class="box tldr">x</div>' WHEN 1 THEN '<p id="claves">It is a soup, 12% of it.</p>' WHEN 2 THEN '<p>refers to 3 million</p>' ELSE '' END,
 CASE page_id % 7 WHEN 0 THEN '<ol><li>a</li><li>b</li><LI>c</li></ol>' WHEN 1 THEN '<table><tr><td>1</td></tr></table>' WHEN 2 THEN '<h2>7 best soups</h2>' WHEN 3 THEN '<table><tr></tr><tr></tr><tr></tr></table>' ELSE '' END, '</article>',
 CASE page_id % 4 WHEN 0 THEN '<a class="x" onclick="x()">go</a>' WHEN 1 THEN '<div href="/x">y</div><a href="/z">z</a>' WHEN 2 THEN '<a routerlink="/r">r</a><button ui-sref="s" href="/k">b</button>' ELSE '' END,
 CASE page_id % 9 WHEN 0 THEN '<p>Our attorney</p>' WHEN 1 THEN '<p>attorneys, free shipping now</p>' WHEN 2 THEN '<p>a saas dashboard</p>' WHEN 3 THEN '<p>serving you</p>' ELSE '' END,
 CASE page_id % 8 WHEN 0 THEN '<script type="application/ld+json">{"@type":"X","datePublished":"2024-01-05","dateModified":"2022-01-01"}</script>' WHEN 1 THEN '<script type="application/ld+json">{"datePublished":"2020-02-30"</script>' WHEN 2 THEN '<meta property="article:modified_time" content="2021-05-06T10:00:00Z">' ELSE '' END)"""
_LANG = "CASE page_id % 3 WHEN 0 THEN 'en-US' WHEN 1 THEN 'de' END"
_TYPES = "CASE page_id % 10 WHEN 0 THEN 'WebAPI|Thing' WHEN 1 THEN 'Dentist' END"
_LINES = "concat('# List', chr(10), '- [a](https://x.example/', page_id % 4, '): b', chr(10), '  - [c](https://x.example/1)', chr(10), '* [d](/e)', chr(10), CASE WHEN page_id % 2 = 0 THEN '- [f [g]](h.md)' ELSE '- none' END)"


def _pages(s, d):
    return table(s, d, "pages").select("page_id", F.expr(_MORE).alias("html"), F.expr(_LANG).alias("lang"), F.split(F.expr(_TYPES), r"\|").alias("types"))


QUERIES = {
    "page_vertical": lambda s, d: _pages(s, d).select("page_id", op.vertical(F.col("html"), F.col("types")).alias("vertical")),
    "uncrawlable_links": lambda s, d: op.uncrawlable_links(_pages(s, d)),
    "markdown_links": lambda s, d: op.markdown_links(table(s, d, "pages").select("page_id", F.expr(_LINES).alias("text"))),
    "phrase_mentions": lambda s, d: table(s, d, "documents").select("doc_id", op.mentions(F.col("text"), "the").alias("the"), op.mentions(F.col("text"), "que la").alias("que_la")),
}

_H = f"h AS (SELECT page_id, {_MORE} AS html, {_LANG} AS lang FROM pages)"
_W = lambda words: f"regexp_matches(t, '(?:^|[^a-z0-9_])(?:{words})(?:[^a-z0-9_]|$)')"
ORACLES = {
    "page_vertical": f"""WITH {_H}, l AS (SELECT page_id, lower(html[:40000]) AS t FROM h)
SELECT page_id, CASE WHEN page_id % 10 = 1 THEN 'local' WHEN page_id % 10 = 0 THEN 'saas' {" ".join(f"WHEN {_W(words)} THEN '{name}'" for name, words in op.VERTICAL_WORDS)} ELSE 'generic' END AS vertical FROM l""",
    "uncrawlable_links": """SELECT page_id, 'anchor without an address' AS reason, 1 AS n FROM pages WHERE page_id % 4 IN (0, 2) UNION ALL SELECT page_id, 'router attribute without an address', 1 FROM pages WHERE page_id % 4 = 2
UNION ALL SELECT page_id, 'address on no anchor', 1 FROM pages WHERE page_id % 4 IN (1, 2)""",
    "markdown_links": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 3 ELSE 2 END AS lines, CASE WHEN page_id % 4 = 1 THEN 1 ELSE 2 END AS absolute, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS relative FROM pages",
    "phrase_mentions": r"SELECT doc_id, regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])the(?:[^\p{L}\p{N}_]|$)') AS the, regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])que la(?:[^\p{L}\p{N}_]|$)') AS que_la FROM documents",
}
