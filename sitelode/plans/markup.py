"""Queries on what pages declare. Tables that the driver lacks are made of its own, by expressions that Spark's SQL and
DuckDB's share."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelode.functions import text as fx
from sitelode.operators import markup as op
from sitelode.sources.tables import SQL, search_rows, table

#: A page's JSON-LD blocks, made of a part: pointers that resolve or not, lists of types, nested nodes, missing fields, junk.
_GRAPH = """concat('{"@context":"https://schema.org","@graph":[{"@type":"Organization","@id":"#org","name":"', p_type, '"', CASE WHEN p_partkey % 2 = 0 THEN ',"url":"https://shop.example.com/","logo":"l.png"' ELSE '' END,
 '},{"@type":"WebSite","name":"Shop","url":"https://shop.example.com/","publisher":{"@type":"Organization","@id":"', CASE WHEN p_partkey % 3 = 0 THEN '#other' ELSE '#org' END, '"}}]}')"""
_PRODUCT = """concat('{"@context":"https://schema.org","@type":"Product","name":"', p_name, '","image":', CASE WHEN p_partkey % 3 = 0 THEN '[]' ELSE '"i.png"' END, ',"offers":[{"@type":"Offer","price":', p_size, ',"priceCurrency":"', CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE 'EUR' END,
 '"},{"@type":"Offer","availability":"InStock"}],"brand":{"@type":"Brand","name":"', p_brand, '"}', CASE WHEN p_partkey % 7 = 0 THEN ',"aggregateRating":{"@type":"AggregateRating","reviewCount":3}' ELSE '' END, '}')"""
_ARTICLE = """concat('[{"@context":"http://example.org","@type":["BlogPosting","Article"],"headline":"', p_name, '","datePublished":"2024-01-02","author":[{"@type":"Person","name":"', p_brand, '"},{"@type":"Robot"},"A name"],"publisher":{"@type":"', CASE WHEN p_partkey % 3 = 0 THEN 'Person' ELSE 'Organization' END, '"',
 CASE WHEN p_partkey % 5 = 0 THEN ',"name":"P"' ELSE '' END, '}}]')"""
_CRUMBS = """concat('{"@type":"BreadcrumbList","itemListElement":', CASE WHEN p_partkey % 3 = 0 THEN '"none"' ELSE '[{"@type":"ListItem","position":1,"name":"Home"},{"@type":"Item","item":"x"},{"@type":"ListItem","position":3}]' END, '}')"""
_SECOND = f"CASE WHEN p_partkey % 4 = 0 THEN {_PRODUCT} WHEN p_partkey % 4 = 1 THEN {_ARTICLE} WHEN p_partkey % 4 = 2 THEN {_CRUMBS} WHEN p_partkey % 8 = 3 THEN '{{\"@type\":\"Person\", broken' END"


def _nodes(s, d):
    return op.declared_nodes(table(s, d, "part").select("p_partkey", F.array_compact(F.array(F.expr(_GRAPH), F.expr(_SECOND))).alias("blocks")))


def _validated(s, d):
    rows = op.validate(_nodes(s, d).select("p_partkey", F.explode("nodes").alias("node")), "p_partkey")
    return rows.select("p_partkey", "type", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"), "valid")


#: Alternates of a page that is made of a supplier: a few languages, some wrong, some twice, some that don't link back.
_LANGS = "CASE k WHEN 0 THEN 'en' WHEN 1 THEN 'de-DE' WHEN 2 THEN CASE WHEN s_suppkey % 5 = 0 THEN 'uk' ELSE 'fr' END WHEN 3 THEN CASE WHEN s_suppkey % 7 = 0 THEN 'english' WHEN s_suppkey % 7 = 1 THEN 'en' ELSE 'es' END ELSE 'x-default' END"
_HREF = "concat('https://shop.example.com/', s_suppkey - s_suppkey % 5 + CASE WHEN k = 4 THEN 0 ELSE k END)"
_KEPT = "k < 2 + s_suppkey % 4 AND NOT (s_suppkey % 11 = 3 AND k = s_suppkey % 5)"


def _alternates(s, d):
    rows = table(s, d, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).where(_KEPT)
    own = F.expr("concat('https://shop.example.com/', s_suppkey)")
    html = rows.select(own.alias("url"), F.expr(_LANGS).alias("lang"), F.expr(_HREF).alias("href"), F.lit("html").alias("source"))
    header = rows.where("s_suppkey % 6 = 0 AND (k <> 1 OR s_suppkey % 12 = 0)").select(own.alias("url"), F.expr(_LANGS).alias("lang"), F.expr(_HREF).alias("href"), F.lit("header").alias("source"))
    return html.unionByName(header)


def _hreflang(s, d):
    pages = table(s, d, "supplier").select(F.expr("concat('https://shop.example.com/', s_suppkey)").alias("url"), F.expr("CASE WHEN s_suppkey % 13 = 0 THEN 404 WHEN s_suppkey % 17 <> 0 THEN 200 END").alias("status"))
    return op.hreflang_issues(_alternates(s, d), pages)


#: Regions and languages that are given to some of the driver's nations.
_COUNTRIES = {
    f"NATION_{i}": tuple(x.split(":"))
    for i, x in enumerate("US:en es|DE:de|CA:en fr|FR:fr|BR:pt|IN:hi en|CN:zh|PE:es|GB:en|AR:es|RO:ro|JP:ja".split("|"))
}
_CODES = ["en-US", "en-GB", "fr", "de-AT", "pt_br", "zh-hant-TW", "x-default", "english", "es-MX"]


def _countries(s, d):
    table_ = s.createDataFrame([(k, r, ls.split()) for k, (r, ls) in _COUNTRIES.items()], "country string, region string, languages array<string>")
    return op.country_gaps(search_rows(s, d), table_, s.createDataFrame([(c,) for c in _CODES], "code string"))


#: Headers of an answer that is made of an order.
_HEADERS = {
    "strict_transport_security": "CASE WHEN o_orderkey % 3 = 0 THEN concat('max-age=', o_orderkey % 4 * 15768000, CASE WHEN o_orderkey % 2 = 0 THEN '; includeSubDomains; preload' ELSE '' END) WHEN o_orderkey % 3 = 1 THEN 'max-age' END",
    "content_security_policy": "CASE WHEN o_orderkey % 4 < 3 THEN concat('default-src ', CASE WHEN o_orderkey % 5 = 0 THEN '''unsafe-inline'' ''unsafe-eval''' ELSE '''self''' END, CASE WHEN o_orderkey % 7 < 3 THEN '; script-src x; object-src ''none''; base-uri y' ELSE '' END) END",
    "x_frame_options": "CASE WHEN o_orderkey % 5 = 1 THEN 'deny' WHEN o_orderkey % 5 = 2 THEN 'ALLOW-FROM x' WHEN o_orderkey % 5 = 3 THEN '' END",
    "x_content_type_options": "CASE WHEN o_orderkey % 6 < 2 THEN 'NoSniff' WHEN o_orderkey % 6 = 2 THEN 'sniff' END",
    "referrer_policy": "CASE WHEN o_orderkey % 7 < 2 THEN 'strict-origin' WHEN o_orderkey % 7 = 2 THEN 'unsafe-url' END",
    "permissions_policy": "CASE WHEN o_orderkey % 8 < 4 THEN concat('geolocation=(), camera=()', CASE WHEN o_orderkey % 8 = 1 THEN ', microphone=(), payment=()' ELSE '' END) END",
    "x_xss_protection": "CASE WHEN o_orderkey % 9 = 0 THEN '0' WHEN o_orderkey % 9 = 1 THEN '1; mode=block' WHEN o_orderkey % 9 = 2 THEN '1' END",
}


def _security(s, d):
    return op.security(table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 10 != 4).alias("https"), *[F.expr(e).alias(k) for k, e in _HEADERS.items()]), "o_orderkey")


_CANONICAL = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN concat(url, '#part') WHEN 2 THEN 'https://other.example.org/x' WHEN 3 THEN ' ' END"
_LINK = "CASE WHEN page_id % 7 = 0 THEN concat('<', url, '>; rel=\"canonical\"') WHEN page_id % 7 = 1 THEN '<https://a.example.org/s.css>; rel=preload' END"
_ROBOTS = "CASE page_id % 6 WHEN 0 THEN 'index, follow' WHEN 1 THEN 'NoIndex' WHEN 2 THEN 'none' WHEN 3 THEN 'max-snippet:nonempty' END"
_TAG = "CASE WHEN page_id % 10 = 0 THEN 'googlebot: noindex' END"
_GATE_STATUS = "CASE WHEN page_id % 11 = 0 THEN 404 WHEN page_id % 11 = 1 THEN 301 ELSE 200 END"


def _gate(s, d):
    robots = F.array_compact(F.array(F.lit("all"), F.expr(_ROBOTS)))
    return op.technical_gate(table(s, d, "pages").select("page_id", (F.col("page_id") % 8 != 5).alias("allowed"), F.expr(_GATE_STATUS).alias("status"), robots.alias("robots"), F.expr(_TAG).alias("x_robots_tag")))


_DEEPER = "concat(html, '<h', page_id % 4 + 2, ' id=\"x\">A <b>b</b>  c</h', page_id % 4 + 2, '><H3>d</H3><h2>e</h2>')"

_NAMED = "CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN '#x' WHEN 2 THEN '/c' WHEN 3 THEN 'HTTPS://Other.example/x' WHEN 4 THEN 'https://' WHEN 5 THEN ' ' WHEN 6 THEN '?q' END"
_HEADED = "CASE page_id % 3 WHEN 0 THEN concat('<', url, '>; rel=\"canonical\"') WHEN 1 THEN '<//other.example/x>; REL=\"canonical\", <y>; rel=next' END"


def _crawlable(s, d):
    p = table(s, d, "pages").select("page_id", "url", F.expr(_NAMED).alias("canonical"), F.expr(_HEADED).alias("link"), F.expr(_ROBOTS).alias("robots"), F.expr(_TAG).alias("x_robots_tag"), F.expr("CASE page_id % 4 WHEN 0 THEN true WHEN 1 THEN false END").alias("allowed"))
    return op.crawlability(p)


QUERIES = {
    "crawlability": _crawlable,
    "jsonld_types": lambda s, d: _nodes(s, d).select("p_partkey", F.size("nodes").alias("nodes"), F.array_join(op.declared_types(F.col("nodes")), ",").alias("types")),
    "schema_validation": _validated,
    "hreflang_checks": _hreflang,
    "country_language_gaps": _countries,
    "security_scores": _security,
    "canonical_conflicts": lambda s, d: op.canonical_conflicts(table(s, d, "pages").select("page_id", "url", F.expr(_CANONICAL).alias("canonical"), F.expr(_LINK).alias("link"))),
    "technical_gate": _gate,
    "page_headings": lambda s, d: op.headings(table(s, d, "pages").select("page_id", F.expr(_DEEPER).alias("html"))).withColumn("parent", F.coalesce("parent", F.lit(-1))),
}

_KEYS = "'@graph', 'author', 'publisher', 'creator', 'mainEntity', 'mainEntityOfPage', 'itemListElement', 'item', 'about', 'offers', 'brand', 'hasPart', 'isPartOf', 'review', 'aggregateRating', 'breadcrumb'"
_N = f"""RECURSIVE b AS (SELECT p_partkey, unnest(list_filter([{_GRAPH}, {_SECOND}], lambda x: x IS NOT NULL AND json_valid(x))) AS j FROM part),
w(p_partkey, depth, v) AS (SELECT p_partkey, 0, j::JSON FROM b UNION ALL
  SELECT p_partkey, depth + 1, unnest(CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') WHEN json_type(v) = 'OBJECT' THEN list_transform(list_filter(json_keys(v), lambda k: k IN ({_KEYS})), lambda k: json_extract(v, '$."' || k || '"')) END) FROM w WHERE depth < 6),
t AS (SELECT p_partkey, v, CASE WHEN json_type(v, '$."@type"') = 'ARRAY' THEN json_extract_string(v, '$."@type"[*]') ELSE [json_extract_string(v, '$."@type"')] END AS types, json_extract_string(v, '$."@id"') AS id,
  coalesce(json_extract_string(v, '$."@id"') IS NOT NULL AND len(list_filter(json_keys(v), lambda k: k NOT IN ('@id', '@type', '@context'))) = 0, false) AS points FROM w WHERE json_type(v) = 'OBJECT' AND json_type(v, '$."@type"') IN ('VARCHAR', 'ARRAY')),
n AS (SELECT * FROM t WHERE NOT (points AND EXISTS (SELECT 1 FROM t o WHERE o.p_partkey = t.p_partkey AND o.id = t.id AND NOT o.points)))"""
_HAS = "(coalesce(json_type({o}, '$.\"{f}\"'), 'NULL') <> 'NULL' AND trim(json_extract_string({o}, '$.\"{f}\"')) NOT IN ('', '[]'))"


def _sql_has(o, f):
    return _HAS.format(o=o, f=f)


def _sql_lacking(fields, words):
    return "[" + ", ".join(f"CASE WHEN NOT {_sql_has('v', f)} THEN '{words}{f}' END" for f in fields.split()) + "]"


def _sql_each(field, rules):
    """Messages of each element of an array, or of the one thing there is."""
    elements = f"CASE WHEN json_type(v, '$.{field}') = 'ARRAY' THEN json_extract(v, '$.{field}[*]') ELSE [json_extract(v, '$.{field}')] END"
    return f"flatten(list_transform({elements}, lambda o, i: [{', '.join(rules)}]))"


_ITEMS = _sql_each("itemListElement", [
    "CASE WHEN coalesce(json_extract_string(o, '$.\"@type\"'), '') <> 'ListItem' THEN 'itemListElement[' || (i - 1) || '] missing @type: ListItem' END",
    f"CASE WHEN NOT {_sql_has('o', 'position')} THEN 'itemListElement[' || (i - 1) || '] missing position' END",
    f"CASE WHEN NOT {_sql_has('o', 'name')} AND NOT {_sql_has('o', 'item')} THEN 'itemListElement[' || (i - 1) || '] missing name or item' END",
])
_OFFERS = f"CASE WHEN {_sql_has('v', 'offers')} THEN " + _sql_each("offers", [f"CASE WHEN NOT {_sql_has('o', f)} THEN 'offers[' || (i - 1) || '] missing {f}' END" for f in ("price", "priceCurrency")]) + " ELSE [] END"
_UNSURE = f"CASE WHEN {_sql_has('v', 'offers')} THEN " + _sql_each("offers", [f"CASE WHEN NOT {_sql_has('o', 'availability')} THEN 'offers[' || (i - 1) || '] missing availability' END"]) + " ELSE [] END"
_AUTHOR = "CASE WHEN json_type(o) = 'OBJECT' THEN {} END"
_AUTHORS = _sql_each("author", [_AUTHOR.format(f"CASE WHEN NOT {_sql_has('o', 'name')} THEN 'author[' || (i - 1) || '] missing name' END")])
_WHO = _sql_each("author", [_AUTHOR.format("CASE WHEN json_type(o, '$.\"@type\"') IS NULL THEN 'author[' || (i - 1) || '] missing @type' WHEN json_extract_string(o, '$.\"@type\"') NOT IN ('Person', 'Organization') THEN 'author[' || (i - 1) || '] @type should be Person or Organization' END")])
_PUB = "json_extract_string(v, '$.publisher.\"@type\"')"
_ARTICLES = "type IN ('Article', 'NewsArticle', 'BlogPosting')"
_ERRORS = "list_concat(CASE type " + " ".join(f"WHEN '{k}' THEN {_sql_lacking(f, 'Missing required field: ')}" for k, f in op.REQUIRED.items()) + f""" ELSE [] END,
  CASE WHEN type = 'BreadcrumbList' THEN CASE WHEN coalesce(json_type(v, '$.itemListElement'), '') <> 'ARRAY' THEN ['itemListElement must be an array'] ELSE {_ITEMS} END
  WHEN type = 'Product' THEN list_concat({_OFFERS}, [CASE WHEN {_sql_has('v', 'aggregateRating')} AND NOT {_sql_has("json_extract(v, '$.aggregateRating')", 'ratingValue')} THEN 'aggregateRating missing ratingValue' END])
  WHEN {_ARTICLES} THEN list_concat([CASE WHEN json_type(v, '$.publisher') = 'OBJECT' AND coalesce({_PUB}, '') <> 'Organization' THEN 'publisher must be of type Organization' END,
    CASE WHEN {_PUB} = 'Organization' AND NOT {_sql_has("json_extract(v, '$.publisher')", 'name')} THEN 'publisher missing name' END], {_AUTHORS}) ELSE [] END)"""
_WARNINGS = "list_concat(CASE type " + " ".join(f"WHEN '{k}' THEN {_sql_lacking(f, 'Missing recommended field: ')}" for k, f in op.RECOMMENDED.items()) + f""" ELSE [] END,
  [CASE WHEN json_type(v, '$."@context"') IS NULL THEN 'Missing @context field' WHEN NOT contains(json_extract_string(v, '$."@context"'), 'schema.org') THEN 'Unexpected @context value (should be https://schema.org)' END],
  CASE WHEN type = 'Product' THEN list_concat({_UNSURE}, [CASE WHEN {_sql_has('v', 'aggregateRating')} AND NOT {_sql_has("json_extract(v, '$.aggregateRating')", 'reviewCount')} AND NOT {_sql_has("json_extract(v, '$.aggregateRating')", 'ratingCount')} THEN 'aggregateRating missing reviewCount or ratingCount' END])
  WHEN {_ARTICLES} THEN list_concat([CASE WHEN {_PUB} = 'Organization' AND NOT {_sql_has("json_extract(v, '$.publisher')", 'logo')} THEN 'publisher missing logo' END], {_WHO}) ELSE [] END)"""
_A = f"""r AS (SELECT *, 'https://shop.example.com/' || s_suppkey AS url FROM supplier, range(5) t(k) WHERE {_KEPT}),
a AS (SELECT url, {_LANGS} AS lang, {_HREF} AS href, 'html' AS source FROM r UNION ALL SELECT url, {_LANGS}, {_HREF}, 'header' FROM r WHERE s_suppkey % 6 = 0 AND (k <> 1 OR s_suppkey % 12 = 0)),
p AS (SELECT 'https://shop.example.com/' || s_suppkey AS url, CASE WHEN s_suppkey % 13 = 0 THEN 404 WHEN s_suppkey % 17 <> 0 THEN 200 END AS status FROM supplier),
f AS (SELECT url, href, arg_min(lang, (source, lang)) AS lang FROM a GROUP BY ALL), g AS (SELECT f.*, status FROM f LEFT JOIN p ON p.url = href)"""
_GOOD = f"(lower(lang) = 'x-default' OR (regexp_matches(lang, '(?i)^[a-z]{{2}}(-[a-z]{{4}})?(-([a-z]{{2}}|[0-9]{{3}}))?$') AND lower(lang[:2]) IN ({', '.join(repr(c) for c in fx.LANGUAGES)})))"
_HAVE = lambda c: f"coalesce({_HEADERS[c]}, '') <> ''"
_SET = {k: f"({v})" for k, v in _HEADERS.items()}
ORACLES = {
    "crawlability": f"""WITH p AS (SELECT page_id, url, page_id % 8 AS m, page_id % 3 AS h, trim({_NAMED}) AS c, {_HEADED} AS link, lower(concat_ws(',', {_ROBOTS}, {_TAG})) AS said FROM pages),
q AS (SELECT *, CASE h WHEN 0 THEN url WHEN 1 THEN '//other.example/x' END AS header, m IN (0, 1, 2, 3, 4, 6) AS stated FROM p)
SELECT page_id, 'html_vs_http' AS kind, header AS value FROM q WHERE stated AND header IS NOT NULL AND NOT (m = 3 AND h = 1) AND NOT (m IN (0, 1) AND h = 0)
UNION ALL SELECT page_id, CASE WHEN stated THEN CASE m WHEN 1 THEN 'invalid' WHEN 2 THEN 'relative' WHEN 3 THEN 'cross_domain' WHEN 4 THEN 'invalid' WHEN 6 THEN 'relative' END ELSE CASE WHEN h = 1 THEN 'relative' END END AS kind, CASE WHEN stated THEN c ELSE header END FROM q WHERE kind IS NOT NULL
UNION ALL SELECT page_id, 'noindex', said FROM q WHERE contains(said, 'noindex') UNION ALL SELECT page_id, 'none', said FROM q WHERE contains(said, 'none') UNION ALL SELECT page_id, 'noindex_unseen', said FROM q WHERE regexp_matches(said, 'noindex|none') AND page_id % 4 = 1""",
    "jsonld_types": f"WITH {_N}, u AS (SELECT p_partkey, count(*) AS c FROM n GROUP BY 1), x AS (SELECT p_partkey, unnest(types) AS y FROM n) SELECT p_partkey, any_value(c)::INT AS nodes, string_agg(DISTINCT y, ',' ORDER BY y) AS types FROM x JOIN u USING (p_partkey) GROUP BY 1",
    "schema_validation": f"""WITH {_N}, y AS (SELECT p_partkey, v, types[1] AS type FROM n), e AS (SELECT p_partkey, type, list_filter({_ERRORS}, lambda z: z IS NOT NULL) AS errors, list_filter({_WARNINGS}, lambda z: z IS NOT NULL) AS warnings FROM y)
SELECT p_partkey, type, array_to_string(errors, '; ') AS errors, array_to_string(warnings, '; ') AS warnings, len(errors) = 0 AS valid FROM e""",
    "hreflang_checks": f"""WITH {_A}
SELECT url, 'invalid-code' AS kind, 'critical' AS severity, lang, href FROM a WHERE NOT {_GOOD}
UNION ALL SELECT url, 'code-is-a-country', 'warning', lang, href FROM a WHERE lang IN ({', '.join(repr(c) for c in fx.CONFUSABLE)})
UNION ALL SELECT url, 'no-self-reference', 'critical', NULL, NULL FROM a GROUP BY url HAVING count(*) FILTER (href = url) = 0
UNION ALL SELECT url, 'no-x-default', 'warning', NULL, NULL FROM a GROUP BY url HAVING count(*) > 1 AND count(*) FILTER (lang = 'x-default') = 0
UNION ALL SELECT url, 'duplicate', 'critical', lang, NULL FROM a GROUP BY url, lang HAVING count(DISTINCT href) > 1
UNION ALL SELECT url, CASE WHEN status = 404 THEN 'not-found' ELSE 'not-answered' END, CASE WHEN status = 404 THEN 'critical' ELSE 'info' END, lang, href FROM g WHERE status IS NULL OR status = 404
UNION ALL SELECT url, 'no-link-back', 'warning', lang, href FROM g WHERE status = 200 AND href <> url AND lang <> 'x-default' AND NOT EXISTS (SELECT 1 FROM a WHERE a.url = g.href AND a.href = g.url)
UNION ALL SELECT url, 'header-differs', 'warning', NULL, NULL FROM (SELECT url, list(DISTINCT lang || ':' || href ORDER BY lang || ':' || href) FILTER (source = 'html') AS x, list(DISTINCT lang || ':' || href ORDER BY lang || ':' || href) FILTER (source = 'header') AS y FROM a GROUP BY url) WHERE x <> y""",
    "country_language_gaps": f"""WITH {SQL['search']}, l(country, region, languages) AS (VALUES {", ".join(f"('{k}', '{r}', string_split('{ls}', ' '))" for k, (r, ls) in _COUNTRIES.items())}),
a(code, lang, reg) AS (VALUES ('en-US', 'en', 'US'), ('en-GB', 'en', 'GB'), ('fr', 'fr', NULL), ('de-AT', 'de', 'AT'), ('pt-BR', 'pt', 'BR'), ('zh-Hant-TW', 'zh', 'TW'), ('x-default', 'x-default', NULL), ('es-MX', 'es', 'MX')),
t AS (SELECT country, sum(impressions) AS impressions, sum(impressions) / (SELECT sum(impressions) FROM search) AS share FROM search GROUP BY 1),
m AS (SELECT t.*, region, languages FROM t LEFT JOIN l USING (country) WHERE impressions >= 100 AND share >= 0.01),
x AS (SELECT m.country, impressions, share, any_value(m.languages) AS languages, string_agg(DISTINCT code, ',' ORDER BY code) FILTER (reg IS NULL OR reg = region) AS here, string_agg(DISTINCT code, ',' ORDER BY code) FILTER (reg <> region) AS elsewhere FROM m LEFT JOIN a ON list_contains(m.languages, lang) GROUP BY ALL)
SELECT country, impressions, share, CASE WHEN languages IS NULL THEN 'unknown country' WHEN here IS NOT NULL THEN 'served' WHEN elsewhere IS NOT NULL THEN 'aimed elsewhere' ELSE 'gap' END AS state, coalesce(CASE WHEN languages IS NOT NULL THEN coalesce(here, elsewhere) END, '') AS codes FROM x""",
    "security_scores": f"""WITH h AS (SELECT o_orderkey, o_orderkey % 10 <> 4 AS https, {', '.join(f'{e} AS {k}' for k, e in _HEADERS.items())} FROM orders),
c AS (SELECT o_orderkey, https,
  CASE WHEN https AND strict_transport_security <> '' THEN 10 + CASE WHEN coalesce(try_cast(nullif(regexp_extract(strict_transport_security, 'max-age=(\\d+)', 1), '') AS DOUBLE), 0) >= 31536000 THEN 5 WHEN coalesce(try_cast(nullif(regexp_extract(strict_transport_security, 'max-age=(\\d+)', 1), '') AS DOUBLE), 0) >= 15768000 THEN 3 ELSE 0 END
    + CASE WHEN contains(strict_transport_security, 'includeSubDomains') THEN 3 ELSE 0 END + CASE WHEN contains(strict_transport_security, 'preload') THEN 2 ELSE 0 END ELSE 0 END AS a,
  CASE WHEN content_security_policy <> '' THEN greatest(0, 15 + contains(content_security_policy, 'default-src')::INT * 3 + contains(content_security_policy, 'script-src')::INT * 2 + contains(content_security_policy, 'object-src ''none''')::INT * 3 + contains(content_security_policy, 'base-uri')::INT * 2
    - contains(content_security_policy, '''unsafe-inline''')::INT * 5 - contains(content_security_policy, '''unsafe-eval''')::INT * 5) ELSE 0 END AS b,
  CASE WHEN x_frame_options <> '' THEN CASE WHEN upper(x_frame_options) IN ('DENY', 'SAMEORIGIN') THEN 15 ELSE 10 END ELSE 0 END AS c, CASE WHEN x_content_type_options <> '' THEN CASE WHEN lower(x_content_type_options) = 'nosniff' THEN 10 ELSE 5 END ELSE 0 END AS d,
  CASE WHEN referrer_policy <> '' THEN CASE WHEN lower(referrer_policy) IN ('no-referrer', 'strict-origin', 'strict-origin-when-cross-origin') THEN 10 ELSE 5 END ELSE 0 END AS e,
  CASE WHEN permissions_policy <> '' THEN 5 + len(list_filter(['geolocation', 'camera', 'microphone', 'payment'], lambda f: contains(permissions_policy, f || '=()'))) ELSE 0 END AS f, CASE WHEN x_xss_protection IN ('0', '1; mode=block') THEN 5 WHEN x_xss_protection <> '' THEN 2.5 ELSE 0 END AS g FROM h),
s AS (SELECT o_orderkey, (a + b + c + d + e + f + g)::DOUBLE AS score, CASE WHEN https THEN 94 ELSE 74 END::DOUBLE AS max FROM c), q AS (SELECT *, score / max * 100 AS percent FROM s)
SELECT *, CASE WHEN percent >= 95 THEN 'A+' WHEN percent >= 85 THEN 'A' WHEN percent >= 75 THEN 'B' WHEN percent >= 65 THEN 'C' WHEN percent >= 50 THEN 'D' ELSE 'F' END AS grade FROM q""",
    "canonical_conflicts": f"""WITH r AS (SELECT page_id, url, nullif(trim({_CANONICAL}), '') AS html, CASE WHEN page_id % 7 = 0 THEN url END AS header FROM pages)
SELECT page_id, coalesce(html, header) AS canonical, CASE WHEN html IS NOT NULL AND header IS NOT NULL THEN 'both' WHEN html IS NOT NULL THEN 'html' WHEN header IS NOT NULL THEN 'header' ELSE 'none' END AS stated,
  CASE WHEN html <> header THEN 'html and header differ' WHEN page_id % 5 = 2 THEN 'names another page' END AS conflict FROM r""",
    "technical_gate": f"""WITH r AS (SELECT page_id, [CASE WHEN page_id % 8 = 5 THEN 'googlebot-allowed' END, CASE WHEN {_GATE_STATUS} <> 200 THEN 'http-200' END, CASE WHEN page_id % 6 IN (1, 2) OR page_id % 10 = 0 THEN 'not-excluded' END] AS f FROM pages)
SELECT page_id, len(list_filter(f, lambda x: x IS NOT NULL)) = 0 AS met, array_to_string(list_filter(f, lambda x: x IS NOT NULL), ',') AS failed FROM r""",
    "page_headings": f"""WITH h AS (SELECT page_id, regexp_extract_all({_DEEPER}, '(?is)<h[1-6]\\b[^>]*>.*?</h[1-6]>') AS x FROM pages),
r AS (SELECT page_id, (i - 1)::INT AS place, x[i][3]::INT AS level, trim(regexp_replace(regexp_replace(x[i], '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS text FROM (SELECT page_id, x, unnest(range(1, len(x) + 1)) AS i FROM h))
SELECT page_id, place AS "at", level, text, coalesce(level > lag(level) OVER w + 1, false) AS skipped, coalesce((SELECT max(o.place) FROM r o WHERE o.page_id = r.page_id AND o.place < r.place AND o.level < r.level), -1)::INT AS parent FROM r WINDOW w AS (PARTITION BY page_id ORDER BY place)""",
}
