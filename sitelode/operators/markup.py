"""What pages declare: structured data, language alternates, canonical addresses, security headers and what bars them from the index.

Structured data is read once a page or node, by a function over batches, and judged by expressions; a page is one row
throughout and nothing is shuffled. Null and malformed JSON declares nothing.
"""

from __future__ import annotations

from json import dumps

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType

from sitelode.functions import text, urls
from sitelode.operators.graphs import resolved
from sitelode.operators.lineage import cut
from sitelode.sources import jsonld

#: What a node of a type must have, and what it should.
REQUIRED = {
    "Organization": "@type name url", "LocalBusiness": "@type name address telephone", "Article": "@type headline author datePublished publisher",
    "NewsArticle": "@type headline author datePublished publisher", "BlogPosting": "@type headline author datePublished publisher", "Product": "@type name image description offers",
    "BreadcrumbList": "@type itemListElement", "WebSite": "@type name url", "WebPage": "@type name url", "Person": "@type name", "Review": "@type itemReviewed author",
    "Rating": "@type ratingValue", "Event": "@type name startDate location", "FAQPage": "@type mainEntity", "HowTo": "@type name step",
    "Recipe": "@type name image author datePublished", "VideoObject": "@type name description thumbnailUrl uploadDate",
}
RECOMMENDED = {
    "Organization": "logo contactPoint sameAs", "LocalBusiness": "image priceRange openingHours", "Article": "image dateModified", "Product": "brand sku aggregateRating",
    "Person": "url image jobTitle", "Review": "reviewRating datePublished", "Event": "endDate organizer performer",
}
_NONE = "array<string>"


def _object(json: Column) -> Column:
    return F.from_json(json, "map<string,string>")


def _elements(json: Column) -> Column:
    """An array's elements as JSON; anything else as the one element there is."""
    one = F.when(json.isNull(), F.array().cast(_NONE)).otherwise(F.array(json))
    return F.when(F.ltrim(json).startswith("["), F.coalesce(F.from_json(json, _NONE), F.array().cast(_NONE))).otherwise(one)


def _types(json: Column) -> Column:
    return _elements(_object(json)["@type"])


@F.arrow_udf(ArrayType(StringType()))
def _declared(blocks: pa.Array) -> pa.Array:
    """The declared nodes of pages' JSON-LD blocks as JSON texts; each block is read once."""
    rows = [jsonld.declared(jsonld.read([b for b in page or [] if b is not None])[0]) for page in blocks.to_pylist()]
    return pa.array([[dumps(n) for n in nodes] for nodes in rows], pa.list_(pa.string()))


@F.arrow_udf(MapType(StringType(), StringType()))
def fields(nodes: pa.Array) -> pa.Array:
    """A node's fields: texts as they are, null for null, everything else as a JSON text; null for what is no object."""
    found = [jsonld.fields(n) for n in nodes.to_pylist()]
    return pa.array([None if f is None else list(f.items()) for f in found], pa.map_(pa.string(), pa.string()))


def declared_nodes(pages: DataFrame, blocks: str = "blocks") -> DataFrame:
    """pages plus nodes: every typed node of its JSON-LD blocks (an array of JSON texts), six levels deep, without those that
    only point at a node described elsewhere on the page. A pointer to nothing stays."""
    return pages.withColumn("nodes", _declared(F.col(blocks)))


def declared_types(nodes: Column) -> Column:
    """The different types of nodes, in order of their names."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(nodes, _types))))


def _has(node: Column, field: str | Column) -> Column:
    value = F.trim(node[field])
    return F.coalesce((value != "") & (value != "[]"), F.lit(False))


def _lists(table: dict[str, str]) -> Column:
    return F.create_map(*[x for kind, fields in table.items() for x in (F.lit(kind), F.array(*map(F.lit, fields.split())))])


def validate(nodes: DataFrame, key: str, column: str = "node") -> DataFrame:
    """key, type (the first of a node's), errors and warnings in order, valid. nodes: a JSON text a row."""
    rows = nodes.select(key, fields(F.col(column)).alias("m")).withColumn("type", F.try_element_at(_elements(F.col("m")["@type"]), F.lit(1)))
    m, kind = F.col("m"), F.col("type")
    none = F.array().cast(_NONE)
    lacking = lambda table, words: F.transform(F.filter(F.coalesce(_lists(table)[kind], none), lambda f: ~_has(m, f)), lambda f: F.concat(F.lit(words), f))
    when = lambda condition, words: F.when(condition, F.lit(words))
    each = lambda field, rule: F.flatten(F.transform(_elements(m[field]), lambda v, i: F.array_compact(F.array(*rule(_object(v), i)))))
    at = lambda name, i, words: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit(f"] {words}"))

    items = F.when(~F.coalesce(F.ltrim(m["itemListElement"]).startswith("["), F.lit(False)), F.array(F.lit("itemListElement must be an array"))).otherwise(
        each("itemListElement", lambda o, i: [
            F.when(F.coalesce(o["@type"], F.lit("")) != "ListItem", at("itemListElement", i, "missing @type: ListItem")),
            F.when(~_has(o, "position"), at("itemListElement", i, "missing position")),
            F.when(~_has(o, "name") & ~_has(o, "item"), at("itemListElement", i, "missing name or item")),
        ])
    )
    offers = F.when(_has(m, "offers"), each("offers", lambda o, i: [F.when(~_has(o, f), at("offers", i, f"missing {f}")) for f in ("price", "priceCurrency")])).otherwise(none)
    unsure_offers = F.when(_has(m, "offers"), each("offers", lambda o, i: [F.when(~_has(o, "availability"), at("offers", i, "missing availability"))])).otherwise(none)
    rating, publisher = _object(m["aggregateRating"]), _object(m["publisher"])
    rated, published = _has(m, "aggregateRating"), F.ltrim(m["publisher"]).startswith("{")
    of_product = F.concat(offers, F.array_compact(F.array(when(rated & ~_has(rating, "ratingValue"), "aggregateRating missing ratingValue"))))
    unsure_product = F.concat(unsure_offers, F.array_compact(F.array(when(rated & ~_has(rating, "reviewCount") & ~_has(rating, "ratingCount"), "aggregateRating missing reviewCount or ratingCount"))))
    organised = F.coalesce(publisher["@type"], F.lit("")) == "Organization"
    authors = lambda rule: F.when(_has(m, "author"), each("author", rule)).otherwise(none)
    of_article = F.concat(
        F.array_compact(F.array(when(published & ~organised, "publisher must be of type Organization"), when(published & organised & ~_has(publisher, "name"), "publisher missing name"))),
        authors(lambda o, i: [F.when(F.size(o) > 0, F.when(~_has(o, "name"), at("author", i, "missing name")))]),
    )
    unsure_article = F.concat(
        F.array_compact(F.array(when(published & organised & ~_has(publisher, "logo"), "publisher missing logo"))),
        authors(lambda o, i: [F.when(F.size(o) > 0, F.when(o["@type"].isNull(), at("author", i, "missing @type")).when(~o["@type"].isin("Person", "Organization"), at("author", i, "@type should be Person or Organization")))]),
    )
    context = when(m["@context"].isNull(), "Missing @context field")
    context = F.coalesce(context, when(~F.ltrim(m["@context"]).rlike(r"^[\[{]") & ~F.contains(m["@context"], F.lit("schema.org")), "Unexpected @context value (should be https://schema.org)"))
    article = kind.isin("Article", "NewsArticle", "BlogPosting")
    errors = F.concat(lacking(REQUIRED, "Missing required field: "), F.when(kind == "BreadcrumbList", items).when(kind == "Product", of_product).when(article, of_article).otherwise(none))
    warnings = F.concat(
        lacking(RECOMMENDED, "Missing recommended field: "), F.array_compact(F.array(context)), F.when(kind == "Product", unsure_product).when(article, unsure_article).otherwise(none)
    )
    return rows.select(key, "type", errors.alias("errors"), warnings.alias("warnings")).withColumn("valid", F.size("errors") == 0)


def _origin_key(url: Column) -> Column:
    """A page's key with its scheme, and with www. where it has one: two origins are two pages."""
    origin = F.lower(F.regexp_extract(F.trim(url), r"(?i)^(https?://(?:www\.)?)", 1))
    return F.coalesce(F.concat(origin, urls.url_key(url)), url)


def hreflang_issues(alternates: DataFrame, pages: DataFrame) -> DataFrame:
    """url, kind, severity, lang, href: a row per issue. alternates: url, lang, href, source (html, header or sitemap) as pages
    state them; pages: url, status (null: not answered) of all that were read.

    Languages must be real and alternates unique a language, a page must name itself, an alternate must be there and link
    back (x-default need not), and both sources must agree."""
    tags = cut(alternates.withColumns({"own": _origin_key(F.col("url")), "to": _origin_key(F.col("href"))}))  # read by four groupings
    none, is_default = F.lit(None).cast("string"), F.lower("lang") == "x-default"
    row = lambda when, kind, severity, lang, href: F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), lang.alias("lang"), href.alias("href")))
    issues = lambda df, *found: df.select("url", F.inline(F.array_compact(F.array(*found))))
    lang, href = F.col("lang"), F.col("href")
    good = text.language_of(lang).isNotNull()
    of_tag = issues(tags, row(~good, "invalid-code", "critical", lang, href), row(good & text.meant_region(lang).isNotNull(), "code-is-a-country", "warning", lang, href))

    pair = F.concat_ws(":", "lang", "href")
    sets = [F.array_sort(F.collect_set(F.when(F.col("source") == s, pair))).alias(s) for s in ("html", "header", "sitemap")]
    of_page = tags.groupBy("url", "own").agg(F.count("*").alias("n"), F.max(F.col("to") == F.col("own")).alias("names_itself"), F.max(is_default).alias("has_default"), *sets)
    differ = lambda other: (F.size("html") > 0) & (F.size(other) > 0) & (F.col("html") != F.col(other))
    of_page = issues(
        of_page, row(~F.col("names_itself"), "no-self-reference", "critical", none, none), row(~F.col("has_default") & (F.col("n") > 1), "no-x-default", "warning", none, none),
        row(differ("header"), "header-differs", "warning", none, none), row(differ("sitemap"), "sitemap-differs", "info", none, none),
    )
    of_lang = tags.groupBy("url", "lang").agg(F.count_distinct("href").alias("n"))
    of_lang = issues(of_lang, row(F.col("n") > 1, "duplicate", "critical", lang, none))

    # a row per alternate address, as the first tag names it, with what was read there and whether it links back
    first = tags.groupBy("url", "own", "to").agg(F.min_by(F.struct("lang", "href"), F.struct("source", "lang", "href")).alias("f")).select("url", "own", "to", "f.*")
    read = pages.groupBy(_origin_key(F.col("url")).alias("to")).agg(F.max("status").alias("status"))
    back = tags.where("source <> 'sitemap'").select(F.col("own").alias("to"), F.col("to").alias("own")).distinct().withColumn("_back", F.lit(True))
    seen = first.join(read, "to", "left").join(back, ["to", "own"], "left")
    gone, answered = F.coalesce(F.col("status").isin(404, 410), F.lit(False)), F.coalesce(F.col("status").between(200, 399), F.lit(False))
    of_target = issues(
        seen, row(gone, "not-found", "critical", lang, href), row(~(gone | answered), "not-answered", "info", lang, href),
        row(answered & (F.col("to") != F.col("own")) & ~is_default & F.col("_back").isNull(), "no-link-back", "warning", lang, href),
    )
    return of_tag.unionByName(of_page).unionByName(of_lang).unionByName(of_target)


def alternates_of(pages: DataFrame, sitemaps: DataFrame | None = None) -> DataFrame:
    """url, lang, href, source: the language alternates that pages name in their head (html), in their answer's Link header (header), and
    that sitemaps name for them, each address resolved against the page's.

    pages: parsed, with url and link, the header's text; sitemaps: body. Tags without a language or an address name nothing."""
    attr = lambda n, name: F.try_element_at(n["attrs"], F.lit(name))
    rel = lambda r: F.array_contains(F.split(F.lower(F.coalesce(r, F.lit(""))), r"\s+"), "alternate")
    tag = lambda lang, href, source: F.struct(F.trim(lang).alias("lang"), F.trim(href).alias("href"), F.lit(source).alias("source"))
    head = F.transform(F.filter("nodes", lambda n: (n["tag"] == "link") & rel(attr(n, "rel"))), lambda n: tag(attr(n, "hreflang"), attr(n, "href"), "html"))
    part = lambda x, name: F.coalesce(*[F.nullif(F.regexp_extract(x, rf"(?i);\s*{name}\s*=\s*{form}", 1), F.lit("")) for form in ('"([^"]*)"', '([^\\s",;]+)')])
    linked = F.regexp_extract_all(F.coalesce("link", F.lit("")), F.lit(r"<[^>]*>[^<]*"), F.lit(0))
    header = F.transform(F.filter(linked, lambda x: rel(part(x, "rel"))), lambda x: tag(part(x, "hreflang"), F.regexp_extract(x, "<([^>]*)>", 1), "header"))
    rows = pages.select("url", F.inline(F.concat(head, header)))
    if sitemaps is not None:
        entry = sitemaps.select(F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))).alias("x"))
        value = lambda x, name: F.regexp_extract(x, rf"\b{name}\s*=\s*[\"']([^\"']*)", 1)
        links = F.filter(F.regexp_extract_all("x", F.lit(r"<(?:\w+:)?link\b[^>]*>"), F.lit(0)), lambda x: rel(value(x, "rel")))
        listed = entry.select(F.trim(F.regexp_extract("x", r"(?s)<loc>(.*?)</loc>", 1)).alias("url"), F.inline(F.transform(links, lambda x: tag(value(x, "hreflang"), value(x, "href"), "sitemap"))))
        rows = rows.unionByName(listed.where("url <> ''"))
    rows = rows.where("lang <> '' AND href <> ''")
    return rows.select("url", "lang", F.coalesce(resolved(F.col("href"), F.col("url")), "href").alias("href"), "source")


def country_gaps(impressions: DataFrame, languages: DataFrame, alternates: DataFrame, least: float = 100.0, least_share: float = 0.01) -> DataFrame:
    """country, impressions, share, state and the codes that serve it. impressions: country, impressions; languages: country,
    region (two letters), languages (of a fixed table, a row a country); alternates: code.

    A country counts with a hundred impressions and a hundredth of all. It is served by an alternate in one of its languages
    for it or no region, else aimed elsewhere if there is one for other regions, else a gap; unknown if the table lacks it."""
    t = cut(impressions.groupBy("country").agg(F.sum("impressions").alias("impressions")))  # a row a country, read four times
    whole = t.agg(F.sum("impressions").alias("_all"))
    t = t.crossJoin(F.broadcast(whole)).withColumn("share", F.col("impressions") / F.col("_all")).drop("_all")
    t = t.where((F.col("impressions") >= least) & (F.col("share") >= least_share)).join(languages, "country", "left")
    alt = alternates.select(text.lang_code(F.col("code")).alias("code")).where("code IS NOT NULL").distinct().select("code", text.language_of(F.col("code")).alias("language"), text.region_of(F.col("code")).alias("to_region"))
    found = t.select("country", "region", F.explode("languages").alias("language")).join(alt, "language")
    here = F.col("to_region").isNull() | (F.col("to_region") == F.col("region"))
    codes = found.groupBy("country").agg(F.array_sort(F.collect_set(F.when(here, F.col("code")))).alias("here"), F.array_sort(F.collect_set(F.when(~here, F.col("code")))).alias("elsewhere"))
    rows = t.join(codes, "country", "left")
    state = F.when(F.col("languages").isNull(), "unknown country").when(F.size("here") > 0, "served").when(F.size("elsewhere") > 0, "aimed elsewhere").otherwise("gap")
    shown = F.when(state == "served", F.array_join("here", ",")).when(state == "aimed elsewhere", F.array_join("elsewhere", ",")).otherwise("")
    return rows.select("country", "impressions", "share", state.alias("state"), shown.alias("codes"))


def security(headers: DataFrame, key: str) -> DataFrame:
    """key, score, max, percent, grade. headers: key, https and the seven headers by name with underscores, null where absent.

    Strict-Transport-Security does not apply without https and leaves both sides."""
    h = F.col
    has = lambda name, part: F.contains(h(name), F.lit(part))
    pts = lambda condition, n: F.when(F.coalesce(condition, F.lit(False)), float(n)).otherwise(0.0)
    age = F.coalesce(F.regexp_extract("strict_transport_security", r"max-age=(\d+)", 1).try_cast("double"), F.lit(0.0))
    hsts = 10.0 + F.when(age >= 31536000, 5.0).when(age >= 15768000, 3.0).otherwise(0.0) + pts(has("strict_transport_security", "includeSubDomains"), 3) + pts(has("strict_transport_security", "preload"), 2)
    csp = 15.0 + pts(has("content_security_policy", "default-src"), 3) + pts(has("content_security_policy", "script-src"), 2) + pts(has("content_security_policy", "object-src 'none'"), 3) + pts(has("content_security_policy", "base-uri"), 2)
    csp = F.greatest(F.lit(0.0), csp - pts(has("content_security_policy", "'unsafe-inline'"), 5) - pts(has("content_security_policy", "'unsafe-eval'"), 5))
    frame = F.when(F.upper("x_frame_options").isin("DENY", "SAMEORIGIN"), 15.0).otherwise(10.0)
    sniff = F.when(F.lower("x_content_type_options") == "nosniff", 10.0).otherwise(5.0)
    referrer = F.when(F.lower("referrer_policy").isin("no-referrer", "strict-origin", "strict-origin-when-cross-origin"), 10.0).otherwise(5.0)
    features = 5.0 + sum((pts(has("permissions_policy", f"{f}=()"), 1) for f in ("geolocation", "camera", "microphone", "payment")), F.lit(0.0))
    xss = F.when(h("x_xss_protection").isin("0", "1; mode=block"), 5.0).otherwise(2.5)
    checks = {"content_security_policy": (csp, 25), "x_frame_options": (frame, 15), "x_content_type_options": (sniff, 10), "referrer_policy": (referrer, 10), "permissions_policy": (features, 9), "x_xss_protection": (xss, 5)}
    given = lambda name: F.coalesce(h(name), F.lit("")) != ""
    score = F.when(h("https") & given("strict_transport_security"), hsts).otherwise(0.0)
    for name, (earned, _) in checks.items():
        score = score + F.when(given(name), earned).otherwise(0.0)
    rows = headers.select(key, score.alias("score"), (F.when(h("https"), 20.0).otherwise(0.0) + float(sum(n for _, n in checks.values()))).alias("max"))
    percent = F.col("score") / F.col("max") * 100
    grade = F.when(percent >= 95, "A+").when(percent >= 85, "A").when(percent >= 75, "B").when(percent >= 65, "C").when(percent >= 50, "D").otherwise("F")
    return rows.withColumns({"percent": percent, "grade": grade})


def canonical_conflicts(pages: DataFrame) -> DataFrame:
    """page_id, canonical, stated (html, header, both or none), conflict. pages: page_id, url, canonical (of the html), link (the
    Link header). The two must agree, and a canonical that names another page than this one is told apart from one that
    names itself."""
    header = F.regexp_extract(F.coalesce("link", F.lit("")), r'(?i)<([^>]+)>;\s*rel="canonical"', 1)
    rows = pages.select("page_id", "url", F.when(F.trim("canonical") != "", F.trim("canonical")).alias("html"), F.when(header != "", header).alias("header"))
    stated = F.when(F.col("html").isNotNull() & F.col("header").isNotNull(), "both").when(F.col("html").isNotNull(), "html").when(F.col("header").isNotNull(), "header").otherwise("none")
    canonical = F.coalesce("html", "header")
    conflict = F.when((stated == "both") & (F.col("html") != F.col("header")), "html and header differ").when(canonical.isNotNull() & ~urls.same_url(canonical, F.col("url")), "names another page")
    return rows.select("page_id", canonical.alias("canonical"), stated.alias("stated"), conflict.alias("conflict"))


def crawlability(pages: DataFrame) -> DataFrame:
    """page_id, kind, value: what keeps a page from being read or named as it means to, a row per finding.

    pages: page_id, url, canonical (of the html), link (the Link header), robots (the meta tag's content), x_robots_tag, allowed
    (whether robots.txt lets the crawler in; null if that couldn't be read). Of a canonical: html_vs_http if the two mean different
    addresses, then invalid (a fragment, or no host), relative or cross_domain. noindex and none of the directives, and
    noindex_unseen where the crawler is kept from reading them."""
    header = F.nullif(F.regexp_extract(F.coalesce("link", F.lit("")), r'(?i)<([^>]+)>;\s*rel="canonical"', 1), F.lit(""))
    html = F.when(F.trim("canonical") != "", F.trim("canonical"))
    rows = pages.select("page_id", "url", html.alias("html"), header.alias("header"), F.lower(F.concat_ws(",", "robots", "x_robots_tag")).alias("said"), "allowed")
    rows = rows.withColumn("canonical", F.coalesce("html", "header")).withColumn("means", resolved(F.col("canonical"), F.col("url")))
    host = lambda u: F.lower(F.regexp_extract(u, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    c = F.col("canonical")
    absolute = c.rlike(r"(?i)^https?://")
    kind = F.when(c.startswith("#") | absolute & (F.coalesce(host(F.col("means")), F.lit("")) == ""), "invalid").when(~absolute, "relative").when(host(F.col("means")) != host(F.col("url")), "cross_domain")
    same = urls.same_url(resolved(F.col("html"), F.col("url")), resolved(F.col("header"), F.col("url")))
    bars = F.col("said").contains("noindex") | F.col("said").contains("none")
    row = lambda when, kind, value: F.when(when, F.struct(kind.alias("kind"), value.alias("value")))
    found = [
        row(F.col("html").isNotNull() & F.col("header").isNotNull() & ~same, F.lit("html_vs_http"), F.col("header")), row(kind.isNotNull(), kind, c), row(F.col("said").contains("noindex"), F.lit("noindex"), F.col("said")),
        row(F.col("said").contains("none"), F.lit("none"), F.col("said")), row(bars & (F.col("allowed") == F.lit(False)), F.lit("noindex_unseen"), F.col("said")),
    ]
    return rows.select("page_id", F.inline(F.array_compact(F.array(*found))))


def technical_gate(pages: DataFrame) -> DataFrame:
    """page_id, met and what fails, in order. pages: page_id, allowed (the crawler's verdict), status, robots (the meta tags'
    contents), x_robots_tag. Met if the crawler may fetch it, it answers 200 and nothing removes it from the index."""
    removes = r"(?i)(?<![A-Za-z0-9_])(?:noindex|none)(?![A-Za-z0-9_])"
    barred = F.coalesce(F.exists("robots", lambda c: c.rlike(removes)), F.lit(False)) | F.coalesce(F.col("x_robots_tag").rlike(removes), F.lit(False))
    fails = F.array_compact(F.array(F.when(~F.coalesce("allowed", F.lit(True)), F.lit("googlebot-allowed")), F.when(F.col("status") != 200, F.lit("http-200")), F.when(barred, F.lit("not-excluded"))))
    return pages.select("page_id", (F.size(fails) == 0).alias("met"), F.array_join(fails, ",").alias("failed"))


def headings(of_pages: DataFrame) -> DataFrame:
    """page_id, at, level, text, skipped, parent: a row per heading of the html, in order. skipped: it is more than one level
    below the heading before it; parent: the place of the nearest heading before it of a higher level, null at the top."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<h([1-6])\b[^>]*>.*?</h[1-6]>"), F.lit(0))
    rows = of_pages.select("page_id", F.transform(found, lambda x: F.struct(F.substring(x, 3, 1).cast("int").alias("level"), F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", ""), r"\s+", " ")).alias("text"))).alias("hs"))
    places = lambda i: F.sequence(F.lit(0), i - 1)
    above = lambda i, h: F.array_max(F.filter(F.when(i > 0, places(i)).otherwise(F.array().cast("array<int>")), lambda j: F.get("hs", j)["level"] < h["level"]))
    marked = F.transform("hs", lambda h, i: F.struct(i.alias("at"), h["level"].alias("level"), h["text"].alias("text"), F.coalesce((i > 0) & (h["level"] > F.get("hs", i - 1)["level"] + 1), F.lit(False)).alias("skipped"), above(i, h).alias("parent")))
    return rows.select("page_id", F.inline(marked))
