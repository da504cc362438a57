"""What pages declare against what they show: structured data without its content, types that a page owes, who publishes it, and
the file in which a site lists its pages for language models. Pages are parsed (`sitelode.sources.dom.parsed`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelode.operators import readable, scores
from sitelode.operators.pages import ARTICLE_TYPES, PRODUCT_TYPES
from sitelode.sources import dom

#: Types that say who publishes, types that a publisher's name is taken from, in this order, and marks of a price and a purchase.
PUBLISHED_BY = ("Organization", "LocalBusiness", "NewsMediaOrganization", "OnlineBusiness")
NAMED_BY = ("Organization", "LocalBusiness", "Corporation", "NGO", "Person")
PRICE = r"(?i)\$[\d,]+(?:\.\d{2})?|[€£¥]\s?[\d,]+|\d+[.,]\d{2}\s?(?:USD|EUR|GBP|MXN)"
PURCHASE = r"(?i)add[\s-]to[\s-]cart|buy[\s-]now|comprar|añadir|checkout"
#: Points of each check on a site's list for language models, and what fewer than three links earn.
LISTED_POINTS, FEW_LINKS = 20, 8


def _attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def _some(condition) -> Column:
    return F.exists("nodes", lambda n: F.coalesce(condition(n), F.lit(False)))


def _inside(inner: str, outer: str) -> Column:
    """An element in another one."""
    return F.exists(dom.elements(outer), lambda o: F.exists(dom.elements(inner), lambda n: (n["i"] > o["i"]) & (n["i"] <= o["last"])))


def _named(word: str) -> Column:
    """An element whose class or id has the word in it."""
    return _some(lambda n: _attr(n, "class").rlike(f"(?i){word}") | _attr(n, "id").rlike(f"(?i){word}"))


def _node(kind: str) -> Column:
    return F.get(F.filter("graph", lambda g: F.array_contains(g["types"], kind)), 0)["node"]


def mismatches(pages: DataFrame) -> DataFrame:
    """page_id, type, severity, lacks: JSON-LD that the page doesn't bear out, of FAQPage, HowTo and Product.

    Questions show as a disclosure, a definition list, an element called faq or a heading that asks; steps as an ordered list, a
    heading with a step's number or an element called step. A product needs offers, a price and an identifier (what it lacks is
    listed), and then, for information, a visible price or a control to buy it."""
    asks = _inside("summary", "details") | (_inside("dt", "dl") & _inside("dd", "dl")) | _named("faq") | (F.size(readable.question_headings()) > 0)
    steps = _inside("li", "ol") | _named("step") | F.exists("nodes", lambda n: n["tag"].isin(*dom.HEADINGS) & dom.text(n).rlike(r"(?i)^(?:step\s*\d|paso\s*\d|\d[.)])"))
    product = _node("Product")
    offers = product["offers"]
    said = lambda *paths: F.coalesce(*[F.nullif(F.nullif(F.get_json_object(offers, f"$.{p}"), F.lit("")), F.lit("0")) for p in paths]).isNotNull()
    price = said("price", "priceSpecification") | product["price"].isNotNull()
    identified = F.coalesce(*[product[k] for k in ("sku", "gtin", "gtin13", "mpn")]).isNotNull()
    lacks = F.array_compact(F.array(F.when(offers.isNull(), "offers"), F.when(~F.coalesce(price, F.lit(False)), "price"), F.when(~identified, "identifier")))
    buys = _some(lambda n: n["tag"].isin("button", "a") & F.exists(F.map_values(n["attrs"]), lambda v: v.rlike(PURCHASE)))
    sells = dom.all_text().rlike(PRICE) | buys
    row = lambda when, kind, severity, what: F.when(when, F.struct(F.lit(kind).alias("type"), severity.alias("severity"), what.alias("lacks")))
    has, none = lambda kind: _node(kind).isNotNull(), F.array().cast("array<string>")
    found = [
        row(has("FAQPage") & ~asks, "FAQPage", F.lit("warning"), none), row(has("HowTo") & ~steps, "HowTo", F.lit("warning"), none),
        row(has("Product") & ((F.size(lacks) > 0) | ~sells), "Product", F.when(F.size(lacks) > 0, "warning").otherwise("info"), lacks),
    ]
    return pages.select("page_id", F.inline(F.array_compact(F.array(*found))))


def expected_types(pages: DataFrame) -> DataFrame:
    """page_id, label, state (present, missing, exempt): the types that a page owes by its kind and place, and whether it has one that
    will do. pages: with page_id and url.

    Every page owes who publishes it, a home page its site, an article and a product themselves, and a page two levels down or
    with a visible trail its breadcrumbs; what the others don't owe is exempt."""
    trail = _some(lambda n: n["tag"].isin("nav", "ol", "ul") & _attr(n, "aria-label").rlike(r"(?i)bread\s*crumb|migas|ruta")) | _named("breadcrumb") | _some(lambda n: _attr(n, "class").rlike("(?i)miga"))
    rows = scores.kinds(pages.withColumn("_trail", trail))
    kind = F.col("kind")
    owed = {
        "Organization": (PUBLISHED_BY, F.lit(True)), "WebSite": (("WebSite",), F.when(kind == "homepage", True)), "Article": (ARTICLE_TYPES, kind == "article"),
        "Product": (PRODUCT_TYPES, F.when(kind == "product", True)), "BreadcrumbList": (("BreadcrumbList",), ~F.col("is_root") & (F.col("_trail") | (F.col("depth") >= 2))),
    }
    has = lambda types: F.arrays_overlap("types", F.array(*map(F.lit, types)))
    state = lambda types, owes: F.when(owes & has(types), "present").when(owes, "missing").when(~owes, "exempt")
    each = [F.struct(F.lit(label).alias("label"), state(types, owes).alias("state")) for label, (types, owes) in owed.items()]
    return rows.select("page_id", F.inline(F.array(*each))).where("state IS NOT NULL")


def publishing_entities(pages: DataFrame) -> DataFrame:
    """page_id, name, source (schema, og, title): who publishes a page by the best source that names it; null if none does.

    The JSON-LD's organisations come before its persons, then the site's name in the head, then the title up to its first bar or
    dash."""
    text = lambda json: F.trim(F.coalesce(scores._string(json), F.lit("")))
    first = lambda kind: F.nullif(text(_node(kind)["name"]), F.lit(""))
    schema = F.coalesce(*[first(kind) for kind in NAMED_BY])
    site = F.get(F.filter("nodes", lambda n: (n["tag"] == "meta") & (F.lower(_attr(n, "property")) == "og:site_name") & (F.trim(_attr(n, "content")) != "")), 0)
    title = F.trim(F.regexp_replace(F.trim(dom.text(F.get(dom.elements("title"), 0))), r"\s*[|–—-]\s*.+$", ""))
    named = F.coalesce(schema, F.trim(_attr(site, "content")), F.nullif(title, F.lit("")))
    source = F.when(schema.isNotNull(), "schema").when(site.isNotNull(), "og").when(F.coalesce(title, F.lit("")) != "", "title")
    return pages.select("page_id", named.alias("name"), source.alias("source"))


def listed_links(files: DataFrame) -> DataFrame:
    """site_id, url: the different absolute addresses that the list lines of a file link to. files: site_id, text."""
    found = F.regexp_extract_all("text", F.lit(r"(?m)^[ \t]*-[ \t]+\[.*?\]\(([^)\s]+)"), F.lit(1))
    return files.select("site_id", F.explode(F.array_distinct(F.filter(found, lambda u: u.rlike(r"(?i)^https?://")))).alias("url"))


def list_scores(files: DataFrame, audit: DataFrame) -> DataFrame:
    """site_id with scores.scored() of a site's list for language models: title, description, links, links that answer, and an
    optional section. files: site_id, text; audit: url, outcome (resolves, broken, unreachable).

    The links' points are shared by those that answered; of links that were not asked there is nothing to say, and if none
    answered, nothing was learned."""
    links = listed_links(files)
    asked = links.join(audit.groupBy("url").agg(F.min("outcome").alias("outcome")), "url", "left").groupBy("site_id").agg(
        F.count("*").alias("links"), F.count("outcome").alias("asked"), F.count_if(F.col("outcome") == "resolves").alias("resolves"), F.count_if(F.col("outcome") == "unreachable").alias("unreachable"),
    )
    text = F.coalesce("text", F.lit(""))
    line = lambda pattern: text.rlike(rf"(?m)^{pattern}")
    rows = files.select("site_id", line(r"#[^\S\r\n]+\S").alias("title"), line(r">[^\S\r\n]+\S").alias("description"), text.rlike(r"(?im)^##\s+Optional").alias("optional"))
    rows = rows.join(asked, "site_id", "left").na.fill(0, ["links", "asked", "resolves", "unreachable"]).withColumn("answered", F.col("asked") - F.col("unreachable"))
    c, points = F.col, LISTED_POINTS
    shared = F.floor(points * c("resolves") / F.nullif(c("answered"), F.lit(0)) + 0.5)
    checks = [
        scores.Check("list", "title", points, scores.passed(points, c("title"))), scores.Check("list", "description", points, scores.passed(points, c("description"))),
        scores.Check("list", "links", points, F.when(c("links") >= 3, points).when(c("links") > 0, FEW_LINKS).otherwise(0)),
        scores.Check("list", "links that answer", points, shared, applies=c("asked") > 0, answered=c("answered") > 0), scores.Check("list", "optional section", points, scores.passed(points, c("optional"))),
    ]
    return scores.scored(rows, checks, [(90, "Excellent"), (70, "Good"), (40, "Needs Improvement")], "Poor", key="site_id")
