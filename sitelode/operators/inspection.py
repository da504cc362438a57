"""Index inspections, archives, sitemaps and lists of properties: what a service says of pages, held against what pages say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelode.functions import urls

#: Words in the name of a rich result, the schema types that produce it, and whether these lead one to expect it.
RICH_RESULTS = [
    ("breadcrumb", "BreadcrumbList", True), ("product merchant", "Product ProductGroup", True), ("review", "Review AggregateRating", False), ("recipe", "Recipe", True), ("video", "VideoObject", True),
    ("event", "Event", True), ("job", "JobPosting", True), ("logo organization", "Organization Corporation OnlineStore NGO", False), ("local_business", "LocalBusiness", False),
    ("q&a q_&_a qa_page", "QAPage", True), ("profile", "ProfilePage", True), ("discussion", "DiscussionForumPosting SocialMediaPosting", True), ("dataset", "Dataset", True), ("course", "Course", True),
    ("software", "SoftwareApplication MobileApplication WebApplication", True), ("movie", "Movie", True), ("vacation", "VacationRental", True), ("math", "MathSolver", True),
]
RETIRED = ("FAQPage", "HowTo")
#: Endings of addresses that are pages.
PAGE_ENDINGS = ("html", "htm", "shtml", "php", "asp", "aspx", "jsp", "cfm")


def canonical_disagrees(google: Column, user: Column) -> Column:
    """Both are named and differ."""
    return F.coalesce((google != "") & (user != "") & (google != user), F.lit(False))


def coverage_reasons(inspected: DataFrame) -> DataFrame:
    """reason, pages, first_page of pages that are not reported as indexed, the commonest reason first. inspected: page,
    verdict, coverage."""
    rows = inspected.where(F.coalesce("verdict", F.lit("")) != "PASS").withColumn("reason", F.coalesce("coverage", F.lit("no coverage state reported")))
    return rows.groupBy("reason").agg(F.count("*").alias("pages"), F.min("page").alias("first_page")).orderBy(F.desc("pages"), "reason")


def rich_result_index(inspected: DataFrame) -> DataFrame:
    """type, pages: how many pages each detected type (column detected, an array) was found on, the commonest first."""
    return inspected.select("page", F.explode(F.array_distinct("detected")).alias("type")).groupBy("type").agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "type")


def _producers(name: Column) -> Column:
    """The schema types that produce a rich result of this name, none if it is in no row of the table."""
    out = []
    for keywords, types, _ in RICH_RESULTS:
        hit = F.lit(False)
        for word in keywords.split():
            hit = hit | F.contains(F.lower(name), F.lit(word.replace("_", " ")))
        out.append(F.when(hit, F.array(*map(F.lit, types.split()))).otherwise(F.array().cast("array<string>")))
    return F.concat(*out)


def detection_gap(inspected: DataFrame) -> DataFrame:
    """page, kind, type: what a page declares and the service did not detect (of types that lead one to expect it, on pages
    that were crawled), what it detected and no declared type produces, detected names that are in no table, and
    retired types. inspected: page, declared, detected (arrays), crawled."""
    expected = [t for _, types, sure in RICH_RESULTS if sure for t in types.split()]
    none = F.array().cast("array<string>")
    rows = inspected.select("page", "crawled", F.array_distinct(F.coalesce("declared", none)).alias("declared"), F.array_distinct(F.coalesce("detected", none)).alias("detected"))
    produced = F.flatten(F.transform("detected", _producers))
    missed = F.filter("declared", lambda t: t.isin(expected) & ~t.isin(list(RETIRED)) & ~F.array_contains(produced, t))
    stale = F.filter("detected", lambda t: (F.size(_producers(t)) > 0) & ~F.arrays_overlap(_producers(t), F.col("declared")))
    unknown = F.filter("detected", lambda t: F.size(_producers(t)) == 0)
    named = lambda found, kind: F.transform(found, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("type")))
    every = F.concat(
        named(F.when(F.col("crawled"), missed).otherwise(none), "not detected"), named(stale, "no longer declared"), named(unknown, "unmapped"), named(F.filter("declared", lambda t: t.isin(list(RETIRED))), "retired")
    )
    return rows.select("page", F.inline(every))


def is_page_like(url: Column) -> Column:
    """An address without a query or odd characters whose last name has no ending, or a page's."""
    path = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1))
    ending = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"\.([a-z0-9]{1,5})$", 1)
    odd = path.rlike(r"""[\\"'<>{}|^`]|%22|%5c|%3c|%3e|%7b|%7d""")
    return url.rlike(r"^[a-zA-Z]+://[^/?#]+") & ~url.rlike(r"^[^#]*\?[^#]") & ~odd & ((ending == "") | ending.isin(list(PAGE_ENDINGS)))


def lost_pages(live: DataFrame, gone: DataFrame) -> DataFrame:
    """urlkey, original, last_live, died_at of pages of an archive: a page died if it was seen gone after it was last seen
    live. Both: urlkey, original, timestamp (14 digits), several captures a key."""
    last = lambda df: df.groupBy("urlkey").agg(F.max(F.struct("timestamp", "original")).alias("c"))
    alive = last(live).select("urlkey", F.col("c.original").alias("original"), F.col("c.timestamp").alias("last_live")).where(is_page_like(F.col("original")))
    dead = last(gone).select("urlkey", F.col("c.timestamp").alias("gone_at"))
    return alive.join(dead, "urlkey", "left").select("urlkey", "original", "last_live", F.when(F.col("gone_at") > F.col("last_live"), F.col("gone_at")).alias("died_at"))


def sitemap_health(entries: DataFrame, stamped_minutes: int = 5, stamped_share: float = 0.8) -> DataFrame:
    """host and what its sitemap's dates look like. entries: host, lastmod (text), fetched_at. Counts of urls, dated, missing,
    malformed and future ones (a day ahead), how many different dates, and whether all carry one date or most the time at
    which they were fetched."""
    shaped = F.col("lastmod").rlike(r"^\d{4}(?:-\d{2}(?:-\d{2})?)?(?:T.+)?$")
    at = F.when(shaped, F.try_to_timestamp("lastmod"))
    absent = F.coalesce("lastmod", F.lit("")) == ""
    near = F.abs(F.unix_timestamp("at") - F.unix_timestamp("fetched_at")) <= stamped_minutes * 60
    stamped = F.when(F.contains("lastmod", F.lit("T")), near).otherwise(F.to_date("at") == F.to_date("fetched_at"))
    rows = entries.withColumn("at", at)
    t = rows.groupBy("host").agg(
        F.count("*").alias("urls"), F.count("at").alias("dated"), F.count_if(absent).alias("missing"), F.count_if(~absent & F.col("at").isNull()).alias("malformed"),
        F.count_if(F.unix_timestamp("at") - F.unix_timestamp("fetched_at") > 86_400).alias("future"), F.count_distinct(F.when(F.col("at").isNotNull(), F.col("lastmod"))).alias("dates"), F.count_if(F.col("at").isNotNull() & stamped).alias("stamped"),
    )
    several = F.col("dated") >= 2
    return t.withColumns({"one_date": several & (F.col("dates") == 1), "generated": several & (F.col("stamped") / F.col("dated") >= stamped_share)})


def match_property(asked: DataFrame, properties: DataFrame) -> DataFrame:
    """input, property. An input that is formatted as a property is one; another is matched by domain (the last two labels of
    its host), a domain property before others, then in the order of the list. asked: input; properties: property, position."""
    domain = lambda host: F.concat_ws(".", F.slice(F.split(host, r"\."), -2, 2))
    of = lambda c: F.when(urls.host_key(c).isNotNull(), domain(urls.host_key(c)))
    formatted = F.col("input").rlike(r"^(?:sc-domain:.+|https?://.+/)$")
    rank = F.row_number().over(Window.partitionBy("domain").orderBy(F.col("property").startswith("sc-domain:").desc(), "position"))
    best = properties.withColumn("domain", of("property")).where("domain IS NOT NULL").withColumn("rank", rank).where("rank = 1").select("domain", "property")
    return asked.withColumn("domain", of("input")).join(best, "domain", "left").select("input", F.when(formatted, F.col("input")).otherwise(F.col("property")).alias("property"))


def by_account(properties: DataFrame) -> DataFrame:
    """account, properties (names in order), n. A missing account is labelled."""
    return properties.groupBy(F.coalesce("account", F.lit("(no account)")).alias("account")).agg(F.array_sort(F.collect_list("name")).alias("properties"), F.count("*").alias("n"))


def search_fields(fields: DataFrame, term: str | None, shown: int = 40) -> DataFrame:
    """Fields whose name or description holds a term in any case; the first of all, by name, without a term."""
    if not term:
        return fields.orderBy("name", "description").limit(shown)
    return fields.where(F.contains(F.lower("name"), F.lit(term.lower())) | F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lit(term.lower())))


def matching(rows: DataFrame, page: str | None = None, query: str | None = None) -> DataFrame:
    """Rows of exactly this page and query, of all where neither is given."""
    for column, value in (("page", page), ("query", query)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def report_page(rows: DataFrame, *order: Column, offset: int = 0, limit: int = 1000) -> DataFrame:
    """A page of an ordered report; the order should tell all rows apart."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_sample(entries: DataFrame, impressions: DataFrame, size: int = 10) -> DataFrame:
    """The entries of a sitemap that are shown most, then in its order. entries: url_key, position; impressions: url_key, impressions."""
    rows = entries.join(impressions, "url_key", "left").withColumn("impressions", F.coalesce("impressions", F.lit(0.0)))
    return rows.orderBy(F.desc("impressions"), "position").limit(max(1, size))
