"""Joins across sources on normalised keys: search with analytics, crawl with sitemap, and as-of and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelode.functions import text, urls


def page_join(search: DataFrame, landings: DataFrame) -> DataFrame:
    """search: page, clicks, impressions, position; landings: landing_page, sessions, engaged, key_events.

    One row per bucket entry: joined, search_only, ambiguous (a path on several hosts is shown per host, joins to nothing
    and still claims the analytics row), analytics_only, and the unreadable of both sides."""
    s = search.withColumns({"path": urls.path_key("page"), "host": urls.host_key("page")})
    weighted = F.sum(F.col("position") * F.col("impressions"))
    sums = [F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.coalesce(F.try_divide(weighted, F.sum("impressions")), F.lit(0.0)).alias("position")]
    readable = s.where("path IS NOT NULL")
    per_path = readable.groupBy("path").agg(F.count_distinct("host").alias("hosts"), *sums)
    lands = landings.withColumn("path", urls.path_key("landing_page"))
    measures = [F.sum(c).alias(c) for c in ("sessions", "engaged", "key_events")]
    per_landing = lands.where("path IS NOT NULL").groupBy("path").agg(*measures)
    both = per_path.join(per_landing, "path", "full_outer")
    bucket = F.when(F.col("hosts").isNull(), "analytics_only").when(F.col("hosts") > 1, "ambiguous").when(F.col("sessions").isNull(), "search_only").otherwise("joined")
    rows = both.withColumn("bucket", bucket)
    rate = F.when(F.col("bucket") == "joined", F.coalesce(F.try_divide("engaged", "sessions"), F.lit(0.0))).alias("engagement_rate")
    columns = ["bucket", "path", "host", "clicks", "impressions", "position", "sessions", "engaged", "key_events"]
    plain = rows.where("bucket <> 'ambiguous'").withColumn("host", F.lit(None).cast("string")).select(*columns, rate)
    per_host = readable.groupBy("path", "host").agg(*sums)
    unclear = per_host.join(rows.where("bucket = 'ambiguous'").select("path"), "path").select(
        F.lit("ambiguous").alias("bucket"), "path", "host", "clicks", "impressions", "position", *[F.lit(None).cast("double").alias(c) for c in ("sessions", "engaged", "key_events", "engagement_rate")]
    )
    lost_search = s.where("path IS NULL").groupBy().agg(F.lit("unreadable_search").alias("bucket"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions")).where("clicks IS NOT NULL")
    lost_lands = lands.where("path IS NULL").groupBy().agg(F.lit("unreadable_landings").alias("bucket"), *measures).where("sessions IS NOT NULL")
    return plain.unionByName(unclear).unionByName(lost_search, allowMissingColumns=True).unionByName(lost_lands, allowMissingColumns=True)


def clicks_without_value(joined: DataFrame, min_clicks: float = 20.0, max_rate: float = 0.3) -> DataFrame:
    """Pages that search sends people to who neither stay nor do what counts: hardly engaged, or without any key event."""
    rows = joined.where("bucket = 'joined'")
    return rows.where((F.col("clicks") >= min_clicks) & ((F.col("engagement_rate") < max_rate) | (F.col("key_events") == 0)))


def value_without_reach(joined: DataFrame) -> DataFrame:
    """Pages with key events whose clicks are below the median of all joined pages. Pages are counted by clicks first, so the
    median is taken over different numbers with their frequency."""
    rows = joined.where("bucket = 'joined'")
    counts = rows.where("clicks IS NOT NULL").groupBy("clicks").agg(F.count("*").alias("n"))
    return rows.crossJoin(F.broadcast(counts.agg(F.percentile("clicks", 0.5, F.col("n")).alias("median_clicks")))).where((F.col("key_events") > 0) & (F.col("clicks") < F.col("median_clicks")))


def orphans(search: DataFrame, crawled: DataFrame, key: str = "url_key") -> DataFrame:
    """Pages with impressions that the crawl of their own host neither fetched nor saw a link to."""
    rows = search.where("impressions > 0").join(crawled.select("host_key").distinct(), "host_key", "left_semi")
    return rows.join(crawled.select(key).distinct(), key, "left_anti")


def zombies(sitemap: DataFrame, crawled: DataFrame, search: DataFrame, key: str = "url_key") -> DataFrame:
    """What a sitemap or the crawl expects to be shown and no search row has. crawled: status, noindex, canonical_key."""
    expects = (F.col("status") < 400) & ~F.col("noindex") & (F.col("canonical_key").isNull() | (F.col("canonical_key") == F.col(key)))
    wanted = sitemap.select(key).union(crawled.where(expects).select(key)).distinct()
    return wanted.join(search.select(key).distinct(), key, "left_anti")


def overlap(sitemap: DataFrame, crawled: DataFrame, key: str = "url_key") -> DataFrame:
    a = sitemap.select(key).distinct().withColumn("s", F.lit(1))
    b = crawled.select(key).distinct().withColumn("c", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.agg(F.count_if(F.col("s").isNotNull() & F.col("c").isNotNull()).alias("in_both"), F.count_if(F.col("c").isNull()).alias("sitemap_only"), F.count_if(F.col("s").isNull()).alias("crawl_only"))


def landing_groups(ai: DataFrame, organic: DataFrame, key: str = "url_key", top: int = 10) -> DataFrame:
    """The landings of either group with most sessions; organic ones are compared without those that AI visitors use."""
    a = ai.groupBy(key).agg(F.sum("sessions").alias("sessions"))
    o = organic.groupBy(key).agg(F.sum("sessions").alias("sessions")).join(a.select(key), key, "left_anti")
    pick = lambda df, name: df.orderBy(F.desc("sessions"), key).limit(top).withColumn("group", F.lit(name))
    return pick(a, "ai").unionByName(pick(o, "organic"))


def _suffixes(host: Column) -> Column:
    """A host and all domains above it."""
    parts = F.split(F.lower(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def crawler_risk(operators: DataFrame, sources: DataFrame) -> DataFrame:
    """operators: assistant, host, blocked; sources: source, sessions. Sessions by assistant, at risk where its crawler is
    blocked and there are any; sources of no assistant are a row of their own. A source belongs to the operators of its
    host and of any domain above it: its suffixes are hash-joined, and only what they add up to is kept."""
    per_source = sources.groupBy("source").agg(F.sum("sessions").alias("sessions"))
    names = operators.select("assistant", F.lower("host").alias("host"), "blocked")
    hits = per_source.select("source", "sessions", F.explode(_suffixes(F.col("source"))).alias("host")).join(names, "host")
    known = names.groupBy("assistant", "blocked").agg(F.count("*").alias("_n")).drop("_n")
    per_assistant = hits.groupBy("assistant", "blocked").agg(F.sum("sessions").alias("sessions"))
    same = known["assistant"].eqNullSafe(per_assistant["assistant"]) & known["blocked"].eqNullSafe(per_assistant["blocked"])
    rows = known.join(per_assistant, same, "left").select(known["assistant"], known["blocked"], F.coalesce("sessions", F.lit(0)).alias("sessions"))
    other = per_source.join(hits.select("source").distinct(), "source", "left_anti").agg(F.sum("sessions").alias("sessions"))
    rows = rows.unionByName(other.where("sessions IS NOT NULL").select(F.lit(None).cast("string").alias("assistant"), F.lit(None).cast("boolean").alias("blocked"), "sessions"))
    return rows.withColumn("at_risk", F.col("blocked") & (F.col("sessions") > 0))


#: What a date of a sitemap may look like: a year, a month or a day, and after these a time.
LASTMOD = r"^\d{4}(?:-\d{2}(?:-\d{2})?)?(?:T.+)?$"


def lastmod(sitemap: DataFrame, search: DataFrame, crawls: DataFrame, key: str = "url_key") -> DataFrame:
    """sitemap: key, lastmod (text); crawls: key, crawled_at. Compared by day where lastmod is a day, else by instant; dates
    of another shape are malformed, even those that a cast would read."""
    by_day = ~F.contains("lastmod", F.lit("T"))
    stamp = F.when(F.col("lastmod").rlike(LASTMOD), F.try_to_timestamp("lastmod"))
    later = F.when(by_day, F.to_date(stamp) > F.to_date("crawled_at")).otherwise(stamp > F.col("crawled_at"))
    state = F.when(F.col("crawled_at").isNull(), "never crawled").when(stamp.isNull(), "malformed").when(later, "pending").otherwise("consistent")
    rows = sitemap.join(search, key, "left").join(crawls, key, "left")
    return rows.select(key, "lastmod", F.col("impressions"), "crawled_at", state.alias("state"))


#: The ceilings under which a vital is good, in milliseconds and as a score.
GOOD = {"lcp": 2500.0, "inp": 200.0, "cls": 0.1}


def vitals_by_traffic(search: DataFrame, page_vitals: DataFrame, origin_vitals: DataFrame) -> DataFrame:
    """search plus basis, lcp, inp, cls, distance, impact. search: url_key, host_key, clicks; vitals: a key, lcp, inp, cls.

    distance is how far a page's own vitals are above their ceilings, each as a share of its ceiling, summed; one without a
    reading adds nothing. impact, clicks times distance, is null where there is nothing to rank: for pages that are above
    none, for an origin's vitals, which only stand in, and where nothing was measured."""
    own = page_vitals.select("url_key", F.struct(*GOOD).alias("own"))
    whole = origin_vitals.select("host_key", F.struct(*GOOD).alias("whole"))
    rows = search.join(own, "url_key", "left").join(whole, "host_key", "left")
    basis = F.when(F.col("own").isNotNull(), "page").when(F.col("whole").isNotNull(), "origin").otherwise("not measured")
    excess = [F.coalesce(F.greatest(F.col(f"own.{name}") / limit - 1, F.lit(0.0)), F.lit(0.0)) for name, limit in GOOD.items()]
    distance = F.when(basis == "page", sum(excess[1:], excess[0]))
    rows = rows.select("url_key", "clicks", basis.alias("basis"), F.coalesce("own", "whole").alias("v"), distance.alias("distance"))
    return rows.select("url_key", "clicks", "basis", "v.*", "distance", F.when(F.col("distance") > 0, F.col("clicks") * F.col("distance")).alias("impact"))


def overlapping(spans: DataFrame, first: str, last: str) -> DataFrame:
    """Spans that share a day with a window; those without dates are kept apart."""
    dated = F.col("start").isNotNull() & F.col("end").isNotNull()
    hit = (F.col("start") <= F.lit(last).cast("date")) & (F.col("end") >= F.lit(first).cast("date"))
    return spans.withColumn("state", F.when(~dated, "undated").when(hit, "overlaps")).where("state IS NOT NULL")


def year_ago(history: DataFrame, key: str, at: str, value: str, as_of: str) -> DataFrame:
    """The last point at or before the first day of the same month a year before."""
    target = F.add_months(F.trunc(F.lit(as_of).cast("date"), "month"), -12)
    return history.where((F.to_date(at) <= target) & F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, F.struct(at, value)).alias("score"), F.max(at).alias("at"))


def title_fit(page_queries: DataFrame, titles: DataFrame, top: int = 3) -> DataFrame:
    """page, query, rank, missing (words that the title lacks, in order) and fit of each page's most shown queries.

    page_queries: page, query, impressions; titles: page, title, lang. Queries lose the filler words of the page's language;
    a title has a word in any case, with or without accents, and in its plural. Pages of other languages have no fit."""
    rank = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("impressions"), "query"))
    rows = page_queries.withColumn("rank", rank).where(F.col("rank") <= top).join(titles, "page")
    asked = F.array_distinct(text.significant(F.col("query"), F.col("lang")))
    rows = rows.withColumns({"asked": asked, "lost": text.missing(asked, text.tokens(F.coalesce("title", F.lit(""))))})
    supported = F.col("lang").isNull() | F.lower(F.substring("lang", 1, 2)).isin(list(text.STOPWORDS))
    fit = F.when(F.size("lost") == 0, "all").when(F.size("lost") < F.size("asked"), "some").otherwise("none")
    return rows.select("page", "query", "rank", F.when(supported, F.array_join("lost", " ")).alias("missing"), F.when(supported, fit).alias("fit"))
