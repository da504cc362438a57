"""Readers of what services answer: archives, sitemaps, reports, field vitals and page views, each a body of text a row.

A body that can't be read gives no rows; fields of another kind than they should be are null. Everything is done by
expressions on the body, but sitemap indexes, whose files are joined level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The rated metrics of field vitals by their names in answers, and how deep sitemap indexes are followed.
METRICS = {"largest_contentful_paint": "lcp", "interaction_to_next_paint": "inp", "cumulative_layout_shift": "cls", "first_contentful_paint": "fcp", "experimental_time_to_first_byte": "ttfb"}
DEEPEST = 3


def captures(answers: DataFrame, key: str, body: str = "body") -> DataFrame:
    """key and the captures of an archive's answers, whose first row names the columns in any order. Rows without a time of 14
    digits are dropped; a status or length that is no number is null."""
    rows = answers.select(key, F.from_json(body, "array<array<string>>").alias("r")).where(F.size("r") > 1)
    rows = rows.select(key, F.col("r")[0].alias("header"), F.explode(F.slice("r", 2, F.size("r"))).alias("row"))
    at = lambda name: F.coalesce(F.get("row", F.when(F.array_position("header", name) > 0, F.array_position("header", name).cast("int") - 1).otherwise(-1)), F.lit(""))
    number = lambda name: F.when(at(name).rlike(r"^\d+$"), at(name).cast("long"))
    out = rows.select(key, at("urlkey").alias("urlkey"), at("timestamp").alias("timestamp"), at("original").alias("original"), at("mimetype").alias("mimetype"), number("statuscode").alias("status"), at("digest").alias("digest"), number("length").alias("length"))
    return out.where(F.col("timestamp").rlike(r"^\d{14}$"))


def versions(rows: DataFrame, key: str) -> DataFrame:
    """Captures whose content differs from that of the capture before."""
    w = Window.partitionBy(key).orderBy("timestamp", "digest")
    return rows.withColumn("_last", F.lag("digest").over(w)).where(~F.col("digest").eqNullSafe(F.col("_last"))).drop("_last")


def sitemap_entries(files: DataFrame, roots: DataFrame) -> DataFrame:
    """loc, lastmod, sitemap: each address once, from the first file that has it, starting at the roots. files: url, body; roots: url.

    Indexes are followed three levels deep; files that are neither an index nor a list give nothing."""
    inside = lambda tag: F.regexp_extract_all("body", F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    field = lambda x, tag: F.trim(F.regexp_extract(x, rf"(?s)<{tag}>(.*?)</{tag}>", 1))
    known = files.select("url", F.when(F.contains("body", F.lit("<sitemapindex")), F.transform(inside("sitemap"), lambda x: field(x, "loc"))).alias("children"), F.when(F.contains("body", F.lit("<urlset")) & ~F.contains("body", F.lit("<sitemapindex")), inside("url")).alias("entries"))
    level, found = roots.select("url").distinct(), []
    for depth in range(DEEPEST + 1):
        read = level.join(known, "url")
        found.append(read.select(F.lit(depth).alias("depth"), "url", "entries"))
        level = read.select(F.explode("children").alias("url")).where("url <> ''").distinct()
    rows = reduce(DataFrame.unionByName, found).select("depth", F.col("url").alias("sitemap"), F.posexplode("entries").alias("at", "x"))
    rows = rows.select("depth", "sitemap", "at", field(F.col("x"), "loc").alias("loc"), field(F.col("x"), "lastmod").alias("lastmod")).where("loc <> ''")
    first = rows.groupBy("loc").agg(F.min_by(F.struct("lastmod", "sitemap"), F.struct("depth", "sitemap", "at")).alias("f"))
    return first.select("loc", F.when(F.col("f.lastmod") != "", F.col("f.lastmod")).alias("lastmod"), "f.sitemap")


_REPORT = (
    "dimensionHeaders array<struct<name:string>>, metricHeaders array<struct<name:string>>, rows array<struct<dimensionValues:array<struct<value:string>>,metricValues:array<struct<value:string>>>>, rowCount long, "
    "totals array<struct<metricValues:array<struct<value:string>>>>, metadata struct<dataLossFromOtherRow:boolean,samplingMetadatas:array<string>,subjectToThresholding:boolean,dataTruncationReasons:array<string>,emptyReason:string>"
)


def _report(answers: DataFrame, key: str, body: str) -> DataFrame:
    return answers.select(key, F.from_json(body, _REPORT).alias("r"))


def report_rows(answers: DataFrame, key: str, body: str = "body") -> DataFrame:
    """key, at, dimensions and metrics (maps by name) of each row of a report; a metric that is no number is 0."""
    number = lambda v: F.coalesce(v.try_cast("double"), F.lit(0.0))
    names = lambda headers: F.transform(headers, lambda h: F.coalesce(h["name"], F.lit("")))
    rows = _report(answers, key, body).select(key, names("r.dimensionHeaders").alias("d"), names("r.metricHeaders").alias("m"), F.posexplode("r.rows").alias("at", "row"))
    values = F.transform("row.metricValues", lambda v: number(v["value"]))
    return rows.select(key, "at", F.map_from_arrays("d", F.transform("row.dimensionValues", lambda v: F.coalesce(v["value"], F.lit("")))).alias("dimensions"), F.map_from_arrays("m", values).alias("metrics"))


def report_caveats(answers: DataFrame, key: str, body: str = "body") -> DataFrame:
    """key, rows, row_count and what a report leaves out: more rows than came back, an (other) row, samples, thresholds, cut
    windows, and why it is empty."""
    r = F.col("r")
    n = F.coalesce(F.size(r["rows"]), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    total = F.coalesce(r["rowCount"], n.cast("long"))
    meta = r["metadata"]
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    found = F.array(
        F.when(total > n, "truncated"), F.when(meta["dataLossFromOtherRow"], "other row"), F.when(some(meta["samplingMetadatas"]), "sampled"), F.when(meta["subjectToThresholding"], "thresholded"),
        F.when(some(meta["dataTruncationReasons"]), "window cut"), F.when((F.coalesce(meta["emptyReason"], F.lit("")) != "") & (n == 0), F.concat(F.lit("empty: "), meta["emptyReason"])),
    )
    return _report(answers, key, body).where(r.isNotNull()).select(key, n.alias("rows"), total.alias("row_count"), F.array_compact(found).alias("caveats"))


def field_vitals(answers: DataFrame, key: str, body: str = "body") -> DataFrame:
    """key, metric, p75, good, middling, poor: a row per rated metric that an answer's record has. Numbers may come as text."""
    kind = "map<string,struct<percentiles:struct<p75:string>,histogram:array<struct<density:string>>>>"
    rows = answers.select(key, F.from_json(body, f"record struct<metrics:{kind}>").alias("a")).select(key, F.explode("a.record.metrics").alias("name", "v"))
    name = F.create_map(*[F.lit(x) for pair in METRICS.items() for x in pair])[F.col("name")]
    number = lambda c: c.try_cast("double")
    share = lambda i: number(F.get("v.histogram", F.lit(i))["density"])
    return rows.select(key, name.alias("metric"), number(F.col("v.percentiles.p75")).alias("p75"), share(0).alias("good"), share(1).alias("middling"), share(2).alias("poor")).where("metric IS NOT NULL")


def pageviews(answers: DataFrame, key: str, body: str = "body") -> DataFrame:
    """key, month, views: items with a time of another shape or negative views are dropped."""
    rows = answers.select(key, F.from_json(body, "items array<struct<timestamp:string,views:double>>").alias("a")).select(key, F.inline("a.items"))
    stamp: Column = F.col("timestamp")
    return rows.where(stamp.rlike(r"^\d{8,10}$") & (F.col("views") >= 0)).select(key, F.concat_ws("-", F.substring(stamp, 1, 4), F.substring(stamp, 5, 2)).alias("month"), "views")


def addresses(rows: DataFrame, key: str, status: int | None = None, mimetype: str | None = None, limit: int = 1000) -> DataFrame:
    """Of an archive's captures the first of each address, by its key in the archive, in the order of those keys; `limit` of them an
    answer, as the archive itself gives. Captures of another status or kind are left out before."""
    for column, value in (("status", status), ("mimetype", mimetype)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    first = rows.groupBy(key, "urlkey").agg(F.min(F.struct("timestamp", "original", "digest")).alias("f")).select(key, "urlkey", "f.*")
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("urlkey"))).where(F.col("_n") <= limit).drop("_n")


def report_totals(answers: DataFrame, key: str, body: str = "body") -> DataFrame:
    """key, metric, total: what a report says its metrics sum up to over all rows, also those that it left out; null if that is no
    number. Reports that were not asked for totals have none."""
    r = _report(answers, key, body).select(key, F.transform("r.metricHeaders", lambda h: F.coalesce(h["name"], F.lit(""))).alias("m"), F.get("r.totals", F.lit(0))["metricValues"].alias("t"))
    return r.select(key, F.posexplode("m").alias("at", "metric"), "t").where(F.col("t").isNotNull()).select(key, "metric", F.get("t", F.col("at"))["value"].try_cast("double").alias("total"))


def vitals_history(answers: DataFrame, key: str, body: str = "body") -> DataFrame:
    """key, metric, at, period_end, p75, good: a row per rated metric and collection period. Gaps are null, as are numbers that are none;
    a period that states no day has no end."""
    kind = "map<string,struct<percentilesTimeseries:struct<p75s:array<string>>,histogramTimeseries:array<struct<densities:array<string>>>>>"
    rows = answers.select(key, F.from_json(body, f"record struct<collectionPeriods:array<struct<lastDate:struct<year:int,month:int,day:int>>>,metrics:{kind}>").alias("a"))
    rows = rows.select(key, F.col("a.record.collectionPeriods").alias("periods"), F.explode("a.record.metrics").alias("name", "v"))
    name = F.create_map(*[F.lit(x) for pair in METRICS.items() for x in pair])[F.col("name")]
    number = lambda c: F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))
    good = F.get("v.histogramTimeseries", F.lit(0))["densities"]
    longest = F.greatest(F.coalesce(F.size("v.percentilesTimeseries.p75s"), F.lit(0)), F.coalesce(F.size(good), F.lit(0)))
    at = rows.select(key, name.alias("metric"), "periods", "v", good.alias("good"), F.explode(F.when(longest > 0, F.sequence(F.lit(0), longest - 1))).alias("at")).where("metric IS NOT NULL")
    last = F.get("periods", F.col("at"))["lastDate"]
    return at.select(key, "metric", "at", F.format_string("%04d-%02d-%02d", last["year"], last["month"], last["day"]).try_cast("date").alias("period_end"), number(F.get("v.percentilesTimeseries.p75s", F.col("at"))).alias("p75"), number(F.get("good", F.col("at"))).alias("good"))


_SCORE = "open_page_rank double, found boolean, rank double, referring_domains double"
_SCORES = f"as_of string, results array<struct<domain:string,{_SCORE.replace(', ', ',').replace(' ', ':')},history:array<struct<date:string,open_page_rank:double,estimated:boolean>>>>"


def _scale(score: Column) -> Column:
    """A score from 0 to 10, null for anything else."""
    return F.when(score.between(0, 10), score)


def domain_scores(answers: DataFrame, key: str, body: str = "body") -> DataFrame:
    """key, as_of, domain, found, score, rank, referring_domains: a row per domain of an answer. A domain is found only with a score."""
    rows = answers.select(key, F.from_json(body, _SCORES).alias("a")).select(key, "a.as_of", F.explode("a.results").alias("r")).where("r.domain IS NOT NULL")
    score, count = _scale(F.col("r.open_page_rank")), lambda c: F.when(F.col(f"r.{c}") >= 0, F.col(f"r.{c}").cast("long"))
    return rows.select(key, "as_of", F.lower("r.domain").alias("domain"), F.coalesce(F.col("r.found") & score.isNotNull(), F.lit(False)).alias("found"), score.alias("score"), count("rank").alias("rank"), count("referring_domains").alias("referring_domains"))


def domain_score_history(answers: DataFrame, key: str, body: str = "body") -> DataFrame:
    """key, domain, date, score, estimated: the points of a domain's history that have a score."""
    rows = answers.select(key, F.from_json(body, _SCORES).alias("a")).select(key, F.explode("a.results").alias("r")).where("r.domain IS NOT NULL").select(key, F.lower("r.domain").alias("domain"), F.explode("r.history").alias("h"))
    return rows.select(key, "domain", "h.date", _scale(F.col("h.open_page_rank")).alias("score"), F.coalesce("h.estimated", F.lit(False)).alias("estimated")).where("date IS NOT NULL AND score IS NOT NULL")


def entities(answers: DataFrame, key: str, body: str = "body") -> DataFrame:
    """key, place, name, type, salience, mentions (different texts, as they come), proper (whether one of them is a name): what a
    language service found in a text. Entities without a name or a salience are left out."""
    kind = "entities array<struct<name:string,type:string,salience:double,mentions:array<struct<text:struct<content:string>,type:string>>>>"
    rows = answers.select(key, F.from_json(body, kind).alias("a")).select(key, F.posexplode("a.entities").alias("place", "e"))
    said = F.filter(F.transform("e.mentions", lambda m: m["text"]["content"]), lambda t: F.trim(t) != "")
    proper = F.coalesce(F.exists("e.mentions", lambda m: F.coalesce(m["type"] == "PROPER", F.lit(False))), F.lit(False))
    rows = rows.select(key, "place", F.trim("e.name").alias("name"), F.coalesce("e.type", F.lit("UNKNOWN")).alias("type"), F.col("e.salience").alias("salience"), F.coalesce(F.array_distinct(said), F.array().cast("array<string>")).alias("mentions"), proper.alias("proper"))
    return rows.where((F.col("name") != "") & F.col("salience").isNotNull() & ~F.isnan("salience"))


#: Where a site's sitemaps are looked for, the first that names any deciding.
ROOT_SOURCES = ("argument", "search-console", "robots.txt", "convention")


def sitemap_roots(origins: DataFrame, named: DataFrame) -> DataFrame:
    """origin, url, source: the sitemaps to begin with. origins: origin; named: origin, url, source, one of the first three of
    ROOT_SOURCES. Without any a site has the file that convention puts at its root."""
    rank = F.array_position(F.array(*map(F.lit, ROOT_SOURCES)), F.col("source"))
    known = named.where(F.col("url").isNotNull() & (F.col("url") != "") & (rank > 0)).select("origin", "url", "source", rank.alias("rank")).distinct()
    best = known.groupBy("origin").agg(F.min("rank").alias("rank"))
    rows = origins.distinct().join(best, "origin", "left").join(known, ["origin", "rank"], "left")
    convention = F.concat(F.regexp_replace("origin", "/+$", ""), F.lit("/sitemap.xml"))
    return rows.select("origin", F.coalesce("url", convention).alias("url"), F.coalesce("source", F.lit("convention")).alias("source"))


def field_source(pages: DataFrame, records: DataFrame, lab: DataFrame) -> DataFrame:
    """url, source (record, lab, none), p75: where a page's field data come from. records: url, state (record, no-data, refused), p75;
    lab: url, p75 of the field data that came with a lab run.

    The record service decides: only where it refused to answer does the lab run's copy stand in."""
    rows = pages.select("url").distinct().join(records, "url", "left").join(lab.select("url", F.col("p75").alias("_lab")), "url", "left")
    source = F.when(F.col("state") == "record", "record").when((F.col("state") == "refused") & F.col("_lab").isNotNull(), "lab").otherwise("none")
    return rows.select("url", source.alias("source"), F.when(source == "record", F.col("p75")).when(source == "lab", F.col("_lab")).alias("p75"))
