"""Search performance: totals, opportunities and movements over rows of clicks, impressions and position.

Ratios are recomputed from sums, never averaged; without impressions they are 0,
as the totals' definition has it. A position that has no counterpart is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEASURES = ["clicks", "impressions", "ctr", "position"]


def measures() -> list[Column]:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    shown = F.sum("impressions")
    return [
        zero(F.sum("clicks")).alias("clicks"), zero(shown).alias("impressions"), zero(F.try_divide(F.sum("clicks"), shown)).alias("ctr"),
        zero(F.try_divide(F.sum(F.col("position") * F.col("impressions")), shown)).alias("position"),
    ]


def totals(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*measures())


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def quick_wins(rows: DataFrame, *keys: str, min_impressions: float = 50.0, max_ctr: float = 2.0, first: float = 4.0, last: float = 10.0, target_ctr: float = 5.0) -> DataFrame:
    """Shown often, just below the top and hardly clicked; with the clicks that a target rate would add."""
    t = totals(rows, *keys).where((F.col("impressions") >= min_impressions) & (F.col("ctr") * 100 <= max_ctr) & F.col("position").between(first, last))
    gain = F.greatest(F.lit(0).cast("bigint"), half_up(F.col("impressions") * target_ctr / 100 - F.col("clicks")))
    return t.withColumn("potential_clicks", gain.cast("bigint"))


def under_clicked(rows: DataFrame, *keys: str, min_impressions: float = 50.0, max_ctr: float = 2.0, first: float = 4.0) -> DataFrame:
    t = totals(rows, *keys)
    return t.where((F.col("impressions") >= min_impressions) & (F.col("ctr") * 100 <= max_ctr) & (F.col("position") >= first))


def cannibalization(rows: DataFrame, min_impressions: float = 10.0) -> DataFrame:
    """Queries that more than one page competes for: how many, the best position, the page with most impressions."""
    t = totals(rows, "query", "page").where(F.col("impressions") >= min_impressions)
    lead = F.min(F.struct((-F.col("impressions")).alias("i"), "page"))["page"]
    return t.groupBy("query").agg(F.count("*").alias("pages"), F.min("position").alias("best_position"), F.sum("impressions").alias("impressions"), lead.alias("lead_page")).where("pages > 1")


def compare(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Both windows by key, a null one as (none): an absent side has no clicks; the position's change is null unless both are there."""
    now, before = (df.withColumn(key, F.coalesce(F.col(key).cast("string"), F.lit("(none)"))) for df in (now, before))
    a = totals(now, key).select(key, *[F.col(c).alias(f"{c}_now") for c in MEASURES])
    b = totals(before, key).select(key, *[F.col(c).alias(f"{c}_before") for c in MEASURES])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    both = a.join(b, key, "full_outer")
    counts = {f"{c}_{w}": zero(F.col(f"{c}_{w}")) for c in ("clicks", "impressions") for w in ("now", "before")}
    return both.withColumn("position_change", F.col("position_now") - F.col("position_before")).withColumns(counts).select(
        key, *counts, (F.col("clicks_now") - F.col("clicks_before")).alias("clicks_change"), (F.col("impressions_now") - F.col("impressions_before")).alias("impressions_change"), "position_change"
    )


def lost(movements: DataFrame, min_before: float = 20.0) -> DataFrame:
    return movements.where((F.col("impressions_before") >= min_before) & (F.col("impressions_now") == 0))


def movers(movements: DataFrame, min_clicks: float = 5.0) -> DataFrame:
    return movements.where((F.greatest("clicks_now", "clicks_before") >= min_clicks) & (F.col("clicks_change") != 0))


def trends(movements: DataFrame, key: str, each: int = 15) -> DataFrame:
    """The largest rises and falls, so many of each."""
    m = movers(movements).withColumn("direction", F.when(F.col("clicks_change") > 0, "up").otherwise("down"))
    rank = F.row_number().over(Window.partitionBy("direction").orderBy(F.abs("clicks_change").desc(), key))
    return m.withColumn("rank", rank).where(F.col("rank") <= each)


def anomalies(rows: DataFrame, threshold: float = 2.0, min_days: int = 14) -> DataFrame:
    """Days whose clicks are far from the mean, by the population's deviation. The statistics are one row, joined to the days."""
    days = totals(rows, "date")
    stats = days.agg(F.avg("clicks").alias("mean"), F.stddev_pop("clicks").alias("sd"), F.count("*").alias("days"))
    z = (F.col("clicks") - F.col("mean")) / F.col("sd")
    return days.crossJoin(F.broadcast(stats)).where((F.col("days") >= min_days) & (F.col("sd") > 0)).withColumn("z", z).where(F.abs("z") >= threshold).select("date", "clicks", "mean", "z")


def is_branded(query: Column, terms: list[str]) -> Column:
    quoted = [F.lower(query).rlike(r"(^|[^a-z0-9])\Q" + t.lower() + r"\E([^a-z0-9]|$)") for t in terms]
    out = F.lit(False)
    for q in quoted:
        out = out | q
    return out


def branded_split(rows: DataFrame, terms: list[str]) -> DataFrame:
    """Totals and number of queries for branded and other queries; both rows are always there."""
    t = totals(rows.withColumn("branded", is_branded(F.col("query"), terms)), "branded", "query")
    per = t.groupBy("branded").agg(F.count("*").alias("queries"), *measures())
    both = rows.sparkSession.createDataFrame([(True,), (False,)], "branded boolean")
    return F.broadcast(both).join(per, "branded", "left").na.fill(0).select("branded", "queries", *MEASURES)


def segment_shares(rows: DataFrame, key: str) -> DataFrame:
    """Each segment's share of impressions, and its click rate against the whole's; segments never shown are dropped."""
    t = totals(rows, key).where("impressions > 0")
    whole = rows.agg(F.sum("impressions").alias("all_i"), F.try_divide(F.sum("clicks"), F.sum("impressions")).alias("all_ctr"))
    joined = t.crossJoin(F.broadcast(whole))
    ratio = F.coalesce(F.try_divide("ctr", "all_ctr"), F.lit(0.0))
    return joined.select(key, *MEASURES, (F.col("impressions") / F.col("all_i")).alias("share"), ratio.alias("ctr_ratio"))


def weak_segments(rows: DataFrame, key: str, max_ratio: float = 0.7, min_share: float = 0.1, inclusive: bool = False) -> DataFrame:
    """Segments that are shown enough and clicked too little; inclusive: a share of exactly min_share counts."""
    s = segment_shares(rows, key)
    enough = F.col("share") >= min_share if inclusive else F.col("share") > min_share
    return s.where((F.col("ctr_ratio") > 0) & (F.col("ctr_ratio") < max_ratio) & enough)


def featured_snippets(rows: DataFrame, *keys: str, holder_ctr: float = 0.35, contender_ctr: float = 0.08, min_impressions: float = 100.0) -> DataFrame:
    t = totals(rows, *keys)
    holder = (F.col("position") <= 1.5) & (F.col("ctr") >= holder_ctr)
    contender = (F.col("position") > 1.5) & (F.col("position") <= 5) & (F.col("ctr") <= contender_ctr) & (F.col("impressions") >= min_impressions)
    return t.withColumn("role", F.when(holder, "holder").when(contender, "contender")).where("role IS NOT NULL")


def busiest(rows: DataFrame, by: str = "clicks", sample: int = 25) -> DataFrame:
    """The busiest pages by one measure, then the other, then their address; pages without any are no candidates."""
    other = "impressions" if by == "clicks" else "clicks"
    t = totals(rows.where("page IS NOT NULL"), "page").where(F.col(by) > 0)
    return t.orderBy(F.desc(by), F.desc(other), "page").limit(max(1, sample))


def page_query_map(rows: DataFrame, top: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("clicks"), F.desc("impressions"), "query"))
    return totals(rows, "page", "query").withColumn("rank", rank).where(F.col("rank") <= top)


def appearance_gap(rows: DataFrame, watched: list[str]) -> DataFrame:
    """Watched appearances of which none is present whose first word contains theirs. Each appearance is held against the
    short list where it is read, so only the matches are joined."""
    first = lambda c: F.lower(F.substring_index(c, " ", 1))
    watch = rows.sparkSession.createDataFrame([(w,) for w in watched], "appearance string")
    names = F.filter(F.array(*map(F.lit, watched)), lambda w: F.contains(first("appearance"), first(w)))
    present = totals(rows, "appearance").where("impressions > 0").select(F.explode(names).alias("appearance")).distinct()
    return watch.join(present, "appearance", "left_anti")


def health(rows: DataFrame, properties: DataFrame, key: str) -> DataFrame:
    """Each property's totals and state: unverified properties have no data, silent ones no impressions."""
    t = properties.join(totals(rows, key), key, "left")
    state = F.when(~F.col("verified"), "unverified").when(F.coalesce("impressions", F.lit(0.0)) == 0, "silent").otherwise("active")
    shown = [F.when(F.col("verified"), F.coalesce(c, F.lit(0.0))).alias(c) for c in ("clicks", "impressions")]
    return t.select(key, state.alias("state"), *shown)


def monthly_clicks(rows: DataFrame, months: list[str]) -> DataFrame:
    """Clicks by page and month (YYYY-MM); a month without rows is 0."""
    m = rows.withColumn("month", F.date_format("date", "yyyy-MM"))
    return m.groupBy("page").pivot("month", months).agg(F.sum("clicks")).na.fill(0.0)
