"""Time series: baselines, decay, runs, movements and monthly roll-ups.

A null value means that a reading was taken and gave no answer; it is skipped,
never counted as zero. Instants that matter are parameters; no operator reads the clock.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hourly_baseline(cells: DataFrame, first_incomplete: str | None = None) -> DataFrame:
    """cells: date, hour, clicks. The mean of the same hour on strictly earlier dates and the value seven days before;
    hours from first_incomplete on are partial and serve no baseline."""
    at = F.col("date").cast("timestamp") + F.make_dt_interval(hours=F.col("hour"))
    partial = at >= F.lit(first_incomplete).cast("timestamp") if first_incomplete else F.lit(False)
    rows = cells.withColumn("partial", partial).withColumn("day", F.datediff("date", F.lit("1970-01-01").cast("date")))
    whole = F.when(~F.col("partial"), F.col("clicks"))
    earlier = Window.partitionBy("hour").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    week = Window.partitionBy("hour").orderBy("day").rangeBetween(-7, -7)
    return rows.select(
        "date", "hour", "clicks", "partial", F.avg(whole).over(earlier).alias("baseline"), F.count(whole).over(earlier).alias("days"), F.max(whole).over(week).alias("week_ago")
    )


def change_shown(value: Column, baseline: Column, least: float = 10.0) -> Column:
    """Per cent against a baseline, only if that is large enough."""
    return F.when(baseline >= least, (value - baseline) / baseline * 100)


def content_decay(clicks: DataFrame, months: list[str], min_peak: float = 20.0, min_decline: float = 0.4, seasonal: float = 0.8) -> DataFrame:
    """clicks: page, month (YYYY-MM), clicks. Pages whose last three months are well below their best three in a row before.

    Of equal peaks the first counts. Against the months a year before, where there are any: at least `seasonal` of them
    is a season, less is decay, and without a counterpart it is unknown."""
    spine = clicks.sparkSession.createDataFrame([(m, i) for i, m in enumerate(months)], "month string, i int")
    n = len(months)
    pages = clicks.select("page").distinct()
    grid = pages.crossJoin(F.broadcast(spine)).join(clicks.groupBy("page", "month").agg(F.sum("clicks").alias("clicks")), ["page", "month"], "left")
    grid = grid.withColumn("clicks", F.coalesce("clicks", F.lit(0.0)))
    three = Window.partitionBy("page").orderBy("i").rowsBetween(0, 2)
    grid = grid.withColumn("mean3", F.avg("clicks").over(three))
    before = F.col("i") <= n - 6
    year_back = grid.select("page", (F.col("i") + 12).alias("i"), F.col("clicks").alias("last_year"))
    recent = F.when(F.col("i") >= n - 3, F.col("clicks"))
    rows = grid.join(year_back, ["page", "i"], "left").groupBy("page").agg(
        F.avg(recent).alias("recent"),
        F.max(F.when(before & (F.col("mean3") > 0), F.struct("mean3", (-F.col("i")).alias("back")))).alias("peak"),
        F.sum(F.when(F.col("last_year").isNotNull(), recent)).alias("now_sum"),
        F.sum(F.when(F.col("i") >= n - 3, F.col("last_year"))).alias("year_sum"),
    )
    ratio = F.try_divide("now_sum", F.when(F.col("year_sum") > 0, F.col("year_sum")))
    peak = F.col("peak.mean3")
    reading = F.when(ratio.isNull(), "unknown").when(ratio >= seasonal, "seasonal").otherwise("decay")
    return rows.where((peak >= min_peak) & ((peak - F.col("recent")) / peak >= min_decline)).select(
        "page", peak.alias("peak"), "recent", (peak - F.col("recent")).alias("lost"), F.element_at(F.array(*map(F.lit, months)), 1 - F.col("peak.back")).alias("peak_from"), reading.alias("reading")
    )


def movement(readings: DataFrame, registry: DataFrame) -> DataFrame:
    """The latest and the previous answered reading of each registered metric; improved by the metric's direction."""
    last = Window.partitionBy("site_id", "metric").orderBy(F.desc("captured_at"), F.desc("refresh_id"))
    rows = readings.where("value IS NOT NULL").join(registry, "metric").withColumn("nth", F.row_number().over(last)).where("nth <= 2")
    pair = rows.groupBy("site_id", "metric", "up_is_better").agg(F.max(F.when(F.col("nth") == 1, F.col("value"))).alias("latest"), F.max(F.when(F.col("nth") == 2, F.col("value"))).alias("previous"))
    change = F.col("latest") - F.col("previous")
    improved = F.when(change.isNotNull(), F.when(F.col("up_is_better"), change > 0).otherwise(change < 0))
    return pair.select("site_id", "metric", "latest", "previous", change.alias("change"), improved.alias("improved"))


def monthly(readings: DataFrame) -> DataFrame:
    """Last, smallest and largest answered value of a metric by site and month, and at how many instants it was read."""
    rows = readings.withColumn("month", F.date_format("captured_at", "yyyy-MM"))
    answered = F.when(F.col("value").isNotNull(), F.struct("captured_at", "refresh_id"))
    return rows.groupBy("site_id", "month", "metric").agg(
        F.max_by("value", answered).alias("last"), F.min("value").alias("min"), F.max("value").alias("max"), F.count_distinct("captured_at").alias("readings")
    )


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """The rows of both; where a key is in both, the new ones'."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    columns = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*columns), "_new").alias("row")).select(*keys, "row.*")


def runs(rows: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """Consecutive rows of one status as one row; null equals null."""
    w = Window.partitionBy(key).orderBy(*order)
    first = F.row_number().over(w) == 1
    changed = F.when(first | ~F.col(status).eqNullSafe(F.lag(status).over(w)), 1).otherwise(0)
    marked = rows.withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "run", status).agg(F.count("*").alias("length"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def last_change(rows: DataFrame, key: str, order: list[str], rating: str) -> DataFrame:
    """The newest adjacent pair of answered periods whose ratings differ."""
    w = Window.partitionBy(key).orderBy(*order)
    pairs = rows.where(F.col(rating).isNotNull()).withColumn("was", F.lag(rating).over(w)).where(F.col("was") != F.col(rating))
    latest = F.max(F.struct(*order, F.col("was"), F.col(rating).alias("now")))
    return pairs.groupBy(key).agg(latest.alias("r")).select(key, F.col(f"r.{order[0]}").alias("since"), "r.was", "r.now")


def half_trend(series: DataFrame, key: str, order: str, value: str, flat: float = 0.1, least: int = 4) -> DataFrame:
    """The later half against the earlier one; a middle point belongs to neither; too few points give nothing."""
    w = Window.partitionBy(key)
    rows = series.withColumn("i", F.row_number().over(w.orderBy(order))).withColumn("n", F.count("*").over(w)).where(F.col("n") >= least)
    half = F.floor(F.col("n") / 2)
    t = rows.groupBy(key).agg(F.sum(F.when(F.col("i") <= half, F.col(value))).alias("first_half"), F.sum(F.when(F.col("i") > F.col("n") - half, F.col(value))).alias("second_half"))
    change = F.try_divide(F.col("second_half") - F.col("first_half"), F.col("first_half"))
    word = F.when(change.isNull(), "from zero").when(F.abs(change) <= flat, "flat").when(change > 0, "up").otherwise("down")
    return t.withColumn("change", change).withColumn("trend", word)


def peaks(series: DataFrame, key: str, order: str, value: str, top: int = 3, spike: float = 2.0) -> DataFrame:
    """The highest points and how many times the median they are."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value), order))
    middle = series.groupBy(key).agg(F.median(value).alias("median"))
    rows = series.withColumn("rank", rank).where(F.col("rank") <= top).join(middle, key)
    times = F.try_divide(value, "median")
    return rows.select(key, order, value, "rank", "median", times.alias("times"), F.coalesce(times >= spike, F.lit(False)).alias("spike"))


def missing(series: DataFrame, key: str, period: str, periods: list[str]) -> DataFrame:
    spine = series.sparkSession.createDataFrame([(p,) for p in periods], f"{period} string")
    return series.select(key).distinct().crossJoin(F.broadcast(spine)).join(series.select(key, period).distinct(), [key, period], "left_anti")


def year_over_year(series: DataFrame, key: str, month: str, value: str) -> DataFrame:
    """The latest month against the same a year before, and the last twelve months against the twelve before, only where complete."""
    rows = series.withColumn("m", F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int"))
    latest = rows.groupBy(key).agg(F.max("m").alias("top"))
    back = F.col("top") - F.col("m")
    t = rows.join(latest, key).groupBy(key).agg(
        F.max(F.when(back == 0, F.col(value))).alias("latest"), F.max(F.when(back == 12, F.col(value))).alias("year_ago"),
        F.sum(F.when(back < 12, F.col(value))).alias("s1"), F.count(F.when(back < 12, 1)).alias("n1"),
        F.sum(F.when(back.between(12, 23), F.col(value))).alias("s2"), F.count(F.when(back.between(12, 23), 1)).alias("n2"),
    )
    whole = (F.col("n1") == 12) & (F.col("n2") == 12)
    return t.select(key, "latest", "year_ago", F.try_divide(F.col("latest") - F.col("year_ago"), F.col("year_ago")).alias("change"), F.when(whole, F.col("s1")).alias("last_12"), F.when(whole, F.col("s2")).alias("prior_12"))


def freshness(rows: DataFrame, key: str, at: str, as_of: str, stale_days: int = 30) -> DataFrame:
    """Ages in days: the youngest, the upper median, the oldest, and how many are stale. Rows are counted by age first, so
    the running sums go over different ages only."""
    age = rows.select(key, F.datediff(F.lit(as_of).cast("date"), F.to_date(at)).alias("age")).where("age IS NOT NULL")
    counts = age.groupBy(key, "age").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(key).orderBy("age"))
    ranked = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy(key)))
    return ranked.groupBy(key).agg(
        F.min("age").alias("youngest"), F.min(F.when(F.col("upto") >= F.floor(F.col("n") / 2) + 1, F.col("age"))).alias("median_age"), F.max("age").alias("oldest"),
        F.coalesce(F.sum(F.when(F.col("age") > stale_days, F.col("c"))), F.lit(0)).alias("stale"), F.sum("c").alias("rated"),
    )


def series(readings: DataFrame, site: int, metric: str, since: str | None = None) -> DataFrame:
    """One metric of one site, newest first, from an instant on if one is given."""
    rows = readings.where((F.col("site_id") == site) & (F.col("metric") == metric))
    rows = rows if since is None else rows.where(F.col("captured_at") >= F.lit(since).cast("timestamp"))
    return rows.select("captured_at", "refresh_id", "value").orderBy(F.desc("captured_at"), F.desc("refresh_id"))


def series_ends(readings: DataFrame) -> DataFrame:
    """The first and last answered value of each site and metric; both null where none was answered."""
    place = F.when(F.col("value").isNotNull(), F.struct("captured_at", "refresh_id"))
    return readings.groupBy("site_id", "metric").agg(F.min_by("value", place).alias("first"), F.max_by("value", place).alias("last"))


UNREAD = "could not be read on this run."


def audit_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, label, was, now, state: labelled values that changed, and those that are in the earlier audit only (not compared).
    Values that an audit could not read are no change, nor are labels that are new."""
    both = before.select(key, "label", F.col("value").alias("was")).join(after.select(key, "label", F.col("value").alias("now"), F.lit(True).alias("_now")), [key, "label"], "left")
    read = F.coalesce(F.col("was") != UNREAD, F.lit(True))
    state = F.when(F.col("_now").isNull() & read, "not compared").when(F.col("_now") & read & ~F.col("was").eqNullSafe(F.col("now")), "changed")
    return both.withColumn("state", state).where("state IS NOT NULL").drop("_now")


def window_of(as_of: date, days: int = 28, lag: int = 3, retention: int = 480) -> tuple[date, date]:
    """The inclusive window of so many days that ends `lag` days ago, no older than what is retained."""
    end = as_of - timedelta(days=lag)
    return max(end - timedelta(days=days - 1), as_of - timedelta(days=retention)), end


def preceding(window: tuple[date, date]) -> tuple[date, date]:
    length = (window[1] - window[0]).days + 1
    return window[0] - timedelta(days=length), window[0] - timedelta(days=1)


def calendar_months(as_of: date, count: int, lag: int = 3, retention: int = 480) -> list[str]:
    """The last complete months before the one that holds the day `lag` days ago, those that begin within retention."""
    held = as_of - timedelta(days=lag)
    index = held.year * 12 + held.month - 1
    oldest = as_of - timedelta(days=retention)
    firsts = [date((index - k) // 12, (index - k) % 12 + 1, 1) for k in range(count, 0, -1)]
    return [f"{d:%Y-%m}" for d in firsts if d >= oldest]


def complete_months(as_of: Column, count: int, lag: int = 3, retention: int = 480) -> Column:
    """calendar_months() of a day in a column, as an array; null for no day."""
    held = F.trunc(F.date_sub(as_of, lag), "month")
    firsts = F.sequence(F.add_months(held, -count), F.add_months(held, -1), F.expr("INTERVAL 1 MONTH"))
    return F.transform(F.filter(firsts, lambda d: d >= F.date_sub(as_of, retention)), lambda d: F.date_format(d, "yyyy-MM"))


def window_at(as_of: Column, days: int = 28, lag: int = 3, retention: int = 480) -> Column:
    """window_of() of a day in a column: first and last day of the window, and those of the window before it."""
    end = F.date_sub(as_of, lag)
    first = F.greatest(F.date_sub(end, days - 1), F.date_sub(as_of, retention))
    length = F.datediff(end, first) + 1
    return F.struct(first.alias("first"), end.alias("last"), F.date_sub(first, length).alias("first_before"), F.date_sub(first, 1).alias("last_before"))
