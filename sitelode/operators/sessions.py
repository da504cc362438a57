"""Sessions, funnels and landings over an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hosts from which a visit means that an assistant's answer was read.
AI_HOSTS = (
    "chatgpt.com", "chat.openai.com", "openai.com", "perplexity.ai", "gemini.google.com", "claude.ai", "copilot.microsoft.com",
    "copilot.com", "edgeservices.bing.com", "grok.com", "meta.ai", "deepseek.com", "you.com", "poe.com", "mistral.ai",
)


def sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """A row per session of a user: its bounds, events and value."""
    w = F.session_window("ts", f"{gap_minutes} minutes")
    rows = events.groupBy("user_id", w).agg(
        F.count("*").alias("events"), F.sum("value").alias("value"), F.count_if(F.col("event_type").isin("purchase", "signup")).alias("key_events"),
        F.max((F.col("event_type") == "purchase").cast("int")).alias("bought"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_event"), F.min_by("k", F.struct("ts", "event_id")).alias("k"),
    )
    start, end = F.col("session_window.start"), F.col("session_window.end")
    engaged = ((F.col("events") >= 2) | (F.col("bought") == 1)).cast("int")
    return rows.select("user_id", start.alias("start"), end.alias("end"), "events", "value", "key_events", engaged.alias("engaged"), "first_event", "k")


def landings(session_rows: DataFrame) -> DataFrame:
    return session_rows.select(F.concat(F.lit("/"), "first_event").alias("landing_page"), F.lit(1).alias("sessions"), "engaged", "key_events", "k")


def landing_rollup(rows: DataFrame, key: str = "landing_page") -> DataFrame:
    total = rows.groupBy(key).agg(F.sum("sessions").alias("sessions"), F.sum("engaged").alias("engaged"), F.sum("key_events").alias("key_events"))
    return total.withColumn("engagement_rate", F.coalesce(F.try_divide("engaged", "sessions"), F.lit(0.0)))


def classify_ai(source: Column, medium: Column) -> Column:
    """google: the source classified the visit itself; host-list: a referral from a listed host or one below it; else null."""
    s = F.lower(source)
    listed = s.isin(*AI_HOSTS)
    for h in AI_HOSTS:
        listed = listed | s.endswith("." + h)
    return F.when(F.lower(medium) == "ai-assistant", "google").when((F.lower(medium) == "referral") & listed, "host-list")


def ai_sources(rows: DataFrame) -> DataFrame:
    """rows: source, medium, sessions, users. Users of a source with several rows are an upper bound."""
    found = rows.withColumn("by", classify_ai(F.col("source"), F.col("medium"))).where("by IS NOT NULL")
    return found.groupBy(F.lower("source").alias("source")).agg(
        F.sum("sessions").alias("sessions"), F.sum(F.when(F.col("by") == "host-list", F.col("sessions")).otherwise(0)).alias("from_host_list"), F.sum("users").alias("users"), (F.count("*") > 1).alias("users_upper_bound")
    )


def ai_landings(rows: DataFrame) -> DataFrame:
    """page, sessions: the landings of visits from assistants; those whose landing is no path are one row without a page."""
    found = rows.where(classify_ai(F.col("source"), F.col("medium")).isNotNull())
    return found.groupBy(F.when(F.col("landing_page").startswith("/"), F.col("landing_page")).alias("page")).agg(F.sum("sessions").alias("sessions"))


def organic_landings(rows: DataFrame) -> DataFrame:
    """Google's organic landings; sessions whose landing page is no path are counted in a row without one."""
    own = rows.where((F.col("source") == "google") & (F.col("medium") == "organic"))
    page = F.when(F.col("landing_page").startswith("/"), F.col("landing_page"))
    return landing_rollup(own.withColumn("landing_page", page))


def users_by_grain(events: DataFrame) -> DataFrame:
    """Distinct users by day and type, by day, and in all: each grain counts anew."""
    day = F.to_date("ts").alias("date")
    return events.rollup(day, "event_type").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("events"))


def key_events(events: DataFrame, names: list[str]) -> DataFrame:
    per = events.where(F.col("event_type").isin(names)).groupBy("event_type").agg(F.count("*").alias("n")).where("n > 0")
    return per.unionByName(per.agg(F.sum("n").alias("n")).select(F.lit("(total)").alias("event_type"), F.coalesce("n", F.lit(0)).alias("n")))


def active_users(events: DataFrame, now: str, minutes: int = 30, by: str = "event_type", top: int = 20) -> DataFrame:
    at = F.lit(now).cast("timestamp")
    recent = events.where((F.col("ts") > at - F.make_dt_interval(mins=F.lit(minutes))) & (F.col("ts") <= at))
    return recent.groupBy(by).agg(F.count_distinct("user_id").alias("active_users")).orderBy(F.desc("active_users"), by).limit(top)


def funnel(events: DataFrame, steps: list[str], first: str, last: str) -> DataFrame:
    """Users who did each step after the one before, with completion and abandonment.

    A user's earliest time for a step after the step before is found with one window pass over its events a step."""
    rows = events.where((F.col("ts") >= F.lit(first).cast("timestamp")) & (F.col("ts") < F.lit(last).cast("timestamp")) & F.col("event_type").isin(steps))
    w = Window.partitionBy("user_id")
    for i, step in enumerate(steps):
        own = F.col("event_type") == step
        after = own if i == 0 else own & (F.col("ts") > F.col(f"t{i - 1}"))
        rows = rows.withColumn(f"t{i}", F.min(F.when(after, F.col("ts"))).over(w))
    users = rows.groupBy("user_id").agg(*[F.first(f"t{i}").alias(f"t{i}") for i in range(len(steps))])
    reached = users.agg(*[F.count(f"t{i}").alias(f"n{i}") for i in range(len(steps))])
    table = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(s).alias("event"), F.col(f"n{i}").alias("users"), (F.col(f"n{i - 1}") if i else F.col("n0")).alias("before"), F.col("n0").alias("entered")) for i, s in enumerate(steps)])
    rate = F.try_divide("users", "before")
    return reached.select(F.inline(table)).select("step", "event", "users", rate.alias("completion"), (F.col("before") - F.col("users")).alias("abandoned"), F.try_divide("users", "entered").alias("end_to_end"))


def busiest_landings(rows: DataFrame, limit: int) -> DataFrame:
    """Landings by key events, then sessions, then page: the first `limit`, in order."""
    return rows.orderBy(F.desc("key_events"), F.desc("sessions"), F.asc_nulls_last("landing_page")).limit(limit)
