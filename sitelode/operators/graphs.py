"""Graphs of pages: redirect chains of any length, and crawls with a budget.

Both go round by round with joins; every round is cut into the checkpoint folder, so a lost executor costs one round. Chains
take a round for each doubling of the longest one, crawls one for each level of links. Nothing but counts of rounds and of
partitions comes to the driver. Null addresses lead nowhere, an empty table gives no rows, repeated links count once; of
rows that repeat an address the one with the smallest status and location counts.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelode.operators.lineage import cut

#: From so many hops on a chain is long, and from so many on none follows it to its end.
LONG, MOST_HOPS = 4, 10


def resolved(location: Column, base: Column) -> Column:
    """The address that a location header means: one with a scheme stands for itself, others begin where the base ends. Null if
    it has a scheme of the web and no host."""
    origin, scheme = F.regexp_extract(base, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*", 0), F.regexp_extract(base, r"(?i)^([a-z][a-z0-9+.-]*:)", 1)
    path = F.regexp_extract(base, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", "")
    location = F.trim(location)
    out = (
        F.when(location.rlike(r"(?i)^https?:/*(?:[?#]|$)"), F.lit(None)).when(location.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), location)
        .when(location.startswith("//"), F.concat(scheme, location)).when(location.startswith("/"), F.concat(origin, location))
        .when(location.startswith("#"), F.concat(F.substring_index(base, "#", 1), location)).when(location.startswith("?"), F.concat(origin, F.when(path == "", "/").otherwise(path), location)).otherwise(F.concat(origin, folder, location))
    )
    host = F.lower(F.regexp_extract(out, r"(?i)^https?://[^/?#]*", 0))
    rest = F.substring(out, F.length(host) + 1, F.length(out))
    way = F.regexp_extract(rest, r"^[^?#]*", 0)
    rest = F.concat(F.when(way == "", "/").when(way.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), _without_dots(way)).otherwise(way), F.substring(rest, F.length(way) + 1, F.length(rest)))
    return F.when(host == "", out).otherwise(F.concat(host, rest))


def _without_dots(path: Column) -> Column:
    """A path whose steps "." stay where they are and ".." go back, but not beyond the root."""
    steps = F.slice(F.split(path, "/"), 2, F.length(path) + 1)
    back = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda done, s: F.when(s == "..", back(done)).when(s == ".", done).otherwise(F.concat(done, F.array(s))))
    ends_open = path.rlike(r"/\.{1,2}$")
    return F.concat(F.lit("/"), F.array_join(walked, "/"), F.when(ends_open & (F.size(walked) > 0), "/").otherwise(""))


def _doubled(steps: DataFrame, most: int) -> DataFrame:
    """url, to, n, open: each address with where so many steps lead, until all ends are reached or `most` rounds are done.

    Only rows that are still under way (open) are joined, so an address where very many chains end is no hot key."""
    for _ in range(most):
        under_way = steps.where("open")
        if under_way.isEmpty():
            break
        further = steps.select(F.col("url").alias("to"), F.col("to").alias("_to"), F.col("n").alias("_n"), F.col("open").alias("_open"))
        went = under_way.join(further, "to").select("url", F.col("_to").alias("to"), (F.col("n") + F.col("_n")).alias("n"), F.col("_open").alias("open"))
        steps = cut(steps.where("NOT open").unionByName(went))
    return steps


def _rounds(n: int) -> int:
    return ceil(log2(n + 1)) + 1


def redirect_chains(redirects: DataFrame) -> DataFrame:
    """url, hops, final_url, loop, missing, long, exceeded: where each address leads. redirects: url, status, location (resolved).

    hops counts the redirects passed, in a loop until an address comes again; final_url is the last address before that.
    missing: the chain ends at a redirect that says not where to. exceeded: ten hops or more, or a loop that takes as many."""
    moved = F.col("status").between(300, 399)
    rows = redirects.where(F.col("url").isNotNull()).groupBy("url").agg(F.min(F.struct("status", "location")).alias("r")).select("url", "r.*")
    rows = cut(rows.select("url", F.when(moved, F.col("location")).alias("next"), (moved & F.col("location").isNull()).alias("missing")))
    moving = rows.where("next IS NOT NULL")
    first = moving.join(moving.select(F.col("url").alias("next"), F.lit(True).alias("more")), "next", "left")
    steps = cut(first.select("url", F.col("next").alias("to"), F.lit(1).cast("long").alias("n"), F.coalesce("more", F.lit(False)).alias("open")))
    steps = _doubled(steps, _rounds(steps.count()))

    still = rows.where("next IS NULL").select("url", F.col("url").alias("final_url"), F.lit(0).cast("long").alias("hops"), F.lit(False).alias("loop"))
    ended = steps.where("NOT open").select("url", F.col("to").alias("final_url"), F.col("n").alias("hops"), F.lit(False).alias("loop"))
    found = still.unionByName(ended)
    endless = steps.where("open")
    if not endless.isEmpty():
        found = found.unionByName(_loops(endless, moving))
    ends = rows.where("missing").select(F.col("url").alias("final_url"), "missing")
    found = found.join(ends, "final_url", "left")
    return found.select("url", "hops", "final_url", "loop", F.coalesce("missing", F.lit(False)).alias("missing"), (F.col("hops") >= LONG).alias("long"), (F.col("hops") >= MOST_HOPS).alias("exceeded"))


def _loops(endless: DataFrame, moving: DataFrame) -> DataFrame:
    """The chains that end in a loop. After enough steps all of them are on it, and every address of a loop is where some other
    one of it leads, so where they are is the loop."""
    on = cut(moving.join(endless.select(F.col("to").alias("url")).distinct(), "url", "left_semi").select("url", "next"))
    size = on.count()
    state = on.select("url", F.col("next").alias("to"), F.least("url", "next").alias("name"))
    for _ in range(_rounds(size)):  # a loop's name is its smallest address
        further = state.select(F.col("url").alias("to"), F.col("to").alias("_to"), F.col("name").alias("_name"))
        state = cut(state.join(further, "to").select("url", F.col("_to").alias("to"), F.least("name", "_name").alias("name")))
    length = state.groupBy("name").agg(F.count("*").alias("length"))
    around = on.join(state.select("url", "name"), "url").join(length, "name").select(F.col("next").alias("entry"), F.col("url").alias("last"), "length")
    way = moving.join(endless.select("url"), "url", "left_semi").join(on.select("url"), "url", "left_anti")
    way = way.join(on.select(F.col("url").alias("next"), F.lit(True).alias("there")), "next", "left")
    way = cut(way.select("url", F.col("next").alias("to"), F.lit(1).cast("long").alias("n"), F.col("there").isNull().alias("open")))
    way = _doubled(way, _rounds(way.count()))
    here = on.select("url", F.col("url").alias("entry"), F.lit(0).cast("long").alias("n"))
    every = way.select("url", F.col("to").alias("entry"), "n").unionByName(here)
    return every.join(around, "entry").select("url", F.col("last").alias("final_url"), (F.col("n") + F.col("length")).alias("hops"), F.lit(True).alias("loop"))


def _ranked(rows: DataFrame, *by: str) -> DataFrame:
    """rows plus rank from 0 in the order of some columns: sorted by ranges, numbered in each, the counts before added."""
    rows = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    counts = sorted(rows.groupBy(F.shiftright("_at", 33).alias("part")).count().collect())  # a number a partition
    before, offsets = 0, []
    for part, n in counts:
        offsets.append((part, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(offsets, "_part long, _before long")
    rows = rows.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(offsets), "_part")
    return rows.withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def crawl(edges: DataFrame, pages: DataFrame, start: DataFrame, budget: int) -> tuple[DataFrame, bool]:
    """node, depth, place, found_on, state (crawled, blocked, failed), and whether the budget ended the crawl.

    edges: src, dst, pos (the link's place on its page). pages: node, allowed, status; pages without a row are fetched and fail.
    start: node, pos. Pages are visited level by level in the order in which they are found, every one once, blocked ones too;
    the first `budget` of them count. Links are followed from pages that are allowed and answer with a status of 200 to 399."""
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    level = start.where("node IS NOT NULL").groupBy("node").agg(F.min("pos").alias("pos")).select("node", F.lit(None).cast("long").alias("parent"), "pos", F.lit(None).cast(start.schema["node"].dataType).alias("found_on"))
    levels: list[DataFrame] = []
    seen, visited, depth = None, 0, 0
    while True:
        ranked = _ranked(level, "parent", "pos", "node").where(F.col("rank") < budget - visited)
        ranked = ranked.select("node", F.lit(depth).alias("depth"), (F.col("rank") + visited).alias("place"), "found_on").join(pages.select("node", "allowed", "status"), "node", "left")
        state = F.when(~F.coalesce("allowed", F.lit(True)), "blocked").when(F.coalesce("status", F.lit(0)).between(200, 399), "crawled").otherwise("failed")
        now = cut(ranked.select("node", "depth", "place", "found_on", state.alias("state")))
        n = now.count()
        levels.append(now)
        seen = now if seen is None else seen.unionByName(now)
        visited, depth = visited + n, depth + 1
        if not n or visited >= budget:
            return seen, visited >= budget
        if depth % 20 == 0:
            seen = cut(seen)
        links = edges.join(now.where("state = 'crawled'").select(F.col("node").alias("src"), F.col("place").alias("parent")), "src")
        found = links.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("parent", "pos", F.col("src").alias("found_on"))).alias("by"))
        level = found.join(seen.select("node"), "node", "left_anti").select("node", "by.*")
