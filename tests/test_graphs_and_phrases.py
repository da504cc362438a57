"""Redirect chains, crawls with a budget, phrases, entities, pivots and vitals against step-by-step calculations."""

import random
from collections import deque

from pyspark.sql import functions as F

from sitelode.operators import graphs, joins, phrases, reports


def walk(nxt, url):
    """hops, last address, loop."""
    way = [url]
    while (to := nxt.get(way[-1])) is not None:
        if to in way:
            return len(way), way[-1], True
        way.append(to)
    return len(way) - 1, way[-1], False


def test_redirects_match_a_walk(spark):
    rng = random.Random(4)
    nxt = {f"u{i}": f"u{rng.randrange(60)}" for i in range(45)} | {f"c{i}": f"c{i + 1}" for i in range(40)} | {"self": "self", "a": "b", "b": "a", "out": "elsewhere"}
    rows = [(u, 301, to) for u, to in nxt.items()] + [("c40", 302, None), ("gone", 410, "c0"), ("home", 200, None), (None, 301, "home"), ("a", 301, "b")] + [(f"hot{i}", 308, "home") for i in range(300)]
    nxt |= {f"hot{i}": "home" for i in range(300)}
    got = {r.url: r for r in graphs.redirect_chains(spark.createDataFrame(rows, "url string, status int, location string")).collect()}
    assert set(got) == set(nxt) | {"c40", "gone", "home"}
    for url, r in got.items():
        hops, last, loop = walk(nxt, url)
        assert (r.hops, r.final_url, r.loop, r.missing, r.long, r.exceeded) == (hops, last, loop, last == "c40" and not loop, hops > 3, hops >= 10), url
    assert graphs.redirect_chains(spark.createDataFrame([], "url string, status int, location string")).count() == 0


def test_locations(spark):
    base = "https://X.example:8/a/b?q=1"
    want = {"c": "https://x.example:8/a/c", "/c?d": "https://x.example:8/c?d", "//Y.example": "https://y.example/", "?z": "https://x.example:8/a/b?z", "#z": "https://x.example:8/a/b?q=1#z", "HTTP://y.example#f": "http://y.example/#f", "http://": None, "https:///?x": None, " mailto:a@b ": "mailto:a@b", "../c": "https://x.example:8/c", "../../c/./d/..?e/../f": "https://x.example:8/c/?e/../f", "/a/..": "https://x.example:8/", ".": "https://x.example:8/a/"}
    got = spark.createDataFrame([(k,) for k in want], "l string").select("l", graphs.resolved(F.col("l"), F.lit(base)).alias("r")).collect()
    assert {r.l: r.r for r in got} == want


def simulate(links, allowed, status, budget):
    """A queue, one page at a time."""
    queue, seen, out = deque([(0, 0, None)]), set(), []
    while queue and len(seen) < budget:
        node, depth, found_on = queue.popleft()
        if node in seen:
            continue
        seen.add(node)
        state = "blocked" if not allowed.get(node, True) else "crawled" if 200 <= status.get(node, 0) <= 399 else "failed"
        out.append((node, depth, len(out), found_on, state))
        if state == "crawled":
            queue.extend((to, depth + 1, node) for to in links.get(node, []))
    return out


def test_crawls_match_a_queue(spark):
    rng = random.Random(6)
    links = {i: [rng.randrange(90) for _ in range(rng.randint(2, 6))] for i in range(80)}
    links[0] = [5, 3, 3, 0, 85, 7]
    allowed, status = {i: rng.random() > 0.15 for i in range(1, 80)} | {0: True}, {i: rng.choice([200, 200, 200, 301, 404, 500]) for i in range(1, 80)} | {0: 200}
    edges = spark.createDataFrame([(s, d, p) for s, to in links.items() for p, d in enumerate(to)] + [(None, 1, 0), (0, None, 9)], "src long, dst long, pos int")
    pages = spark.createDataFrame([(i, allowed[i], status[i]) for i in range(80)], "node long, allowed boolean, status int")
    start = spark.createDataFrame([(0, 0)], "node long, pos int")
    whole = simulate(links, allowed, status, 10**9)
    assert len(whole) > 50 and all(simulate(links, allowed, status, b) == whole[:b] for b in range(1, 51))
    for budget in (1, 2, 7, 23, 50, len(whole), len(whole) + 1):
        seen, cut_off = graphs.crawl(edges, pages, start, budget)
        assert sorted(map(tuple, seen.collect()), key=lambda r: r[2]) == whole[:budget] and cut_off == (budget <= len(whole))


def test_phrases(spark):
    texts = spark.createDataFrame([(1, "Le Café-Bar, at 5 o'clock."), (2, "cafe  BAR at five"), (3, None), (4, ""), (5, "one two three four five six seven eight nine ten"), (5, "café"), (6, "ﬁne Ⅷ ½")], "text_id long, text string")
    asked = [(1, "café bar"), (2, "bar cafe"), (3, "Cafe"), (4, "?!"), (5, None), (6, "one two three four five six seven eight nine"), (7, "one two three four five six seven eight ten"), (8, "o clock"), (8, "five"), (9, "caf"), (10, "fine VIII 1 2")]
    got = phrases.naming(texts, spark.createDataFrame(asked, "phrase_id long, phrase string"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 3), (1, 8), (2, 1), (2, 3), (2, 8), (5, 3), (5, 6), (5, 8), (6, 10)]
    none = spark.createDataFrame([], "phrase_id long, phrase string")
    assert phrases.naming(texts, none).count() == 0 and phrases.naming(texts.limit(0), none).count() == 0


def test_subjects(spark):
    pages = spark.createDataFrame([(1, None, "All about Soup Inc today", "t"), (2, "Acme", "h", "t"), (3, " ", "", "Only Ümlaut here"), (4, None, None, None), (5, None, "nothing named", None)], "page_id long, target string, h1 string, title string")
    rows = [
        (1, 0, "Soup", 0.2, None), (1, 1, "Today", 0.2, ["x"]), (1, 2, "Other", 0.9, []), (1, 3, " ", 1.0, None), (1, 4, "All", None, None), (1, 5, "All", float("nan"), None), (2, 0, "Acme Corp", 0.1, None), (2, 1, "Top", 0.5, ["acme"]),
        (3, 0, "x", 0.5, ["a", "umlaut"]), (4, 0, "Any", 0.5, None), (5, 0, "None", 0.5, None),
    ]
    got = phrases.subject_entities(pages, spark.createDataFrame(rows, "page_id long, place int, name string, salience double, mentions array<string>")).collect()
    assert sorted((r.page_id, r.source, r.name, r["rank"], r.top) for r in got) == [(1, "H1", "Soup", 2, "Other"), (2, "target", "Top", 1, "Top"), (3, "title", "x", 1, "x"), (4, None, None, None, "Any"), (5, "H1", None, None, "None")]


def test_pivot_keeps_the_sum(spark):
    rows = [(f"r{i}", f"c{i % 4}" if i % 5 else None, float(i)) for i in range(40)] + [(None, "c1", 1000.0), ("(rest)", "c1", 500.0), ("r1", "c1", None)]
    got = reports.pivot(spark.createDataFrame(rows, "a string, b string, v double"), "a", "b", {"v": F.col("v"), "n": F.lit(1)}, 3, 2).collect()
    assert sum(r.v or 0 for r in got) == sum(v or 0 for *_, v in rows) and sum(r.n for r in got) == len(rows)
    assert {r.row for r in got} == {None, "(rest)", "r39"} and {r.column for r in got} == {"c1", "c0", "(rest)"}
    assert [(r.v, r.row_total) for r in got if r.row == "(rest)" and not r.beyond] == [(500.0, 500.0)]
    assert reports.pivot(spark.createDataFrame([], "a string, b string, v double"), "a", "b", {"v": F.col("v")}).count() == 0


def test_vitals_are_summed(spark):
    search = spark.createDataFrame([("p1", "h", 10.0), ("p2", "h", 10.0), ("p3", "h", 5.0), ("p4", "x", 5.0), ("p5", "x", 1.0)], "url_key string, host_key string, clicks double")
    own = spark.createDataFrame([("p1", 5000.0, 300.0, 0.2), ("p2", 2500.0, None, 0.1), ("p5", None, None, None)], "url_key string, lcp double, inp double, cls double")
    whole = spark.createDataFrame([("h", 9000.0, 1.0, 1.0)], "host_key string, lcp double, inp double, cls double")
    got = {r.url_key: (r.basis, r.distance, r.impact) for r in joins.vitals_by_traffic(search, own, whole).collect()}
    assert got == {"p1": ("page", 2.5, 25.0), "p2": ("page", 0.0, None), "p3": ("origin", None, None), "p4": ("not measured", None, None), "p5": ("page", 0.0, None)}
