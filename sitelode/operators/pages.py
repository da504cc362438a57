"""Pages: facts from html, on-page rules, scored checks, robots rules, the link graph and vitals.

Facts are taken by expressions over the html text, all in the JVM. A check that
does not apply or was not evaluated leaves both sides of a score.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits of vitals, good up to the first, poor above the second.
VITALS = {"lcp": (2500.0, 4000.0), "cls": (0.1, 0.25), "inp": (200.0, 500.0), "fcp": (1800.0, 3000.0), "ttfb": (800.0, 1800.0)}
#: Crawlers of AI systems and what they fetch pages for.
AI_CRAWLERS = {
    "GPTBot": "training", "OAI-SearchBot": "search", "ChatGPT-User": "user-fetch", "ClaudeBot": "training", "anthropic-ai": "training", "Claude-SearchBot": "search",
    "Claude-User": "user-fetch", "PerplexityBot": "search", "Perplexity-User": "user-fetch", "MistralAI-Index": "search", "MistralAI-User": "user-fetch",
    "MistralAI-Training": "training", "Google-Extended": "control-token", "Applebot-Extended": "control-token", "Meta-ExternalAgent": "training", "FacebookBot": "training",
    "CCBot": "training", "Bytespider": "training", "Omgilibot": "training", "Diffbot": "training",
}


def word_count(html: Column) -> Column:
    """Words of a page without scripts, styles, tags and named entities; numeric ones stay part of their word."""
    plain = html
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"<[^>]+>", r"(?i)&[a-z]+;"):
        plain = F.regexp_replace(plain, pattern, " ")
    return F.size(F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def facts(pages: DataFrame) -> DataFrame:
    """page_id, url and what the rules look at: one pass over the html."""
    h = F.col("html")
    meta = lambda name: F.regexp_extract(h, rf"(?is)<meta[^>]*\bname=[\"']{name}[\"'][^>]*\bcontent=[\"']([^\"']*)[\"']", 1)
    images = F.regexp_extract_all(h, F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))
    found = lambda c: F.when(c != "", c)
    return pages.select(
        "page_id", "url",
        found(F.trim(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1))).alias("title"),
        found(F.trim(meta("description"))).alias("description"), found(meta("viewport")).alias("viewport"), F.lower(meta("robots")).alias("robots"),
        found(F.regexp_extract(h, r"(?is)<link[^>]*\brel=[\"']canonical[\"'][^>]*\bhref=[\"']([^\"']*)[\"']", 1)).alias("canonical"),
        found(F.regexp_extract(h, r"(?is)<html[^>]*\blang=[\"']([^\"']*)[\"']", 1)).alias("lang"),
        F.regexp_count(h, F.lit(r"(?i)<h1\b")).alias("h1"), F.regexp_count(h, F.lit(r"(?i)<h2\b")).alias("h2"),
        F.size(images).alias("images"), F.size(F.filter(images, lambda i: ~i.rlike(r"(?i)\balt="))).alias("images_without_alt"),
        F.regexp_extract_all(h, F.lit(r"(?is)<a\b[^>]*\bhref=[\"']([^\"'#]+)"), F.lit(1)).alias("links"), word_count(h).alias("words"),
    )


def rules(of_pages: DataFrame) -> DataFrame:
    """The on-page rules that a page breaks, in order."""
    c = F.col
    broken = [
        ("title-missing", c("title").isNull()), ("title-long", F.length("title") > 70), ("description-missing", c("description").isNull()), ("description-long", F.length("description") > 165),
        ("h1-missing", c("h1") == 0), ("h1-multiple", c("h1") > 1), ("canonical-missing", c("canonical").isNull()), ("viewport-missing", c("viewport").isNull()),
        ("lang-missing", c("lang").isNull()), ("images-alt", c("images_without_alt") > 0),
    ]
    return of_pages.select("page_id", F.array_compact(F.array(*[F.when(when, F.lit(name)) for name, when in broken])).alias("issues"))


def crawl_issues(crawled: DataFrame) -> DataFrame:
    """crawled: page_id, status (0: not fetched), redirects, depth, title, description, h1, noindex. A row per issue with its
    severity. A page that could not be read has that one issue only."""
    c = F.col
    ok = c("status").between(200, 299)
    found = [
        ("fetch_error", "critical", c("status") == 0), ("server_error", "critical", c("status") >= 500), ("broken_link", "critical", ~ok & (c("status") > 0) & (c("status") < 500)),
        ("missing_title", "critical", ok & c("title").isNull()), ("long_title", "warning", ok & (F.length("title") > 70)), ("missing_description", "warning", ok & c("description").isNull()),
        ("missing_h1", "warning", ok & (c("h1") == 0)), ("redirect_chain", "warning", ok & (c("redirects") > 3)), ("noindex", "warning", ok & c("noindex")),
        ("very_deep_page", "critical", ok & (c("depth") >= 6)), ("deep_page", "warning", ok & c("depth").between(4, 5)),
    ]
    issues = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(k).alias("type"), F.lit(s).alias("severity"))) for k, s, when in found]))
    return crawled.select("page_id", F.inline(issues))


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("type").agg(F.count("*").alias("n"))


def duplicates(of_pages: DataFrame, column: str) -> DataFrame:
    """Texts that several pages have, how many pages, and the first of them."""
    return of_pages.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page")).where("n > 1")


def short_pages(of_pages: DataFrame, least: int = 300) -> DataFrame:
    """Readable pages that may be indexed and have fewer words, but some. of_pages: page_id, words, status, noindex."""
    return of_pages.where((F.col("words") > 0) & (F.col("words") < least) & (F.col("status") < 400) & ~F.col("noindex")).select("page_id", "words")


#: Path names that tell a page's kind, and schema types that declare it.
FAQ_PATH = r"(?i)(?:^|/)(?:faqs?|preguntas-frecuentes|preguntas)(?:/|$)"
ARTICLE_PATH = r"(?i)/(blog|news|post|posts|article|articles|noticias|noticia|articulo|articulos|artículo|artículos|entrada|entradas)/"
PRODUCT_PATH = r"(?i)/(product|products|shop|store|item|items|producto|productos|tienda)/"
ARTICLE_TYPES = ("Article", "BlogPosting", "NewsArticle", "TechArticle", "Report")
PRODUCT_TYPES = ("Product", "ProductGroup", "Offer")
COLLECTION_TYPES = ("CollectionPage", "ItemList", "SearchResultsPage")
PROFILE_TYPES = ("ProfilePage", "AboutPage")
CALLS = (
    r"(?i)\b(get started|sign up|try free|buy now|start free|start trial|book a demo|request demo|empieza|empezar|regístrate|registrate|prueba gratis|prueba gratuita"
    r"|comprar ahora|reserva una demo|solicita una demo|solicitar demo)\b"
)


def identity(of_pages: DataFrame, keep: bool = False) -> DataFrame:
    """page_id, kind, is_root, depth. of_pages: page_id, url, types (declared schema types), og_type, dated_article (an article
    element with a date or byline), calls (clickable texts of the content that call to action).

    A locale alone or an index file is the root too, at depth 0. What a page declares is weighed with its path, in the
    order faq, product, article, collection, profile, and landing for three calls to action. With keep all columns stay."""
    path = F.regexp_extract("url", r"^[^:]+://[^/?#]+([^?#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda p: p != "")
    segments = F.when((F.size(segments) == 1) & segments[0].rlike(r"(?i)^index\.(html?|php|aspx?)$"), F.array().cast("array<string>")).otherwise(segments)
    is_root = (F.size(segments) == 0) | ((F.size(segments) == 1) & F.try_element_at(segments, F.lit(1)).rlike(r"(?i)^[a-z]{2}(?:[-_][a-z]{2,4})?$"))
    types = F.coalesce("types", F.array().cast("array<string>"))
    declares = lambda names: F.arrays_overlap(types, F.array(*map(F.lit, names)))
    og = F.coalesce(F.lower(F.trim("og_type")), F.lit(""))
    kind = (
        F.when(is_root, "homepage").when(path.rlike(FAQ_PATH) | declares(["FAQPage"]), "faq")
        .when(declares(PRODUCT_TYPES) | (og == "product") | path.rlike(PRODUCT_PATH), "product")
        .when(declares(ARTICLE_TYPES) | (og == "article") | path.rlike(ARTICLE_PATH) | F.col("dated_article"), "article")
        .when(declares(COLLECTION_TYPES), "collection").when(declares(PROFILE_TYPES) | (og == "profile"), "profile")
        .when(F.col("calls") >= 3, "landing").otherwise("generic")
    )
    found = {"kind": kind, "is_root": is_root, "depth": F.when(is_root, 0).otherwise(F.size(segments))}
    return of_pages.withColumns(found) if keep else of_pages.select("page_id", *[c.alias(name) for name, c in found.items()])


def tally(checks: DataFrame, key: str) -> DataFrame:
    """checks: key, points, earned, status. Points that don't apply or weren't evaluated leave both sides."""
    counted = F.col("status").isNull()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    t = checks.groupBy(key).agg(
        zero(F.sum(F.when(counted, F.coalesce("earned", F.lit(0))))).alias("score"), zero(F.sum(F.when(counted, F.col("points")))).alias("max"),
        zero(F.sum(F.when(F.col("status") == "not-applicable", F.col("points")))).alias("not_applicable"), zero(F.sum(F.when(F.col("status") == "not-evaluated", F.col("points")))).alias("not_evaluated"),
    )
    return t.withColumn("percent", F.floor(F.try_divide(F.col("score") * 100, "max") + 0.5).cast("bigint"))


def grade(percent: Column, bands: list[tuple[float, str]], last: str) -> Column:
    """The first band whose lower end is reached; null stays null."""
    out = F.when(percent.isNull(), F.lit(None).cast("string"))
    for least, name in bands:
        out = out.when(percent >= least, name)
    return out.otherwise(last)


def rate_vital(metric: Column, value: Column) -> Column:
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for name, (good, poor) in VITALS.items():
        out = out.when(metric == name, F.when(value <= good, "good").when(value > poor, "poor").otherwise("needs improvement"))
    return out


def assess_vitals(readings: DataFrame, key: str) -> DataFrame:
    """key, metric, value: fails if any of the three is not good, else unassessable if one is missing, else passes."""
    rated = readings.where(F.col("metric").isin("lcp", "inp", "cls")).withColumn("rating", rate_vital(F.col("metric"), F.col("value")))
    t = rated.groupBy(key).agg(F.count_if(F.col("rating") != "good").alias("bad"), F.count_distinct(F.when(F.col("rating").isNotNull(), F.col("metric"))).alias("known"))
    return t.select(key, F.when(F.col("bad") > 0, "fails").when(F.col("known") < 3, "unassessable").otherwise("passes").alias("assessment"))


def prevalence(rows: DataFrame, group: str, signals: list[str], least: int = 3, notable: float = 25.0) -> DataFrame:
    """Shares of yes among the answered of either group (ai, organic) and their gap in points; null where too few answered."""
    per = rows.groupBy(group).agg(*[F.count_if(F.col(s)).alias(f"yes_{s}") for s in signals], *[F.count(s).alias(f"of_{s}") for s in signals])
    long = per.select(group, F.inline(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(f"yes_{s}").alias("yes"), F.col(f"of_{s}").alias("answered")) for s in signals])))
    share = F.when(F.col("answered") >= least, F.col("yes") * 100 / F.col("answered"))
    t = long.groupBy("signal").agg(F.max(F.when(F.col(group) == "ai", share)).alias("ai"), F.max(F.when(F.col(group) == "organic", share)).alias("organic"))
    return t.withColumn("gap", F.col("ai") - F.col("organic")).withColumn("notable", F.coalesce(F.abs("gap") >= notable, F.lit(False)))


def robots_rules(files: DataFrame) -> DataFrame:
    """files: host, text. A row per rule: host, agent, kind (allow or disallow), pattern. Agents that follow each other share
    the rules below them."""
    lines = files.select("host", F.posexplode(F.split("text", r"\r?\n")).alias("i", "raw"))
    bare = F.trim(F.regexp_replace("raw", "#.*$", ""))
    fields = lines.select("host", "i", F.lower(F.trim(F.regexp_extract(bare, r"^([^:]+):", 1))).alias("field"), F.trim(F.regexp_extract(bare, r"^[^:]+:(.*)$", 1)).alias("value"))
    known = fields.where(F.col("field").isin("user-agent", "allow", "disallow"))
    w = Window.partitionBy("host").orderBy("i")
    starts = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    grouped = known.withColumn("s", F.when(starts, 1).otherwise(0)).withColumn("g", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    agents = grouped.where("field = 'user-agent'").select("host", "g", F.lower("value").alias("agent"))
    return agents.join(grouped.where("field <> 'user-agent'").select("host", "g", F.col("field").alias("kind"), F.col("value").alias("pattern")), ["host", "g"], "left").select("host", "agent", "kind", "pattern")


#: What site owners can say of the use of their pages, and how much of a file is read.
USES = ("search", "ai-input", "ai-train")
MOST_BYTES = 500 * 1024


def _robots_lines(files: DataFrame) -> DataFrame:
    """host, line (from 1), bare (without comments), field, value, and g, the group that a line belongs to (0 before the first)."""
    rows = files.select("host", F.posexplode(F.split("text", r"\r?\n")).alias("i", "raw")).select("host", (F.col("i") + 1).alias("line"), F.trim(F.substring_index("raw", "#", 1)).alias("bare")).where("bare <> ''")
    rows = rows.withColumns({"field": F.lower(F.trim(F.regexp_extract("bare", r"^([^:]*):", 1))), "value": F.trim(F.regexp_extract("bare", r"^[^:]*:(.*)$", 1)), "colon": F.contains("bare", F.lit(":"))})
    w = Window.partitionBy("host").orderBy("line")
    # lines that begin or fill a group; an agent begins one unless it follows another agent
    counts = F.col("colon") & ((F.col("field") == "user-agent") & (F.col("value") != "") | F.col("field").isin("allow", "content-signal") & (F.col("value") != "") | (F.col("field") == "disallow"))
    last = F.last(F.when(counts, F.col("field")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = counts & (F.col("field") == "user-agent") & (F.coalesce(last, F.lit("")) != "user-agent")
    return rows.withColumn("s", starts.cast("int")).withColumn("g", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("s")


def robots_issues(files: DataFrame) -> DataFrame:
    """host, line, issue: what is wrong with a file, line by line, line 0 being the file itself. files: host, text."""
    rows = _robots_lines(files)
    ruled = F.col("field").isin("allow", "disallow", "content-signal")
    issue = F.when(~F.col("colon"), "no colon").when((F.col("value") == "") & (F.col("field") != "disallow"), "empty value").when(ruled & (F.col("g") == 0), "before any user-agent")
    large = files.where(F.octet_length("text") > MOST_BYTES).select("host", F.lit(0).alias("line"), F.lit("too large").alias("issue"))
    return rows.select("host", "line", issue.alias("issue")).where("issue IS NOT NULL").unionByName(large)


def robots_sitemaps(files: DataFrame) -> DataFrame:
    """host, line, url: the sitemaps that a file names, whatever group they stand in."""
    return _robots_lines(files).where((F.col("field") == "sitemap") & (F.col("value") != "")).select("host", "line", F.col("value").alias("url"))


def robots_uses(files: DataFrame) -> DataFrame:
    """host, agent, use, preference (yes or no): what a file says of the use of pages, agent by agent; of several lines of a group the
    last counts, what names no use or says neither yes nor no is left out."""
    rows = _robots_lines(files).where("g > 0")
    agents = rows.where((F.col("field") == "user-agent") & (F.col("value") != "")).select("host", "g", F.lower("value").alias("agent")).distinct()
    said = rows.where(F.col("field") == "content-signal").select("host", "g", "line", F.posexplode(F.split("value", ",")).alias("at", "pair"))
    said = said.select("host", "g", "line", "at", F.lower(F.trim(F.substring_index("pair", "=", 1))).alias("use"), F.lower(F.trim(F.regexp_extract("pair", "=(.*)$", 1))).alias("preference"))
    last = said.where(F.col("use").isin(*USES) & F.col("preference").isin("yes", "no")).groupBy("host", "g", "use").agg(F.max_by("preference", F.struct("line", "at")).alias("preference"))
    return agents.join(last, ["host", "g"]).select("host", "agent", "use", "preference")


def groups_of(rules_: DataFrame, agents: DataFrame) -> DataFrame:
    """host, crawler, kind, pattern: the rules that hold for each crawler, those of the longest declared name that begins its
    own, of * if there is none. agents: crawler; a few rows. Groups without a rule keep a row with nulls."""
    starts = F.lower("crawler").startswith(F.col("agent")) | (F.col("agent") == "*")
    length = F.when(F.col("agent") == "*", 0).otherwise(F.length("agent"))
    declared = rules_.select("host", "agent").distinct().crossJoin(F.broadcast(agents.select("crawler"))).where(starts)
    best = declared.groupBy("host", "crawler").agg(F.max_by("agent", length).alias("agent"))
    return best.join(rules_, ["host", "agent"]).select("host", "crawler", "kind", "pattern")


def _pattern(pattern: Column) -> Column:
    """A rule's pattern as a regular expression: * is anything, a last $ the end."""
    regex = F.concat(F.lit(r"^\Q"), F.replace(pattern, F.lit("*"), F.lit(r"\E.*\Q")), F.lit(r"\E"))
    return F.when(pattern.endswith("$"), F.concat(F.regexp_replace(regex, r"\$\\E$", r"\\E"), F.lit("$"))).otherwise(regex)


def allowed_for(paths: DataFrame, rules_: DataFrame, agents: DataFrame) -> DataFrame:
    """host, path, crawler, allowed of each path and crawler. The longest pattern that matches decides, allow wins ties, and
    without one all is allowed. Rules are the small side, a few a host; paths are joined to them by host."""
    own = groups_of(rules_, agents).where(F.coalesce("pattern", F.lit("")) != "").select("host", "crawler", "kind", F.length("pattern").alias("length"), _pattern(F.col("pattern")).alias("regex"))
    hits = paths.join(own, "host").where(F.expr("rlike(path, regex)"))
    verdict = hits.groupBy("host", "path", "crawler").agg(F.max(F.struct("length", (F.col("kind") == "allow").alias("allow")))["allow"].alias("allow"))
    rows = paths.crossJoin(F.broadcast(agents)).join(verdict, ["host", "path", "crawler"], "left")
    return rows.select("host", "path", *agents.columns, F.coalesce("allow", F.lit(True)).alias("allowed"))


def allowed(paths: DataFrame, rules_: DataFrame, agent: str) -> DataFrame:
    """host, path, allowed for one crawler. paths: host, path."""
    agents = paths.sparkSession.createDataFrame([(agent,)], "crawler string")
    return allowed_for(paths, rules_, agents).drop("crawler")


def robots_access(rules_: DataFrame, agents: DataFrame) -> DataFrame:
    """host, crawler, blocked (the whole site), restrictions (the patterns that bar a path, in order): of each crawler whose rules a host
    declares, by name or for all."""
    own = groups_of(rules_, agents)
    barred = F.when((F.col("kind") == "disallow") & (F.col("pattern") != ""), F.col("pattern"))
    listed = own.groupBy("host", "crawler").agg(F.array_sort(F.collect_set(barred)).alias("restrictions"))
    root = allowed_for(rules_.select("host", F.lit("/").alias("path")).distinct(), rules_, agents)
    return listed.join(root, ["host", "crawler"]).select("host", "crawler", (~F.col("allowed")).alias("blocked"), "restrictions")


def robots_status(status: Column) -> Column:
    """What an answer says of a site's rules: absent for 404 and 410, read for 200 to 299, unavailable for all else."""
    return F.when(status.isin(404, 410), "absent").when(status.between(200, 299), "read").otherwise("unavailable")


def presence(platforms: DataFrame, key: str) -> DataFrame:
    """key, answered, found, unchecked: on how many platforms a brand was found, of those that answered. platforms: key, found
    (null: no answer)."""
    return platforms.groupBy(key).agg(F.count("found").alias("answered"), F.count_if("found").alias("found"), F.count_if(F.col("found").isNull()).alias("unchecked"))


def crawl_depth(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, depth: the fewest links from a root. The frontier goes on by joins until nothing new is found; each level is
    written to the checkpoint folder, so a lost executor costs one level."""
    from sitelode.operators.lineage import cut

    seen = cut(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in count(1):
        found = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if depth % 20 == 0:  # a plan of few tables, however many levels there are
            seen = cut(seen.coalesce(edges.sparkSession.sparkContext.defaultParallelism))


def broken_links(edges: DataFrame, status: DataFrame) -> DataFrame:
    """Broken pages (status 400 and up, or 0) and how many pages link to them."""
    bad = status.where((F.col("status") >= 400) | (F.col("status") == 0))
    return bad.join(edges.select(F.col("dst").alias("node"), "src").distinct(), "node").groupBy("node", "status").agg(F.count("*").alias("found_on"))
