"""Text queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelode.functions import text as fx
from sitelode.sources.tables import table



def _t():
    return F.col("text")


def _lang_codes(s, d):
    """Codes made of parts' names, brands and sizes: bare ones, with regions and scripts, and of no language."""
    two, n = F.substring("p_name", 1, 2), F.col("p_partkey")
    code = F.when(n % 5 == 0, two).when(n % 5 == 1, F.concat(two, F.lit("-"), F.substring("p_type", 1, 2))).when(n % 5 == 2, F.concat(two, F.lit("_hant_"), F.substring("p_type", 2, 2)))
    code = code.when(n % 5 == 3, F.concat(two, F.lit("-"), (F.col("p_size") + 400).cast("string"))).when(n % 35 == 4, "X-Default").when(n % 35 == 9, "uk").when(n % 35 == 14, "english").otherwise("pt-br ")
    return table(s, d, "part").select("p_partkey", code.alias("code")).select("p_partkey", "code", fx.lang_code(F.col("code")).alias("normal"), fx.meant_region(F.col("code")).alias("meant"))


def _measured(s, d):
    rows = table(s, d, "documents").select("doc_id", F.size(fx.words(_t())).alias("words"), fx.sentences(_t()).alias("sentences"), fx.paragraphs(_t()).alias("paragraphs"), fx.syllables(_t()).alias("syllables"))
    return rows.select("doc_id", "words", "sentences", "paragraphs", "syllables", F.coalesce(F.try_divide("words", "sentences"), F.lit(0.0)).alias("words_per_sentence"), F.coalesce(F.try_divide("syllables", "words"), F.lit(0.0)).alias("syllables_per_word"))


def _readability(s, d):
    w, n, y = F.col("words"), F.col("sentences"), F.col("syllables")
    rows = _measured(s, d).withColumns({"ease": fx.reading_ease(w, n, y), "grade": fx.grade_level(w, n, y)})
    return rows.select("doc_id", "ease", "grade", fx.ease_label(F.col("ease")).alias("label"))


def _density(s, d):
    low = F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    rows = table(s, d, "documents").select("doc_id", low.alias("w"))
    ratio = fx.half_up(F.try_divide(F.size(F.array_distinct("w")), F.size("w")), 3)
    return rows.select("doc_id", F.coalesce(ratio, F.lit(0.0)).alias("density"))


def _coverage(s, d):
    q = F.array_distinct(fx.significant(F.col("p_name"), F.lit("en")))
    title = fx.tokens(F.concat_ws(" ", F.lit("Small red widgets and"), "p_type"))
    rows = table(s, d, "part").select("p_partkey", q.alias("q"), fx.missing(q, title).alias("m"))
    fit = F.when(F.size("m") == 0, "all").when(F.size("m") < F.size("q"), "some").otherwise("none")
    return rows.select("p_partkey", F.array_join("m", " ").alias("missing"), fit.alias("fit"))


def _meta(s, d):
    head = F.substring("html", 1, 60000)
    title = F.regexp_extract(head, r"(?is)<title[^>]*>(.*?)</title>", 1)
    plain = title
    for code, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(code), F.lit(c))
    return table(s, d, "pages").select("page_id", F.trim(plain).alias("title"), F.regexp_extract(head, r'(?i)<html[^>]*\slang="([^"]*)"', 1).alias("lang"))


QUERIES = {
    "word_counts": lambda s, d: table(s, d, "documents").select("doc_id", F.size(fx.words(_t())).alias("words")),
    "text_metrics": _measured,
    "readability": _readability,
    "lexical_density": _density,
    "query_coverage": _coverage,
    "lang_codes": _lang_codes,
    "stat_counts": lambda s, d: table(s, d, "documents").select("doc_id", F.regexp_count("text", F.lit(fx.STATISTIC)).alias("n")),
    "defines_something": lambda s, d: table(s, d, "documents").select("doc_id", fx.defines_something(_t(), F.col("lang")).alias("defines")),
    "entity_density": lambda s, d: table(s, d, "documents").select("doc_id", fx.entity_density(_t()).alias("density")),
    "page_meta": _meta,
}

_WORDS = r"list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: regexp_matches(w, '[\p{L}\p{N}]'))"
_M = rf"""WITH w AS (SELECT doc_id, text, {_WORDS} AS w FROM documents),
y AS (SELECT *, list_transform(w, lambda x: lower(x)) AS l, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean FROM w),
n AS (SELECT doc_id, len(w)::INT AS words, CASE WHEN clean = '' THEN 0 ELSE greatest(1, len(list_filter(regexp_split_to_array(clean, '[.!?]+'), lambda s: trim(s) <> ''))) END::INT AS sentences,
  CASE WHEN clean = '' THEN 0 ELSE greatest(1, len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda s: regexp_matches(s, '\S')))) END::INT AS paragraphs,
  coalesce(list_sum(list_transform(l, lambda x: CASE WHEN length(x) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(regexp_replace(regexp_replace(x, '(?:[^laeiouy]es|ed|[^laeiouy]e)$', ''), 'y$', ''), '[aeiouy]{{1,2}}'))) END)), 0)::INT AS syllables FROM y),
m AS (SELECT *, coalesce(words / nullif(sentences, 0), 0) AS words_per_sentence, coalesce(syllables / nullif(words, 0), 0) AS syllables_per_word FROM n)"""
ORACLES = {
    "word_counts": f"SELECT doc_id, len({_WORDS})::INT AS words FROM documents",
    "text_metrics": f"{_M} SELECT * FROM m",
    "readability": f"""{_M}, r AS (SELECT doc_id, CASE WHEN words > 0 THEN floor(greatest(0, least(100, 206.835::DOUBLE - 1.015::DOUBLE * (words / sentences) - 84.6::DOUBLE * (syllables / words))) * 10 + 0.5::DOUBLE) / 10 ELSE 0 END AS ease,
  CASE WHEN words > 0 THEN floor(greatest(0, 0.39::DOUBLE * (words / sentences) + 11.8::DOUBLE * (syllables / words) - 15.59::DOUBLE) * 10 + 0.5::DOUBLE) / 10 ELSE 0 END AS grade FROM m)
SELECT *, CASE WHEN ease >= 90 THEN 'very easy' WHEN ease >= 80 THEN 'easy' WHEN ease >= 70 THEN 'fairly easy' WHEN ease >= 60 THEN 'standard' WHEN ease >= 50 THEN 'fairly difficult' WHEN ease >= 30 THEN 'difficult' ELSE 'very difficult' END AS label FROM r""",
    "lexical_density": r"""WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, coalesce(floor(len(list_distinct(w)) / nullif(len(w), 0) * 1000 + 0.5) / 1000, 0) AS density FROM w""",
    "query_coverage": """WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS q, ['small', 'red', 'widgets', 'and', lower(p_type)] AS t FROM part),
m AS (SELECT p_partkey, q, list_filter(q, lambda x: NOT (list_contains(t, x) OR list_contains(t, x || 's') OR list_contains(t, x || 'es') OR list_contains(list_transform(t, lambda y: y || 's'), x))) AS m FROM t)
SELECT p_partkey, array_to_string(m, ' ') AS missing, CASE WHEN len(m) = 0 THEN 'all' WHEN len(m) < len(q) THEN 'some' ELSE 'none' END AS fit FROM m""",
    "lang_codes": f"""WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name[:2] WHEN p_partkey % 5 = 1 THEN p_name[:2] || '-' || p_type[:2] WHEN p_partkey % 5 = 2 THEN p_name[:2] || '_hant_' || p_type[2:3]
  WHEN p_partkey % 5 = 3 THEN p_name[:2] || '-' || (p_size + 400) WHEN p_partkey % 35 = 4 THEN 'X-Default' WHEN p_partkey % 35 = 9 THEN 'uk' WHEN p_partkey % 35 = 14 THEN 'english' ELSE 'pt-br ' END AS code FROM part),
s AS (SELECT *, string_split(lower(replace(code, '_', '-')), '-') AS p FROM c),
l AS (SELECT *, regexp_matches(replace(code, '_', '-'), '(?i)^[a-z]{{2}}(-[a-z]{{4}})?(-([a-z]{{2}}|[0-9]{{3}}))?$') AND p[1] IN ({", ".join(f"'{c}'" for c in fx.LANGUAGES)}) AS good FROM s)
SELECT p_partkey, code, CASE WHEN lower(code) = 'x-default' THEN 'x-default' WHEN good THEN array_to_string(list_concat([p[1]], list_transform(p[2:], lambda x: CASE WHEN length(x) = 4 THEN upper(x[1]) || x[2:] ELSE upper(x) END)), '-') END AS normal,
  CASE lower(code) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fx.CONFUSABLE.items())} END AS meant FROM l""",
    "stat_counts": rf"SELECT doc_id, len(regexp_extract_all(text, '{fx.STATISTIC}'))::INT AS n FROM documents",
    "defines_something": rf"SELECT doc_id, CASE WHEN lang = 'en' THEN regexp_matches(text, '{fx.DEFINES['en']}') WHEN lang = 'es' THEN regexp_matches(text, '{fx.DEFINES['es']}') END AS defines FROM documents",
    "entity_density": r"""WITH t AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> '')) AS s FROM documents),
n AS (SELECT doc_id, coalesce(list_sum(list_transform(s, lambda x: len(x))), 0) AS total, coalesce(list_sum(list_transform(s, lambda x: len(list_filter(x[2:], lambda y: regexp_matches(y, '^\p{Lu}\p{L}'))))), 0) AS proper FROM t)
SELECT doc_id, coalesce(proper / nullif(total, 0), 0)::DOUBLE AS density FROM n""",
    "page_meta": r"""SELECT page_id, trim(replace(replace(replace(replace(replace(regexp_extract(html[:60000], '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS title,
regexp_extract(html[:60000], '(?i)<html[^>]*\slang="([^"]*)"', 1) AS lang FROM pages""",
}
