"""Mixing sources to target weights by capped water-filling, with DataFrame operations only.

Each source gets its weight's share of ``share`` times all words, but at most
``epochs`` times its own words. What a capped source can't take is shared out
again by weight among the others, until no target is above its cap. In closed
form: sources are ordered by the level (words per unit of weight) at which they
reach their cap; the water level is that of the first source which, once all
before it are capped, stays below its own.

A source's words are taken in whole repetitions and one fractional one. For the
latter documents are ordered by a seeded hash into ``buckets`` buckets: those of
the lower buckets are taken whole once more, those of the bucket in which the
target is reached in the same proportion of their words, so that a source comes
within a word a document of that one bucket. No document is taken more than
``epochs`` times its size. Reruns choose alike.

A null text has no words; rows of size 0 take nothing. A null source is a
source of its own, the last. Rows that repeat an id and text are alike and
share a bucket. Columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelode.llm.common import WORD, materialize

WEIGHTS = (5, 2, 1)


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", buckets: int = 4096, seed: int = 42) -> DataFrame:
    """doc_id, source, size in words, bucket: a row per document."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), F.col(text_col))), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int").alias("bucket"),
    )


def targets(of_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: float = 3.0, share: float = 1.0) -> DataFrame:
    """of_source (source, source_size), a row each, plus target."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place - 1, F.lit(len(weights))).cast("int") + 1)
    cap = epochs * F.col("source_size")
    rows = of_source.withColumn("weight", weight).withColumn("cap", cap).withColumn("own_level", F.col("cap") / F.col("weight"))
    before = Window.orderBy("own_level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    goal = F.sum("source_size").over(everything) * share
    left_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (goal - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / left_weight
    rows = rows.withColumn("level", level)
    rows = rows.withColumn("nth", F.row_number().over(Window.orderBy("own_level", F.col("source").asc_nulls_last())))
    water = F.min(F.when(F.col("level") < F.col("own_level"), F.struct("nth", "level"))).over(everything)["level"]
    return rows.withColumn("water", water).select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("water"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: float = 3.0, share: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", buckets: int = 4096, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target (of the source), taken (words of the document in the mix): one row per input row."""
    rows = materialize(sizes(docs, id_col, text_col, source_col, buckets, seed), "sizes")
    per_bucket = materialize(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    goal = targets(per_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), weights, epochs, share)
    rate = F.try_divide(F.col("target"), F.col("source_size"))
    goal = goal.withColumn("whole", F.floor(F.coalesce(rate, F.lit(0.0)))).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = materialize(goal, "targets")
    # the bucket in which the fractional repetition ends, and how much of it is taken
    running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    sums = per_bucket.withColumn("upto", running).alias("b").join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source")))
    last = F.min(F.when(F.col("upto") >= F.col("rest"), F.struct("bucket", F.try_divide(F.col("rest") - (F.col("upto") - F.col("words")), F.col("words")).alias("part"))))
    ends = sums.groupBy("g.source").agg(last.alias("last"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("whole").alias("whole"))
    ends = materialize(ends.select("source", "source_size", "target", "whole", F.col("last.bucket").alias("end"), F.col("last.part").alias("part")), "ends")
    again = F.when(F.col("end").isNull(), F.lit(0)).when(F.col("bucket") < F.col("end"), F.col("size")).when(F.col("bucket") == F.col("end"), F.floor(F.col("size") * F.coalesce("part", F.lit(0.0)) + 1e-9)).otherwise(F.lit(0))
    taken = F.least(F.col("whole") * F.col("size") + again, F.floor(F.lit(epochs) * F.col("size"))).cast("long")
    return rows.alias("d").join(ends.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source"))).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


#: The same in DuckDB's SQL, for the default parameters.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(concat_ws('|', '42', doc_id::VARCHAR, text)), 1, 8))::BIGINT % 4096)::INT AS bucket
  FROM documents),
b AS (SELECT source, bucket, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
s AS (SELECT source, sum(words)::BIGINT AS source_size FROM b GROUP BY ALL),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, cap / weight AS own_level, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS nth FROM w),
c AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level
  FROM l WINDOW p AS (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, coalesce(weight * (SELECT arg_min(level, nth) FROM c WHERE level < own_level), cap)) AS target FROM c),
g AS (SELECT *, floor(coalesce(target / nullif(source_size, 0), 0)) AS whole, target - floor(coalesce(target / nullif(source_size, 0), 0)) * source_size AS rest FROM t),
r AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY bucket) AS upto FROM b),
e AS (
  SELECT g.source, source_size, target, whole, rest,
         min(bucket) FILTER (upto >= rest) AS stop, arg_min((rest - (upto - words)) / nullif(words, 0), bucket) FILTER (upto >= rest) AS part
  FROM g JOIN r ON g.source IS NOT DISTINCT FROM r.source GROUP BY ALL)
SELECT doc_id, size, source_size, target,
       least(whole * size + CASE WHEN stop IS NULL THEN 0 WHEN bucket < stop THEN size WHEN bucket = stop THEN floor(size * coalesce(part, 0) + 1e-9) ELSE 0 END, floor(3.0 * size))::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
