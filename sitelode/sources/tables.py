"""Adapters from a star schema and an event log to search rows, landings and metric readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.functions import urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, query, page, country, device, appearance, clicks, impressions, position: a row per cell."""
    t = lambda name: table(spark, sf_dir, name)
    rows = (
        t("lineitem")
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    page = F.concat(F.lit("https://shop.example.com/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit("/"), F.lower("p_type"))
    return rows.select(
        F.to_date("l_shipdate").alias("date"), F.col("p_name").alias("query"), page.alias("page"), F.col("n_name").alias("country"),
        F.col("o_orderpriority").alias("device"), F.col("l_returnflag").alias("appearance"),
        F.floor(F.col("l_quantity") * F.col("l_discount")).cast("double").alias("clicks"), F.col("l_quantity").alias("impressions"),
        (F.lit(1.0) + F.round(F.col("l_tax") * 100)).alias("position"),
    )


def product_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As search_rows() without country and device, which needs one join only: date, query, page, appearance and measures."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    page = F.concat(F.lit("https://shop.example.com/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit("/"), F.lower("p_type"))
    return rows.select(
        F.to_date("l_shipdate").alias("date"), F.col("p_name").alias("query"), page.alias("page"), F.col("l_returnflag").alias("appearance"),
        F.floor(F.col("l_quantity") * F.col("l_discount")).cast("double").alias("clicks"), F.col("l_quantity").alias("impressions"),
        (F.lit(1.0) + F.round(F.col("l_tax") * 100)).alias("position"),
    )


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with k, the number in its properties."""
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, refresh_id, captured_at, metric, value (null: asked, no answer)."""
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return e.select(F.col("user_id").alias("site_id"), F.col("event_id").alias("refresh_id"), F.col("ts").alias("captured_at"), F.col("event_type").alias("metric"), value.alias("value"))


def page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with host_key, url_key and path_key."""
    p = table(spark, sf_dir, "pages")
    return p.withColumns({"host_key": urls.host_key("url"), "url_key": urls.url_key("url"), "path_key": urls.path_key("url")})


#: The same adapters as DuckDB's common table expressions.
SQL = {
    "search": """search AS (
  SELECT l_shipdate::DATE AS date, p_name AS query, 'https://shop.example.com/' || lower(replace(p_brand, '#', '-')) || '/' || lower(p_type) AS page,
         n_name AS country, o_orderpriority AS device, l_returnflag AS appearance, floor(l_quantity * l_discount)::DOUBLE AS clicks, l_quantity AS impressions, 1.0::DOUBLE + round(l_tax * 100) AS position
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)""",
    "ev": "ev AS (SELECT *, (props->>'$.k')::INT AS k FROM events)",
    "readings": "readings AS (SELECT user_id AS site_id, event_id AS refresh_id, ts AS captured_at, event_type AS metric, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)",
    "pk": r"""pk AS (
  SELECT *, regexp_extract(lower(url), '^https?://(?:www\.)?([^/?#:]+)', 1) AS host_key,
         regexp_extract(lower(url), '^https?://(?:www\.)?([^/?#:]+)', 1) || CASE WHEN rtrim(regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1), '/') = '' THEN '/' ELSE rtrim(regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1), '/') END || regexp_extract(url, '(\?[^#]+)', 1) AS url_key,
         CASE WHEN rtrim(regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1), '/') = '' THEN '/' ELSE rtrim(regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1), '/') END AS path_key
  FROM pages)""",
}
