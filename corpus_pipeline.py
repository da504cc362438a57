"""The corpus pipeline: documents in, a weighted training mix out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.llm import decontamination, langid, mixing, simhash, toxicity
from sitelode.llm.common import materialize, table


#: A text that is nearer to no profile than this share of the largest possible distance is in none of the languages.
NEAR_ENOUGH = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language: without a text or a letter, or too far from every profile (a score below 0.25).

    Where no row has a language to learn from, only texts without a letter go. Null languages teach nothing; repeated rows
    are judged alike; an empty table stays empty; other columns pass through, whatever their names."""
    profiles = langid.profiles(docs)
    if not profiles:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return docs.where(langid.score_of(profiles, F.col("text")) >= NEAR_ENOUGH)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are likelier toxic than not.

    Null and empty texts have the score of a text without toxic words, repeated rows the same one; without labels of both
    kinds the score is the share of toxic labels. An empty table stays empty; other columns pass through."""
    model = toxicity.fit_sample(*toxicity.sample(docs, table(spark, sf_dir, "labels")))
    return docs.where(toxicity.score_of(model, F.col("text")) < 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group at a similarity of 0.8 or more: that of the smallest id, null being the largest.

    Rows are told apart by id and text: of rows that share an id only copies go, and of rows that repeat both one stays.
    Null texts and texts without words are copies of each other. An empty table stays empty; other columns pass through."""
    groups = materialize(simhash.similar_documents(docs), "groups")
    losers = groups.where("uid <> keeper").select(F.col("uid").alias("_loser")).distinct()
    uid = F.xxhash64(docs["doc_id"], docs["text"])
    kept = docs.join(losers, uid == losers["_loser"], "left_anti")
    repeated = groups.groupBy("uid").count().where("count > 1").select(F.col("uid").alias("_repeated"))
    if repeated.isEmpty():
        return kept
    uid = F.xxhash64(kept["doc_id"], kept["text"])
    once = kept.join(repeated, uid == repeated["_repeated"], "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, uid == repeated["_repeated"], "left_anti").unionByName(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item or one with other values.

    Null and empty texts hold none; rows that repeat an id and text go or stay together. An empty table stays empty, as an
    empty benchmark rejects nothing; other columns pass through, whatever their names."""
    found = decontamination.matches(docs, table(spark, sf_dir, "benchmark")).select(F.col("uid").alias("_found")).distinct()
    return docs.join(found, F.xxhash64(docs["doc_id"], docs["text"]) == found["_found"], "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes: doc_id, size, source_size, target, taken.

    Null texts have no words, null sources are one source; repeated rows are taken alike. An empty table gives no rows;
    other columns are ignored."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mix", mix),
]

#: The stages learn models and hash shingles with XXH64, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what each keeps is written to the shared folder once, so later ones don't repeat its work."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
