"""The queries of this subpackage, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitelode.llm import alignment, anchors, decontamination, elkan, katz, langid, mixing, simhash, token_counts, toolcalls, toxicity, vptree, warc
from sitelode.llm.common import remainder, table


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = toolcalls.link(*toolcalls.of_turns(table(spark, sf_dir, "conversations")), toolcalls.SCHEMAS)
    return linked.select("conv_id", "call_id", "place", "name", "level", "copies", "result_place", "status", "valid", "json")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), remainder("doc_id", 4) == 2
    return langid.identify(docs, langid.profiles(docs.where(~held)), held)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read(spark, warc.write(table(spark, sf_dir, "pages"), revisit_from=0))
    return read.where("gap IS NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vptree.usable(table(spark, sf_dir, "embeddings"))
    return vptree.nearest(vectors, vectors.where("id % 100 = 0"), k=10, factor=1.0)


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(table(spark, sf_dir, "documents"), katz.fold(7, 2))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.remove_repeats(table(spark, sf_dir, "documents"), window=35)


def op12_elkan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elkan.clusters(elkan.integers(table(spark, sf_dir, "embeddings")), k=16, rounds=3, seed=1)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit_sample(*toxicity.sample(docs, labels, remainder("id", 5) == 0))
    return toxicity.score(docs, model, remainder("doc_id", 5) == 0, spans=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tool_calls": op1_tool_calls,
    "op2_simhash": op2_simhash,
    "op3_langid": op3_langid,
    "op4_warc": op4_warc,
    "op5_vptree": op5_vptree,
    "op6_katz": op6_katz,
    "op7_token_counts": op7_token_counts,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_decontamination": op10_decontamination,
    "op11_anchors": op11_anchors,
    "op12_elkan": op12_elkan,
    "op13_alignment": op13_alignment,
}

ORACLES: dict[str, str] = {"op1_tool_calls": toolcalls.ORACLE, "op4_warc": warc.ORACLE, "op5_vptree": vptree.ORACLE, "op8_mixing": mixing.ORACLE, "op11_anchors": anchors.ORACLE, "op12_elkan": elkan.ORACLE}
