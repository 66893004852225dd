"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lattica.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.toxicity import held_out, toxicity, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity(docs, train(docs, labels.where(~held_out())))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.embeddings import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lattica.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=3, size=3)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.quality import quality, train

    docs = table(spark, sf_dir, "documents")
    return quality(docs, train(docs, table(spark, sf_dir, "labels")))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.substrings import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents")).drop("twin")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lattica.llm.chat import rotate

    spans = F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m["start"].cast("string"), m["stop"].cast("string"))), ",")
    out = rotate(table(spark, sf_dir, "conversations"))
    return out.withColumn("mask_spans", spans).drop("masks")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from lattica.llm import chat, mixing, substrings

    return {"op3_mixing": mixing.ORACLE, "op9_substring_dedup": substrings.ORACLE, "op10_chat_formatting": chat.ORACLE}
