"""The opN queries: thin wrappers that apply each operator to its whole table with production parameters.

Where a query tells held-out rows by the CRC of doc_id, a row without a doc_id is neither: its ``held_out`` is null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import chat, decontam, embeddings, langid, licenses, linededup, lines_crf, packing, pii, resample, simhash, toxicity, turns
from rasterlake.llm._common import bucket_of, table

KEEP_QUALITY = 0.3


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return chat.read_back(chat.format_windows(rows.unionByName(probe)))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lines_crf.train(docs, table(spark, sf_dir, "labels"))
    out = lines_crf.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= KEEP_QUALITY).cast("int").alias("predicted"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return out.select("doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    report, repaired = turns.repair(turns.damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    digest = turns.digests(repaired).withColumnRenamed("conv_id", "d_id").hint("merge")
    return report.join(digest, report["conv_id"].eqNullSafe(digest["d_id"])).drop("d_id")


def op12_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, least_length=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.draw(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), n=2, buckets=10_000, percent=25, least_words=20, seed=7)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op1_decontamination": op1_decontamination, "op2_chat": op2_chat, "op3_licenses": op3_licenses, "op4_quality": op4_quality, "op5_simhash": op5_simhash, "op6_toxicity": op6_toxicity, "op7_language": op7_language, "op8_packing": op8_packing, "op9_pii": op9_pii, "op10_embeddings": op10_embeddings, "op11_turns": op11_turns, "op12_linededup": op12_linededup, "op13_resample": op13_resample}
ORACLE: dict[str, str] = {"op2_chat": chat.ORACLE, "op3_licenses": licenses.ORACLE, "op11_turns": turns.ORACLE, "op12_linededup": linededup.ORACLE, "op13_resample": resample.ORACLE}
