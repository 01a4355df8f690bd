"""One query per operator over its whole table, with the result that the contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_mil, bwt_dedup, cover_tree, grammar_store, kneser_ney, mixing, packing, quality_rules, sentence_spans, simhash
from .common import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mixing.plan(read(spark, sf_dir, "documents")).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return p.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op3_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = quality_rules.judge(read(spark, sf_dir, "documents"))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = attention_mil.score(docs, attention_mil.fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_repair_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar_store.read_documents(grammar_store.write_shards(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op6_bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = bwt_dedup.dedup(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return r.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return r.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.train_and_score(read(spark, sf_dir, "documents"))


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sentence_spans.dedup(read(spark, sf_dir, "documents"))
    return r.select("doc_id", F.size("units").cast("bigint").alias("n_sentences"), F.size("removed").cast("bigint").alias("n_removed"), F.md5(F.col("kept_text").cast("binary")).alias("kept_md5"))


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(read(spark, sf_dir, "embeddings"))


QUERIES |= {f.__name__: f for f in (op1_harmonic_packing, op2_pivotal_mixing, op3_weak_supervision, op4_attention_mil, op5_repair_grammar, op6_bwt_merge, op7_simhash_tiles, op8_kneser_ney, op9_sentence_spans, op10_cover_tree)}
ORACLES["op9_sentence_spans"] = sentence_spans.ORACLE
