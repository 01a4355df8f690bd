"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns a
DataFrame that is written as Parquet and read again as the next one's `docs`. All but the last
return the columns of `docs`, whatever their names; rows travel as a struct, so no column of the
stage's own can clash with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import attention_mil, bwt_dedup, mixing, packing, simhash
from keystrata.llm.common import all_columns, cut, in_order
from keystrata.llm.queries import read, vocabulary

THRESHOLD = 0.3


def _rows(docs: DataFrame) -> DataFrame:
    """row (all columns), doc_id and text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score, learned from labels outside the held-out fold, is below the threshold go.

    Null and empty texts have the score of an empty passage; equal rows share a score; a null doc_id
    has no label but is scored. A score equal to the threshold stays. An empty table stays empty.
    """
    model = attention_mil.fit(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return attention_mil.score(_rows(docs), model, ("row",)).filter(F.col("score") >= THRESHOLD).select(*all_columns(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by Jaccard 0.8 or more of five-word shingles one document stays, that with the smallest doc_id.

    Among rows that share an id, and among those without one, which come first, the first by text stays; so one of equal
    rows stays. All texts without words are one group. An empty table stays empty.
    """
    rows, _ = in_order(docs)
    first = simhash.similar(rows.select(F.col("k").alias("doc_id"), "text")).filter("doc_id = component_id").select(F.col("doc_id").alias("k"))
    return rows.join(first, "k", "left_semi").select(*all_columns(docs))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 100 that start earlier go; a document with nothing left goes with them.

    A cut may fall inside a character; what is left of that character is dropped, and nothing else.
    Texts that were null or empty stay, as empty ones. Rows that share an id are documents of their own,
    in order of their texts; rows without one come first. n_chars follows the text where the column
    is there. An empty table stays empty.
    """
    found = bwt_dedup.dedup(_rows(docs), keep=["row"], whole=True).filter((F.octet_length("kept") > 0) | (F.col("n_bytes") == 0))
    text = F.col("kept").cast("string")
    new = {"text": text, "n_chars": F.length(text).cast("bigint")}
    return found.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them.

    Rows alike in doc_id, source and text are one unit and are taken equally often; null sources are
    a source; texts without words get the whole part of their share. An empty table stays empty.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences, see `packing.pack`; null and empty texts are an end id alone.

    Workers still hold memory of the stages before, so the tokenizer gets a small cache.
    """
    return packing.pack(docs.select("doc_id", "text"), vocabulary("byte_bpe_50k.json"), cache_size=100_000, at_once=1_000_000)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Classifier, components, suffixes and packing are not expressible in SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
