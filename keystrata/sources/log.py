"""Change logs: the canonical view over `events`, and deterministic generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_WIDTH = 1000
LOG_SCHEMA = "seq bigint, key string, value string, is_tombstone boolean"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, run, key, value, is_tombstone; an `error` event is a delete of its user's key."""
    e = table(spark, sf_dir, "events")
    dead = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("seq"),
        F.floor(F.col("event_id") / RUN_WIDTH).alias("run"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        F.when(~dead, F.concat("event_type", F.lit("="), "props")).alias("value"),
        dead.alias("is_tombstone"),
    )


def lineitem_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wider log: several versions of (order, line) keys, ordered by ship date and content."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws(":", F.lit("line"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("key"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("seq"),
        F.when(F.col("l_returnflag") != "R", F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))).alias("value"),
        (F.col("l_returnflag") == "R").alias("is_tombstone"),
    )


def crash_writer(spark: SparkSession, n: int, value_bytes: int = 16384) -> DataFrame:
    """`key:i` with the first `value_bytes` bytes of `i:` repeated."""
    unit = F.concat(F.col("id").cast("string"), F.lit(":"))
    times = F.ceil(F.lit(value_bytes) / F.length(unit)).cast("int")
    return spark.range(n).select(
        F.col("id").alias("seq"), F.concat(F.lit("key:"), F.col("id").cast("string")).alias("key"),
        F.substring(F.repeat(unit, times), 1, value_bytes).alias("value"), F.lit(False).alias("is_tombstone"),
    )


def benchmark_keys(spark: SparkSession, n: int = 16384, value_bytes: int = 256) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("seq"), F.format_string("k%08d", F.col("id")).alias("key"), F.lit("v" * value_bytes).alias("value"), F.lit(False).alias("is_tombstone"))
