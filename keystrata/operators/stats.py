"""Deterministic workloads, floor-rank percentiles, first-wins upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import valid_email
from .prefix import ROWS, running_sums


def workload_mix(spark: SparkSession, ops: int, read_pct: int, n_keys: int) -> DataFrame:
    i = F.col("id")
    kind = F.when((i * 37) % 100 < read_pct, "read").otherwise("write")
    return spark.range(ops).select(i.alias("op"), kind.alias("kind"), F.format_string("k%08d", (i * 7919) % n_keys).alias("key"))


def floor_rank_percentiles(samples: DataFrame, group: str, value: str, points: tuple[int, ...] = (50, 95, 99), rows: int = ROWS) -> DataFrame:
    """The element at index (n - 1) * p / 100 in integer division, for each group.

    Values are counted first and ranks are running sums of counts, so a group is as many rows as
    it has distinct values, and equal values cost nothing.
    """
    counts = samples.groupBy(group, value).agg(F.count("*").alias("c"))
    ranked = running_sums(counts, group, value, {"upto": F.col("c")}, rows)
    sizes = counts.groupBy(F.col(group).alias("g_")).agg(F.sum("c").alias("n"))
    ranked = ranked.join(sizes, F.col(group).eqNullSafe(F.col("g_")))
    picks = [F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * p / 100), F.col(value))).alias(f"p{p}") for p in points]
    return ranked.groupBy(group).agg(F.max("n").alias("n"), *picks)


def ops_per_second(samples: DataFrame, group: str, elapsed: str) -> DataFrame:
    return samples.groupBy(group).agg(F.count("*").alias("ops"), (F.count("*") / F.sum(elapsed)).alias("ops_per_sec"))


def first_wins(signups: DataFrame, arrival: str = "arrival") -> DataFrame:
    """One row per normalised e-mail address, the earliest; invalid addresses are left out."""
    email = F.lower(F.trim("email"))
    rows = signups.select(email.alias("email"), F.substring(F.coalesce("source", F.lit("unknown")), 1, 40).alias("source"), F.substring("user_agent", 1, 400).alias("user_agent"), arrival)
    rows = rows.filter(valid_email(F.col("email")))
    return rows.groupBy("email").agg(F.min_by(F.struct("source", "user_agent"), arrival).alias("f"), F.min(arrival).alias(arrival)).select("email", "f.source", "f.user_agent", arrival)
