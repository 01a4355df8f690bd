"""Newest-wins merge and every read that follows from it.

The winner of a key is chosen first and tombstones are dropped afterwards. Key bounds commute
with the per-key merge and are applied below it, where they reach the Parquet scan; value
predicates never are. `max_by` combines before the shuffle, so a hot key costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_KEYS = 100_000


def newest_wins(log: DataFrame, version: str = "seq") -> DataFrame:
    """One row per key: its newest version, tombstones included."""
    pick = F.max_by(F.struct("value", "is_tombstone"), F.col(version)).alias("w")
    return log.groupBy("key").agg(pick).select("key", "w.value", "w.is_tombstone")


def newest_versions(log: DataFrame) -> DataFrame:
    """As `newest_wins`, with the version; of rows alike in key and version the greatest (value, is_tombstone)."""
    pick = F.max(F.struct("seq", "value", "is_tombstone")).alias("w")
    return log.groupBy("key").agg(pick).select("key", "w.value", "w.is_tombstone", "w.seq")


def live(merged: DataFrame) -> DataFrame:
    return merged.filter(~F.col("is_tombstone")).select("key", "value")


def within(key: Column, start: str | None = None, end: str | None = None, prefix: str | None = None) -> Column:
    cond = F.lit(True)
    if start is not None:
        cond = cond & (key >= start)
    if end is not None:
        cond = cond & (key < end)
    return cond & key.startswith(prefix) if prefix is not None else cond


def scan(log: DataFrame, start: str | None = None, end: str | None = None, prefix: str | None = None, as_of: int | None = None, ordered: bool = True) -> DataFrame:
    """Live pairs in key order within half-open bounds or a prefix, optionally as of a version."""
    if as_of is not None:
        log = log.filter(F.col("seq") < as_of)
    rows = live(newest_wins(log.filter(within(F.col("key"), start, end, prefix))))
    return rows.orderBy("key") if ordered else rows


def raw_scan(log: DataFrame) -> DataFrame:
    return newest_wins(log).orderBy("key")


def lookup(log: DataFrame, probes: DataFrame, n_probes: int | None = None) -> DataFrame:
    """Found / Deleted / NotFound for each distinct probe key.

    Pass `n_probes` when the number of probes is known: up to BROADCAST_KEYS they are broadcast and
    prune the log before the merge; otherwise both sides meet in a shuffle on the key.
    """
    status = F.when(F.col("hit").isNull(), "NotFound").when(F.col("is_tombstone"), "Deleted").otherwise("Found")
    if n_probes is not None and n_probes <= BROADCAST_KEYS:
        probes = probes.select("key").distinct()
        state = newest_wins(log.join(F.broadcast(probes), "key", "left_semi")).withColumn("hit", F.lit(True))
        return probes.join(state, "key", "left").select("key", status.alias("status"), "value")
    # One shuffle on the key for both: a probe is a row without a version, which any version beats.
    asked = probes.select("key", F.lit(True).alias("asked"), F.lit(None).alias("w"))
    known = log.select("key", F.lit(False).alias("asked"), F.struct("seq", "value", "is_tombstone").alias("w"))
    both = asked.unionByName(known).groupBy("key").agg(F.max("asked").alias("asked"), F.max_by("w", "w.seq").alias("w"))
    both = both.filter("asked").select("key", F.when(F.col("w").isNotNull(), True).alias("hit"), "w.value", "w.is_tombstone")
    return both.select("key", status.alias("status"), "value")


def multi_get(log: DataFrame, keys: list[str]) -> DataFrame:
    spark = log.sparkSession
    probes = spark.createDataFrame([(k,) for k in keys], "key string")
    return lookup(log, probes, len(keys)).filter("status = 'Found'").select("key", "value")


def get(log: DataFrame, key: str) -> DataFrame:
    return live(newest_wins(log.filter(F.col("key") == key)))


def merge_layers(layers: list[DataFrame]) -> DataFrame:
    """Merge (key, value, is_tombstone) layers given newest first."""
    out = None
    for age, layer in enumerate(layers):
        one = layer.select("key", "value", "is_tombstone", F.lit(-age).alias("seq"))
        out = one if out is None else out.unionByName(one)
    return newest_wins(out)
