"""Immutable runs: entries, layout arithmetic, layer probes, memtable sizing, compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .merge import live, newest_wins
from .prefix import ROWS, running_sums


def record_bytes(key: Column, value: Column) -> Column:
    """Framed size of a record: two 4-byte lengths, the key, and the value unless deleted."""
    return (F.lit(8) + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("bigint")


def run_entries(log: DataFrame) -> DataFrame:
    """Newest version of each key inside each run, tombstones kept."""
    w = F.max_by(F.struct("value", "is_tombstone", "seq"), F.col("seq")).alias("w")
    return log.groupBy("run", "key").agg(w).select("run", "key", "w.value", "w.is_tombstone", "w.seq")


def run_stats(entries: DataFrame) -> DataFrame:
    body = record_bytes(F.col("key"), F.col("value"))
    return entries.groupBy("run").agg(
        F.count("*").alias("entries"),
        F.sum(F.col("is_tombstone").cast("bigint")).alias("tombstones"),
        F.min("key").alias("min_key"), F.max("key").alias("max_key"),
        F.sum(body).alias("index_offset"),
        (F.sum(body) + F.sum(F.lit(12) + F.octet_length("key")) + 8).cast("bigint").alias("file_size"),
    )


def index_offsets(entries: DataFrame, rows: int = ROWS) -> DataFrame:
    """Where each entry of a run begins: the bytes of those before it in key order."""
    body = record_bytes(F.col("key"), F.col("value"))
    summed = running_sums(entries.select("run", "key", body.alias("b")), "run", "key", {"upto": F.col("b")}, rows)
    return summed.select("run", "key", (F.col("upto") - F.col("b")).cast("bigint").alias("entry_offset"))


def log_bytes(log: DataFrame, rows: int = ROWS) -> DataFrame:
    """Framed size of each record, and of a run's log up to and with it."""
    size = record_bytes(F.col("key"), F.col("value"))
    summed = running_sums(log.select("run", "seq", size.alias("record_bytes")), "run", "seq", {"log_bytes": F.col("record_bytes")}, rows)
    return summed.select("seq", "record_bytes", "log_bytes")


def layers_probed(entries: DataFrame) -> DataFrame:
    """Runs a point read touches before it stops: newest run first, one row per key."""
    runs = entries.agg(F.max("run").alias("last"), F.countDistinct("run").alias("n"))
    return entries.groupBy("key").agg(F.max("run").alias("newest")).crossJoin(runs).select("key", (F.col("last") - F.col("newest") + 1).alias("layers"))


def memtable_trace(log: DataFrame, rows: int = ROWS) -> DataFrame:
    """Running byte size and entry count of a sorted in-memory table after each write.

    The size change of a write depends on the key's previous write only, so it is a window per
    key; the running sum is ordered per run, which is the unit that a flush resets.
    """
    size = (F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).cast("bigint")
    per_key = Window.partitionBy("run", "key").orderBy("seq")
    d = log.select("run", "seq", "key", size.alias("sz")).withColumn("prev", F.lag("sz").over(per_key))
    d = d.select("run", "seq", "key", (F.col("sz") - F.coalesce("prev", F.lit(0))).alias("delta"), F.col("prev").isNull().cast("bigint").alias("fresh"))
    return running_sums(d, "run", "seq", {"size_bytes": F.col("delta"), "entries": F.col("fresh")}, rows).drop("delta", "fresh")


def flush_points(log: DataFrame, capacity: int) -> DataFrame:
    """First write of each run at which the table is full (size >= capacity); null: never."""
    full = F.min(F.when(F.col("size_bytes") >= capacity, F.col("seq")))
    return memtable_trace(log).groupBy("run").agg(full.alias("full_at"), F.max("size_bytes").alias("peak_bytes"))


def compact(entries: DataFrame) -> DataFrame:
    """Merge all runs; every older layer is an input, so tombstones may go."""
    return live(newest_wins(entries, "run"))


def compact_stats(entries: DataFrame) -> DataFrame:
    merged = newest_wins(entries, "run").agg(
        F.count("*").alias("k"), F.sum((~F.col("is_tombstone")).cast("bigint")).alias("entries_out"), F.sum(F.col("is_tombstone").cast("bigint")).alias("tombstones_dropped")
    )
    total = entries.agg(F.count("*").alias("entries_in"))
    return total.crossJoin(merged).select("entries_in", "entries_out", (F.col("entries_in") - F.col("k")).alias("superseded"), "tombstones_dropped")


def compaction_difference(log: DataFrame) -> DataFrame:
    """Rows that a scan before and after compaction would disagree on; empty by contract."""
    before, after = live(newest_wins(log)), compact(run_entries(log))
    return before.exceptAll(after).unionByName(after.exceptAll(before))
