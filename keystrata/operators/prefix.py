"""Running sums inside groups of any size.

A window over a group is one task. Where a group has more than `rows` rows, its order is cut at
sampled points into buckets; windows run inside (group, bucket), and what comes before a bucket is a
running sum over at most MOST_POINTS + 1 totals a group. Points only decide where work is done: a sum
is the same wherever the cuts fall.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS, MOST_POINTS, SAMPLE = 1_000_000, 1023, 50_000


def bucket_of(order: str, points: list) -> Column:
    """Number of points at or below a value, by a balanced tree of comparisons."""
    if not points:
        return F.lit(0)

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(order) < F.lit(points[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(points))


def split_points(df: DataFrame, order: str, buckets: int, total: int) -> list:
    """Values that cut the order into about equal parts, from a sample of about SAMPLE rows."""
    share = min(1.0, SAMPLE / max(1, total))
    seen = df.select(order).filter(F.col(order).isNotNull())
    seen = [r[0] for r in (seen.sample(share, 11) if share < 1 else seen).orderBy(order).collect()]
    return sorted({seen[len(seen) * i // buckets] for i in range(1, buckets)}) if seen else []


def running_sums(df: DataFrame, group: str, order: str, values: dict[str, Column], rows: int = ROWS) -> DataFrame:
    """`df` with each value's running sum, its own row included; `order` is distinct inside a group, null first."""
    total, most = df.groupBy(group).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if most <= rows:
        w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: F.sum(v).over(w) for n, v in values.items()})
    points = split_points(df, order, min(MOST_POINTS + 1, -(-total // rows)), total)
    made = df.withColumns({f"_{n}": v for n, v in values.items()}).withColumn("_bucket", bucket_of(order, points))
    totals = made.groupBy(group, "_bucket").agg(*(F.sum(f"_{n}").alias(f"_{n}") for n in values))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(group).alias("_group"), F.col("_bucket").alias("_at"), *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in values))
    inside = Window.partitionBy(group, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = made.withColumns({f"_{n}": F.sum(f"_{n}").over(inside) for n in values})
    joined = local.join(totals, local[group].eqNullSafe(totals["_group"]) & (local["_bucket"] == totals["_at"]))
    return joined.select(*[local[c] for c in df.columns], *((F.col(f"_{n}") + F.col(f"_before_{n}")).alias(n) for n in values))
