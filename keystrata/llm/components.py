"""Connected components of a graph that no machine holds.

Every round, each node points to one node among itself and its neighbours, edges are redrawn
between the nodes pointed to, and loops go. Odd rounds point to the smallest id, which ends stars
around it at once; even rounds point to the smallest of a fresh hash, which shrinks any graph, long
paths included, by a constant share in expectation. Aggregates combine before their shuffle, joins
are plain equi-joins that Spark may split when a hub is hot, and each round is written out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each end of an (a, b) edge; nodes of a component share a root.

    Loops, repeated and reversed edges are allowed; rows with a null end are left out.
    """
    e = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).filter("a <> b")
    e = cut(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    while not e.isEmpty():
        n = len(steps)
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # A key orders candidates: the id alone, or a hash of this round before the id.
        key = lambda c, n=n: F.struct((F.lit(0) if n % 2 == 0 else F.xxhash64(F.lit(n), c)).cast("bigint").alias("h"), F.col(c).alias("id"))
        near = both.groupBy("a").agg(F.min(key("b")).alias("least"))
        to = cut(near.select(F.col("a").alias("node"), F.least("least", key("a"))["id"].alias("root")), f"step{n}")
        steps.append(to)
        ra, rb = to.toDF("a", "ra"), to.toDF("b", "rb")
        drawn = e.join(ra, "a").join(rb, "b").filter("ra <> rb")
        new = cut(drawn.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        discard(e)
        e = new
    if not steps:
        return e.sparkSession.createDataFrame([], "node bigint, root bigint")
    out = steps[0]
    for i, to in enumerate(steps[1:]):
        out = out.join(to.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        if i % 4 == 3:
            out = cut(out, f"roots{i}")
    return cut(out, "roots")
