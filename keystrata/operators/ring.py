"""Consistent-hash placement of keys on nodes."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_hex, hash_order, key_hash_int, node_hash_int, order_of, placement_hash

BUCKET_BITS = 12
BROADCAST_POSITIONS = 1_000_000


class ZeroVirtualNodes(ValueError):
    """A ring needs one virtual node or more per node."""


class HashRing:
    """Immutable ring; `add_node` and `remove_node` return a new ring and whether it changed."""

    def __init__(self, virtual_nodes: int = 256, nodes: tuple[str, ...] = ()):
        if virtual_nodes < 1:
            raise ZeroVirtualNodes("virtual node count must be positive")
        self.virtual_nodes, self.nodes = virtual_nodes, tuple(sorted(set(nodes), key=str.encode))
        self._pos = sorted((node_hash_int(n, i), n.encode(), i) for n in self.nodes for i in range(virtual_nodes))

    def add_node(self, node: str) -> tuple["HashRing", bool]:
        return (self, False) if node in self.nodes else (HashRing(self.virtual_nodes, (*self.nodes, node)), True)

    def remove_node(self, node: str) -> tuple["HashRing", bool]:
        return (HashRing(self.virtual_nodes, tuple(n for n in self.nodes if n != node)), True) if node in self.nodes else (self, False)

    def owner(self, key: str) -> str | None:
        return self.owner_of_hash(key_hash_int(key))

    def owner_of_hash(self, h: int) -> str | None:
        if not self._pos:
            return None
        i = bisect_left(self._pos, (h,))
        return self._pos[i % len(self._pos)][1].decode()

    def positions(self, spark: SparkSession) -> DataFrame:
        rows = [(f"{h:016x}", n.decode(), i) for h, n, i in self._pos]
        return spark.createDataFrame(rows, "hash string, node_id string, vnode int")

    def owners(self, keys: DataFrame, key: str = "key") -> DataFrame:
        """`keys` with a `node_id` column, whatever the names of the others."""
        return _placed(keys, key, {"node_id": self})


def _spans(rings: list[HashRing]) -> list[tuple]:
    """(bucket, low, high, node of each ring): keys of low < order <= high inside the bucket."""
    ends = sorted({h for r in rings for h, _, _ in r._pos} | {(1 << 64) - 1})
    rows, width = [], 64 - BUCKET_BITS
    for a, b in zip([-1, *ends[:-1]], ends, strict=True):
        nodes = [r.owner_of_hash(b) for r in rings]
        for bucket in range((a + 1) >> width, (b >> width) + 1):
            rows.append((bucket, order_of(a) if a >= 0 else None, order_of(b), *nodes))
    return rows


def _placed(keys: DataFrame, key: str, rings: dict[str, HashRing]) -> DataFrame:
    """Each key's owner on some rings, hashed once: equality on the hash's high bits, then the interval test.

    The interval table has the rings' nodes x virtual_nodes + 2^12 rows whatever the data; it is
    broadcast up to BROADCAST_POSITIONS positions and shuffled on the bucket beyond that.
    """
    names = [f"n{i}" for i in range(len(rings))]
    spans = keys.sparkSession.createDataFrame(_spans(list(rings.values())), "b int, lo bigint, hi bigint, " + ", ".join(f"{n} string" for n in names))
    side = (F.broadcast(spans) if sum(len(r._pos) for r in rings.values()) <= BROADCAST_POSITIONS else spans).alias("s")
    hashed = keys.select(F.struct(*[keys[c] for c in keys.columns]).alias("row"), placement_hash(keys[key]).alias("h"))
    hashed = hashed.select("row", hash_order(F.col("h")).alias("o"), F.shiftright(F.col("h")["hi"], 32 - BUCKET_BITS).cast("int").alias("b")).alias("k")
    hit = hashed.join(side, (F.col("k.b") == F.col("s.b")) & (F.isnull("s.lo") | (F.col("k.o") > F.col("s.lo"))) & (F.col("k.o") <= F.col("s.hi")), "left")
    return hit.select(*[F.col("k.row")[c].alias(c) for c in keys.columns], *(F.col(f"s.{n}").alias(out) for n, out in zip(names, rings, strict=True)))


def key_hashes(keys: DataFrame, key: str = "key") -> DataFrame:
    return keys.select(key, hash_hex(placement_hash(F.col(key))).alias("hash"))


def balance(owned: DataFrame) -> DataFrame:
    return owned.groupBy("node_id").agg(F.count("*").alias("keys"))


def movement(keys: DataFrame, before: HashRing, after: HashRing) -> DataFrame:
    """Keys whose owner differs between two rings, counted by (from, to)."""
    both = _placed(keys.select("key"), "key", {"from_node": before, "to_node": after})
    return both.filter("from_node <> to_node").groupBy("from_node", "to_node").agg(F.count("*").alias("moved"))


def partitioned_multi_get(log: DataFrame, probes: DataFrame, ring: HashRing) -> DataFrame:
    """Batched reads grouped by owner: each owner answers its own keys."""
    from .merge import lookup

    return ring.owners(lookup(log, probes))
