"""SimHash near-duplicates by exact tiled comparison.

Of radius + k bands of bits, fingerprints within `radius` bits agree on k at least, so only
fingerprints that share some k bands are compared, in tiles: numpy exclusive-or and bit counts over
blocks in order of population count, where a pair of blocks whose counts differ by more than the
radius is skipped. k follows from the number of fingerprints: more bands send each fingerprint more
often, and to far fewer others; the links are the same. A key with more fingerprints than a tile holds
is dealt by population count into several tiles, and pairs of tiles within the radius become tasks of
their own.

A tile reports links as stars, never all pairs; components are then found on distinct fingerprints.

`similar` links by shingle Jaccard instead. Bits that such a radius needs leave no useful band, so
every pair of distinct shingle sets of like size is compared, strip by strip, and near pairs are verified.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted, text_or_empty
from .components import components
from .unions import merge

SEED = 42
TILE = 2048
BLOCK = 256
#: Shingle sets in a strip; a task compares two strips.
STRIP = 32_768


def hashes(text: str, shingle: int = 4, seed: int = SEED) -> np.ndarray:
    """One hash per word shingle, repeats included; a shorter text is one shingle, one without words none."""
    from xxhash import xxh64_intdigest as digest

    words = text.encode("utf-8", "replace").lower().split()  # lower() of bytes is A-Z alone; split() is space and \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    return np.array([digest(joined[a:b], seed) for a, b in zip(begins, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashed: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashed), 4096):
        part = hashed[i : i + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashed), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, shingle: int = 4, seed: int = SEED) -> int:
    """64 bits over word shingles, repeats included; 0 for a text without words."""
    return majority(hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits in a BIGINT). A null text has no words."""

    def encode(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(encode, "doc_id bigint, fp bigint")


def star_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the radius among distinct fingerprints, as (member, smallest of its group)."""
    count = np.bitwise_count(fps)
    order = np.argsort(count, kind="stable")
    fps, count = fps[order], count[order].astype(np.int64)
    root = np.arange(len(fps))
    for a in range(0, len(fps), BLOCK):
        x, top = fps[a : a + BLOCK], count[min(a + BLOCK, len(fps)) - 1]
        for b in range(a, len(fps), BLOCK):
            if count[b] - top > radius:
                break  # this block and all after it have too many ones
            i, j = np.nonzero(np.bitwise_count(x[:, None] ^ fps[None, b : b + BLOCK]) <= radius)
            root = merge(root, i + a, j + b)
    member = np.flatnonzero(root != np.arange(len(fps)))
    return fps[member], fps[root[member]]


def bands(n: int, radius: int, row_cost: int = 1000) -> tuple[list[int], int]:
    """Widths of the bands, and how many of them a key has, for n fingerprints: cheapest when sending one costs `row_cost` comparisons."""
    best = None
    for k in range(1, 6):
        parts = radius + k
        widths = [64 // parts + (i < 64 % parts) for i in range(parts)]
        cost = math.comb(parts, k) * (row_cost + n / 2 ** (64 * k / parts))
        if best is None or cost < best[0]:
            best = cost, widths, k
    return best[1], best[2]


def links(fps: DataFrame, radius: int = 4, n: int | None = None) -> DataFrame:
    """(a, b) edges that connect all fingerprints within `radius` bits; `fps` has distinct fp values, n of them."""
    widths, k = bands(fps.count() if n is None else n, radius)
    places = np.cumsum(widths) - widths
    keys = []
    for i, some in enumerate(itertools.combinations(range(len(widths)), k)):
        mask = sum(((1 << widths[b]) - 1) << int(places[b]) for b in some)
        keys.append(F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint")).alias("key")))
    rows = fps.select("fp", F.bit_count("fp").alias("ones"), F.explode(F.array(*keys)).alias("k")).select("fp", "ones", "k.*")
    hist = cut(rows.groupBy("band", "key", "ones").agg(F.count("*").alias("c")), "bands")
    sizes = hist.groupBy("band", "key").agg(F.sum("c").alias("n"))
    calm = rows.join(sizes.filter(f"n between 2 and {TILE}"), ["band", "key"]).groupBy("band", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
    hot = hist.join(sizes.filter(f"n > {TILE}").select("band", "key"), ["band", "key"]).withColumn("parts", F.ceil(F.col("c") / (TILE // 2)).cast("int"))
    units = calm
    if not hot.isEmpty():
        tiles = hot.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        p, q = tiles.alias("p"), tiles.alias("q")
        near = (F.col("p.band") == F.col("q.band")) & (F.col("p.key") == F.col("q.key")) & (F.col("q.ones") - F.col("p.ones")).between(0, radius)
        ahead = (F.col("q.ones") > F.col("p.ones")) | (F.col("q.part") >= F.col("p.part"))
        pairs = p.join(q, near & ahead).select(F.col("p.band").alias("band"), F.col("p.key").alias("key"), F.col("p.ones").alias("o1"), F.col("p.part").alias("p1"), F.col("q.ones").alias("o2"), F.col("q.part").alias("p2"))
        own = pairs.withColumn("ones", F.explode(F.array_distinct(F.array(F.struct(F.col("o1").alias("o"), F.col("p1").alias("p")), F.struct(F.col("o2").alias("o"), F.col("p2").alias("p"))))))
        own = own.select("band", "key", "o1", "p1", "o2", "p2", F.col("ones.o").alias("ones"), F.col("ones.p").alias("part"))
        dealt = rows.join(hot.select("band", "key", "ones", "parts"), ["band", "key", "ones"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        full = dealt.join(own, ["band", "key", "ones", "part"]).groupBy("band", "key", "o1", "p1", "o2", "p2").agg(F.collect_list("fp").alias("fps"))
        units = calm.unionByName(full.select("fps"))

    def compare(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(0)
            flat, cuts = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            found = [star_links(flat[a:b], radius) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            a, b = (np.concatenate([f[i] for f in found]).view(np.int64) if found else np.zeros(0, np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return units.mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable, itself included), one row per row of `docs`.

    Equal fingerprints are one node. Texts without words have fingerprint 0 and link like any other.
    A null doc_id is never the smallest unless all of its component are null. Other columns are ignored.
    """
    f = cut(fingerprints(docs, shingle), "fps")
    classes = cut(f.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes")
    roots = components(links(classes.select("fp"), radius))
    reached = classes.join(roots.withColumnRenamed("node", "fp"), "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    linked = roots.join(reached, "root").select(F.col("node").alias("fp"), "component_id")
    # Only classes with company need a look-up; a document alone is its own component.
    grouped = classes.join(linked, "fp", "left").filter("n > 1 or component_id is not null").select("fp", "n", F.coalesce("component_id", "first").alias("component_id"))
    return join_counted(f, cut(grouped, "grouped"), "fp").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def sketches(docs: DataFrame, shingle: int, with_set: bool = False) -> DataFrame:
    """doc_id, node (hash of the set of shingles), n (its size) and two fingerprints of it, or doc_id, node, n and the set."""

    def encode(batches) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh64_intdigest as digest

        for batch in batches:
            sets = [np.unique(hashes(t.as_py(), shingle)) for t in batch.column(1)]
            node = np.fromiter((digest(s.tobytes(), SEED) for s in sets), np.uint64, len(sets)).view(np.int64)
            columns = [batch.column(0), pa.array(node), pa.array(np.fromiter(map(len, sets), np.int64, len(sets)))]
            if with_set:
                columns.append(pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "n", "hashes"])
            else:
                for f in (lambda s: s, rehash):
                    columns.append(pa.array(np.fromiter((majority(f(s)) for s in sets), np.uint64, len(sets)).view(np.int64)))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "n", "fp", "fp2"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(encode, "doc_id bigint, node bigint, n bigint, " + ("hashes array<bigint>" if with_set else "fp bigint, fp2 bigint"))


def rehash(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def near_pairs(x: dict[str, np.ndarray], y: dict[str, np.ndarray], radius: int, wide: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in x and y, block by block, of pairs that may have Jaccard 0.8: first fingerprints within `radius` bits, second within `wide`, sizes within 4 to 5."""
    ix, iy = (np.argsort(np.bitwise_count(s["fp"]), kind="stable") for s in (x, y))
    x, y = ({k: v[o] for k, v in s.items()} for s, o in ((x, ix), (y, iy)))
    ox, oy = (np.bitwise_count(s["fp"]).astype(np.int64) for s in (x, y))
    for a in range(0, len(ox), BLOCK):
        z = min(a + BLOCK, len(ox))
        low, high = np.searchsorted(oy, ox[a] - radius), np.searchsorted(oy, ox[z - 1] + radius, "right")
        for b in range(low, high, 4 * BLOCK):
            e = min(b + 4 * BLOCK, high)
            i, j = np.nonzero(np.bitwise_count(x["fp"][a:z, None] ^ y["fp"][None, b:e]) <= radius)
            i, j = i + a, j + b
            n, m = x["n"][i], y["n"][j]
            ok = (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (np.bitwise_count(x["fp2"][i] ^ y["fp2"][j]) <= wide) & (x["node"][i] != y["node"][j])
            if ok.any():
                yield ix[i[ok]], iy[j[ok]]


def _two_strips(key, table) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Columns, and the places of either strip of the key (p, q)."""
    c = {k: table.column(k).to_numpy() for k in ("node", "n", "fp", "fp2", "s")}
    c["fp"], c["fp2"] = c["fp"].view(np.uint64), c["fp2"].view(np.uint64)
    return c, *(np.flatnonzero(c["s"] == k.as_py()) for k in key)


#: Sizes of sets in a bucket differ by less than this factor, more than the 1.25 of a pair of Jaccard 0.8, whose buckets are one or neighbours.
STEP = 1.26


def reach(nodes: DataFrame, radius: int, wide: int) -> DataFrame:
    """node, n, fp, fp2, its strip s, and the pairs of strips (p, q) where it has a pair; `nodes` has distinct nodes.

    Strips are parts of buckets by size, numbered bucket by bucket; a strip meets those of its own
    bucket and of the two next to it.
    """
    bucket = F.when(F.col("n") > 0, F.floor(F.log("n") / math.log(STEP)).cast("int") + 1).otherwise(0)
    nodes = nodes.withColumn("bucket", bucket)
    # A row for each factor of STEP in size: some hundred at most.
    sizes = {r.bucket: r.c for r in nodes.groupBy("bucket").agg(F.count("*").alias("c")).collect()}
    first, strips = [0], []
    for b in range(max(sizes, default=0) + 1):
        strips.append(-(-sizes.get(b, 0) // STRIP))
        first.append(first[-1] + strips[-1])
    of = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), at)
    here = F.col("bucket") + 1
    s = of(first, here) + F.pmod("node", of([max(1, x) for x in strips], here)).cast("int")
    low, high = of(first, F.greatest(F.lit(1), here - 1)), of(first, F.least(F.lit(len(first)), here + 2)) - 1
    rows = nodes.select("node", "n", "fp", "fp2", s.alias("s"), F.explode(F.sequence(low, high)).alias("o"))
    rows = rows.select("node", "n", "fp", "fp2", "s", F.least("s", "o").alias("p"), F.greatest("s", "o").alias("q"))
    pairs = sum(a * (a + 1) // 2 + a * b for a, b in zip(strips, [*strips[1:], 0], strict=True))

    def compare(key, table):
        c, x, y = _two_strips(key, table)
        found = np.zeros(len(c["node"]), bool)
        for i, j in near_pairs(*({k: v[t] for k, v in c.items()} for t in (x, y)), radius, wide):
            found[x[i]] = found[y[j]] = True
        return table.take(np.flatnonzero(found))

    return rows.repartition(max(1, pairs), "p", "q").groupBy("p", "q").applyInArrow(compare, rows.schema)


def verified(ends: DataFrame, radius: int, wide: int) -> DataFrame:
    """(a, b) edges that connect all nodes of `ends` (rows of `reach` with their sets) in pairs of Jaccard 0.8 or more.

    Pairs are never listed: a task finds them again among its ends, block by block, and leaves out
    those that verified pairs connect already, so a large group of near copies gives one edge a node.
    """

    def check(key, table):
        import pyarrow as pa

        c, x, y = _two_strips(key, table)
        lists = table.column("hashes").combine_chunks()
        flat, cuts = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        root = np.arange(len(c["node"]))
        out = []
        for i, j in near_pairs(*({k: v[t] for k, v in c.items()} for t in (x, y)), radius, wide):
            i, j = x[i], y[j]
            if c["s"][i[0]] == c["s"][j[0]]:  # a strip against itself meets each pair twice
                i, j = i[i < j], j[i < j]
            for a in np.unique(i).tolist():
                mine, others = flat[cuts[a] : cuts[a + 1]], j[i == a]
                for at in range(0, len(others), BLOCK):
                    bs = others[at : at + BLOCK]
                    bs = bs[root[bs] != root[a]]
                    if not len(bs):
                        continue
                    sizes = cuts[bs + 1] - cuts[bs]
                    theirs = np.concatenate([flat[cuts[b] : cuts[b + 1]] for b in bs])
                    both = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                    common = np.add.reduceat(both, np.cumsum(sizes) - sizes, dtype=np.int64)
                    # Of places with one root, one edge connects all.
                    alike = bs[9 * common >= 4 * (len(mine) + sizes)]
                    alike = alike[np.unique(root[alike], return_index=True)[1]]
                    out += [(a, b) for b in alike.tolist()]
                    root = merge(root, np.full(len(alike), a), alike)
        linked = c["node"][np.array(out, np.int64).reshape(-1, 2)]
        return pa.table({"a": pa.array(linked[:, 0], pa.int64()), "b": pa.array(linked[:, 1], pa.int64())})

    return ends.groupBy("p", "q").applyInArrow(check, "a bigint, b bigint")


def similar(docs: DataFrame, shingle: int = 5, radius: int = 16, wide: int = 22) -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable, itself included) over pairs of shingle Jaccard 0.8 or more.

    Equal sets of shingles are one node, texts without words are equal. Bits of pairs at 0.8 differ
    in 9.7 of 64 on average, so 99% are within 16; the second radius is for speed and loses 1 in
    100,000. Every pair found is verified on the sets, which are taken again from texts of its ends
    alone. A null doc_id is never the smallest unless all of its component are null.
    """
    f = cut(sketches(docs, shingle), "sketches")
    classes = cut(f.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("fp2").alias("fp2")), "sets")
    ends = cut(reach(classes.select("node", "n", "fp", "fp2"), radius, wide), "ends")
    wanted = classes.join(ends.select("node").distinct(), "node").select(F.col("node").alias("end"), "first")
    texts = docs.select("doc_id", "text").join(wanted.select("first").distinct(), F.col("doc_id").cast("bigint").eqNullSafe(F.col("first")), "left_semi")
    sets = sketches(texts, shingle, True).join(wanted, (F.col("node") == F.col("end")) & F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")
    sets = cut(sets.select("node", "hashes").dropDuplicates(["node"]), "hashes")
    alike = verified(ends.join(sets, "node"), radius, wide)
    roots = components(alike.select("a", "b"))
    reached = classes.join(roots, "node").groupBy("root").agg(F.min("first").alias("component_id"))
    linked = roots.join(reached, "root").select("node", "component_id")
    grouped = classes.join(linked, "node", "left").select("node", F.col("copies").alias("n"), F.coalesce("component_id", "first").alias("component_id"))
    return join_counted(f.select("doc_id", "node"), cut(grouped, "grouped"), "node").select("doc_id", "component_id")
