"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

On unit vectors, cosine >= t is distance <= sqrt(2 - 2t), called the reach. A cover tree has nested
levels whose radii halve; two nodes whose centres are further apart than their covering radii and the
reach together hold no pair, so the traversal of two trees drops them with all below.

The upper levels are Spark's. The vectors of a label are a unit; a unit of more than CHUNK vectors is
divided by centres that its own bounded sample gives, and so on down, so that cells are as many as the
data need. A vector lives in the cell of its nearest centre and visits a later cell only if that
cell's covering radius, and the plane half-way between the two centres, leave room for a vector within
the reach. A pair within the reach meets in exactly one cell with one of the two at home; `away`
marks the levels at which a vector is a visitor, and a pair away at one level together is not counted.
Where the sample shows that dividing would not pay, as in vectors without any clusters, or in one tight
cluster, the unit is dealt in chunks instead, and pairs of chunks are compared. Both ways see every
pair once; a task holds at most two chunks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components
from .unions import merge

#: Most vectors that a task takes at once from one side, vectors sampled to divide a unit, and its cells.
CHUNK, SAMPLE, CELLS = 8192, 1024, 64
#: Levels of division in Spark; what is left then is dealt in chunks.
DEPTH = 24
FIRST_RADIUS = 2.0
SLACK = 1e-6
BLOCK = 1024


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def unit_vectors(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; each is first scaled by its largest component, so that no square over- or underflows."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def net(x: np.ndarray, radius: float, most: int, seeds: np.ndarray | None = None) -> np.ndarray | None:
    """Places of points that are more than `radius` apart and cover all; None if that takes more than `most`.

    `seeds` are such points of a coarser net, which this one contains. Candidates come in blocks: a
    block is thinned among itself and then covers what it can, so no full matrix arises.
    """
    chosen = [] if seeds is None else seeds.tolist()
    free = np.ones(len(x), bool)
    for lo in range(0, len(chosen), BLOCK):
        free &= ~_covered(x, x[chosen[lo : lo + BLOCK]], radius)
    while True:
        block = np.flatnonzero(free)[: BLOCK // 4]
        if not len(block):
            return np.array(chosen, np.int64)
        d, taken = distances(x[block], x[block]), []
        open_ = np.ones(len(block), bool)
        for i in range(len(block)):
            if open_[i]:
                taken.append(i)
                open_ &= d[i] > radius
        chosen += block[taken].tolist()
        if len(chosen) > most:
            return None
        free &= ~_covered(x, x[block[taken]], radius)
        free[block] = False


def _covered(x: np.ndarray, centres: np.ndarray, radius: float) -> np.ndarray:
    return np.concatenate([(distances(x[lo : lo + BLOCK], centres) <= radius).any(1) for lo in range(0, len(x), BLOCK)])


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    got = [(d.argmin(1), d.min(1)) for d in (distances(x[lo : lo + BLOCK], centres) for lo in range(0, len(x), BLOCK))]
    return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


class CoverTree:
    """Nested levels over unit vectors: level i's nodes are FIRST_RADIUS / 2^i apart, and cover all below.

    Points are kept in an order in which each node's points follow each other: `order` gives their
    places, `levels[i]` the centres, first points, ends and covering radii of level i, and `below[i]`
    the first node of level i + 1 under each node. Levels end at `smallest`, or where the next would
    have more than an eighth of the points as nodes and so prune next to nothing.
    """

    def __init__(self, x: np.ndarray, smallest: float):
        nets, radius, seeds = [], FIRST_RADIUS, None
        while len(x):
            seeds = net(x, radius, max(1, len(x) // 8), seeds)
            if seeds is None:
                break
            nets.append(seeds)
            if radius <= smallest:
                break
            radius /= 2
        if len(x) and not nets:
            nets = [np.zeros(1, np.int64)]
        # Every point belongs to its nearest node of the last level, that to its nearest of the level above.
        self.order = np.zeros(len(x), np.int64)
        self.levels, self.below = [], []
        if not len(x):
            return
        labels = [nearest(x, x[nets[-1]])[0]]
        for up, low in zip(nets[-2::-1], nets[:0:-1], strict=True):
            labels.append(nearest(x[low], x[up])[0][labels[-1]])
        self.order = np.lexsort(labels)
        self.x = x[self.order]
        last = None
        for centres, label in zip(nets, labels[::-1], strict=True):
            mine = label[self.order]
            # A node of a net is inside its own points, but its parent may have moved it next to others.
            start = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
            if last is not None:
                start = np.union1d(start, last)
            end = np.append(start[1:], len(x))
            c = x[centres[mine[start]]]
            far = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", self.x, np.repeat(c, end - start, axis=0))))
            if last is not None:
                self.below.append(np.searchsorted(start, last))
            self.levels.append((c, start, end, np.maximum.reduceat(far, start)))
            last = start
        self.below.append(None)


def dual_blocks(a: CoverTree, b: CoverTree, cosine: float, same: bool = False):
    """Blocks (places in a, places in b, near) that hold all pairs at or above the threshold, each once.

    Both trees go down together, level by level, and pairs of nodes too far apart are dropped with all
    below. With `same`, a and b are one tree and a pair of nodes is looked at in one order only.
    """
    if not a.levels or not b.levels:
        return
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK
    i, j = (v.ravel() for v in np.indices((len(a.levels[0][1]), len(b.levels[0][1]))))
    la = lb = 0
    while True:
        (ca, sa, ea, ra), (cb, sb, eb, rb) = a.levels[la], b.levels[lb]
        keep = np.ones(len(i), bool)
        for lo in range(0, len(i), 1 << 16):
            p, q = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
            d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", ca[p], cb[q])))
            keep[lo : lo + (1 << 16)] = (d <= reach + ra[p] + rb[q]) & (not same or p <= q)
        i, j = i[keep], j[keep]
        if la + 1 == len(a.levels) and lb + 1 == len(b.levels):
            break
        if la + 1 < len(a.levels):
            i, j = _children(a, la, i, j)
            la += 1
        if lb + 1 < len(b.levels):
            j, i = _children(b, lb, j, i)
            lb += 1
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    edge = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1], [True]))) if len(i) else np.zeros(1, np.int64)
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        node, others = i[lo], j[lo:hi]
        left = np.arange(sa[node], ea[node])
        size = eb[others] - sb[others]
        right = np.repeat(sb[others] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        for p in range(0, len(left), BLOCK):
            for q in range(0, len(right), 2 * BLOCK):
                l, r = left[p : p + BLOCK], right[q : q + 2 * BLOCK]
                near = a.x[l] @ b.x[r].T >= cosine
                if same:
                    near &= l[:, None] < r[None, :]
                if near.any():
                    yield a.order[l], b.order[r], near


def _children(t: CoverTree, level: int, mine: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = t.below[level]
    size = np.diff(np.append(first, len(t.levels[level + 1][1])))[mine]
    at = np.repeat(first[mine] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return at, np.repeat(other, size)


def visits(x: np.ndarray, centres: np.ndarray, radius: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home of each point, and (point, cell) of its visits to later cells that may hold a partner."""
    d = distances(x, centres)
    home = d.argmin(1)
    own = d[np.arange(len(x)), home][:, None]
    apart = distances(centres, centres)[home]
    may = (d <= radius + reach + SLACK) & (d * d - own * own <= 2 * (reach + SLACK) * apart + SLACK) & (np.arange(len(centres)) > home[:, None])
    return home, *np.nonzero(may)


def divide(x: np.ndarray, reach: float) -> np.ndarray | None:
    """Centres that divide a unit of which x is a sample; None where copies of visitors would cost more than cells save."""
    radius, centres = FIRST_RADIUS, np.zeros(1, np.int64)
    while len(centres) < 2 and radius > reach / 4:
        radius /= 2
        found = net(x, radius, CELLS, centres)
        if found is None:  # the first CELLS of a net are apart, whether they cover all or not
            found = _first_apart(x, radius)
        centres = found
    if len(centres) < 2:
        return None
    c = x[centres]
    home, dist = nearest(x, c)
    r = np.zeros(len(c))
    np.maximum.at(r, home, dist)
    copies = 1 + len(visits(x, c, r, reach)[1]) / len(x)
    share = np.bincount(home, minlength=len(c)).max() / len(x)
    return c if copies * copies / len(c) < 0.5 and share < 0.9 else None


def _first_apart(x: np.ndarray, radius: float) -> np.ndarray:
    chosen, far = [], np.ones(len(x), bool)
    while far.any() and len(chosen) < CELLS:
        i = int(np.argmax(far))
        chosen.append(i)
        far &= distances(x, x[i : i + 1])[:, 0] > radius
    return np.array(chosen, np.int64)


def _matrix(column, dims: int) -> np.ndarray:
    return unit_vectors(column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))


def _divided(points: DataFrame, sizes: DataFrame, level: int, reach: float, kind: str) -> tuple[DataFrame, DataFrame]:
    """Points of big units, dealt to their cells, and the units that are not divided."""
    big = sizes.filter(F.col("n") > CHUNK)
    inside = points.join(big, "unit")
    picked = inside.filter(F.pmod(F.xxhash64(F.lit(level), "id"), F.lit(1 << 30)) * F.col("n") < F.lit(SAMPLE << 30)).select("unit", "dims", "id", "embedding")

    def centres(table):
        import pyarrow as pa

        table = table.sort_by("id")
        dims = table.column("dims")[0].as_py()
        c = divide(_matrix(table.column("embedding"), dims), reach)
        flat = [None if c is None else c.ravel()]
        return pa.table({"unit": table.column("unit")[:1], "centres": pa.array(flat, pa.list_(pa.float64()))})

    made = cut(big.join(picked.groupBy("unit").applyInArrow(centres, "unit string, centres array<double>"), "unit", "left"), "centres")
    whole = made.filter("centres is null").select("unit")
    # A big unit's points meet its centres in as many groups as it has chunks.
    salts = F.ceil(F.col("n") / CHUNK).cast("int")
    spread = made.filter("centres is not null").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    salted = inside.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int")).drop("n")
    placed_schema = "unit string, salt int, cell int, dist double"

    def homes(left, right):
        import pyarrow as pa

        if not left.num_rows or not right.num_rows:
            return pa.table({"unit": pa.array([], pa.string()), "salt": pa.array([], pa.int32()), "cell": pa.array([], pa.int32()), "dist": pa.array([], pa.float64())})
        dims = left.column("dims")[0].as_py()
        cell, dist = nearest(_matrix(left.column("embedding"), dims), np.array(right.column("centres")[0].as_py()).reshape(-1, dims))
        used = np.unique(cell)
        far = np.zeros(int(used.max()) + 1)
        np.maximum.at(far, cell, dist)
        return pa.table({"unit": pa.array([left.column("unit")[0].as_py()] * len(used), pa.string()), "salt": pa.array([0] * len(used), pa.int32()), "cell": pa.array(used.astype(np.int32)), "dist": pa.array(far[used])})

    near = salted.groupBy("unit", "salt").cogroup(spread.groupBy("unit", "salt")).applyInArrow(homes, placed_schema)
    radii = near.groupBy("unit", "cell").agg(F.max("dist").alias("r")).groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("cell", "r"))).alias("radii"))
    known = cut(spread.join(radii, "unit"), "radii")
    schema = f"unit string, id bigint, m bigint, away bigint, dims int, embedding {kind}"

    def deal(left, right):
        import pyarrow as pa

        names = ["id", "m", "away", "dims", "embedding"]
        if not left.num_rows or not right.num_rows:
            return left.slice(0, 0).select(["unit", *names])
        dims = left.column("dims")[0].as_py()
        c = np.array(right.column("centres")[0].as_py()).reshape(-1, dims)
        r = np.full(len(c), -1.0)  # a cell without points has no partner for anyone
        for k, v in right.column("radii")[0].as_py():
            r[k] = v
        home, who, cell = visits(_matrix(left.column("embedding"), dims), c, np.where(r < 0, -1e9, r), reach)
        take, cells = np.concatenate((np.arange(len(home)), who)), np.concatenate((home, cell))
        away = left.column("away").to_numpy()[take] | np.where(np.arange(len(take)) < len(home), 0, 1 << level)
        out = left.take(take)
        path = left.column("unit")[0].as_py()
        cols = {n: out.column(n) for n in names} | {"away": pa.array(away, pa.int64())}
        return pa.table({"unit": pa.array([f"{path}.{k}" for k in cells.tolist()], pa.string()), **cols})

    dealt = salted.select("unit", "salt", "id", "m", "away", "dims", "embedding").groupBy("unit", "salt").cogroup(known.groupBy("unit", "salt")).applyInArrow(deal, schema)
    return cut(dealt, f"dealt{level}"), whole


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per row of `vectors`.

    A row whose label is null, or whose vector is null, zero or holds a null or non-finite component,
    links with nothing and is its own component. Vectors of other dimensions do not compare. Equal
    vectors of a label link with each other, rows that share a vec_id included. A null vec_id is never
    the smallest unless all of its component are null. A cosine equal to the threshold links. Needs
    vec_id, label and embedding; other columns are ignored. An empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding")
    fine = F.expr("label is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    rows = cut(rows.withColumn("ok", F.coalesce(fine, F.lit(False))).withColumn("embedding", F.when(F.col("ok"), F.col("embedding"))), "rows")
    classes = rows.filter("ok").groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("m"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    kind = dict(classes.dtypes)["embedding"]
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    columns = ["unit", "id", "m", "away", "dims", "embedding"]
    points = classes.select(F.concat_ws("/", F.col("label").cast("string"), F.size("embedding").cast("string")).alias("unit"), "id", "m", F.lit(0).cast("bigint").alias("away"), F.size("embedding").alias("dims"), "embedding")

    units = None
    for level in range(DEPTH + 1):
        sizes = cut(points.groupBy("unit").agg(F.count("*").alias("n")), f"sizes{level}")
        more = not sizes.filter(F.col("n") > CHUNK).isEmpty()
        ready = points.join(sizes.filter(F.col("n") <= CHUNK), "unit").select(*columns, F.lit(1).alias("parts")) if more else points.select(*columns, F.lit(1).alias("parts"))
        if more and level < DEPTH:
            dealt, whole = _divided(points, sizes, level, reach, kind)
            chunked = points.join(sizes.join(whole, "unit"), "unit")
        elif more:
            dealt, chunked = None, points.join(sizes.filter(F.col("n") > CHUNK), "unit")
        if more:
            ready = ready.unionByName(chunked.select(*columns, F.ceil(F.col("n") / CHUNK).cast("int").alias("parts")))
        units = ready if units is None else units.unionByName(ready)
        if not more or dealt is None:
            break
        points = dealt

    # A point goes to each pair of chunks that holds its own; a unit of one chunk is one pair.
    part = F.pmod(F.xxhash64(F.lit(7), "id"), F.col("parts")).cast("int")
    meets = units.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    meets = meets.select("unit", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "id", "m", "away", "dims", "embedding")

    def walk(key, table):
        import pyarrow as pa

        p, q = key[1].as_py(), key[2].as_py()
        dims = table.column("dims")[0].as_py()
        ids, m, away, part = (table.column(c).to_numpy() for c in ("id", "m", "away", "part"))
        x = _matrix(table.column("embedding"), dims)
        left, right = np.flatnonzero(part == p), np.flatnonzero(part == q)
        a = CoverTree(x[left], reach / 2)
        b = a if p == q else CoverTree(x[right], reach / 2)
        n, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i, j, near in dual_blocks(a, b, cosine, p == q):
            i, j = left[i], right[j]
            if away.any():
                near &= (away[i][:, None] & away[j][None, :]) == 0
            n[i] += near @ m[j]
            n[j] += near.T @ m[i]
            r, c = np.nonzero(near)
            root = merge(root, i[r], j[c])
        mine, some = np.flatnonzero(root != np.arange(len(ids))), np.flatnonzero(n)
        return pa.table({"id": np.concatenate((ids[some], ids[mine])), "n": np.concatenate((n[some], np.zeros(len(mine), np.int64))), "b": np.concatenate((np.full(len(some), -1), ids[root[mine]]))})

    found = cut(meets.groupBy("unit", "p", "q").applyInArrow(walk, "id bigint, n bigint, b bigint"), "found")
    counts = found.filter("b < 0").groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.filter("b >= 0").select(F.col("id").alias("a"), "b"))
    joined = classes.join(roots.withColumnRenamed("node", "id"), "id", "left").join(counts, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    info = joined.join(least, "root").select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    good = rows.filter("ok").join(info, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.filter("not ok").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
