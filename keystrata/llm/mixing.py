"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each source gets a target in words; a document of the source is wanted target / source_size times.
The whole part of that is certain. The fractional parts are rounded together: two documents move
words from one to the other until one of them is taken wholly or not at all, with odds that keep
each one's expectation, and words are conserved by every move.

Most documents go through a reduction tree: leaves of about `fan_in` documents fold on their own,
each leaves at most one undecided document, and the undecided ones meet in a tree of the same
fan-in. What stays at a source's root is one document, of any length, so a reserve is kept out of the
tree: of every octave of lengths (powers of two) about `reserve` documents of the source, picked by hash;
of an octave with no more than that, all. The reserve is settled last, one document at a time, the root's
document first and then the longest: it moves words against all that is still undecided, whose
fractions change in proportion, until it is integral. Each octave below can take what the one
above needs, so only the shortest document is left to be rounded to the nearer, and a source misses
its target by at most half of that. Where the rest can move words one way only, that way is taken, and
where neither suffices the document is rounded; that biases a source with few documents.

Groups are leaves of a hash, never a source, so a source with any share of all rows is spread; a
reserve has at most some hundred documents.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words

#: More sources than this and their table is joined by salted shuffle, not broadcast.
BROADCAST_SOURCES = 10_000
SALTS = 64
#: Documents of an octave of lengths that a source's reserve holds, on average.
RESERVE = 24


def targets(units: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """source, source_size, n_units, target: shares by weight of all words, none above cap x source_size.

    Weights repeat over the sources in code point order, null last. The excess of capped sources is
    shared again by weight until none is above. With sources in order of cap x size / weight, those
    capped come first: a source is capped when its ratio is below the level that would share what
    the capped ones leave, so running sums over one row per source settle it.
    """
    s = units.groupBy("source").agg(F.sum("z").alias("source_size"), F.sum("m").alias("n_docs"), F.count("*").alias("n_units"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("top", F.col("source_size") * F.lit(float(cap)))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Ratios in order; `source` breaks ties the same way on every run.
    up_to = Window.orderBy(F.col("top") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn("all_w", F.sum("w").over(every))
    s = s.withColumn("cap_before", F.sum("top").over(up_to) - F.col("top")).withColumn("w_before", F.sum("w").over(up_to) - F.col("w"))
    level = (F.col("total") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before"))
    s = s.withColumn("capped", F.col("top") <= level * F.col("w"))
    free = (F.col("total") - F.sum(F.when(F.col("capped"), F.col("top")).otherwise(0.0)).over(every)) / F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(every)
    return s.select("source", "source_size", "n_units", F.when(F.col("capped"), F.col("top")).otherwise(free * F.col("w")).alias("target"))


#: The reserve of a source, in order: `a` is settled against the rest, which holds `left` words wanted
#: `g` times each. An item with `own` has its own fraction, the root's document, and is not of the rest.
SETTLE = """
aggregate(items,
  named_struct('done', cast(array() as array<struct<doc_id:bigint,th:bigint,x:int>>), 'g', g, 'left', words),
  (s, x) -> transform(array(named_struct('p', coalesce(x.own, s.g), 'left', if(x.own is null, greatest(0D, s.left - x.z), s.left),
                                         'u', pmod(xxhash64({seed}, x.doc_id, x.th), 9007199254740992) / 9007199254740992D)),
    m -> transform(array(named_struct('p', m.p, 'left', m.left, 'up', (1 - m.p) * x.z, 'down', m.p * x.z, 'have', s.g * m.left, 'room', (1 - s.g) * m.left, 'u', m.u)),
      t -> transform(array(if(t.up <= t.have and t.down <= t.room, t.u < t.p, if(t.up <= t.have, true, if(t.down <= t.room, false, t.p >= 0.5D)))),
        taken -> named_struct('done', array_append(s.done, named_struct('doc_id', x.doc_id, 'th', x.th, 'x', cast(taken as int))),
          'g', if(t.left <= 0, s.g, if(taken, greatest(0D, s.g - least(t.up, t.have) / t.left), least(1D, s.g + least(t.down, t.room) / t.left))),
          'left', t.left))[0])[0])[0])
"""

#: State: what is decided, and the one document that is not. `a` is carried, `x` comes next; words
#: move from x to a (up) or from a to x. An exact 0 or 1 is set, never computed.
FOLD = """
aggregate(items,
  named_struct('done', cast(array() as array<struct<doc_id:bigint,th:bigint,x:int>>), 'a', cast(null as struct<doc_id:bigint,th:bigint,z:double,f:double>)),
  (s, x) -> if(s.a is null,
    named_struct('done', s.done, 'a', named_struct('doc_id', x.doc_id, 'th', x.th, 'z', x.z, 'f', x.f)),
    transform(array(named_struct('a', s.a,
        'up', least((1 - s.a.f) * s.a.z, x.f * x.z), 'down', least(s.a.f * s.a.z, (1 - x.f) * x.z),
        'u', pmod(xxhash64({seed}, s.a.doc_id, s.a.th, x.doc_id, x.th), 9007199254740992) / 9007199254740992D)),
      m -> transform(array(named_struct('toward_a', m.u * (m.up + m.down) < m.down or m.down + m.up = 0, 'm', m)),
        t -> if(t.toward_a,
          if((1 - t.m.a.f) * t.m.a.z <= x.f * x.z,
            named_struct('done', array_append(s.done, named_struct('doc_id', t.m.a.doc_id, 'th', t.m.a.th, 'x', 1)),
                         'a', named_struct('doc_id', x.doc_id, 'th', x.th, 'z', x.z, 'f', greatest(0D, x.f - t.m.up / x.z))),
            named_struct('done', array_append(s.done, named_struct('doc_id', x.doc_id, 'th', x.th, 'x', 0)),
                         'a', named_struct('doc_id', t.m.a.doc_id, 'th', t.m.a.th, 'z', t.m.a.z, 'f', least(1D, t.m.a.f + t.m.up / t.m.a.z)))),
          if(t.m.a.f * t.m.a.z <= (1 - x.f) * x.z,
            named_struct('done', array_append(s.done, named_struct('doc_id', t.m.a.doc_id, 'th', t.m.a.th, 'x', 0)),
                         'a', named_struct('doc_id', x.doc_id, 'th', x.th, 'z', x.z, 'f', least(1D, x.f + t.m.down / x.z))),
            named_struct('done', array_append(s.done, named_struct('doc_id', x.doc_id, 'th', x.th, 'x', 1)),
                         'a', named_struct('doc_id', t.m.a.doc_id, 'th', t.m.a.th, 'z', t.m.a.z, 'f', greatest(0D, t.m.a.f - t.m.down / t.m.a.z)))))
      )[0])[0]))
"""


def plan(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, fan_in: int = 64, seed: int = 42, reserve: int = RESERVE) -> DataFrame:
    """doc_id, source, th (hash of the text), size, m (rows alike), source_size, target, copies, for each distinct (doc_id, source, text).

    Rows alike in all three are one unit and get the same copies. A text without words gets the
    whole part of its share; null texts count zero words; null sources are a source of their own,
    the last; null doc_ids are ordinary ids; documents of one length are ordered by hash. Rerunning
    gives the same copies. Other columns are ignored. An empty table gives no rows.
    """
    units = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.xxhash64("text").alias("th"), n_words(F.col("text")).alias("size"))
    units = units.groupBy("doc_id", "source", "th", "size").agg(F.count("*").alias("m")).withColumn("z", F.col("size") * F.col("m"))
    units = cut(units.withColumn("octave", F.when(F.col("z") > 0, F.floor(F.log2("z")).cast("int"))), "units")
    # An octave's part of a source: at most 64 numbers a source, which ride on its row.
    octaves = units.filter("z > 0").groupBy("source", "octave").agg(F.count("*").alias("n")).groupBy(F.col("source").alias("source_")).agg(F.map_from_entries(F.collect_list(F.struct("octave", "n"))).alias("octaves"))
    table = targets(units, weights, cap)
    table = cut(table.join(octaves, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_"), "targets")
    n_sources, most = table.agg(F.count("*"), F.coalesce(F.max("n_units"), F.lit(0))).first()
    if n_sources <= BROADCAST_SOURCES:
        wide = units.join(F.broadcast(table), units.source.eqNullSafe(table.source))
    else:
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = units.withColumn("salt_", F.pmod(F.xxhash64("doc_id", "th"), F.lit(SALTS)))
        wide = left.join(salted, left.source.eqNullSafe(salted.source) & (left.salt_ == salted.salt))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wide = wide.drop(table.source).withColumn("share", share).withColumn("whole", F.floor("share").cast("int")).withColumn("f", F.col("share") - F.col("whole"))
    open_ = wide.filter((F.col("f") > 0) & (F.col("z") > 0))
    one_of = F.pmod(F.xxhash64(F.lit(seed + 2), "doc_id", "th"), F.lit(1 << 30)) * F.col("octaves")[F.col("octave")] < F.lit(reserve << 30)
    open_ = open_.withColumn("spare", one_of)
    leaf = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "th"), F.ceil(F.col("n_units") / fan_in))
    level = open_.filter("not spare").select("source", leaf.alias("leaf"), "doc_id", "th", F.col("z").cast("double").alias("z"), "f")
    depth = 1 + max(0, math.ceil(math.log(max(1, most / fan_in), fan_in) - 1e-9))
    decided = None
    for i in range(depth + 1):
        items = F.array_sort(F.collect_list(F.struct((-F.col("z")).alias("by_size"), F.xxhash64(F.lit(seed + 1), "doc_id", "th").alias("h"), "doc_id", "th", "z", "f")))
        folded = level.groupBy("source", "leaf").agg(items.alias("items")).select("source", "leaf", F.expr(FOLD.format(seed=f"{seed}L")).alias("s"))
        folded = cut(folded, f"level{i}")
        done = folded.select("source", F.explode("s.done").alias("d")).select("source", "d.*")
        decided = done if decided is None else decided.unionByName(done)
        level = folded.filter("s.a is not null").select("source", F.floor(F.col("leaf") / fan_in).alias("leaf"), "s.a.*")
    # One root document a source, and a reserve of at most some hundred, meet in one row.
    last = level.select("source", "doc_id", "th", "z", F.col("f").alias("own"), F.lit(None).cast("double").alias("g"))
    last = last.unionByName(open_.filter("spare").select("source", "doc_id", "th", F.col("z").cast("double").alias("z"), F.lit(None).cast("double").alias("own"), F.col("f").alias("g")))
    items = F.array_sort(F.collect_list(F.struct(F.col("own").isNull().alias("later"), (-F.col("z")).alias("by_size"), F.xxhash64(F.lit(seed + 3), "doc_id", "th").alias("h"), "doc_id", "th", "z", "own")))
    last = last.groupBy("source").agg(items.alias("items"), F.coalesce(F.max("g"), F.lit(0.0)).alias("g"), F.coalesce(F.sum(F.when(F.col("own").isNull(), F.col("z"))), F.lit(0.0)).alias("words"))
    settled = last.select("source", F.explode(F.expr(SETTLE.format(seed=f"{seed + 4}L"))["done"]).alias("d")).select("source", "d.*")
    decided = decided.unionByName(cut(settled, "settled"))
    decided = decided.select(F.col("source").alias("s_"), F.col("doc_id").alias("d_"), F.col("th").alias("t_"), "x")
    same = wide.doc_id.eqNullSafe(decided.d_) & (wide.th == decided.t_) & wide.source.eqNullSafe(decided.s_)
    copies = F.col("whole") + F.coalesce("x", F.lit(0))
    return wide.join(decided, same, "left").select("doc_id", "source", "th", "size", "m", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it; columns as they came, whatever their names."""
    p = plan(docs, **options).filter("copies > 0")
    plan_key = F.struct(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("source").alias("s"))
    taken = p.select(plan_key.alias("key"), F.col("copies").alias("copies"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(F.col("doc_id").cast("bigint").alias("d"), F.xxhash64("text").alias("t"), F.col("source").alias("s")).alias("key"))
    rows = keyed.alias("a").join(taken.alias("b"), F.col("a.key").eqNullSafe(F.col("b.key")))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("i")).select(*[F.col("row")[c].alias(c) for c in docs.columns])
