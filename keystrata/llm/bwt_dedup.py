"""Exact removal of repeated byte strings, by merging Burrows-Wheeler transforms.

A byte goes when a string of `length` bytes that covers it also starts earlier, in a document of
smaller id or before in the same one.

1. Every window of `length` bytes has an anchor: the least hashed gram of GRAM bytes in it. Windows
   that follow each other and share their anchor are a run, about one per 35 bytes, with a context:
   the bytes of all its windows. Equal windows have equal anchors at equal offsets, so only runs
   with a common anchor can share one. Anchors that a bounded sample of the texts finds frequent are
   paired with a second anchor, by another hash, and these pairs with a third, so that a common line
   does not bring all its surroundings together; which anchors are paired never changes the result.
   A task sends each of its distinct contexts once; what it has seen before is known to be repeated.
2. Runs meet by anchor. Equal contexts are copies of one string, of which the first stays. Where an
   anchor has several contexts, around edits and the ends of shared passages, their windows are compared:
3. The contexts of a bucket of anchors are dealt to shards by document. Each shard is sorted on its own
   and contributes its Burrows-Wheeler transform, the byte before every suffix. The transforms are
   merged by refining an interleave, the shard of each suffix in the merged order: reading every shard's
   transform along the interleave gives the column before the merged suffixes, and a stable counting
   sort by it turns the order by the first h bytes into the order by the first h + 1. Borders of blocks
   that are equal so far come along and give the common prefixes; after `length` rounds the blocks are the
   repeated intervals, and no suffix of one shard was compared with one of another. An anchor whose
   contexts would outgrow a bucket even so has its windows grouped by their bytes instead, which
   combines before the shuffle.
4. Removed ranges meet their documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, in_order

LENGTH, GRAM = 100, 32
#: Bytes of text that are hashed at once (places must fit 20 bits), and runs that a task compares at once.
SLICE, FLUSH = 600_000, 400_000
#: Contexts of one merge, and most contexts of one anchor in it; shards that are merged.
BUCKET, MOST, SHARDS = 3000, 6000, 8
#: Most anchors beyond MOST whose table is broadcast, and rows that a task hands over at once.
CROWDED, HANDED = 100_000, 50_000
#: Texts of the sample, about; an anchor that holds more than a share of 1 / FREQUENT of its runs, and MIN_SEEN of them, is paired.
SAMPLE, FREQUENT, MIN_SEEN, LEVELS = 4000, 10_000, 8, 3


def grams(raw: np.ndarray, level: int = 0) -> np.ndarray:
    """64-bit hash, one of several, of the GRAM bytes at each place that has so many."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    word = np.empty(len(raw) - 7, np.uint64)
    for i in range(min(8, len(word))):  # the eight bytes at each place, by their remainder
        word[i::8] = raw[i : i + 8 * len(word[i::8])].view("<u8")
    h = np.full(n, 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 * level & (1 << 64) - 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, GRAM, 8):
            h ^= word[i : i + n]
            h *= np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(32)
        return h * np.uint64(0xD6E8FEB86659FD93)


def _anchors(raw: np.ndarray, width: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the least gram of each window, and the hashes of all grams."""
    h = grams(raw, level)
    v = (h & ~np.uint64(0xFFFFF)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    if span < width:
        v = np.minimum(v[: len(v) - (width - span)], v[width - span :])
    return (v & np.uint64(0xFFFFF)).astype(np.int32), h


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes are among the known ones, which are in order."""
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)


def _runs(parts: list[bytes], length: int, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
    """For the texts of a slice: text number, start, windows, place of the anchor from the start, anchor hash."""
    joined = b"".join(parts)
    raw = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    begins = np.cumsum(sizes) - sizes
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    if len(raw) < length:
        return none
    anchor, grams_ = _anchors(raw, length - GRAM + 1, 0)
    new = np.ones(len(anchor) + 1, bool)
    np.not_equal(anchor[1:], anchor[:-1], out=new[1:-1])
    # The last windows of a text would reach into the next one: they are runs of their own, and left out.
    past = np.maximum(begins, begins + sizes - length + 1)
    new[begins[begins < len(anchor)]] = new[past[past < len(anchor)]] = True
    first = np.flatnonzero(new)
    start, m = first[:-1], np.diff(first)
    text = np.searchsorted(begins, start, "right") - 1
    inside = start < past[text]
    start, m, text = start[inside], m[inside], text[inside]
    place = anchor[start].astype(np.int64)
    h = grams_[place]
    for level in range(1, LEVELS):
        hot = _among(h, frequent)
        if not hot.any():
            break
        paired, grams_ = _anchors(raw, length - GRAM + 1, level)
        # A run whose anchor is frequent is cut where its second anchor changes.
        which = np.repeat(np.arange(len(start)), np.where(hot, m, 1))
        at = start[which] + np.arange(len(which)) - np.searchsorted(which, which)
        second = np.where(hot[which], paired[at], -1)
        new = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (second[1:] != second[:-1]))))
        which, at, second = which[new], at[new], second[new]
        last = np.append(which[1:] != which[:-1], True)
        m = np.where(last, (start + m)[which], np.append(at[1:], 0)) - at
        start, text, place, h = at, text[which], place[which], h[which]
        with np.errstate(over="ignore"):
            h = np.where(second < 0, h, (h ^ grams_[second]) * np.uint64(0x9FB21C651E98DF25) + np.uint64(level))
    return text, start - begins[text], m, place - start, h


def _frequent(rows: DataFrame, length: int) -> np.ndarray:
    """Hashes of anchors, and of their pairs, that a sample of about SAMPLE texts has often; fewer than LEVELS * FREQUENT."""
    share = min(1.0, SAMPLE / max(1, rows.count()))
    picked = rows.select("b").sample(share, 3) if share < 1 else rows.select("b")
    known = np.zeros(0, np.uint64)
    for _ in range(LEVELS - 1):
        have = known

        def count(batches, have=have) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                for t in batch.column(0):
                    data = t.as_py()
                    for lo in range(0, len(data), SLICE):
                        h, c = np.unique(_runs([data[lo : lo + SLICE]], length, have)[4], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

        counted = picked.mapInArrow(count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
        total = counted.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
        often = counted.filter((F.col("c") * FREQUENT > total) & (F.col("c") >= MIN_SEEN)).select("h").collect()
        found = np.array([r.h & (1 << 64) - 1 for r in often], np.uint64)
        if not len(found):
            break
        known = np.union1d(known, found)
    return known


def _contexts(batches, length: int, frequent: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of whole texts with a hash of their contexts: key, start, windows, anchor place, anchor, context hash."""
    from xxhash import xxh64_intdigest as digest

    def handle(keys, bases, parts):
        text, start, m, o, h = _runs(parts, length, frequent)
        x = np.array([digest(parts[t][s : s + n + length - 1], n << 8 | a) for t, s, n, a in zip(text.tolist(), start.tolist(), m.tolist(), o.tolist(), strict=True)], np.uint64)
        return np.array(keys, np.int64)[text], np.array(bases, np.int64)[text] + start, m, o, h, x

    keys, bases, parts, size = [], [], [], 0
    for batch in batches:
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = t.as_py()
            # A text longer than a slice is taken in slices that overlap, so each window is in one.
            for lo in range(0, max(1, len(data) - length + 1), SLICE - length):
                piece = data[lo : lo + SLICE - 1]
                if len(piece) < length:
                    continue
                if size + len(piece) > SLICE and parts:
                    yield handle(keys, bases, parts)
                    keys, bases, parts, size = [], [], [], 0
                keys.append(k)
                bases.append(lo)
                parts.append(piece)
                size += len(piece)
    if parts:
        yield handle(keys, bases, parts)


class Shard:
    """Some texts, each with an end after it, in the order of their suffixes by their first `length` symbols."""

    def __init__(self, texts: list[bytes], length: int):
        sizes = np.array([len(t) for t in texts], np.int64) + 1
        self.begins = np.cumsum(sizes) - sizes
        t = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + 1
        t[self.begins + sizes - 1] = 0
        # Ranks by 7 symbols of 9 bits, then by twice as many each time.
        key = np.zeros(len(t), np.uint64)
        for i in range(7):
            key = key << np.uint64(9) | np.append(t[i:], np.zeros(min(i, len(t)), np.uint16))[: len(t)]
        done = 7
        while True:
            order = np.argsort(key)  # suffixes alike in `length` symbols may come in any order
            rank = np.empty(len(t), np.uint64)
            rank[order] = np.cumsum(np.concatenate(([0], key[order][1:] != key[order][:-1])))
            if done >= length:
                break
            key = rank << np.uint64(32) | np.append(rank[done:], np.zeros(min(done, len(t)), np.uint64))[: len(t)]
            done *= 2
        self.order = order
        self.begin_window = np.repeat(self.begins + sizes - 1, sizes)[order] - order >= length
        before = np.append(t[-1:], t[:-1])
        before[self.begins] = 0  # the end of a text comes before its first byte
        self.transform = before[order]


def interleave(shards: list[Shard], length: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the merged order, numbered shard by shard and in each by rank, and their blocks, equal in `length` symbols.

    Suffixes that begin no window and those alone in their block are left out, unless the `whole` order is asked for.
    """
    column = np.concatenate([s.transform for s in shards])
    size = np.cumsum([0, *(len(s.transform) for s in shards)])
    # Where a shard's transform sends each rank: its rank with the symbol in front.
    to = np.empty(len(column), np.int32)
    for lo, s in zip(size.tolist(), shards, strict=False):
        to[lo + np.argsort(s.transform, kind="stable")] = np.arange(lo, lo + len(s.transform), dtype=np.int32)
    at = np.arange(len(column), dtype=np.int32)
    if not whole:
        # Only what arrives at a window's first symbol has to go: the transforms, read backwards, tell where that starts.
        back = np.empty_like(to)
        back[to] = at
        at = at[np.concatenate([s.begin_window for s in shards])]
        for bit in range(length.bit_length()):
            if length >> bit & 1:
                at = back[at]
            back = back[back]
        at.sort()
    block = np.zeros(len(at), np.int32)
    for _ in range(length):
        symbol = column[at]
        order = np.argsort(symbol, kind="stable")
        symbol, block, at = symbol[order], block[order], to[at[order]]
        border = np.ones(len(at), bool)
        border[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(border, dtype=np.int32)
        if not whole:
            keep = ~(border & np.append(border[1:], True))
            at, block = at[keep], block[keep]
    return at, block


def repeated_windows(groups: list[list[bytes]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group, text and place of the windows that occur twice or more, and the number of their block."""
    shards = [Shard(g, length) for g in groups]
    at, block = interleave(shards, length)
    size = np.cumsum([0, *(len(s.transform) for s in shards)])
    group = np.searchsorted(size, at, "right") - 1
    text, place, fits = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    for i, (s, g) in enumerate(zip(shards, groups, strict=True)):
        mine = np.flatnonzero(group == i)
        start = s.order[at[mine] - size[i]]
        who = np.searchsorted(s.begins, start, "right") - 1
        text[mine], place[mine] = who, start - s.begins[who]
        fits[mine] = place[mine] + length <= np.array([len(t) for t in g], np.int64)[who]
    return group[fits], text[fits], place[fits], block[fits]


def _later_windows(keys: np.ndarray, starts: np.ndarray, texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows (key, start, windows) that also occur earlier among these contexts."""
    none = (np.zeros(0, np.int64),) * 3
    if len(texts) < 2:
        return none
    shard = keys % min(SHARDS, len(texts))
    names, shard = np.unique(shard, return_inverse=True)
    members = [np.flatnonzero(shard == i) for i in range(len(names))]
    group, text, place, block = repeated_windows([[texts[j] for j in m] for m in members], length)
    if not len(group):
        return none
    which = np.concatenate(members)[(np.cumsum([0, *(len(m) for m in members[:-1])]))[group] + text]
    key, place = keys[which], starts[which] + place
    order = np.lexsort((place, key, block))
    block, key, place = block[order], key[order], place[order]
    first = np.concatenate(([True], block[1:] != block[:-1]))
    key, place = key[~first], place[~first]
    if not len(key):
        return none
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    run = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (place[1:] > place[:-1] + 1))))
    ends = np.append(run[1:], len(key)) - 1
    return key[run], place[run], place[ends] - place[run] + 1


def _joined(k: np.ndarray, s: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows (key, start, windows), in order; those that follow each other in a text are one."""
    if not len(k):
        return k, s, m
    order = np.lexsort((s, k))
    k, s, m = k[order], s[order], m[order]
    first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] != s[:-1] + m[:-1]))))
    return k[first], s[first], np.add.reduceat(m, first)


def removed_runs(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k, s, m): runs of windows that also start earlier; `rows` has unique k, ordered as documents are, and b (bytes)."""
    frequent = _frequent(rows, length)

    def find(batches) -> Iterator:
        import pyarrow as pa

        def emit(got):
            k, s, m, _, h, x = (np.concatenate(c) for c in zip(*got, strict=True))
            order = np.lexsort((s, k, x, h))
            k, s, m, h, x = (c[order] for c in (k, s, m, h, x))
            seen = np.zeros(len(k), bool)
            seen[1:] = (h[1:] == h[:-1]) & (x[1:] == x[:-1])
            # A run that is known to be repeated needs no meeting: it joins those next to it and is dealt evenly.
            ks, ss, ms = _joined(k[seen], s[seen], m[seen])
            with np.errstate(over="ignore"):
                hs = ks.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + ss.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            known = np.arange(len(ks) + len(k) - seen.sum()) < len(ks)
            h, x, k, s, m = (np.concatenate((a, b[~seen])) for a, b in ((hs, h), (np.zeros_like(hs), x), (ks, k), (ss, s), (ms, m)))
            for lo in range(0, len(k), HANDED):
                at = slice(lo, lo + HANDED)
                yield pa.RecordBatch.from_arrays([pa.array(known[at]), pa.array(h[at].view(np.int64)), pa.array(x[at].view(np.int64)), pa.array(k[at]), pa.array(s[at].astype(np.int32)), pa.array(m[at].astype(np.int32))], ["known", "h", "x", "k", "s", "m"])

        got, size = [], 0
        for r in _contexts(batches, length, frequent):
            got.append(r)
            size += len(r[0])
            if size >= FLUSH:
                yield from emit(got)
                got, size = [], 0
        if got:
            yield from emit(got)

    runs = rows.select("k", "b").mapInArrow(find, "known boolean, h bigint, x bigint, k bigint, s int, m int")
    anchor = Window.partitionBy("known", "h").orderBy("x", "k", "s")
    high = F.max("x").over(anchor.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    met = runs.withColumn("before", F.lag("x").over(anchor)).withColumn("high", high)
    again = F.col("known") | F.coalesce(F.col("before") == F.col("x"), F.lit(False))
    # Contexts are in order: one that is the first of its kind has another before it, or after it.
    met = met.withColumn("again", again).filter(F.col("again") | F.col("before").isNotNull() | (F.col("x") != F.col("high")))
    met = cut(met.select("again", "h", "k", "s", "m"), "met")
    whole = met.filter("again").select("k", "s", "m")
    mixed = met.filter("not again").select("h", "k", "s", "m")

    per_anchor = mixed.groupBy("h").agg(F.count("*").alias("n"))
    n, crowded = per_anchor.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > MOST)).first()
    hot = F.lit(False)
    if crowded:
        often = per_anchor.filter(F.col("n") > MOST).select(F.col("h").alias("h_"))
        mixed = mixed.join(F.broadcast(often) if crowded <= CROWDED else often, F.col("h") == F.col("h_"), "left")
        hot = F.col("h_").isNotNull()
    wanted = mixed.groupBy(F.col("k").alias("k_")).agg(F.collect_list(F.struct("h", "s", "m", hot.alias("hot"))).alias("r"))
    context = F.struct(F.col("r.h").alias("h"), F.col("r.s").alias("s"), F.col("r.hot").alias("hot"), F.expr(f"substring(b, r.s + 1, r.m + {length - 1})").alias("c"))
    contexts = rows.join(wanted, F.col("k") == F.col("k_")).select("k", "b", F.explode("r").alias("r")).select("k", context.alias("c")).select("k", "c.*")

    def merge(table):
        import pyarrow as pa

        k, s, m = _later_windows(table.column("k").to_numpy(), table.column("s").to_numpy().astype(np.int64), table.column("c").to_pylist(), length)
        return pa.table({"k": k, "s": s.astype(np.int32), "m": m.astype(np.int32)})

    def merged(contexts):
        bucket = F.pmod("h", F.lit(max(1, -(-n // BUCKET))))
        return contexts.select("h", "k", "s", "c").groupBy(bucket.alias("bucket")).applyInArrow(merge, "k bigint, s int, m int")

    if not crowded:
        return whole.unionByName(merged(contexts))
    contexts = cut(contexts, "contexts")
    windows = contexts.filter("hot").select("k", F.expr(f"explode(transform(sequence(0, length(c) - {length}), j -> named_struct('s', s + j, 'w', substring(c, j + 1, {length}))))").alias("w")).select("k", "w.*")
    leads = windows.groupBy("w").agg(F.min(F.struct("k", "s")).alias("lead"), F.count("*").alias("n")).filter("n > 1")
    late = windows.join(leads, "w").filter(F.struct("k", "s") != F.col("lead")).select("k", "s", F.lit(1).alias("m"))
    return whole.unionByName(merged(contexts.filter("not hot"))).unionByName(late)


def dedup(docs: DataFrame, length: int = LENGTH, keep: list[str] | None = None, whole: bool = False) -> DataFrame:
    """`keep` columns (all but text, unless named), n_bytes, n_removed, n_spans and kept (the bytes left).

    Null and empty texts have no bytes. Rows that share a doc_id are documents of their own, in order
    of their texts; null ids come first. Texts shorter than `length` are never touched. An empty
    table gives no rows. With `whole`, kept has only UTF-8 characters that lost no byte.
    """
    keep = [c for c in docs.columns if c != "text"] if keep is None else keep
    if clash := {"n_bytes", "n_removed", "n_spans", "kept"} & set(keep):
        raise ValueError(f"keep {sorted(clash)} inside a struct")
    rows, _ = in_order(docs)
    rows = rows.select(*[F.col("row")[c].alias(f"c_{i}") for i, c in enumerate(keep)], "k", F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    spans = removed_runs(rows, length).groupBy(F.col("k").alias("k_")).agg(F.collect_list("s").alias("s"), F.collect_list("m").alias("m"))
    names = [f"c_{i}" for i in range(len(keep))]
    joined = rows.join(spans, F.col("k") == F.col("k_"), "left").select(*names, "b", "s", "m")
    schema = joined.select(*names).schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")

    def apply(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            at = len(names)
            for b, s, m in zip(batch.column(at), batch.column(at + 1), batch.column(at + 2), strict=True):
                b = b.as_py()
                if not s.is_valid:
                    out.append((len(b), 0, 0, b))
                    continue
                s, m = s.values.to_numpy(), m.values.to_numpy()
                edge = np.zeros(len(b) + 1, np.int32)
                np.add.at(edge, s, 1)
                np.add.at(edge, s + m - 1 + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
                data, n = np.frombuffer(b, np.uint8), int(gone.sum())
                if whole:
                    character = np.cumsum((data & 0xC0) != 0x80)
                    gone = np.bincount(character, gone)[character] > 0
                out.append((len(b), n, spans, data[~gone].tobytes()))
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            made = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *made], names=[f.name for f in schema])

    done = joined.mapInArrow(apply, schema)
    return done.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "n_bytes", "n_removed", "n_spans", "kept")

