"""Token ids on disk as Re-Pair grammars, one per shard, with random access to documents.

Re-Pair replaces the most frequent adjacent pair of ids by a new symbol, again and again, until no
pair occurs twice. Here a round replaces many pairs at once: those at least a sixty-fourth as
frequent as the most frequent, leaving out any pair whose left symbol is another's right one, so that occurrences
never overlap and a round gives what replacing its pairs one by one would. Of a run of one symbol
every second place is an occurrence, counted from the left. Pairs never cross the end of a document.
A place whose pair occurs once can never take part again, whatever is replaced around it, so a round
only looks at the others.

A shard holds its rules, each symbol's expansion length, its symbol stream, and each document's place
in it. Lengths say where every part of a symbol goes, so a document, or any span of ids, is decoded
from its own symbols alone.

Shards are rows of a Parquet table (any file system that Spark writes): part, shard, n_tokens and
the grammar's bytes. Parts are ranges of doc_id, shards follow each other inside a part.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunked_tokenizer import DROPS_BLANKS, kept_tokenizer
from .common import cut, text_or_empty

MAGIC = b"KSRP0002"
#: Slots of the table that finds pairs which occur once, as a power of two.
BITS = 21
#: How often a round looks at pairs that others stand against.
LOOKS = 8
#: Documents that are decoded together.
TOGETHER = 256
#: Documents that are encoded together, bytes of text that are cut at once, and pieces of text that a
#: worker remembers; none changes an id.
ENCODED, AT_ONCE, CACHED = 1024, 2_000_000, 250_000
SHARDS = "part int, shard int, n_docs bigint, n_tokens bigint, grammar binary"


def _compatible(left: np.ndarray, right: np.ndarray, n_symbols: int) -> np.ndarray:
    """Which pairs, most frequent first, a round takes: no symbol is a left one and a right one of different pairs.

    A pair is taken when none before it stands against it; those that a taken one stands against are out.
    What is then left is looked at again, a few times; the rest waits for another round.
    """
    take, rest = np.zeros(len(left), bool), np.arange(len(left))
    is_left, is_right = np.zeros(n_symbols, bool), np.zeros(n_symbols, bool)
    for _ in range(LOOKS):
        a, b = left[rest], right[rest]
        first_left, first_right = np.full(n_symbols, len(left)), np.full(n_symbols, len(left))
        first_left[a[::-1]] = first_right[b[::-1]] = rest[::-1]
        good = (first_right[a] >= rest) & (first_left[b] >= rest)
        take[rest[good]] = is_left[a[good]] = is_right[b[good]] = True
        rest = rest[~(good | is_right[a] | is_left[b])]
        if not len(rest):
            break
    return take


def _slots(key: np.ndarray, seed: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed) >> np.uint64(64 - bits)).astype(np.int64)


def repair(ids: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, stream, last): the symbols of each rule, the stream of symbols, and where documents end in it."""
    base = int(ids.max()) + 1 if len(ids) else 0
    sym = ids.astype(np.uint32)
    last = np.zeros(len(sym), bool)
    last[doc_ends - 1] = True
    open_ = ~last[:-1]  # places whose pair may occur again
    made, lefts, rights, turn = base, [], [], 0
    while len(sym) > 1:
        at = np.flatnonzero(open_)
        a, b = sym[at], sym[at + 1]
        key = a.astype(np.uint64) << np.uint64(32) | b
        same = np.flatnonzero(a == b)
        counted = None
        if len(same):
            counted = np.ones(len(at), bool)
            # Places of a run of equal pairs in turn: every second one overlaps the one before.
            p = at[same]
            run = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1] + 1) | (sym[p[1:]] != sym[p[:-1]]))))
            odd = (np.arange(len(p)) - np.repeat(run, np.diff(np.append(run, len(p))))) % 2 == 1
            counted[same[odd]] = False
        if turn % 3 == 2:
            # Pairs by slot of a table: one that is alone in its slot occurs once, and its place is closed for good.
            bits = min(BITS, max(8, len(at).bit_length() + 1))
            slot = _slots(key, turn, bits)
            alone = np.bincount(slot, minlength=1 << bits)[slot] == 1
            open_[at[alone]] = False
            some = ~alone if counted is None else counted & ~alone
            at, key = at[some], key[some]
        elif counted is not None:
            at, key = at[counted], key[counted]
        ranked = np.sort(key)
        edge = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1], [True]))) if len(ranked) else np.zeros(1, np.int64)
        count = np.diff(edge)
        most = int(count.max()) if len(count) else 0
        if most < 2:
            break
        chosen = np.flatnonzero(count >= max(2, most // 64))
        chosen = chosen[np.argsort(most - count[chosen], kind="stable")]
        pairs = ranked[edge[chosen]]
        left, right = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        take = _compatible(left, right, made)
        # A pair whose slot another one has waits for a round with other slots.
        taken = np.flatnonzero(take)[::-1]
        bits = min(BITS, 4 + max(8, int(len(taken)).bit_length()))
        table = np.full(1 << bits, -1, np.int32)
        table[_slots(pairs[taken], turn, bits)] = taken
        taken = taken[table[_slots(pairs[taken], turn, bits)] == taken][::-1]
        number = table[_slots(key, turn, bits)]
        turn += 1
        if not len(taken):
            continue
        rule = np.full(len(pairs), -1, np.int64)
        rule[taken] = np.arange(len(taken))
        left, right = left[taken], right[taken]
        hit = np.flatnonzero(number >= 0)
        hit = hit[pairs[number[hit]] == key[hit]]
        at, number = at[hit], rule[number[hit]]
        sym[at] = made + number
        last[at] = last[at + 1]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        keep = np.flatnonzero(keep)
        # The pair behind a replaced one begins at its first place now.
        behind = at[at + 1 < len(open_)]
        open_[behind] = open_[behind + 1]
        sym, last, open_ = sym[keep], last[keep], open_[keep[: np.searchsorted(keep, len(open_))]]
        open_ = open_[: len(sym) - 1] & ~last[:-1]
        lefts.append(left)
        rights.append(right)
        made += len(left)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(lefts or none), np.concatenate(rights or none), sym, last


def compress(ids: np.ndarray, doc_ends: np.ndarray) -> bytes:
    """Grammar bytes of `ids`; doc_ends[i] is the place after document i's last id (documents are not empty)."""
    base = int(ids.max()) + 1 if len(ids) else 0
    left, right, sym, last = repair(ids, doc_ends)
    length = _lengths(left, right, base)
    wide = base + len(left) > 1 << 16
    head = struct.pack("<8sIIQQI", MAGIC, base, len(left), len(sym), len(doc_ends), 4 if wide else 2)
    unit = np.uint32 if wide else np.uint16
    parts = [left.astype(unit), right.astype(unit), length.astype(np.uint64), doc_ends.astype(np.uint64), (np.flatnonzero(last) + 1).astype(np.uint64), sym.astype(unit)]
    return head + b"".join(p.tobytes() for p in parts)


def _lengths(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """Expansion length of each rule; a rule's parts are of earlier rules, so what is ready grows until all is."""
    length = np.zeros(base + len(left), np.int64)
    length[:base] = 1
    todo = np.arange(len(left))
    while len(todo):
        a, b = length[left[todo]], length[right[todo]]
        ready = (a > 0) & (b > 0)
        length[base + todo[ready]] = (a + b)[ready]
        todo = todo[~ready]
    return length[base:]


class Grammar:
    """Reader of one shard's bytes."""

    def __init__(self, data: bytes):
        magic, self.base, n_rules, n_sym, n_docs, width = struct.unpack_from("<8sIIQQI", data)
        if magic != MAGIC:
            raise ValueError("not a grammar shard")
        at = struct.calcsize("<8sIIQQI")

        def take(n, dtype):
            nonlocal at
            out = np.frombuffer(data, dtype, n, at)
            at += out.nbytes
            return out

        unit = np.uint32 if width == 4 else np.uint16
        self.left, self.right = take(n_rules, unit), take(n_rules, unit)
        self.length = take(n_rules, np.uint64).astype(np.int64)
        self.doc_ends, self.places = take(n_docs, np.uint64).astype(np.int64), take(n_docs, np.uint64).astype(np.int64)
        self.sym = take(n_sym, unit)

    def sizes(self, sym: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for."""
        out = np.ones(len(sym), np.int64)
        rule = np.flatnonzero(sym >= self.base)
        out[rule] = self.length[sym[rule].astype(np.int64) - self.base]
        return out

    def expand(self, sym: np.ndarray) -> np.ndarray:
        """Ids of a stretch of symbols: every part goes to its place, which lengths tell."""
        size = self.sizes(sym)
        out = np.empty(int(size.sum()), np.uint32)
        at = np.cumsum(size) - size
        while len(sym):
            plain = sym < self.base
            out[at[plain]] = sym[plain]
            at = at[~plain]
            rule = sym[~plain].astype(np.int64) - self.base
            a, b = self.left[rule], self.right[rule]
            sym, at = np.concatenate((a, b)), np.concatenate((at, at + self.sizes(a)))
        return out

    def docs(self, first: int, stop: int) -> np.ndarray:
        """Ids of documents first..stop, from their own symbols."""
        return self.expand(self.sym[self.places[first - 1] if first else 0 : self.places[stop - 1]]) if stop > first else np.zeros(0, np.uint32)

    def doc(self, i: int) -> np.ndarray:
        return self.docs(i, i + 1)

    def token_span(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of the shard: expansion lengths find the symbols that hold them."""
        ends = np.cumsum(self.sizes(self.sym))
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skip = start - (int(ends[a - 1]) if a else 0)
        return self.expand(self.sym[a:b])[skip : skip + stop - start]


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_tokens: int = 1_000_000) -> DataFrame:
    """Encode documents in ascending doc_id order into the shard table and return it, read from its files.

    Null and empty texts are their end id alone. A null doc_id comes first; rows that share a
    doc_id follow each other by text. Other columns are ignored; an empty table gives no shards.
    The grammar column starts with the shard's doc ids.
    """

    def encode(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        tok = kept_tokenizer(tokenizer, DROPS_BLANKS, CACHED, AT_ONCE)
        doc_ids: list[int | None] = []
        packed: list[np.ndarray] = []
        size = 0

        def close():
            nonlocal shard, size, doc_ids, packed
            ends = np.cumsum([len(p) for p in packed])
            body = compress(np.concatenate(packed), ends)
            null = np.array([d is None for d in doc_ids], np.uint8)
            names = np.array([d or 0 for d in doc_ids], np.int64)
            row = [[part], [shard], [len(doc_ids)], [int(ends[-1])], [struct.pack("<Q", len(doc_ids)) + names.tobytes() + null.tobytes() + body]]
            shard, size, doc_ids, packed = shard + 1, 0, [], []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "shard", "n_docs", "n_tokens", "grammar"])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids), ENCODED):
                made, ends = tok.encode_with_end(texts.slice(lo, ENCODED), end_id)
                for doc, p in zip(ids[lo : lo + ENCODED], np.split(made, ends[:-1]), strict=True):
                    doc_ids.append(doc)
                    packed.append(p)
                    size += len(p)
                    if size >= shard_tokens:
                        yield close()
        if doc_ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return cut(rows.mapInArrow(encode, SHARDS), "shards")


def read_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, Grammar]:
    """Doc ids, null flags and grammar of a stored shard."""
    (n,) = struct.unpack_from("<Q", data)
    return np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.uint8, n, 8 + 8 * n), Grammar(data[8 + 9 * n :])


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, decoded from the shards."""
    per_part = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    before = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.select("part", F.coalesce(F.sum("n").over(before_part), F.lit(0)).alias("p0"))
    starts = shards.select("part", "shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("s0")).join(per_part, "part")
    starts = cut(starts.select("part", "shard", (F.col("p0") + F.col("s0")).alias("first")), "starts")

    def decode(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names, null, g = read_shard(data.as_py())
                ends, crc = g.doc_ends, []
                begins = np.concatenate(([0], ends[:-1]))
                for lo in range(0, len(ends), TOGETHER):
                    hi = min(lo + TOGETHER, len(ends))
                    raw, zero = g.docs(lo, hi).view(np.uint8).data, int(begins[lo])
                    crc += [zlib.crc32(raw[4 * (a - zero) : 4 * (b - zero)]) for a, b in zip(begins[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, mask=null.astype(bool)), pa.array(begins + first), pa.array(ends - begins), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.join(starts, ["part", "shard"]).select("first", "grammar").mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def open_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(path)
