"""Interpolated modified Kneser-Ney language model, counted in Spark and scored from mapped files.

Trigrams (u, v, w) over two starts, a text's words and one end; with order 2, bigrams.

    p(w | u v) = max(c(u v w) - D3(c), 0) / c(u v .) + g3(u v) p(w | v)
    p(w | v)   = max(a(v w) - D2(a), 0) / a(v .) + g2(v) p(w)
    p(w)       = max(b(w) - D1(b), 0) / B + g1 / (V + 1)

a(v w) is the number of distinct u before v w (of v the start, where u is always the same, the count),
b(w) that of distinct v before w, B their sum, g the mass that discounts D set free, and discounts come
from counts of counts.

1. A bounded sample of texts estimates the number of tokens, which sets the number of parts, and the
   middle words v that hold more than a fraction of a part.
2. A map task counts its split and deals trigrams by their middle word, so that the contexts (u v), the
   bigrams (v w) and the context v are whole in one part. A frequent v is dealt over a square of cells by
   hashes of u and w. Trigrams travel as packed arrays, words by a dictionary of each, in few rows.
3. A part sums its trigrams and writes its sorted hash arrays. What it knows of words goes to parts by
   word; what cells know of a frequent v goes with that and is summed there. These write theirs.

An array has 48 bits of each key, in order, and counts in one byte, with a table of 64-bit numbers for
those that need more. Contexts that occur once are not stored: a bigram that is known, and of which
nothing is stored as a context, was followed once. Files go to the shared folder under names of their
own and appear by rename, so a task that runs twice does no harm. Workers map them and look up whole
batches; a model of any size needs little memory.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, text_or_empty, work_dir

#: Words are known by 56 bits of their 64-bit hash: a billion distinct words have 7 pairs alike in them.
WORD_BITS = np.uint64((1 << 56) - 1)
START = np.uint64(0x9E3779B97F4A7C15) & WORD_BITS
END = np.uint64(0xD1B54A32D192ED03) & WORD_BITS
#: Tokens that a map task counts at once, tokens that are scored at once, and tokens a part should hold.
FLUSH, BATCH, PART = 3_000_000, 400_000, 3_000_000
#: Texts of the sample, about; a middle word that holds more than 1 / HOT of a part gets cells of its own.
SAMPLE, HOT = 4000, 4
#: Bytes of local copies of a remote model that a worker keeps at most, beyond the file in use.
LOCAL_BYTES = 1 << 30


def tokens(text: str) -> np.ndarray:
    """Hashes of a text's words, A-Z lower-cased, and the end."""
    from xxhash import xxh64_intdigest as digest

    words = text.encode("utf-8", "replace").lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = list(map(digest, words))
    out &= WORD_BITS
    out[-1] = END
    return out


def histories(toks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """u, v and w of every token of some texts."""
    w = np.concatenate(toks)
    first = np.cumsum([0, *(len(t) for t in toks[:-1])])
    v = np.concatenate(([START], w[:-1]))
    v[first] = START
    u = np.concatenate(([START], v[:-1]))
    u[first] = START
    return u, v, w


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = a * np.uint64(0x9FB21C651E98DF25) ^ (b + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the keys, and where each distinct one begins in it."""
    order = np.argsort(key)
    k = key[order]
    return order, np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, at) if len(at) else values[:0]


@dataclass
class Layout:
    """Which part a middle word has: `parts` by hash, then a square of `side` by `side` cells for each hot word."""

    parts: int
    hot: np.ndarray
    side: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, parts: int, shares: list[tuple[int, float]]) -> "Layout":
        shares = sorted((w & (1 << 64) - 1, s) for w, s in shares)
        side = np.array([max(2, int(np.ceil(np.sqrt(2 * s * parts)))) for _, s in shares], np.int64)
        return cls(parts, np.array([w for w, _ in shares], np.uint64), side, parts + np.cumsum(side * side) - side * side)

    def cell(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = ((v >> np.uint64(7)) % np.uint64(self.parts)).astype(np.int64)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, v), len(self.hot) - 1)
            rows = np.flatnonzero(self.hot[at] == v)
            side = self.side[at[rows]]
            place = lambda x: ((x[rows] >> np.uint64(9)) % side.astype(np.uint64)).astype(np.int64)
            out[rows] = self.first[at[rows]] + place(u) * side + place(w)
        return out

    def is_hot(self, v: np.ndarray) -> np.ndarray:
        return np.isin(v, self.hot)


def _pack(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


class _Unpack:
    def __init__(self, blob: bytes):
        self.raw, self.at = zlib.decompress(blob), 0

    def take(self, n: int, dtype) -> np.ndarray:
        out = np.frombuffer(self.raw, dtype, n, self.at)
        self.at += out.nbytes
        return out


def _planes(a: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of numbers, byte by byte, which compresses better than number by number."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize)[:, :size].T).tobytes()


def _from_planes(raw: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = raw.reshape(size, -1).T
    return out.view(np.uint64).ravel()


def pack_trigrams(u: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray) -> bytes:
    """Distinct words once, in 7 bytes each; places in them, in order of (v, u, w), v by steps; counts with a table of the large ones."""
    words, place = np.unique(np.concatenate((u, v, w)), return_inverse=True)
    u, v, w = place.astype(np.uint64).reshape(3, -1)
    if len(words) < 1 << 21:
        order = np.argsort(v << np.uint64(42) | u << np.uint64(21) | w)
    else:
        order = np.lexsort((w, u, v))
    u, v, w, c = u[order], v[order], w[order], c[order]
    size = 2 if len(words) <= 1 << 16 else 4
    large = np.flatnonzero(c > 254)
    head = np.array([len(c), len(words), len(large)], np.uint64)
    body = b"".join(_planes(x, size) for x in (np.diff(v, prepend=np.uint64(0)), u, w))
    rest = zlib.compress(body + np.minimum(c, 255).astype(np.uint8).tobytes() + large.astype(np.uint64).tobytes() + c[large].astype(np.uint64).tobytes(), 1)
    return head.tobytes() + _planes(words, 7) + rest


def unpack_trigrams(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, n_words, n_large = np.frombuffer(blob, np.uint64, 3).tolist()
    words = _from_planes(np.frombuffer(blob, np.uint8, 7 * n_words, 24), 7)
    size = 2 if n_words <= 1 << 16 else 4
    rest = _Unpack(blob[24 + 7 * n_words :])
    v, u, w = (_from_planes(rest.take(n * size, np.uint8), size) for _ in range(3))
    c = rest.take(n, np.uint8).astype(np.int64)
    large = rest.take(n_large, np.uint64).astype(np.int64)
    c[large] = rest.take(n_large, np.uint64)
    return words[u], words[np.cumsum(v)], words[w], c


def _filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


class HashArray:
    """Rows of counts by hash, in a file: 48 bits of each key in order, a byte a count, and a table of large rows."""

    @staticmethod
    def write(folder: str, name: str, key: np.ndarray, values: np.ndarray) -> None:
        """`values` has a row for each key; keys are distinct."""
        order = np.argsort(key)
        key, values = key[order], values[order].astype(np.uint64)
        large = np.flatnonzero(values.max(1) > 254) if len(values) else np.zeros(0, np.int64)
        small = np.minimum(values, 255).astype(np.uint8)
        small[large] = 255
        head = np.array([len(key), values.shape[1], len(large)], np.uint64)
        fs, path = _filesystem(folder)
        fs.create_dir(path, recursive=True)
        tmp = f"{path}/.{name}.{os.getpid()}.{int.from_bytes(os.urandom(4))}"
        with fs.open_output_stream(tmp) as f:
            # Eight-byte fields come first, so that all are aligned.
            for a in (head, large.astype(np.uint64), values[large], (key >> np.uint64(32)).astype(np.uint32), (key >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.uint16), small):
                f.write(np.ascontiguousarray(a).tobytes())
        fs.move(tmp, f"{path}/{name}")

    def __init__(self, raw: np.ndarray):
        n, k, large = (int(x) for x in raw[:24].view(np.uint64))
        at = 24

        def take(count, dtype):
            nonlocal at
            size = count * np.dtype(dtype).itemsize
            out = raw[at : at + size].view(dtype)
            at += size
            return out

        self.size, self.width = raw.nbytes, k
        self.large, self.values = take(large, np.uint64), take(large * k, np.uint64).reshape(large, k)
        self.high, self.low = take(n, np.uint32), take(n, np.uint16)
        self.small = take(n * k, np.uint8).reshape(n, k)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of counts of some keys (zeros where there is none), and which are there."""
        out, hit = np.zeros((len(key), self.width), np.int64), np.zeros(len(key), bool)
        if not len(self.high) or not len(key):
            return out, hit
        high, low = (key >> np.uint64(32)).astype(np.uint32), (key >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.uint16)
        at, rows = np.searchsorted(self.high, high), np.arange(len(key))
        while len(rows):  # keys that share the first bits follow each other
            inside = at < len(self.high)
            rows, at = rows[inside], at[inside]
            same = self.high[at] == high[rows]
            rows, at = rows[same], at[same]
            found = self.low[at] == low[rows]
            hit[rows[found]] = True
            out[rows[found]] = self.small[at[found]]
            big = found & (self.small[at, 0] == 255)
            if big.any():
                out[rows[big]] = self.values[np.searchsorted(self.large, at[big].astype(np.uint64))]
            rows, at = rows[~found], at[~found] + 1
        return out, hit


_MAPPED: OrderedDict[tuple[str, str], HashArray | None] = OrderedDict()
_LOCAL: OrderedDict[tuple[str, str], int] = OrderedDict()


def _map(folder: str, name: str) -> HashArray | None:
    """A mapped file, None where there is none; from a remote store, by way of an unlinked local copy.

    Copies used longest ago are let go of beyond LOCAL_BYTES.
    """
    key = (folder, name)
    if key in _MAPPED:
        if key in _LOCAL:
            _LOCAL.move_to_end(key)
        return _MAPPED[key]
    fs, path = _filesystem(folder)
    info = fs.get_file_info(f"{path}/{name}")
    have = None
    if info.is_file and fs.type_name == "local":
        have = HashArray(np.memmap(f"{path}/{name}", np.uint8, "r"))
    elif info.is_file:
        while _LOCAL and sum(_LOCAL.values()) + info.size > LOCAL_BYTES:
            _MAPPED.pop(_LOCAL.popitem(last=False)[0])
        with tempfile.TemporaryFile() as local:
            with fs.open_input_stream(f"{path}/{name}") as f:
                while part := f.read(1 << 24):
                    local.write(part)
            local.flush()
            have = HashArray(np.memmap(local, np.uint8, "r"))
        _LOCAL[key] = info.size
    _MAPPED[key] = have
    return have


def _look_up(folder: str, kind: str, part: np.ndarray, key: np.ndarray, width: int) -> np.ndarray:
    """Rows of counts by part and key, zeros where there is none."""
    out = np.zeros((len(key), width), np.int64)
    order = np.argsort(part, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], np.diff(part[order]) != 0, [True]))) if len(part) else np.zeros(1, np.int64)
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        rows = order[lo:hi]
        table = _map(folder, f"{kind}-{int(part[rows[0]])}")
        if table is not None:
            out[rows] = table.find(key[rows])[0]
    return out


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from counts of counts; a small corpus without some of them gets usual values."""
    if min(n[0], n[1], n[2]) == 0:
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return tuple(min(max(x, 0.01), i + 0.99) for i, x in enumerate(d))


def _taken(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(0.0, n - np.array((0.0, *d))[np.minimum(n, 3)])


@dataclass
class Model:
    folder: str
    order: int
    layout: Layout
    tokens: int
    types: int
    bigrams: int
    #: Discounts of trigrams, bigrams and words.
    discounts: tuple[tuple[float, float, float], ...]
    low: tuple[int, int, int]
    #: a(v .) and its counts of counts of the hot words, in the layout's order.
    hot_contexts: np.ndarray

    def _by_word(self, w: np.ndarray) -> np.ndarray:
        """c, b, a(w .) and its counts of counts 1, 2, 3 and more, of each word."""
        words, back = np.unique(w, return_inverse=True)
        found = _look_up(self.folder, "words", _word_part(words, self.layout.parts), words, 6)
        if len(self.layout.hot):
            at = np.minimum(np.searchsorted(self.layout.hot, words), len(self.layout.hot) - 1)
            hot = self.layout.hot[at] == words
            found[hot, 2:] = self.hot_contexts[at[hot]]
        return found[back]

    def log10(self, toks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """log10 p of every token of some texts, and c(w)."""
        u, v, w = histories(toks)
        hot = self.layout.is_hot(v)
        plain = ((v >> np.uint64(7)) % np.uint64(self.layout.parts)).astype(np.int64)
        word = self._by_word(w)
        context = np.zeros((len(w), 4), np.int64)  # of v: that of the word before, or of the start
        context[1:] = word[:-1, 2:]
        first = v == START
        context[first] = self._by_word(np.array([START]))[0, 2:]
        total = max(1, self.bigrams)
        back = sum(d * n for d, n in zip(self.discounts[2], self.low, strict=True)) / total if self.bigrams else 1.0
        p = _taken(word[:, 1], self.discounts[2]) / total + back / (self.types + 1)
        a = np.zeros(len(w), np.int64)
        vw = mix(v, w)
        a[~hot] = _look_up(self.folder, "bigrams", plain[~hot], vw[~hot], 1)[:, 0]
        a[hot] = _look_up(self.folder, "hot-bigrams", _word_part(w[hot], self.layout.parts), vw[hot], 1)[:, 0]
        p = _one_level(a, context, self.discounts[1], p)
        if self.order == 3:
            uv = mix(u, v)
            c = _look_up(self.folder, "trigrams", self.layout.cell(u, v, w), mix(vw, u), 1)[:, 0]
            context = np.zeros((len(w), 4), np.int64)
            context[~hot] = _look_up(self.folder, "contexts", plain[~hot], uv[~hot], 4)
            context[hot] = _look_up(self.folder, "hot-contexts", _word_part(uv[hot], self.layout.parts), uv[hot], 4)
            once = np.zeros(len(w), bool)
            once[1:] = a[:-1] > 0  # the bigram u v is known, as that of the token before
            once &= ~first & (context[:, 0] == 0)
            context[once] = (1, 1, 0, 0)
            p = _one_level(c, context, self.discounts[0], p)
        return np.log10(p), word[:, 0]


def _one_level(n: np.ndarray, context: np.ndarray, d: tuple[float, float, float], lower: np.ndarray) -> np.ndarray:
    seen = context[:, 0] > 0
    total = np.maximum(1, context[:, 0])
    gamma = np.where(seen, (context[:, 1:] @ np.array(d)) / total, 1.0)
    return np.where(seen, _taken(n, d) / total, 0.0) + gamma * lower


def _word_part(w: np.ndarray, parts: int) -> np.ndarray:
    return (w % np.uint64(parts)).astype(np.int64)


def _layout(rows: DataFrame, part_tokens: int) -> Layout:
    """Parts from the sample's tokens, and middle words too frequent for one; both are of the layout only, not of results."""
    n = rows.count()
    share = min(1.0, SAMPLE / max(1, n))

    def count(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for t in batch.column(0):
                w, c = np.unique(histories([tokens(t.as_py())])[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c.astype(np.int64))], ["w", "c"])

    picked = rows.sample(share, 5) if share < 1 else rows
    counted = picked.mapInArrow(count, "w bigint, c bigint").groupBy("w").agg(F.sum("c").alias("c"))
    total = counted.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    parts = max(2, int(np.ceil(total / share / part_tokens)))
    # Fewer than HOT * parts words can be as frequent as this.
    often = counted.filter(F.col("c") * (HOT * parts) > total).collect() if parts > 2 else []
    return Layout.of(parts, [(r.w, r.c / total) for r in often])


def train(docs: DataFrame, folder: str | None = None, order: int = 3, part_tokens: int = PART) -> Model:
    """Count every text of `docs` (null: empty) and write the model's arrays under `folder`.

    A table without rows gives a model that knows nothing. Only the text column is read.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = docs.sparkSession
    folder = f"{folder or work_dir(spark)}/kneser-ney"
    rows = docs.select(text_or_empty().alias("text"))
    layout = _layout(rows, part_tokens)
    parts = layout.parts

    def count(batches) -> Iterator:
        import pyarrow as pa

        def emit(toks):
            u, v, w = histories(toks)
            if order == 2:
                u = np.full(len(u), START)
            at, first = groups(mix(mix(v, w), u))
            c = np.diff(np.append(first, len(at)))
            u, v, w = (x[at[first]] for x in (u, v, w))
            cells = layout.cell(u, v, w)
            by = np.argsort(cells, kind="stable")
            u, v, w, c, cells = (x[by] for x in (u, v, w, c, cells))
            edge = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1], [True])))
            blobs = [pack_trigrams(u[a:b], v[a:b], w[a:b], c[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(cells[edge[:-1]]), pa.array(blobs, pa.binary())], ["part", "blob"])

        toks, size = [], 0
        for batch in batches:
            for t in batch.column(0):
                toks.append(tokens(t.as_py()))
                size += len(toks[-1])
                if size >= FLUSH:
                    yield emit(toks)
                    toks, size = [], 0
        if toks:
            yield emit(toks)

    def merge(key, table):
        import pyarrow as pa

        part = key[0].as_py()
        hot = part >= parts
        got = [unpack_trigrams(b.as_py()) for b in table.column("blob")]
        u, v, w, c = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        vw = mix(v, w)
        at, first = groups(mix(vw, u))
        c = sums(c[at], first)
        u, v, w, vw = (x[at[first]] for x in (u, v, w, vw))
        stats = {f"t{k}": int((c == k).sum()) for k in (1, 2, 3, 4)}
        out = {}
        if order == 3:
            HashArray.write(folder, f"trigrams-{part}", mix(vw, u), c[:, None])
            uv = mix(u, v)
            at, first = groups(uv)
            ctx = np.stack([sums(x[at].astype(np.int64), first) for x in (c, c == 1, c == 2, c >= 3)], 1)
            key_ = uv[at[first]]
            if hot:
                out["contexts"] = key_, key_, ctx
            else:
                some = (ctx[:, 0] > 1) | (v[at[first]] == START)
                HashArray.write(folder, f"contexts-{part}", key_[some], ctx[some])
        # Bigrams: distinct u before v w, or occurrences where v is the start or the order is 2.
        at, first = groups(vw)
        n_u = sums(np.where((v == START) | (order == 2), c, 1)[at], first)
        bv, bw, bc = v[at[first]], w[at[first]], sums(c[at], first)
        if hot:
            out["bigrams"] = bw, bv, n_u[:, None]
            new = np.zeros(len(bw), np.int64)
        else:
            HashArray.write(folder, f"bigrams-{part}", vw[at[first]], n_u[:, None])
            stats |= {f"a{k}": int((n_u == k).sum()) for k in (1, 2, 3, 4)}
            new = np.ones(len(bw), np.int64)
            at, first = groups(bv)
            out["histories"] = bv[at[first]], bv[at[first]], np.stack([sums(x[at].astype(np.int64), first) for x in (n_u, n_u == 1, n_u == 2, n_u >= 3)], 1)
        at, first = groups(bw)
        out["words"] = bw[at[first]], bw[at[first]], np.stack([sums(x[at], first) for x in (bc, new)], 1)
        to, kinds, blobs, sizes = [], [], [], []
        for kind, (by, other, values) in out.items():
            target = _word_part(by, parts)
            order_ = np.argsort(target, kind="stable")
            edge = np.flatnonzero(np.concatenate(([True], np.diff(target[order_]) != 0, [True]))) if len(target) else np.zeros(1, np.int64)
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                rows_ = order_[a:b]
                to.append(int(target[rows_[0]]))
                kinds.append(kind)
                sizes.append(b - a)
                blobs.append(_pack(by[rows_], *([other[rows_]] if kind == "bigrams" else []), *(_narrow(values[rows_, j]) for j in range(values.shape[1]))))
        names = [f"t{k}" for k in (1, 2, 3, 4)] + [f"a{k}" for k in (1, 2, 3, 4)]
        cols = {n: pa.array([stats.get(n, 0) if i == 0 else 0 for i in range(len(to))], pa.int64()) for n in names}
        return pa.table({"part": pa.array(to, pa.int64()), "kind": pa.array(kinds, pa.string()), "n": pa.array(sizes, pa.int64()), "blob": pa.array(blobs, pa.binary()), **cols})

    def finish(key, table):
        import pyarrow as pa

        part, got, stats = key[0].as_py(), {}, {}
        widths = {"words": 2, "histories": 4, "contexts": 4, "bigrams": 1}
        for kind, n, blob in zip(table.column("kind").to_pylist(), table.column("n").to_pylist(), table.column("blob"), strict=True):
            raw = _Unpack(blob.as_py())
            fields = [raw.take(n, np.uint64) for _ in range(2 if kind == "bigrams" else 1)]
            got.setdefault(kind, []).append((*fields, np.stack([_wide(raw, n) for _ in range(widths[kind])], 1)))
        for k in (1, 2, 3, 4):
            for s in "ta":
                stats[f"{s}{k}"] = sum(table.column(f"{s}{k}").to_pylist())
        join = {kind: [np.concatenate(x) for x in zip(*rows_, strict=True)] for kind, rows_ in got.items()}
        empty = np.zeros(0, np.uint64)
        w, cb = join.get("words", (empty, np.zeros((0, 2), np.int64)))
        h, hv = join.get("histories", (empty, np.zeros((0, 4), np.int64)))
        hot_rows = {}
        if "bigrams" in join:
            bw, bv, n_u = join["bigrams"]
            vw = mix(bv, bw)
            at, first = groups(vw)
            n_u, bw, bv = sums(n_u[at, 0], first), bw[at[first]], bv[at[first]]
            HashArray.write(folder, f"hot-bigrams-{part}", vw[at[first]], n_u[:, None])
            for k in (1, 2, 3, 4):
                stats[f"a{k}"] += int((n_u == k).sum())
            w, cb = np.concatenate((w, bw)), np.concatenate((cb, np.stack((np.zeros(len(bw), np.int64), np.ones(len(bw), np.int64)), 1)))
            at, first = groups(bv)
            hot_rows = dict(zip(bv[at[first]].view(np.int64).tolist(), np.stack([sums(x[at].astype(np.int64), first) for x in (n_u, n_u == 1, n_u == 2, n_u >= 3)], 1).tolist(), strict=True))
        if "contexts" in join:
            k, values = join["contexts"]
            at, first = groups(k)
            HashArray.write(folder, f"hot-contexts-{part}", k[at[first]], np.stack([sums(values[at, j], first) for j in range(4)], 1))
        all_keys = np.concatenate((w, h))
        values = np.zeros((len(all_keys), 6), np.int64)
        values[: len(w), :2], values[len(w) :, 2:] = cb, hv
        at, first = groups(all_keys)
        values = np.stack([sums(values[at, j], first) for j in range(6)], 1)
        HashArray.write(folder, f"words-{part}", all_keys[at[first]], values)
        c, b = values[:, 0], values[:, 1]
        stats |= {"n_tokens": int(c.sum()), "types": int((c > 0).sum()), "bigrams": int(b.sum()), "b_more": int((b >= 3).sum()), **{f"b{k}": int((b == k).sum()) for k in (1, 2, 3, 4)}}
        rows_ = [(None, [stats.get(n, 0) for n in names], [0] * 4), *((k, [0] * len(names), x) for k, x in hot_rows.items())]
        cols = {n: pa.array([r[1][i] for r in rows_], pa.int64()) for i, n in enumerate(names)} | {f"h{i}": pa.array([r[2][i] for r in rows_], pa.int64()) for i in range(4)}
        return pa.table({"v": pa.array([r[0] for r in rows_], pa.int64()), **cols})

    numbers = ", ".join(f"{s}{k} bigint" for s in "ta" for k in (1, 2, 3, 4))
    names = [f"{s}{k}" for s in "tab" for k in (1, 2, 3, 4)] + ["b_more", "n_tokens", "types", "bigrams"]
    blobs = rows.mapInArrow(count, "part bigint, blob binary")
    merged = blobs.groupBy("part").applyInArrow(merge, f"part bigint, kind string, n bigint, blob binary, {numbers}")
    stats = merged.groupBy("part").applyInArrow(finish, "v bigint, " + ", ".join(f"{n} bigint" for n in names) + ", h0 bigint, h1 bigint, h2 bigint, h3 bigint")
    # A row for all, and one a hot word.
    found = stats.groupBy("v").agg(*(F.sum(n).alias(n) for n in (*names, "h0", "h1", "h2", "h3"))).collect()
    s = next((r.asDict() for r in found if r.v is None), dict.fromkeys(names, 0))
    by_word = {r.v & (1 << 64) - 1: (r.h0, r.h1, r.h2, r.h3) for r in found if r.v is not None}
    hot_contexts = np.array([by_word.get(int(x), (0, 0, 0, 0)) for x in layout.hot], np.int64).reshape(-1, 4)
    discounts = tuple(_discounts([s[f"{k}{i}"] for i in (1, 2, 3, 4)]) for k in "tab")
    return Model(folder, order, layout, s["n_tokens"], s["types"], s["bigrams"], discounts, (s["b1"], s["b2"], s["b_more"]), hot_contexts)


def _narrow(a: np.ndarray) -> np.ndarray:
    """A column of counts with the size of its numbers in front."""
    size = 1 if not len(a) or a.max() < 1 << 8 else 4 if a.max() < 1 << 32 else 8
    return np.frombuffer(bytes([size]) + a.astype(f"<u{size}").tobytes(), np.uint8)


def _wide(raw: _Unpack, n: int) -> np.ndarray:
    size = int(raw.take(1, np.uint8)[0])
    return raw.take(n, f"<u{size}").astype(np.int64)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10) of each whole text; null texts are empty.

    Repeated rows are scored each; a null doc_id is carried along; other columns are ignored.
    """
    base_of = (0.5, model.tokens + 0.5 * (model.types + 1))

    def scored(batches) -> Iterator:
        import pyarrow as pa

        def emit(ids, toks):
            p, c = model.log10(toks)
            at = np.cumsum([0, *(len(t) for t in toks[:-1])])
            base = np.add.reduceat(np.log10((c + base_of[0]) / base_of[1]), at)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in toks], pa.int64()), pa.array(np.add.reduceat((c > 0).astype(np.int64), at)), pa.array(base), pa.array(np.add.reduceat(p, at))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

        ids, toks, size = [], [], 0
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(d)
                toks.append(tokens(t.as_py()))
                size += len(toks[-1])
                if size >= BATCH:
                    yield emit(ids, toks)
                    ids, toks, size = [], [], 0
        if ids:
            yield emit(ids, toks)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(scored, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")


def train_and_score(docs: DataFrame, order: int = 3, part_tokens: int = PART) -> DataFrame:
    """Learn from the rows whose fold is not 1 and score all; adds held_out and train_tokens.

    An empty table gives no rows; one without training rows scores by a uniform guess.
    """
    model = train(docs.filter(fold(F.col("doc_id")) != 1), order=order, part_tokens=part_tokens)
    return score(docs, model).withColumn("held_out", fold(F.col("doc_id")) == 1).withColumn("train_tokens", F.lit(model.tokens).cast("bigint"))
