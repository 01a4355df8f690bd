"""Hashed text embeddings, cosine scores and top-k retrieval."""

from __future__ import annotations

import functools
import math
import operator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.hashing import FNV32_BASIS, FNV32_PRIME, MASK32, let

DIM = 64
#: Rows of one id that are written out together.
BLOCK = 4096
TOKEN = "[a-z0-9]+"


def trigrams(tok: str) -> Column:
    """One trigram of `<token>` per character of the token."""
    return F.transform(F.sequence(F.lit(1), F.length(tok)), lambda j: F.substring(F.concat(F.lit("<"), F.col(tok), F.lit(">")), j, 3))


def _weights():
    """A function of Arrow batches (id, text in lower case between two spaces) that gives (id, weights), null where no feature falls.

    All that it needs is made here, so that workers need not have this package.
    """
    basis, prime, dim = FNV32_BASIS, FNV32_PRIME, DIM
    at_once, look, rows_at_once, few = 1 << 20, 4096, 4096, 32
    keep = np.zeros(256, bool)
    keep[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True

    def start(kind: bytes) -> np.uint32:
        h = basis
        for c in kind:
            h = ((h ^ c) * prime) & 0xFFFFFFFF
        return np.uint32(h)

    byte, by = np.arange(256, dtype=np.uint32), np.uint32(prime)
    # A trigram's first and last character; outside the token they are the frame's.
    first, last = (start(b"g:") ^ np.where(keep, byte, ord("<")).astype(np.uint32)) * by, np.where(keep, byte, ord(">")).astype(np.uint32)
    word = start(b"w:")

    def cell(h: np.ndarray) -> np.ndarray:
        """dim, and dim + DIM where the sign is negative."""
        return h % np.uint32(dim) + (h >> np.uint32(31)) * np.uint32(dim)

    def words(text: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of tokens, longest first: all take a character at a time, the last few longest go on by themselves."""
        short = np.minimum(end - at, 255)
        order = np.argsort((255 - short).astype(np.uint8), kind="stable")
        at, end = at[order], end[order]
        longer = len(at) - np.cumsum(np.bincount(short, minlength=256))
        h, here = np.full(len(at), word), at.copy()
        for n in longer[: np.argmax(longer < few)]:
            h[:n] ^= text[here[:n]]
            h[:n] *= by
            here[:n] += 1
        for i in np.flatnonzero(here < end):
            x = int(h[i])
            for c in text[here[i] : end[i]].tobytes():
                x = ((x ^ c) * prime) & 0xFFFFFFFF
            h[i] = x
        return at, h

    def counts(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and trigrams by row and cell. Pieces are cut between tokens, so a long text is no larger in memory than its bytes."""
        n, a = len(ends) - 1, 0
        out = np.zeros((2, n, 2 * dim), np.int64)
        while a < len(data) - 1:
            b = min(a + at_once, len(data) - 1)
            while not len(gap := np.flatnonzero(~keep[data[b : b + look]])):
                b += look
            b += gap[0] + 1
            before, text, after = data[a : b - 2], data[a + 1 : b - 1], data[a + 2 : b]
            ok = keep[text]
            lo, hi = np.searchsorted(ends, a, "right") - 1, np.searchsorted(ends, b - 1, "right")
            place = np.repeat(np.arange(hi - lo) * (2 * dim), np.diff(np.clip(ends[lo : hi + 1], a + 1, b - 1)))
            h = first[before]
            for c in (text, last[after]):
                h ^= c
                h *= by
            grams = place[ok] + cell(h[ok])
            at, w = words(text, np.flatnonzero(ok & ~keep[before]), np.flatnonzero(ok & ~keep[after]) + 1)
            for kind, found in enumerate((place[at] + cell(w), grams)):
                out[kind, lo:hi] += np.bincount(found, minlength=(hi - lo) * 2 * dim).reshape(-1, 2 * dim)
            a = b - 1
        return out[0], out[1]

    def weigh(batches):
        import pyarrow as pa

        for whole in batches:
            for i in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(i, rows_at_once)
                text = batch.column(1).cast(pa.large_binary())
                _, ends, data = text.buffers()
                ends = np.frombuffer(ends, np.int64)[text.offset : text.offset + len(text) + 1]
                w, g = counts(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0])
                weight = (w[:, :dim] - w[:, dim:]) + 0.5 * (g[:, :dim] - g[:, dim:])
                none = (w[:, :dim] + w[:, dim:] + g[:, :dim] + g[:, dim:]) == 0
                rows = pa.ListArray.from_arrays(np.arange(len(text) + 1, dtype=np.int32) * dim, pa.array(weight.ravel(), mask=none.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), rows], ["doc", "w"])

    return weigh


def _sums(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, list[Column]]:
    """(doc, rows, w0 to w63): an id's rows and the sums of its texts, null where no feature falls; and the columns of the sums.

    A row's features are hashed and summed where the row is read, so the shuffle moves one row a document
    and task, and no token, trigram or repeated id meets anywhere.
    """
    # The SQL lowers a dotted capital I to a plain i; Spark would add a dot, which ends the token.
    lower = F.lower(F.replace(F.col(text), F.lit("\u0130"), F.lit("i")))
    framed = docs.select(F.col(doc_id).alias("doc"), F.concat(F.lit(" "), F.coalesce(lower, F.lit("")), F.lit(" ")).alias("text"))
    schema = StructType([StructField("doc", framed.schema["doc"].dataType), StructField("w", ArrayType(DoubleType()))])
    names = [f"w{i}" for i in range(DIM)]
    rows = framed.mapInArrow(_weights(), schema)
    return rows.groupBy("doc").agg(F.count("*").alias("rows"), *[F.sum(F.col("w")[i]).alias(c) for i, c in enumerate(names)]), [F.col(c) for c in names]


def _total(terms: list[Column]) -> Column:
    return functools.reduce(operator.add, terms)


def embed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Un-normalised signed sums (doc, dim, weight): `w:token` weighs 1, `g:trigram` of `<token>` weighs 0.5."""
    sums, weights = _sums(docs, doc_id, text)
    rows = sums.select("doc", F.posexplode(F.array(*weights)).alias("dim", "weight"))
    return rows.filter(F.col("weight").isNotNull()).select("doc", F.col("dim").cast("bigint").alias("dim"), "weight")


def embed_vectors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, embedding), a row for a row: DIM 32-bit floats of length one, or all zero where sums cancel or there is no token."""
    sums, weights = _sums(docs, doc_id, text)
    dense = F.array(*[F.coalesce(w, F.lit(0.0)) for w in weights])
    # Bound by let(): a length named in a column of its own is put into the loop again, and taken for each of the DIM places.
    made = let(dense, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: (x / F.when(n == 0, 1.0).otherwise(n)).cast("float"))))
    made = sums.select("doc", "rows", made.alias("embedding"))
    # Rows of an id are given back a block at a time, so that a list of them stays short.
    blocks = made.select("doc", "rows", "embedding", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1, F.lit(BLOCK).cast("bigint"))).alias("b"))
    block = F.least(F.col("rows") - F.col("b"), F.lit(BLOCK)).cast("int")
    return blocks.select("doc", "embedding", F.explode(F.array_repeat(F.lit(0), block))).select("doc", "embedding")


def embed_local(text: str) -> list[float]:
    """The same embedding of one query, L2-normalised, on the driver."""
    import re

    v = [0.0] * DIM
    for t in re.findall(TOKEN, text.replace("\u0130", "i").lower()):
        p = f"<{t}>"
        for feature, w in [(f"w:{t}", 1.0), *((f"g:{p[j : j + 3]}", 0.5) for j in range(len(t)))]:
            h = FNV32_BASIS
            for ch in feature:
                h = ((h ^ ord(ch)) * FNV32_PRIME) & MASK32
            v[h % DIM] += -w if h >> 31 else w
    n = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / n for x in v]


def dot(vec: Column, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vec, q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def topk_cosine(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """k most similar rows; each task keeps k rows and the k-row lists meet once."""
    size = math.sqrt(sum(float(x) ** 2 for x in query)) or 1.0
    n = norm(F.col(vec_col))
    score = dot(F.col(vec_col), query) / F.when(n == 0, 1.0).otherwise(n) / size
    return vectors.select(id_col, F.round(score, 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def topk_text(docs: DataFrame, query: str, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Nearest texts under the hashed embedding; ids without a token are none."""
    sums, weights = _sums(docs, doc_id, text)
    full = [F.coalesce(w, F.lit(0.0)) for w in weights]
    d, nn = _total([w * F.lit(x) for w, x in zip(full, embed_local(query), strict=True)]), _total([w * w for w in full])
    found = sums.filter(F.coalesce(*weights).isNotNull()).select("doc", d.alias("d"), nn.alias("nn"))
    score = F.col("d") / F.when(F.col("nn") == 0, 1.0).otherwise(F.sqrt("nn"))
    return found.select(F.col("doc").alias(doc_id), F.round(score, 6).alias("score")).orderBy(F.desc("score"), doc_id).limit(k)


def topk_per_shard(vectors: DataFrame, query: list[float], k: int, shard: Column) -> DataFrame:
    """Partial top-k in each shard, then the global k of those."""
    from pyspark.sql import Window

    n = norm(F.col("embedding"))
    rows = vectors.select("vec_id", shard.alias("shard"), F.round(dot(F.col("embedding"), query) / F.when(n == 0, 1.0).otherwise(n), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("r", rank).filter(F.col("r") <= k).select("vec_id", "score").orderBy(F.desc("score"), "vec_id").limit(k)
