"""Harmonic packing of documents into fixed-length training sequences.

A piece of length L belongs to class j = capacity // L, so that j pieces of its class always fit
one sequence; each class fills sequences with exactly j pieces, and classes never wait for each
other. A document's ids are cut into full sequences and a remainder. A remainder that would leave
more than `slack` of its sequence empty gives off the largest piece of the next class's exact
reciprocal size, which fills without loss, until what is left packs well.

Pieces are numbered inside each class by a count per input block, so no class, however frequent,
meets in one task: blocks number their own pieces, and a prefix sum over the small
(block, class) counts makes the numbers global. At most j - 1 pieces of each class are left over
in the whole corpus (fewer than 8 x capacity pieces, whatever its size); they are packed together by
first-fit decreasing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunked_tokenizer import KEEPS_BLANKS, ChunkedTokenizer
from .common import cut, text_or_empty

PIECES = "block int, cls int, rank bigint, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(total: int, capacity: int, slack: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    out = [(i, capacity) for i in range(0, total - capacity + 1, capacity)]
    at = len(out) * capacity
    while at < total:
        rest = total - at
        fits = capacity // rest
        size = rest if rest <= slack or capacity - fits * rest <= slack // 2 else capacity // (fits + 1)
        out.append((at, size))
        at += size
    return out


def _first_fit(capacity: int):
    def pack(pdf):
        room: list[int] = []
        seq, off = [], []
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], na_position="first")
        for n in pdf["length"]:
            i = next((i for i, r in enumerate(room) if r >= n), len(room))
            if i == len(room):
                room.append(capacity)
            seq.append(i)
            off.append(capacity - room[i])
            room[i] -= n
        pdf["bin"], pdf["offset"] = seq, off
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "offset"]]

    return pack


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, slack: int = 32, cache_size: int = 1_500_000, at_once: int = 4_000_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone. Repeated rows are packed once each; a null doc_id is
    carried along. Other columns of `docs` are ignored. An empty table gives no rows. `cache_size`
    (chunks) and `at_once` (bytes of text) trade a worker's memory for time; ids are the same.
    """
    spark = docs.sparkSession

    def encode(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        tok = ChunkedTokenizer(tokenizer, KEEPS_BLANKS, cache_size, at_once)
        ranks: dict[int, int] = {}
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids), 2048):
                rows = []
                made, ends = tok.encode_with_end(texts.slice(lo, 2048), end_id)
                raw, first = made.view(np.uint8).data, 0
                for doc, last in zip(ids[lo : lo + 2048], ends.tolist(), strict=True):
                    for start, size in pieces(last - first, capacity, slack):
                        c = capacity // size
                        r = ranks.get(c, 0)
                        ranks[c] = r + 1
                        at = 4 * (first + start)
                        rows.append((block, c, r, doc, start, size, zlib.crc32(raw[at : at + 4 * size]), last - first))
                    first = last
                types = [pa.int32(), pa.int32(), *[pa.int64()] * 6]
                names = ["block", "cls", "rank", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    made = cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(encode, PIECES), "pieces")
    counts = made.groupBy("block", "cls").agg((F.max("rank") + 1).alias("n"))
    before = Window.partitionBy("cls").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "counts")
    # At most `capacity` classes exist, so this summary is that many rows at any scale.
    totals = {r.cls: r.n for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect()}
    base, bins = {}, 0
    for c in sorted(totals):
        base[c] = bins
        bins += totals[c] // c
    classes = spark.createDataFrame([(c, base[c], totals[c] // c) for c in sorted(totals)], "cls int, base bigint, full bigint")

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    placed = made.join(counts.select("block", "cls", "first"), ["block", "cls"]).join(F.broadcast(classes), "cls")
    placed = placed.withColumn("rank", F.col("rank") + F.col("first")).withColumn("slot", F.expr("rank div cls"))
    whole = placed.filter("slot < full").withColumn("sequence_id", F.col("base") + F.col("slot"))
    order = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    single = whole.filter("cls = 1").select(*columns, "sequence_id", F.lit(0).cast("bigint").alias("offset"))
    shared = whole.filter("cls > 1").withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0))).select(*columns, "sequence_id", "offset")
    left = placed.filter("slot >= full").select(*columns).groupBy(F.lit(0).alias("g"))
    left = left.applyInPandas(_first_fit(capacity), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, bin bigint, offset bigint")
    left = left.select(*columns, (F.col("bin") + bins).alias("sequence_id"), "offset")
    return single.unionByName(shared).unionByName(left)
