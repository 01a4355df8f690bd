"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage of every text is encoded: shares of
character classes, word statistics and hashed byte pairs. A hidden layer turns a passage into h;
gated attention, softmax over w . (tanh(V h) * sigmoid(U h)), weighs the passages of a document,
and the weighted sum of their h is what the document label trains and what is scored.

The model is fitted by the driver on at most `sample` labelled documents, the first by a hash of
the id; their passages are encoded by the executors. Everything else covers every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, text_or_empty

PASSAGE = 100
PAIRS = 64
HIDDEN, GATE = 24, 12
#: Most labelled documents that the model is fitted on, and most passages of each.
SAMPLE, PER_DOCUMENT = 4000, 64
#: Bytes of text that are encoded at once.
SLICE = 1_000_000

# Classes of bytes: 0 white space, 1 a-z, 2 A-Z, 3 digits, 4 beyond ASCII, 5 . , ; :, 6 ! ?, 7 symbols, 8 brackets and quotes, 9 the rest.
CLASSES = 10
_CLASS = np.full(256, 9, np.uint8)
for _c, _chars in enumerate((b" \t\n\x0b\x0c\r", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", bytes(range(128, 256)), b".,;:", b"!?", b"#*$%&|<>@_=+~^\\/", b"()[]{}'\"`")):
    _CLASS[list(_chars)] = _c
WIDTH = CLASSES + 5 + PAIRS


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Passages of all texts, one row each, and the number of passages of each text (one at least)."""
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    cls = _CLASS[raw]
    space = cls == 0
    begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1
    stops = np.cumsum([len(t) + 1 for t in texts])
    first = np.searchsorted(begins, np.concatenate(([0], stops[:-1])))
    n_words = np.searchsorted(begins, stops) - first
    n_pass = np.maximum(1, -(-n_words // PASSAGE))
    total = int(n_pass.sum())
    base = np.cumsum(n_pass) - n_pass
    doc_of_word = np.repeat(np.arange(len(texts)), n_words)
    word_pass = base[doc_of_word] + (np.arange(len(begins)) - first[doc_of_word]) // PASSAGE
    # A byte belongs to the passage of the last word that began before it in its text.
    doc_of_byte = np.repeat(np.arange(len(texts)), np.diff(np.concatenate(([0], stops))))
    last = np.cumsum(np.bincount(begins, minlength=len(raw))) - 1
    byte_pass = base[doc_of_byte] + np.maximum(0, last - first[doc_of_byte]) // PASSAGE
    x = np.zeros((total, WIDTH), np.float32)
    size = np.maximum(1, np.bincount(byte_pass, minlength=total))[:, None]
    x[:, :CLASSES] = np.bincount(byte_pass * CLASSES + cls, minlength=total * CLASSES).reshape(total, CLASSES) / size
    length = (ends - begins).astype(np.float64)
    n = np.bincount(word_pass, minlength=total)
    some = np.maximum(1, n)
    mean = np.bincount(word_pass, length, total) / some
    x[:, CLASSES] = mean / 10
    x[:, CLASSES + 1] = np.sqrt(np.maximum(0, np.bincount(word_pass, length * length, total) / some - mean * mean)) / 10
    x[:, CLASSES + 2] = np.minimum(1, n / PASSAGE)
    # Distinct words of a passage over the root of its words; equal words of a passage have equal keys.
    key = _word_keys(raw, begins, ends) ^ (word_pass.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    x[:, CLASSES + 3] = np.bincount(word_pass[order][fresh], minlength=total) / np.sqrt(some) / 10
    same = np.zeros(len(key), bool)
    if len(key) > 1:
        same[1:] = key[1:] == key[:-1]
    x[:, CLASSES + 4] = np.bincount(word_pass[same], minlength=total) / some
    pair = (cls[:-1].astype(np.int64) * 31 + raw[1:] * np.int64(17) + raw[:-1]) % PAIRS
    own = doc_of_byte[:-1] == doc_of_byte[1:]  # a text's features do not depend on its neighbours
    x[:, CLASSES + 5 :] = np.bincount((byte_pass[:-1] * PAIRS + pair)[own], minlength=total * PAIRS).reshape(total, PAIRS) / size * 8
    return x, n_pass


def _word_keys(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit sum over each word's bytes, weighted by place."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(raw.astype(np.uint64) * _powers(len(raw)))))
        return (prefix[ends] - prefix[begins]) * _powers(len(raw), True)[begins] + (ends - begins).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)


_cache: dict = {}


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers of an odd number mod 2^64, or of its inverse."""
    have = _cache.get(inverse)
    if have is None or len(have) < n:
        g = 0x9E3779B97F4A7C15 | 1
        g = pow(g, -1, 1 << 64) if inverse else g
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * n, g, np.uint64))))
        _cache[inverse] = have
    return have[:n]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def hidden(self, x):
        return np.maximum(0, ((x - self.mean) / self.scale) @ self.p["w1"] + self.p["b1"])

    def score(self, x: np.ndarray, n_pass: np.ndarray) -> np.ndarray:
        return forward(self.p, self.hidden(x), n_pass)["score"]

    def attention(self, x: np.ndarray, n_pass: np.ndarray) -> np.ndarray:
        return forward(self.p, self.hidden(x), n_pass)["a"]


def forward(p: dict, h: np.ndarray, n_pass: np.ndarray) -> dict:
    at = np.cumsum(n_pass) - n_pass
    bag = np.repeat(np.arange(len(n_pass)), n_pass)
    t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
    e = (t * s) @ p["w"]
    e = np.exp(e - np.maximum.reduceat(e, at)[bag])
    a = e / np.add.reduceat(e, at)[bag]
    z = np.add.reduceat(a[:, None] * h, at)
    return {"t": t, "s": s, "a": a, "z": z, "at": at, "bag": bag, "score": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))}


def train(x: np.ndarray, n_pass: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Model:
    """Adam on the cross-entropy of document labels; without both labels, a constant score."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    p = {"w1": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "v": rng.normal(0, 0.2, (HIDDEN, GATE)), "u": rng.normal(0, 0.2, (HIDDEN, GATE)), "w": rng.normal(0, 0.2, GATE), "c": rng.normal(0, 0.2, HIDDEN), "d": np.zeros(1)}
    if len(y) == 0 or y.min() == y.max():
        p["c"][:] = 0
        p["d"][:] = 0 if not len(y) else (4 if y[0] else -4)
        return Model(mean.astype(np.float32), scale.astype(np.float32), p)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    xs, at, step = (x - mean) / scale, np.cumsum(n_pass) - n_pass, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            docs = order[lo : lo + batch]
            rows = np.concatenate([np.arange(at[i], at[i] + n_pass[i]) for i in docs])
            xb, nb, yb = xs[rows], n_pass[docs], y[docs]
            pre = xb @ p["w1"] + p["b1"]
            h = np.maximum(0, pre)
            f = forward(p, h, nb)
            g = (f["score"] - yb) / len(yb)
            dz = (g[:, None] * p["c"])[f["bag"]]
            da = (dz * h).sum(1)
            de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["at"])[f["bag"]])
            dts = de[:, None] * p["w"]
            dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
            dh = (f["a"][:, None] * dz + dt @ p["v"].T + ds @ p["u"].T) * (pre > 0)
            grad = {"w1": xb.T @ dh, "b1": dh.sum(0), "v": h.T @ dt, "u": h.T @ ds, "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ g, "d": np.array([g.sum()])}
            step += 1
            for k in p:
                gk = grad[k] + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk * gk
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean.astype(np.float32), scale.astype(np.float32), p)


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about SLICE bytes; all but the last hold whole passages, so passages are those of the whole."""
    lo = 0
    while len(text) - lo > SLICE:
        size = SLICE
        while True:
            raw = np.frombuffer(text, np.uint8, min(size, len(text) - lo), lo)
            word = _CLASS[raw] != 0
            begins = np.flatnonzero(word & np.concatenate(([True], ~word[:-1])))
            cuts = begins[PASSAGE::PASSAGE]
            if len(cuts) or lo + size >= len(text):
                break
            size *= 2  # words so long that a slice has less than a passage
        if not len(cuts):
            break
        yield text[lo : lo + int(cuts[-1])]
        lo += int(cuts[-1])
    yield text[lo:]


def encode_all(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """As `encode`, about SLICE bytes at a time, however long a text is."""
    xs, ns, part, of, size = [], [], [], [], 0

    def flush():
        x, n = encode(part)
        xs.append(x)
        np.add.at(counts, of, n)

    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        for piece in _pieces(t):
            part.append(piece)
            of.append(i)
            size += len(piece)
            if size >= SLICE:
                flush()
                part, of, size = [], [], 0
    if part:
        flush()
    return np.concatenate(xs), counts


def _slices(batch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes, a few MB at a time."""
    lo, size, part = 0, 0, []
    for i, t in enumerate(batch.column(column)):
        b = t.as_py().encode("utf-8", "replace")
        part.append(b)
        size += len(b)
        if size >= SLICE:
            yield lo, part
            lo, size, part = i + 1, 0, []
    if part:
        yield lo, part


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, per_document: int = PER_DOCUMENT) -> Model:
    """Learn from labelled rows whose fold is not 0; docs needs doc_id and text, labels doc_id and quality.

    At most `sample` label rows are taken, the first by a hash of the id, then at most as many rows of
    `docs` that have such an id, and of each at most `per_document` passages, spread evenly; this is all
    that reaches the driver. Labels that are null or without an id are left out; an id that is labelled
    or occurs repeatedly is learnt from as often; ties of the hash go by id, label and text. Null texts
    are empty. Without labels of both kinds, or without rows, the model gives one score to all. Other
    columns are not read.
    """
    ids = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    ids = ids.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    rows = docs.sparkSession.createDataFrame([tuple(r) for r in ids.collect()], "id_ bigint, y int")
    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(rows), F.col("doc_id") == F.col("id_")).select("doc_id", "y", "text")

    def encoded(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo, texts in _slices(batch, 2):
                x, n = encode_all(texts)
                blobs = []
                for end, k in zip(np.cumsum(n).tolist(), n.tolist(), strict=True):
                    some = np.arange(k) if k <= per_document else np.arange(per_document) * k // per_document
                    blobs.append(x[end - k + some].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), batch.column(1).slice(lo, len(texts)), pa.array(blobs, pa.binary())], ["doc_id", "y", "x"])

    got = sorted(picked.mapInArrow(encoded, "doc_id bigint, y int, x binary").orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(sample).collect())
    xs = [np.frombuffer(r.x, np.float32).reshape(-1, WIDTH) for r in got]
    x = np.concatenate(xs) if xs else np.zeros((1, WIDTH), np.float32)
    return train(x.astype(np.float64), np.array([len(a) for a in xs], np.int64), np.array([r.y for r in got], np.float64))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and score (0 to 1) of each whole text.

    Null and empty texts are one empty passage and get its score; repeated rows get the same score; a
    null doc_id is carried along. `keep` may not hold a column named score; others may have any name.
    An empty table gives no rows.
    """
    if "score" in keep:
        raise ValueError("keep a column named score inside a struct")
    names = [f"c_{i}" for i in range(len(keep))]
    kept = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], text_or_empty().alias("t_"))
    schema = kept.drop("t_").schema.add("score", "double")

    def scored(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            col = batch.num_columns - 1
            for lo, texts in _slices(batch, col):
                p = model.score(*encode_all(texts))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, len(texts)) for i in range(col)), pa.array(p.astype(np.float64))], names=[*names, "score"])

    return kept.mapInArrow(scored, schema).select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "score")
