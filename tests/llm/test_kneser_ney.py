"""The language model against plain Python, at both orders, in one part and in many with cells of frequent words."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from keystrata.llm import kneser_ney

RNG = np.random.default_rng(3)
VOCAB = [f"W{i}ord" for i in range(120)]
PROB = 1 / np.arange(1, 121)
TEXTS = [None, "", " \n\t ", "One", "Ça et là, 東京\x85x", "spam " * 400, *[" ".join(RNG.choice(VOCAB, int(n), p=PROB / PROB.sum())) for n in RNG.integers(1, 200, 60)], " ".join(RNG.choice(VOCAB, 9000))]
TEXTS += [TEXTS[8], TEXTS[8] + " tail"]


def cut_off(x, q):
    return max(0.0, x - (0, *q)[min(x, 3)])


class Plain:
    def __init__(self, train, order):
        self.order = order
        pad = lambda t: [("<s>", "<s>", *t)[i : i + 3] for i in range(len(t))]
        tri = collections.Counter(x for t in train for x in pad(t))
        if order == 2:
            tri = collections.Counter({("<s>", v, w): n for (v, w), n in collections.Counter((v, w) for t in train for _, v, w in pad(t)).items()})
        self.tri, self.c = tri, collections.Counter(w for t in train for w in t)
        self.bi = collections.Counter()
        for (_, v, w), n in tri.items():
            self.bi[v, w] += n if v == "<s>" or order == 2 else 1
        self.uni = collections.Counter(w for _, w in self.bi)
        coc = lambda x: kneser_ney._discounts([sum(k == i for k in x.values()) for i in (1, 2, 3, 4)])
        self.d = [coc(self.tri), coc(self.bi), coc(self.uni)]
        self.ctx3, self.ctx2 = collections.defaultdict(list), collections.defaultdict(list)
        for (u, v, _), n in tri.items():
            self.ctx3[u, v].append(n)
        for (v, _), n in self.bi.items():
            self.ctx2[v].append(n)

    def level(self, n, ctx, d, low):
        total = sum(ctx)
        return cut_off(n, d) / total + sum((0, *d)[min(x, 3)] for x in ctx) / total * low if total else low

    def p(self, u, v, w):
        n = max(1, len(self.bi))
        left = sum((0, *self.d[2])[min(x, 3)] for x in self.uni.values()) / n if self.bi else 1.0
        p = cut_off(self.uni[w], self.d[2]) / n + left / (len(self.c) + 1)
        p = self.level(self.bi[v, w], self.ctx2.get(v, []), self.d[1], p)
        return self.level(self.tri[u, v, w], self.ctx3.get((u, v), []), self.d[0], p) if self.order == 3 else p


@pytest.mark.parametrize("order, part_tokens, flush", [(3, 3_000_000, 1_000_000), (3, 700, 500), (2, 700, 500)])
def test_model_against_brute_force(spark, monkeypatch, order, part_tokens, flush):
    monkeypatch.setattr(kneser_ney, "FLUSH", flush)
    monkeypatch.setattr(kneser_ney, "BATCH", flush)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "One two", 1), (7, TEXTS[7], 2)], "doc_id bigint, text string, score int").repartition(3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    toks = [[w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["</s>"] for _, t in rows]
    fold = [zlib.crc32((str(i) if i is not None else "").encode()) % 5 for i, _ in rows]
    m = Plain([t for t, f in zip(toks, fold, strict=True) if f != 1], order)
    got = sorted(kneser_ney.train_and_score(docs, order, part_tokens).collect(), key=str)
    n, v = sum(m.c.values()), len(m.c)
    want = []
    for (i, _), t, f in zip(rows, toks, fold, strict=True):
        base = sum(math.log10((m.c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        score = sum(math.log10(m.p(*x)) for x in (("<s>", "<s>", *t)[k : k + 3] for k in range(len(t))))
        want.append((i, len(t), sum(m.c[w] > 0 for w in t), base, score, f == 1, n))
    key = lambda r: (-1 if r[0] is None else r[0], r[1])
    for r, x in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert r[:3] == x[:3] and r[5:] == x[5:] and r[3:5] == pytest.approx(x[3:5])
    some = [w for w in m.c][:1] * 2
    for u, v in ((some[0], some[1]), ("<s>", "<s>"), ("never", "never")):
        assert sum(m.p(u, v, w) for w in [*m.c, "unseen"]) == pytest.approx(1)


def test_layout_has_cells_for_frequent_words(spark):
    docs = spark.createDataFrame([(t or "",) for t in TEXTS], "text string")
    layout = kneser_ney._layout(docs, 700)
    assert layout.parts > 10 and len(layout.hot) and (layout.first[0] == layout.parts)
    u, v, w = (RNG.choice(np.append(layout.hot, np.arange(50, dtype=np.uint64)), 500) for _ in range(3))
    cell = layout.cell(u, v, w)
    assert (layout.is_hot(v) == (cell >= layout.parts)).all() and cell.max() < layout.first[-1] + layout.side[-1] ** 2


def test_counts_beyond_32_bits():
    c = np.array([1, 254, 255, 3 * 2**31, 2**40])
    w = np.arange(5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) & kneser_ney.WORD_BITS
    rows = lambda *x: sorted(zip(*(a.tolist() for a in x), strict=True))
    assert rows(*kneser_ney.unpack_trigrams(kneser_ney.pack_trigrams(w, w[::-1], w, c))) == rows(w, w[::-1], w, c)
    wide = np.arange(70_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) & kneser_ney.WORD_BITS
    ones = np.ones(70_000, np.int64)
    assert rows(*kneser_ney.unpack_trigrams(kneser_ney.pack_trigrams(wide, wide[::-1], wide, ones))) == rows(wide, wide[::-1], wide, ones)
    for a in (c, c[:2], c[:0]):
        raw = kneser_ney._Unpack(kneser_ney._pack(kneser_ney._narrow(a)))
        assert kneser_ney._wide(raw, len(a)).tolist() == a.tolist()


def test_hash_array_finds_neighbours(tmp_path):
    key = np.unique(RNG.integers(0, 1 << 63, 3000, dtype=np.uint64) & ~np.uint64(0xFFFF))
    key[:50] = (key[0] & ~np.uint64(0xFFFFFFFF)) + (np.arange(50, dtype=np.uint64) << np.uint64(16))  # one first half
    values = RNG.integers(0, 300, (len(key), 4))
    values[5] = (2**40, 0, 1, 2)
    kneser_ney.HashArray.write(str(tmp_path), "x", key, values)
    table = kneser_ney._map(str(tmp_path), "x")
    ask = np.concatenate((key, key + np.uint64(1 << 16)))
    found, hit = table.find(ask)
    known = dict(zip(key.tolist(), values.tolist(), strict=True))
    assert [f.tolist() if h else None for f, h in zip(found, hit, strict=True)] == [known.get(k) for k in ask.tolist()]
    assert kneser_ney._map(str(tmp_path), "missing") is None
