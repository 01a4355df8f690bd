"""Each operator on awkward rows: nulls, empty and long texts, ties, repeated rows, clashing columns, no rows."""

import collections
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keystrata.llm import attention_mil, bwt_dedup, chunked_tokenizer, components, cover_tree, grammar_store, kneser_ney, mixing, packing, quality_rules, sentence_spans, simhash
from keystrata.llm.chunked_tokenizer import DROPS_BLANKS, KEEPS_BLANKS, ChunkedTokenizer
from keystrata.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, start bigint, fp string, k string, z double"
RNG = np.random.default_rng(3)
VOCAB = [f"w{i}ord" for i in range(300)]


def prose(n):
    return " ".join(RNG.choice(VOCAB, n)) + "."


PASSAGE = prose(60)
TEXTS = [None, "", " \n\t ", "one", "Ça et là, “déjà” vu 東京\x85x", PASSAGE, prose(30) + "\n" + PASSAGE + "\n" + prose(20), prose(300), "spam " * 400, "x" * 5000, *[prose(80) for _ in range(20)]]
TEXTS += [TEXTS[7], TEXTS[7].replace("w1", "w2", 1), TEXTS[7] + " tail", "a|b #c " * 40, "line of words\n" * 12, prose(4000)]


def frame(spark, texts=TEXTS, extra=()):
    rows = [(i, t, "en", None if i % 7 == 3 else f"s{i % 3}", 0, 1, "fp", "k", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).repartition(3).cache()


def ids_of(name, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name, chunks", [("byte_bpe_50k.json", KEEPS_BLANKS), ("word_bpe_49k.json", DROPS_BLANKS)])
def test_chunks_give_the_library_ids(name, chunks):
    tok = ChunkedTokenizer(vocabulary(name), chunks)
    odd = ["a  b\n\n c\t^ ^^ x~", " ^ ^", "'s don't I'LL", "\x85 \xa0 é　z", "<|endoftext|>a", "x  <|endoftext|>  y<|endoftext|>", "<|startoftext|>b <|ENDOFTEXT|> <|x", "a <|", "\x1f q \x1c", "1234 5,6", " lead", "trail ", *[t or "" for t in TEXTS]]
    for t, got in zip(odd, tok.encode_packed(odd), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids_of(name, t), t


def test_pieces_end_where_the_rules_end_them():
    tok = ChunkedTokenizer(vocabulary("word_bpe_49k.json"), DROPS_BLANKS)
    known = set(tok.cache.number)
    texts = ["Quixword, quixword. (QUIXWORD)quixword\nquixword;quixword7 Quixword", "quixword quixword "]
    assert [np.frombuffer(g, "<u4").tolist() for g in tok.encode_packed(texts)] == [ids_of("word_bpe_49k.json", t) for t in texts]
    assert [c for c in set(tok.cache.number) - known if b"quixword" in c.lower()] == [b"quixword"]  # encoded once, whatever is around it
    # Marks that join the letter before them, letters that become two, what is no letter, apostrophes.
    alphabet = list("aHjTEé×÷ßÉİKÅŉσΣ東”‘'’.,-7\x1c\x85 \n\u0300\u0301\u0307\u0308\u0331\u037e'")
    odd = ["".join(RNG.choice(alphabet, int(RNG.integers(1, 12)))) for _ in range(6000)] + ["H\u0331 T\u0308", "x's'X", "I\u0307.İ.", "a×.b", "Don'T'll"]
    for t, got in zip(odd, tok.encode_packed(odd), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tok.model.encode(t, add_special_tokens=False).ids, t


def test_grammar_worker_keeps_one_small_tokenizer():
    args = (vocabulary("word_bpe_49k.json"), DROPS_BLANKS, grammar_store.CACHED, grammar_store.AT_ONCE)
    assert chunked_tokenizer.kept_tokenizer(*args) is chunked_tokenizer.kept_tokenizer(*args) and grammar_store.CACHED <= 250_000


def test_packing(docs):
    got = packing.pack(docs, vocabulary("byte_bpe_50k.json")).toPandas()
    full = {i: [*ids_of("byte_bpe_50k.json", t), 0] for i, t in enumerate(TEXTS)}
    for i, g in got.groupby("doc_id"):
        g = g.sort_values("start")
        assert g.start.tolist() == np.cumsum([0, *g.length])[:-1].tolist() and g.length.sum() == len(full[i]) == g.doc_tokens.iloc[0]
        assert all(zlib.crc32(np.array(full[i][a : a + n], "<u4").tobytes()) == c for a, n, c in zip(g.start, g.length, g.ids_crc32, strict=True))
    assert got.doc_id.nunique() == len(TEXTS)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == np.cumsum([0, *g.length])[:-1].tolist() and g.length.sum() <= 1024


def test_pieces_cover_every_length():
    for n in range(1, 3000):
        p = packing.pieces(n, 1024, 32)
        assert [a for a, _ in p] == np.cumsum([0, *(s for _, s in p)])[:-1].tolist() and sum(s for _, s in p) == n and all(0 < s <= 1024 for _, s in p)


def test_mixing(spark, docs):
    p = mixing.plan(docs).toPandas()
    assert (p["size"].to_numpy() == [len(WORD.findall(TEXTS[i] or "")) for i in p.doc_id]).all() and len(p) == len(TEXTS)
    assert p.groupby(p.source.fillna("~")).target.first().sum() == pytest.approx(p["size"].sum())
    assert (p.copies <= 3).all() and (p.target <= 3 * p.source_size + 1e-6).all()
    assert mixing.plan(docs.repartition(5)).select("doc_id", "copies").exceptAll(mixing.plan(docs).select("doc_id", "copies")).isEmpty()
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == p.copies.sum()
    many = spark.createDataFrame([(i, "w " * (1 + i % 9), f"s{i % 4}") for i in range(4000)], "doc_id bigint, text string, source string")
    s = mixing.plan(many, fan_in=16).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 5 for r in s)


def test_mixing_comes_near_targets_with_long_texts(spark):
    sizes = np.minimum(20_000, np.exp(RNG.normal(5.2, 1.4, 1500)).astype(int) + 1)
    rows = [(i, "w " * int(n), f"s{i % 6}") for i, n in enumerate(sizes)] + [(None, "w " * 19_000, "s1"), (None, "w w", None), (7, "w " * int(sizes[7]), "s1")]
    p = mixing.plan(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(6), fan_in=16).toPandas()
    p["source"] = p.source.fillna("~")
    for _, g in p.groupby("source"):
        taken = (g.copies * g["size"] * g.m).sum()
        if len(g) > 1:
            assert abs(taken - g.target.iloc[0]) <= max(0.005 * g.target.iloc[0], g["size"].min() / 2)
    assert (p.copies <= 3).all()


def test_mix_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, "a b", "s", i, 2, 3) for i in range(9)], "doc_id bigint, text string, source string, row int, key int, copies int")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == 9 and sorted(r.row for r in mixed.collect()) == list(range(9))


def test_targets_share_the_excess(spark):
    t = mixing.targets(spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), (None, 1, 1)], "source string, z bigint, m bigint")).collect()
    got = {r.source: r.target for r in t}
    assert got["a"] == 30 and got[None] == 3 and got["b"] == pytest.approx(978)


def test_quality_features(docs):
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        seen = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        covered = {k for j in range(len(w) - 7) if seen[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)), i
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_em_matches_brute_force_and_outvotes_objections(spark):
    names = list(quality_rules.rules())
    n = 600
    good = RNG.random(n) < 0.85
    votes = np.full((n, len(names)), quality_rules.GOOD)
    votes[RNG.random(votes.shape) < 0.1] = quality_rules.ABSTAIN
    for i in np.flatnonzero(~good):  # every kind of junk is seen by some rules together
        votes[i, RNG.choice(len(names), 5, replace=False)] = quality_rules.BAD
    lone = np.flatnonzero(good)[:30]
    votes[lone, RNG.integers(0, len(names), 30)] = quality_rules.BAD
    rows = spark.createDataFrame([(*map(int, v),) for v in votes], ", ".join(f"{x} int" for x in names))
    patterns = rows.groupBy(*names).agg(F.count("*").alias("n")).cache()
    listed = [(r.asDict(), r.n) for r in patterns.collect()]
    share, objects = quality_rules.start(names)
    rate = np.array([[objects[r][c] for r in names] for c in (1, 0)])
    worth, w = quality_rules.objective(listed, names, share, objects), quality_rules.STRENGTH * n
    for _ in range(12):
        # The same step on all rows in numpy.
        like = np.stack([np.prod(np.where(votes == 0, rate[k], np.where(votes == 1, 1 - rate[k], 1)), 1) * p for k, p in ((0, share), (1, 1 - share))])
        q = like[0] / like.sum(0)
        of = lambda p, x: ((votes == 0) * p[:, None]).sum(0) + w * x, lambda p: ((votes != 2) * p[:, None]).sum(0) + w
        rate_ = np.stack([of[0](p, quality_rules.OBJECTS[c]) / of[1](p) for p, c in ((q, 1), (1 - q, 0))])
        share_ = (q.sum() + w * quality_rules.PRIOR_GOOD) / (n + w)
        got, objects = quality_rules.step(patterns, names, share, objects)
        assert got == pytest.approx(share_) and [[objects[r][c] for r in names] for c in (1, 0)] == [pytest.approx(r) for r in rate_]
        after = quality_rules.objective(listed, names, got, objects)
        assert after >= worth - 1e-9
        share, rate, worth = got, rate_, after
    fitted = quality_rules.fit(patterns, names)
    kept = [r.k for r in rows.select((quality_rules.posterior(names, *fitted) >= 0.5).alias("k")).collect()]
    assert np.mean(np.array(kept) == good) > 0.95 and np.mean(np.array(kept)[lone]) > 0.9


def test_classifier_learns(spark):
    good, bad = [prose(150) for _ in range(60)], ["#@! $$ " * 60 + prose(40) for _ in range(60)]
    d = frame(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)] + [(None, 1, 0), (500, None, 0)], "doc_id bigint, quality int, toxic int")
    s = {r.doc_id: r.score for r in attention_mil.score(d, attention_mil.fit(d, labels)).collect()}
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(s) == 122 and all((s[i] >= 0.3) == (i < 60) for i in held) and all(0 <= x <= 1 for x in s.values())
    one = attention_mil.fit(d, labels.filter("quality = 1"))
    assert all(x > 0.5 for x in [r.score for r in attention_mil.score(d, one).collect()])


def test_attention_sums_to_one_and_gradient_descends():
    x, n = attention_mil.encode([prose(350).encode(), b"", prose(20).encode()])
    assert n.tolist() == [4, 1, 1]
    m = attention_mil.train(x.astype(float), n, np.array([1.0, 0.0, 1.0]))
    a = m.attention(x, n)
    assert a[:4].sum() == pytest.approx(1) and m.score(x, n)[1] < 0.3 < m.score(x, n)[0]


def test_grammar_round_trip(docs):
    shards = grammar_store.write_shards(docs, vocabulary("word_bpe_49k.json"), shard_tokens=700)
    at = 0
    for r in grammar_store.read_documents(shards).orderBy("doc_id").collect():
        want = [*ids_of("word_bpe_49k.json", TEXTS[r.doc_id]), 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)


def grammar_of(ids, ends):
    """The reader, after checking that no pair is left twice and that all documents come back."""
    left, right, sym, last = grammar_store.repair(ids, ends)
    seen, taken = collections.Counter(), -1
    for i in range(len(sym) - 1):
        if last[i] or i == taken:
            continue
        seen[sym[i], sym[i + 1]] += 1
        taken = i + 1 if sym[i] == sym[i + 1] and not last[i + 1] else -1
    assert not seen or max(seen.values()) == 1
    g = grammar_store.Grammar(grammar_store.compress(ids, ends))
    begins = [0, *ends[:-1].tolist()]
    assert (g.docs(0, len(ends)) == ids).all() and all((g.doc(i) == ids[a:b]).all() for i, (a, b) in enumerate(zip(begins, ends.tolist(), strict=True)))
    return g


def test_many_pairs_of_a_round_are_picked_as_one_by_one():
    for n_symbols in (3, 40, 6000):
        pairs = np.unique(RNG.integers(0, n_symbols, (9000, 2)), axis=0)
        left, right = pairs[RNG.permutation(len(pairs))].T
        lefts, rights, want = set(), set(), []
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            want.append(a not in rights and b not in lefts and (a != b or a not in lefts and a not in rights))
            if want[-1]:
                lefts.add(a)
                rights.add(b)
        got = grammar_store._compatible(left, right, n_symbols)
        assert not (got & ~np.array(want)).any() and got.sum() >= 0.95 * sum(want)
        assert not set(left[got & (left != right)]) & set(right[got])


def test_no_pair_is_left_twice():
    for _ in range(60):
        ids = RNG.integers(0, int(RNG.integers(1, 7)), int(RNG.integers(1, 400))).astype(np.uint32)
        grammar_of(ids, np.unique(np.append(RNG.integers(1, len(ids) + 1, 5), len(ids))))
    one = grammar_of(np.full(200_000, 7, np.uint32), np.array([200_000]))
    assert len(one.sym) + len(one.left) < 3 * 18
    phrase = np.tile(RNG.integers(0, 49_000, 400).astype(np.uint32), 500)
    assert len(grammar_of(phrase, np.array([len(phrase)])).sym) < 20
    twins = np.repeat(np.arange(6000, dtype=np.uint32), 2)  # many pairs of one symbol each
    grammar_of(np.concatenate((twins, twins[::-1])), np.array([12_000, 24_000]))
    ids = RNG.integers(0, 9, 5000).astype(np.uint32)
    ends = np.array([1, 700, 2000, 5000])
    assert (grammar_of(ids, ends).token_span(650, 2100) == ids[650:2100]).all() and (grammar_of(ids + 70_000, ends).docs(1, 3) == ids[1:2000] + 70_000).all()


def brute_windows(texts, n=100):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            w = b[p : p + n]
            if w in seen:
                gone[p : p + n] = True
            seen.add(w)
        out.append(np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


def test_suffix_dedup(docs):
    got = {r.doc_id: bytes(r.kept) for r in bwt_dedup.dedup(docs).collect()}
    assert [got[i] for i in range(len(TEXTS))] == brute_windows(TEXTS)


def test_suffix_dedup_hot_anchors_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(bwt_dedup, "MOST", 2)
    texts = [prose(25) + PASSAGE + prose(25) for _ in range(12)]
    got = {r.doc_id: bytes(r.kept) for r in bwt_dedup.dedup(frame(spark, texts)).collect()}
    assert [got[i] for i in range(12)] == brute_windows(texts)
    same = spark.createDataFrame([(None, PASSAGE), (5, PASSAGE), (5, PASSAGE), (5, "short")], "doc_id bigint, text string")
    r = bwt_dedup.dedup(same).collect()
    assert sorted(x.n_removed for x in r) == [0, 0, len(PASSAGE), len(PASSAGE)] and next(x for x in r if x.doc_id is None).n_removed == 0


def test_suffix_dedup_pairs_frequent_anchors(spark, monkeypatch):
    for name, value in (("MIN_SEEN", 2), ("FREQUENT", 10**9)):
        monkeypatch.setattr(bwt_dedup, name, value)
    line = "a line that very many documents have in common, word for word. "
    texts = [prose(15) + line + prose(15) + (PASSAGE if i % 3 == 0 else "") for i in range(24)] + [TEXTS[7], "x" * 3000, TEXTS[7]]
    d = frame(spark, texts)
    found = bwt_dedup._frequent(d.selectExpr("cast(text as binary) b"), 100)
    assert len(found) > 10
    got = {r.doc_id: bytes(r.kept) for r in bwt_dedup.dedup(d).collect()}
    assert [got[i] for i in range(len(texts))] == brute_windows(texts)


def test_runs_of_a_slice_are_those_of_each_text():
    texts = [t.encode() for t in TEXTS if t] + [b"x" * 99, b"y" * 100, b""]
    for frequent in (np.zeros(0, np.uint64), np.unique(bwt_dedup._runs(texts, 100, np.zeros(0, np.uint64))[4])[::3]):
        got = list(zip(*(x.tolist() for x in bwt_dedup._runs(texts, 100, frequent)), strict=True))
        alone = [bwt_dedup._runs([t], 100, frequent) for t in texts]
        assert got == [(i, *row[1:]) for i, x in enumerate(alone) for row in zip(*(c.tolist() for c in x), strict=True)]
        # Each window is in one run, and holds its anchor.
        assert sorted((i, s + j) for i, s, m, _, _ in got for j in range(m)) == [(i, p) for i, t in enumerate(texts) for p in range(len(t) - 99)]
        assert all(m - 1 <= o <= 100 - bwt_dedup.GRAM for _, _, m, o, _ in got)


def test_merge_moves_only_what_begins_windows(monkeypatch):
    seen = []
    monkeypatch.setattr(bwt_dedup.np, "cumsum", lambda *a, f=np.cumsum, **k: (seen.append(len(a[0])) if k.get("dtype") is np.int32 else None) or f(*a, **k))
    groups = [[prose(8).encode()[:60] for _ in range(40)] for _ in range(2)]
    bwt_dedup.interleave([bwt_dedup.Shard(g, 50) for g in groups], 50)
    assert seen and max(seen) == sum(max(0, len(t) - 49) for g in groups for t in g)


def test_suffix_dedup_known_copies_meet_as_few_rows(spark, monkeypatch):
    tables = {}

    def kept(df, name, cut=bwt_dedup.cut):
        tables[name] = cut(df, name)
        return tables[name]

    monkeypatch.setattr(bwt_dedup, "cut", kept)
    texts = [prose(300)] * 9 + [prose(30) + PASSAGE + prose(30) for _ in range(6)]
    got = {r.doc_id: bytes(r.kept) for r in bwt_dedup.dedup(frame(spark, texts).coalesce(1)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_windows(texts)
    # A task sends a copy that it has seen as one row, not as one for each anchor; contexts are read once and not written.
    copies = tables["met"].filter("again and k between 1 and 8").groupBy("k").count().collect()
    assert [r["count"] for r in copies] == [1] * 8 and set(tables) == {"met"}


def test_transforms_are_those_of_the_sorted_suffixes():
    texts = [bytes(RNG.integers(0, 3, 40).astype(np.uint8)) for _ in range(5)] + [b"", b"\xff" * 30]
    s = bwt_dedup.Shard(texts, 20)
    joined = [list(x + 1 for x in t) + [0] for t in texts]
    every = [(w, i) for w, t in enumerate(joined) for i in range(len(t))]
    flat = [x for t in joined for x in t]
    of = lambda w, i: flat[sum(map(len, joined[:w])) + i :][:20]
    places = [(int(np.searchsorted(s.begins, p, "right")) - 1, int(p)) for p in s.order]
    prefixes = [of(w, p - int(s.begins[w])) for w, p in places]
    assert prefixes == sorted(prefixes) and len(places) == len(every)
    assert s.transform.tolist() == [joined[w][p - s.begins[w] - 1] if p > s.begins[w] else 0 for w, p in places]


def test_interleave_finds_repeated_windows():
    for n, size, letters in ((8, 60, 2), (30, 25, 3), (3, 200, 1)):
        groups = [[bytes(RNG.integers(0, letters, int(RNG.integers(0, size))).astype(np.uint8)) for _ in range(n)] for _ in range(3)]
        windows = [(g, t, p, x[p : p + 7]) for g, some in enumerate(groups) for t, x in enumerate(some) for p in range(len(x) - 6)]
        count = collections.Counter(w for *_, w in windows)
        got = list(zip(*(x.tolist() for x in bwt_dedup.repeated_windows(groups, 7)), strict=True))
        assert sorted(x[:3] for x in got) == sorted(w[:3] for w in windows if count[w[3]] > 1)
        by = {w[:3]: w[3] for w in windows}
        assert len({x[3] for x in got}) == len({by[x[:3]] for x in got}) == len({(x[3], by[x[:3]]) for x in got})
        # The interleave is the merged order: read through it, suffixes do not fall.
        shards = [bwt_dedup.Shard(g, 7) for g in groups]
        at, _ = bwt_dedup.interleave(shards, 7, whole=True)
        flat = [[x for t in g for x in (*(b + 1 for b in t), 0)] for g in groups]
        sizes = [len(x) for x in flat]
        assert sorted(at.tolist()) == list(range(sum(sizes)))
        prefixes = []
        for place in at.tolist():
            k = 0 if place < sizes[0] else 1 if place < sizes[0] + sizes[1] else 2
            p = int(shards[k].order[place - sum(sizes[:k])])
            text = flat[k][p : p + 7]
            prefixes.append(text[: text.index(0) + 1] if 0 in text else text)
        assert [x for x in prefixes if 0 not in x] == sorted(x for x in prefixes if 0 not in x)


def plain_fingerprint(text, k=4):
    """Bit by bit, from the contract alone."""
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in WORD.findall(text or "")]
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(n, pairs):
    root = list(range(n))
    for a, b in pairs:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    return root


@pytest.mark.parametrize("n, k", [(10**5, 1), (10**8, 2), (10**11, 3)])
def test_bands_follow_the_number_of_fingerprints(n, k):
    widths, some = simhash.bands(n, 4)
    assert some >= k and sum(widths) == 64 and len(widths) == 4 + some


@pytest.mark.parametrize("tile, some", [(2048, 1), (8, 1), (2048, 3)])
def test_simhash(spark, docs, monkeypatch, tile, some):
    monkeypatch.setattr(simhash, "TILE", tile)
    real = simhash.bands
    monkeypatch.setattr(simhash, "bands", lambda n, radius: real({1: 10, 3: 10**10}[some], radius))
    base = prose(120).split()
    texts = [*TEXTS, *[" ".join(w if RNG.random() > 0.03 else "changed" for w in base) for _ in range(60)]]
    d = frame(spark, texts)
    r = simhash.near_duplicates(d).orderBy("doc_id").collect()
    fp = np.array([plain_fingerprint(t) for t in texts], np.uint64)
    assert [x.fp for x in r] == fp.view(np.int64).tolist() and fp[0] == 0
    pairs = [(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 4]
    assert [x.component_id for x in r] == union(len(fp), pairs)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(1, i) for i in range(2, 60)] + [(7, 7), (None, 3)]
    got = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert len({r.root for r in got if r.node >= 100}) == 1 and len({r.root for r in got if r.node < 100}) == 1 and len(got) == 81 + 59


def test_cover_tree(spark):
    base = RNG.normal(size=(40, 8))
    x = np.concatenate([base, base[:20] + RNG.normal(size=(20, 8)) * 0.05, base[:5], base[:5] * 3])
    rows = [(i, int(i % 2) if i < 60 else 0, v.tolist()) for i, v in enumerate(x)]
    odd = [(100, 0, None), (101, None, x[0].tolist()), (102, 0, [0.0] * 8), (103, 0, [float("nan")] * 8), (104, 0, [1.0, None]), (105, 0, []), (106, 0, [1.0, 0.0])]
    r = {k.vec_id: k for k in cover_tree.near_duplicates(spark.createDataFrame(rows + odd, "vec_id bigint, label int, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (np.array([q[1] for q in rows])[:, None] == np.array([q[1] for q in rows]))
    np.fill_diagonal(near, False)
    want = union(len(x), np.argwhere(near).tolist())
    assert [r[i].n_links for i in range(len(x))] == near.sum(1).tolist() and [r[i].component_id for i in range(len(x))] == want
    assert all(r[q[0]].n_links == 0 and r[q[0]].kept for q in odd)


@pytest.mark.parametrize("chunk, sample", [(8192, 1024), (40, 150), (15, 60)])
def test_cover_tree_divided(spark, monkeypatch, chunk, sample):
    monkeypatch.setattr(cover_tree, "CHUNK", chunk)
    monkeypatch.setattr(cover_tree, "SAMPLE", sample)
    base = RNG.normal(size=(40, 6))
    x = base[RNG.integers(0, 40, 500)] + RNG.normal(size=(500, 6)) * 0.08
    x[490:495] = [[1e200] * 6, [2e200] * 6, [1e-200] * 6, [3e-200, 3e-200, 3e-200, 3e-200, 3e-200, 3e-200], [-1e-300] * 6]
    label = RNG.integers(0, 2, 500)
    label[490:495] = 0
    rows = [(i, int(g), v.tolist(), 1) for i, (v, g) in enumerate(zip(x, label, strict=True))]
    got = sorted(cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>, unit int")).collect())
    u = x / np.abs(x).max(1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    assert [r.n_links for r in got] == near.sum(1).tolist() and [r.component_id for r in got] == union(500, np.argwhere(near).tolist())
    assert near[490, 491] and near[492, 493]


def test_units_divide_where_that_pays():
    base = cover_tree.unit_vectors(RNG.normal(size=(30, 6)))
    tight = cover_tree.unit_vectors(base[RNG.integers(0, 30, 800)] + RNG.normal(size=(800, 6)) * 0.02)
    assert len(cover_tree.divide(tight, 0.2)) > 4
    assert cover_tree.divide(cover_tree.unit_vectors(RNG.normal(size=(800, 64))), 0.2) is None  # no clusters
    assert cover_tree.divide(cover_tree.unit_vectors(np.ones((800, 8)) + RNG.normal(size=(800, 8)) * 0.001), 0.2) is None  # one cluster


def test_scores_do_not_depend_on_neighbours():
    texts = [prose(30).encode(), b"", prose(120).encode()]
    x, n = attention_mil.encode(texts)
    alone = [attention_mil.encode([t])[0] for t in texts]
    assert n.tolist() == [1, 1, 2] and (x == np.concatenate(alone)).all()


def test_long_texts_are_encoded_in_slices(monkeypatch):
    texts = [prose(2500).encode(), b"", ("x" * 3000 + " ").encode() * 9, prose(130).encode()]
    whole, n = attention_mil.encode(texts)
    monkeypatch.setattr(attention_mil, "SLICE", 1500)
    sliced, m = attention_mil.encode_all(texts)
    assert n.tolist() == m.tolist() and whole.shape == sliced.shape
    share = np.abs(whole - sliced).max(0)
    assert share[: attention_mil.CLASSES + 4].max() < 0.02  # a slice has no white space behind its last word


def test_gradient_is_that_of_the_loss():
    """The score's derivative by every parameter, against differences; training follows it."""
    x, n = attention_mil.encode([prose(250).encode(), prose(30).encode(), b"#! " * 90])
    y = np.array([1.0, 1.0, 0.0])
    m = attention_mil.train(x.astype(float), n, y, epochs=3)
    loss = lambda: -float((y * np.log(m.score(x, n)) + (1 - y) * np.log(1 - m.score(x, n))).mean())
    before = loss()
    m = attention_mil.train(x.astype(float), n, y, epochs=60)
    assert loss() < before / 2
    h = m.hidden(x)
    f = attention_mil.forward(m.p, h, n)
    a = np.exp((np.tanh(h @ m.p["v"]) / (1 + np.exp(-(h @ m.p["u"])))) @ m.p["w"])
    at = 0
    for i, k in enumerate(n.tolist()):  # one document at a time, in plain steps
        weight = a[at : at + k] / a[at : at + k].sum()
        z = (weight[:, None] * h[at : at + k]).sum(0)
        assert f["score"][i] == pytest.approx(1 / (1 + np.exp(-(z @ m.p["c"] + m.p["d"][0]))))
        at += k


def test_names_that_clash_are_refused(spark, docs):
    with pytest.raises(ValueError):
        attention_mil.score(docs.withColumn("score", F.lit(1)), None, ("score",))
    with pytest.raises(ValueError):
        bwt_dedup.dedup(docs.withColumn("kept", F.lit(1)))


def test_no_shared_folder_on_a_cluster_is_an_error():
    from types import SimpleNamespace

    from keystrata.llm import common

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://far:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.work_dir(session)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert packing.pack(none, vocabulary("byte_bpe_50k.json")).count() == 0
    assert mixing.plan(none).count() == 0 and quality_rules.judge(none).count() == 0
    assert grammar_store.read_documents(grammar_store.write_shards(none, vocabulary("word_bpe_49k.json"))).count() == 0
    assert bwt_dedup.dedup(none).count() == 0 and simhash.near_duplicates(none).count() == 0 and sentence_spans.dedup(none).count() == 0
    assert kneser_ney.train_and_score(none).count() == 0
    assert cover_tree.near_duplicates(spark.createDataFrame([], "vec_id bigint, label int, embedding array<float>")).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert attention_mil.score(none, attention_mil.fit(none, labels)).count() == 0
