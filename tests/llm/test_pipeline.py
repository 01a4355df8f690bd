"""Stages of the pipeline against plain Python."""

import numpy as np
import pytest

import corpus_pipeline
from keystrata.llm import simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
RNG = np.random.default_rng(5)
VOCAB = [f"w{i}ord" for i in range(400)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def near_rows():
    rows = [(0, None), (1, ""), (2, "a few words"), (3, "a few words")]
    for _ in range(12):
        base = RNG.choice(VOCAB, 300)
        rows.append((len(rows), " ".join(base)))
        for edits in (2, 4, 6, 9, 12, 20):
            w = base.copy()
            w[RNG.choice(300, edits, replace=False)] = "changed"
            rows.append((len(rows), " ".join(w)))
    return [*rows, rows[4], (None, rows[4][1]), (None, rows[4][1]), (None, "alone without an id")]


@pytest.mark.parametrize("strip", [32_768, 20])
def test_near_copies_by_jaccard(spark, monkeypatch, strip):
    monkeypatch.setattr(simhash, "STRIP", strip)
    monkeypatch.setattr(simhash, "BLOCK", min(strip, simhash.BLOCK))
    rows = near_rows()
    sets = [shingles(t) for _, t in rows]
    close = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    assert sum(0.8 <= jaccard(sets[i], sets[j]) < 0.95 for i, j in close) > 20
    root = list(range(len(rows)))
    for i, j in close:
        x, y = root[i], root[j]
        root = [min(x, y) if r in (x, y) else r for r in root]
    key = lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][1] or "")
    want = sorted((str(rows[min((i for i in range(len(rows)) if root[i] == r), key=key)]) for r in set(root)))
    got = corpus_pipeline.simhash_near_dedup(spark, frame(spark, rows), "").collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == want


def whole_characters(rows, n=100):
    """Texts, in order of id, without windows that start earlier and without characters that lost a byte."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            if b[p : p + n] in seen:
                gone[p : p + n] = True
            seen.add(b[p : p + n])
        at, left = 0, ""
        for c in t or "":
            size = len(c.encode())
            left += "" if gone[at : at + size].any() else c
            at += size
        if left or not b:
            out.append((i, left))
    return out


def suffix_rows():
    cjk = "".join(chr(0x4E00 + int(x)) for x in RNG.integers(0, 4000, 60))
    neighbours = chr(0x4E00) + cjk + chr(0x4E41), chr(0x4E01) + cjk + chr(0x4E81)  # cuts fall inside the outer characters
    return [(0, None), (1, ""), (2, "x\ufffdy"), (3, neighbours[0]), (4, "real \ufffd here " + neighbours[1] + " and \ufffd there"), (5, neighbours[0])]


def test_suffix_cuts_leave_replacement_characters_of_the_source(spark):
    rows = suffix_rows()
    got = corpus_pipeline.suffix_array_dedup(spark, frame(spark, rows), "").collect()
    want = whole_characters(rows)
    assert sorted((r.doc_id, r.text) for r in got) == want and all(r.n_chars == len(r.text) for r in got)
    assert dict(want)[4].count("\ufffd") == 2 and dict(want)[4].startswith("real ") and len(dict(want)[4]) < 40


CLASHES = ["row", "k", "b", "s", "m", "score", "_text", "t_", "first", "kept", "n_bytes", "n_removed", "_h", "_c", "copies", "key", "n", "node", "hashes", "doc.part"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Tables with clashing columns, repeated rows, null ids and texts, and junk that labels name."""
    folder = tmp_path_factory.mktemp("corpus")
    prose = lambda n: " ".join(RNG.choice(VOCAB, n)) + "."
    shared = prose(40)
    texts = [prose(120) for _ in range(70)] + ["#@! $$ " * 60 + prose(30) for _ in range(40)]
    texts += [texts[0], texts[1] + " tail words", shared + " " + prose(80), prose(70) + " " + shared, None, "", "few words"]
    rows = [(i, t, "en", None if i % 7 == 3 else f"s{i % 3}", len(t or ""), *range(len(CLASHES))) for i, t in enumerate(texts)]
    rows += [rows[5], (None, prose(90), "en", "s1", 0, *range(len(CLASHES))), (None, None, "en", "s1", 0, *range(len(CLASHES)))]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", `{c}` int" for c in CLASHES))
    docs.repartition(3).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 70), 0) for i in range(110)], "doc_id bigint, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return folder, texts


def test_stages_one_by_one(spark, corpus):
    from keystrata.llm import attention_mil, mixing

    folder, texts = corpus
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    bag = lambda df: sorted(str(tuple(r)) for r in df.collect())

    kept = corpus_pipeline.quality_classifier(spark, docs, str(folder))
    model = attention_mil.fit(docs.select("doc_id", "text"), spark.read.parquet(str(folder / "labels.parquet")))
    by_text = {t: float(model.score(*attention_mil.encode([(t or "").encode()]))[0]) for t in {r.text for r in docs.collect()}}
    assert kept.columns == docs.columns and bag(kept) == sorted(str(tuple(r)) for r in docs.collect() if by_text[r.text] >= corpus_pipeline.THRESHOLD)
    ids = [r.doc_id for r in kept.collect()]
    assert {i for i in range(70) if i in ids} == set(range(70)) and not set(ids) & set(range(70, 110))

    kept = spark.createDataFrame(kept.collect(), kept.schema)
    alone = corpus_pipeline.simhash_near_dedup(spark, kept, str(folder))
    rows = sorted(kept.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    left, sets = [], []
    for r in rows:  # groups here are stars around their first member
        mine = shingles(r.text)
        if all(jaccard(mine, x) < 0.8 for x in sets):
            left.append(r)
            sets.append(mine)
    assert alone.columns == docs.columns and bag(alone) == sorted(str(tuple(r)) for r in left)

    whole = corpus_pipeline.suffix_array_dedup(spark, spark.createDataFrame(left, docs.schema), str(folder))
    want = whole_characters([(i, r.text) for i, r in enumerate(left)])
    assert whole.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in whole.collect()) == sorted((str(left[i].doc_id), t) for i, t in want)
    assert sum(len(r.text) for r in whole.collect()) < sum(len(r.text or "") for r in left)

    mixed = corpus_pipeline.mix_sources(spark, whole, str(folder))
    copies = {(r.doc_id, r.source, r.th): r.copies for r in mixing.plan(whole).collect()}
    assert mixed.columns == docs.columns and mixed.count() == sum(copies[r.doc_id, r.source, r.th] for r in whole.selectExpr("doc_id", "source", "xxhash64(text) th").collect())


def test_run_packs_what_the_stages_keep(spark, corpus):
    from tokenizers import Tokenizer

    from keystrata.llm.queries import vocabulary

    folder, _ = corpus
    got = corpus_pipeline.run(spark, str(folder)).toPandas()
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(folder))
    model = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    sizes = sorted(len(model.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert got.length.sum() == sum(sizes) and sorted(got[got.start == 0].doc_tokens) == sizes
    assert (got.groupby("sequence_id").length.sum() <= 1024).all()


def test_stages_on_empty_tables(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(str(folder / "documents.parquet")).filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(folder)).count() == 0
