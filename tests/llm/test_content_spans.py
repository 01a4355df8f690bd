"""Sentence spans: against the SQL, against brute force, and a passage at every offset of a long sentence."""

import re

import duckdb
import numpy as np
import pytest

from keystrata.llm import queries, sentence_spans

RNG = np.random.default_rng(8)
VOCAB = [f"w{i}ord" for i in range(3000)]
SCHEMA = "doc_id bigint, text string"


def words(n, every=0):
    w = RNG.choice(VOCAB, n).tolist()
    return " ".join(x + "," if every and i % every == every - 1 else x for i, x in enumerate(w))


def plain_units(text, longest=16):
    out = []
    for m in re.findall(r"[^.!?\n]*[.!?]+|[^.!?\n]+", text or ""):
        w = re.findall(r"[^\x20\x09-\x0D]+", m)
        if len(w) <= longest:
            out += [" ".join(w)] if w else []
            continue
        run = []
        for x in w:
            run.append(x)
            if x[-1] in ",;:" or len(run) == longest:
                out.append(" ".join(run))
                run = []
        out += [" ".join(run)] if run else []
    return out


def plain(rows, span=3):
    """Units left, by place of the row; rows alike in id and text are one document."""
    made = [(i, t, plain_units(t)) for i, t in rows]
    seen, gone = set(), {}
    for i, t, u in sorted({(i, t): (i, t, tuple(u)) for i, t, u in made}.values(), key=lambda r: r[0]):
        gone[i, t] = set()
        for k in range(len(u) - span + 1):
            if u[k : k + span] in seen:
                gone[i, t] |= set(range(k, k + span))
            seen.add(u[k : k + span])
    return sorted((i, tuple(x for k, x in enumerate(u) if k not in gone[i, t])) for i, t, u in made)


def test_passage_at_other_offsets(spark):
    passage = words(70, 6)
    rows = [(0, words(40) + " " + passage + " " + words(40)), *((i, f"{words(i)} {passage} {words(30)}") for i in range(1, 33))]
    left = lambda r: len(set(passage.split()) & set(r.kept_text.split()))
    for r in sentence_spans.dedup(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r.removed == [] if r.doc_id == 0 else left(r) < 25, r.doc_id
        assert " ".join(r.units) == rows[r.doc_id][1] and max(len(u.split()) for u in r.units) <= 16


def test_whole_sentences(spark):
    long = words(300)
    rows = [(0, long + ". One two. Three four. Five six."), (1, "One two. Three four. Five six. " + long + ".")]
    got = {r.doc_id: r for r in sentence_spans.dedup(spark.createDataFrame(rows, SCHEMA), longest=None).collect()}
    assert len(got[0].units) == 4 and got[0].removed == [] and got[1].removed == [0, 1, 2] and got[1].kept_text == long + "."


TEXTS = [
    None, "", " \n\t ", "one", "Ça et là, “déjà” vu 東京\x85x,\x85", "...", words(60, 5), words(21) + " " + words(60, 4), "spam " * 400, words(16) + ".", words(17) + "!",
    "a  b\tc. " * 30 + words(50), "x. y\nz " + words(60, 7), "comma,inside a,b word, ,; , " * 20, words(30_000, 9),
]
TEXTS += [TEXTS[6], "lead " + TEXTS[6] + " tail", TEXTS[14] + " more", TEXTS[12]]


@pytest.mark.parametrize("hot", [10_000, 2])
def test_spans_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(sentence_spans, "HOT_KEYS", hot)
    rows = [*enumerate(TEXTS), (6, TEXTS[6]), (None, TEXTS[6])]
    key = lambda r: -1 if r[0] is None else r[0]
    want = plain([(key(r), r[1]) for r in rows])
    got = sentence_spans.dedup(spark.createDataFrame([(i, t, "u", 1) for i, t in rows], SCHEMA + ", units string, h int"))
    assert sorted((key((r.doc_id,)), tuple(r.kept_text.split("\n")) if r.kept_text else ()) for r in got.collect()) == want


def test_spans_match_sql(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in queries.QUERIES["op9_sentence_spans"](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(queries.ORACLES["op9_sentence_spans"]).fetchall()) and got[16][2] > 0
