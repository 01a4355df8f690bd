"""Substring dedup by sliding sentence spans, in DataFrame operations.

A text is cut into sentences at `.`, `!`, `?` and line ends. A sentence of more than `longest` words is
taken by its clauses, which end after a word with a comma, semicolon or colon, or at `longest` words;
both are content, so a passage has the same units wherever it stands. Every run of `span`
consecutive units is hashed (96 bits); runs that occur more than once keep their first occurrence, by
(doc_id, place), and every unit that another occurrence covers goes.

Units are hashed once, into one compact row a document. Counting combines before its shuffle. Places
of repeated spans are found by joining: spans that make up more than 1 / HOT_KEYS of all repeated places
are fewer than HOT_KEYS, whatever the data, and are joined by broadcast, so none meets in one task; the
others are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SENTENCE = r"[^.!?\n]*[.!?]+|[^.!?\n]+"
LONGEST = 16
HOT_KEYS = 10_000


def clause(longest: int) -> str:
    """Words joined by spaces, to the first that ends a clause, or `longest` of them."""
    return rf"(?:[^ ]+ ){{0,{longest - 1}}}?[^ ]*[,;:](?: |\z)|(?:[^ ]+ ){{0,{longest - 1}}}[^ ]+"


def units(text: Column, longest: int | None = LONGEST) -> Column:
    """Sentences, long ones as clauses, words joined by one space; nothing for a text without words."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09\x0B-\x0D]+", " ")
    sentences = F.filter(F.transform(F.regexp_extract_all(spaced, F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")
    if longest is None:
        return sentences
    n_words = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1
    clauses = lambda s: F.transform(F.regexp_extract_all(s, F.lit(clause(longest)), F.lit(0)), lambda c: F.trim(c))
    return F.flatten(F.transform(sentences, lambda s: F.when(n_words(s) > longest, clauses(s)).otherwise(F.array(s))))


def dedup(docs: DataFrame, span: int = 3, longest: int | None = LONGEST) -> DataFrame:
    """doc_id, units, removed (places from 0, in order) and kept_text (units left, one a line).

    Rows alike in doc_id and text count as one document, and neither copy removes the other. A text
    with fewer than `span` units is left alone; null and empty texts have none. Null doc_ids come
    first. Of equal spans the one at the smaller (doc_id, hash of the text, place) stays. Other
    columns are ignored. An empty table gives no rows. With `longest` None, units are whole sentences.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), units(F.col("text"), longest).alias("units"))
    one = d.select("doc_id", "th", F.transform("units", lambda u: F.struct(F.xxhash64(u).alias("a"), F.hash(u).alias("b"))).alias("u")).filter(F.size("u") >= span)
    parts = [", ".join(f"u[i + {k}].{c}" for k in range(span)) for c in "ab"]
    runs = F.expr(f"transform(sequence(0, size(u) - {span}), i -> named_struct('h', xxhash64({parts[0]}), 'g', hash({parts[1]})))")
    hashed = cut(one.select("doc_id", "th", runs.alias("r")), "spans")
    spans = hashed.select("doc_id", "th", F.posexplode("r").alias("i", "r")).select("doc_id", "th", "i", "r.h", "r.g")
    place = F.struct("doc_id", "th", "i")
    repeated = cut(spans.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1"), "repeated")
    all_places = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") > all_places / HOT_KEYS
    hot, calm = (repeated.filter(c).select(F.col("h").alias("h_"), F.col("g").alias("g_"), "first") for c in (often, ~often))
    same = (F.col("h") == F.col("h_")) & (F.col("g") == F.col("g_"))
    met = spans.join(F.broadcast(hot), same, "left")
    # Null ids compare as equal here, as they do in min().
    hits = met.filter(F.col("h_").isNotNull()).filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "th", "i")
    rest = met.filter(F.col("h_").isNull()).select("doc_id", "th", "i", "h", "g").join(calm, same)
    hits = hits.unionByName(rest.filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "th", "i"))
    covered = hits.groupBy("doc_id", "th").agg(F.collect_set("i").alias("starts"))
    every = F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (span - 1))))))
    covered = cut(covered.select(F.col("doc_id").alias("d_"), F.col("th").alias("t_"), every.alias("removed")), "covered")
    out = d.join(covered, d.doc_id.eqNullSafe(F.col("d_")) & (d.th == F.col("t_")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    # Both lists are in order, so marks come from one merge of sets, not a search per unit.
    left = F.array_except(F.when(F.size("units") > 0, F.sequence(F.lit(0), F.size("units") - 1)).otherwise(F.array().cast("array<int>")), removed)
    kept = F.when(F.size(removed) == 0, F.array_join("units", "\n")).otherwise(F.array_join(F.transform(left, lambda i: F.element_at("units", i + 1)), "\n"))
    return out.select("doc_id", "units", removed.alias("removed"), kept.alias("kept_text"))


_N_WORDS = "length(s) - length(replace(s, ' ', '')) + 1"
ORACLE = f"""WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(regexp_replace(coalesce(text, ''), '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g'), '[^.!?\\n]*[.!?]+|[^.!?\\n]+'), lambda s: trim(s)), lambda s: s <> '') AS s FROM documents),
u AS (SELECT doc_id, flatten(list_transform(s, lambda s: CASE WHEN {_N_WORDS} > {LONGEST} THEN list_transform(regexp_extract_all(s, '{clause(LONGEST)}'), lambda c: trim(c)) ELSE [s] END)) AS u FROM t),
s AS (SELECT doc_id, u, unnest(range(0, len(u) - 2)) AS i FROM u WHERE len(u) >= 3),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY u[i + 1 : i + 3] ORDER BY doc_id, i) AS r FROM s),
c AS (SELECT doc_id, list_sort(list_distinct(flatten(list([i, i + 1, i + 2])))) AS gone FROM r WHERE r > 1 GROUP BY doc_id)
SELECT u.doc_id, len(u) AS n_sentences, coalesce(len(gone), 0) AS n_removed,
 md5(array_to_string(list_transform(list_filter(range(0, len(u)), lambda i: NOT list_contains(coalesce(gone, []), i)), lambda i: u[i + 1]), chr(10))) AS kept_md5 FROM u LEFT JOIN c USING (doc_id)"""
