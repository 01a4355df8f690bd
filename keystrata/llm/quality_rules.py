"""Weak supervision of quality rules, in DataFrame operations only.

Each rule votes good (1), bad (0) or abstains (2). Rows are counted by their pattern of votes, which
is all that expectation-maximisation needs: it estimates, for good and for bad documents, how often
each rule that votes objects, and every document gets the posterior probability of being good.
Abstaining says nothing about a document. Counting patterns is one pass with partial aggregation;
the patterns are at most 3^rules rows.

Most kinds of junk are seen by two rules or more, and every rule has a band in which it votes good,
so a single objection can be outvoted, and rules that agree with the others gain weight.

The estimate is the maximum of the posterior density under Beta priors (Dirichlet of two classes or
votes): one on each rule's rate of objections in each class, one on the share of good documents.
What rules are written for is in their means: a rule rarely objects to a good document, and finds a
part of the junk only. A prior weighs as much as STRENGTH of all rows, so that the result is alike
at every size. No step lowers the penalised likelihood, see `objective`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, cut

SYMBOLS = "#*$%&|<>"
#: ASCII characters that are neither letters nor white space.
NO_LETTERS = "0123456789" + SYMBOLS + ".,;:!?()[]{}'\"`@_=+~^/\\-"
WINDOW = 8
GOOD, BAD, ABSTAIN = 1, 0, 2
#: Means of the priors, and where the steps start: rate of objections among votes, by class (1 good, 0 bad).
OBJECTS = {1: 0.01, 0: 0.3}
PRIOR_GOOD = 0.8
#: Weight of each prior, as a share of the number of rows.
STRENGTH = 0.01


def _without(chars: str, c: str = "text") -> Column:
    """Number of characters that are among `chars`."""
    return (F.length(c) - F.length(F.translate(F.col(c), chars, ""))).cast("bigint")


def features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts over each whole text; a null text counts as empty, all zero.

    n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (words that lie in a window of
    WINDOW words whose sequence of words occurs twice or more), n_upper, n_distinct (words),
    n_marked (words that end in a symbol or an exclamation mark), n_bare (words without a letter),
    n_stops (characters that end sentences), n_others (ASCII characters of words that are no letters) and n_lines (lines with a word). Windows are compared by
    a 64-bit hash made from their words' hashes by three doublings. Work is in proportion to n log n
    in a text's words: hashes are sorted, and only texts with an equal pair go on to positions.
    """
    t = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    marks = SYMBOLS + "!"
    t = t.select(
        *keep, F.array_remove(F.split("text", SPACE), "").alias("w"), lines.alias("lines"),
        (F.length("text") - _without(" \t\n\x0b\x0c\r")).cast("bigint").alias("word_chars"),
        _without(SYMBOLS).alias("n_symbols"), _without(".!?").alias("n_stops"), _without(NO_LETTERS).alias("n_others"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("bigint").alias("n_upper"),
        F.regexp_count("text", F.lit(rf"[{marks}](?=[\x20\x09-\x0D]|\z)")).cast("bigint").alias("n_marked"),
        F.regexp_count("text", F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]++(?=[\x20\x09-\x0D]|\z)")).cast("bigint").alias("n_bare"),
    )
    counted = ["word_chars", "n_symbols", "n_stops", "n_others", "n_upper", "n_marked", "n_bare"]
    t = t.select(
        *keep, *counted, F.size("w").cast("bigint").alias("n_words"), F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"),
        F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size("w") >= WINDOW, F.transform("w", lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    step = 1
    while step < WINDOW:  # a hash of `step` words and the one `step` words on make one of twice as many
        t = t.withColumn("h", F.expr(f"if(size(h) > {step}, zip_with(slice(h, 1, size(h) - {step}), slice(h, {step + 1}, size(h) - {step}), (a, b) -> xxhash64(a, b)), cast(array() as array<bigint>))"))
        step *= 2
    twice = F.size(F.array_distinct("h")) < F.size("h")
    # Positions by (hash, place): a window repeats when its hash equals a neighbour's.
    t = t.withColumn("r", F.when(twice, F.expr("array_sort(transform(h, (x, i) -> named_struct('h', x, 'i', i)))"))).drop("h")
    again = F.expr("array_sort(transform(filter(transform(r, (x, i) -> if((i > 0 and r[greatest(i - 1, 0)].h = x.h) or (i < size(r) - 1 and r[least(i + 1, size(r) - 1)].h = x.h), x.i, -1)), y -> y >= 0), y -> y))")
    t = t.withColumn("p", again).drop("r")
    covered = F.expr(f"aggregate(p, named_struct('n', 0L, 'end', 0), (s, i) -> named_struct('n', s.n + i + {WINDOW} - greatest(s.end, i), 'end', i + {WINDOW}), s -> s.n)")
    return t.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("p")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Votes; comparisons are products of whole numbers, so no division by zero and no rounding.

    Between the two bands of a rule, and where a text is too short to tell, it abstains.
    """
    w, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    some, more = w >= 20, w >= 50
    bands = {
        # name: (votes good, votes bad)
        "symbols": (some & (100 * F.col("n_symbols") <= chars), 20 * F.col("n_symbols") > chars),
        "letters": (some & (10 * F.col("n_others") <= chars), 4 * F.col("n_others") > chars),
        "marked_words": (some & (20 * F.col("n_marked") <= w), 10 * F.col("n_marked") > 3 * w),
        "capitals": (some & (10 * F.col("n_upper") <= chars), 3 * F.col("n_upper") > chars),
        "bare_words": (some & (50 * F.col("n_bare") <= w), 10 * F.col("n_bare") > w),
        "word_length": (some & (chars >= 3 * w) & (chars <= 9 * w), (chars < 2 * w) | (chars > 12 * w)),
        # Distinct words over the root of all words hardly depends on a text's length.
        "variety": (more & (F.col("n_distinct") * F.col("n_distinct") >= 16 * w), F.col("n_distinct") * F.col("n_distinct") < 4 * w),
        "new_words": (more & (5 * F.col("n_distinct") >= 2 * w), more & (5 * F.col("n_distinct") < w)),
        "repeated_words": (more & (F.col("n_repeat_words") == 0), 5 * F.col("n_repeat_words") > w),
        "repeated_lines": ((lines >= 3) & (F.col("n_dup_lines") == 0), F.col("n_dup_lines") >= 3),
        "sentences": (some & (5 * F.col("n_stops") <= w) & (w <= 40 * F.col("n_stops")), more & (w > 60 * F.col("n_stops"))),
    }
    return {n: F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN) for n, (good, bad) in bands.items()}


def start(names: list[str]) -> tuple[float, dict]:
    return PRIOR_GOOD, {n: dict(OBJECTS) for n in names}


def step(patterns: DataFrame, names: list[str], good: float, objects: dict) -> tuple[float, dict] | None:
    """One step of expectation and maximisation; None for a table without rows.

    It is one aggregation over the table of patterns; its single row is all that reaches the driver.
    """
    expected = patterns.withColumn("g", F.col("n") * posterior(names, good, objects)).withColumn("b", F.col("n") - F.col("g"))
    sums = [F.sum("n").alias("n"), F.sum("g").alias("g")]
    for r in names:
        for tag, votes in (("v", F.col(r) != ABSTAIN), ("o", F.col(r) == BAD)):
            sums += [F.coalesce(F.sum(F.when(votes, F.col(of))), F.lit(0.0)).alias(f"{r}_{tag}{c}") for c, of in ((1, "g"), (0, "b"))]
    row = expected.agg(*sums).first()
    if not row.n:
        return None
    s = STRENGTH * row.n
    new = {r: {c: (row[f"{r}_o{c}"] + s * OBJECTS[c]) / (row[f"{r}_v{c}"] + s) for c in (1, 0)} for r in names}
    return (row.g + s * PRIOR_GOOD) / (row.n + s), new


def objective(patterns: list[tuple[dict[str, int], int]], names: list[str], good: float, objects: dict) -> float:
    """Penalised log-likelihood of counted patterns, which no step lowers."""
    n, total = sum(c for _, c in patterns), 0.0
    rate = lambda r, c, vote: 1.0 if vote == ABSTAIN else objects[r][c] if vote == BAD else 1 - objects[r][c]
    for votes, count in patterns:
        total += count * math.log(sum(share * math.prod(rate(r, c, votes[r]) for r in names) for c, share in ((1, good), (0, 1 - good))))
    beta = lambda mean, x: mean * math.log(x) + (1 - mean) * math.log(1 - x)
    return total + STRENGTH * n * (beta(PRIOR_GOOD, good) + sum(beta(OBJECTS[c], objects[r][c]) for r in names for c in (1, 0)))


def fit(patterns: DataFrame, names: list[str], steps: int = 30) -> tuple[float, dict[str, dict[int, float]]]:
    """Share of good documents, and rate of objections by rule and class (1 good, 0 bad)."""
    good, objects = start(names)
    for _ in range(steps):
        made = step(patterns, names, good, objects)
        if made is None:
            break
        moved = max(abs(made[0] - good), *(abs(made[1][r][c] - objects[r][c]) for r in names for c in (1, 0)))
        good, objects = made
        if moved < 1e-6:
            break
    return good, objects


def posterior(names: list[str], good: float, objects: dict) -> Column:
    """Probability of class good given the votes, from log odds."""
    odds = F.lit(math.log(good / (1 - good)))
    for r in names:
        for_it, against = math.log((1 - objects[r][1]) / (1 - objects[r][0])), math.log(objects[r][1] / objects[r][0])
        odds = odds + F.when(F.col(r) == GOOD, for_it).when(F.col(r) == BAD, against).otherwise(0.0)
    return 1.0 / (1.0 + F.exp(-odds))


def judge(docs: DataFrame, threshold: float = 0.5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Features, votes, base_failed, quality (posterior of good) and kept, one row per row of `docs`.

    Only `keep` and `text` are read, so other columns may have any name; `keep` may not name one
    that is made here. Null and empty texts have no words and fail the base test; repeated rows
    stay repeated, each with the same verdict; a null doc_id is carried along. A posterior equal to
    the threshold is kept. An empty table gives no rows.
    """
    f = cut(features(docs, keep), "features")
    votes = rules()
    voted = f.withColumns(votes)
    names = list(votes)
    patterns = cut(voted.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1), "patterns")
    good, objects = fit(patterns, names)
    q = posterior(names, good, objects)
    return voted.withColumn("base_failed", base_failed()).withColumn("quality", q).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
