"""Formatting, workload arithmetic, predicates and search tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL_PATTERN = r"^[^@\s]+@[^@\s.]+\.[^@\s]+$"
UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def _fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x)


def fmt_bytes(b: Column) -> Column:
    """1024-step units; two decimals under 10, one under 100, else none."""
    b = b.cast("double")
    out = None
    for i, unit in reversed(list(enumerate(UNITS))):
        v = b / float(1024**i)
        text = F.concat(F.when(v >= 100, _fixed(v, 0)).when(v >= 10, _fixed(v, 1)).otherwise(_fixed(v, 2)), F.lit(f" {unit}"))
        out = text if out is None else F.when(b < float(1024 ** (i + 1)), text).otherwise(out)
    return out


def fmt_num(n: Column) -> Column:
    n = n.cast("double")
    return (
        F.when(n >= 1e9, F.concat(_fixed(n / 1e9, 1), F.lit("B")))
        .when(n >= 1e6, F.concat(_fixed(n / 1e6, 1), F.lit("M")))
        .when(n >= 1e3, F.concat(_fixed(n / 1e3, 0), F.lit("k")))
        .otherwise(F.floor(n + 0.5).cast("string"))
    )


def cost_model(docs: Column, value_bytes: Column, keys: Column, qps: Column, hit_pct: Column) -> dict[str, Column]:
    """Corpus size, read bandwidth, memory and round trips of a batched read workload.

    `hit_pct` is a whole percentage; shares are taken in integers so that results are exact.
    """
    docs, value_bytes, keys, qps, hit_pct = (c.cast("bigint") for c in (docs, value_bytes, keys, qps, hit_pct))
    parts = F.least(keys, F.lit(3).cast("bigint"))
    return {
        "corpus_bytes": docs * value_bytes,
        "per_query_bytes": keys * value_bytes,
        "read_bandwidth": qps * keys * value_bytes,
        "disk_bandwidth": F.expr("bigint(0)") + F.floor(qps * keys * value_bytes * (F.lit(100) - hit_pct) / 100),
        "ram_bytes": F.floor(docs * value_bytes * hit_pct / 100),
        "partitions_touched": parts,
        "saved_pct": F.when(keys > 0, F.floor((keys - parts) * 100 / keys)).otherwise(F.lit(0).cast("bigint")),
    }


def valid_email(c: Column) -> Column:
    return c.rlike(EMAIL_PATTERN) & F.char_length(c).between(6, 254)


def search_tier(query: str, label: Column, hint: Column, body: Column) -> Column:
    """0 prefix, 1 substring, 2 subsequence of the label, 3 hint, 4 body (three letters or more); null: no match."""
    q = query.lower()
    if not q:
        return F.lit(0)
    low = F.lower(label)
    subsequence = "(?s)" + ".*".join("\\Q" + ch + "\\E" for ch in q)
    tier = (
        F.when(low.startswith(q), 0)
        .when(F.instr(low, q) > 0, 1)
        .when(low.rlike(subsequence), 2)
        .when(F.instr(F.lower(F.coalesce(hint, F.lit(""))), q) > 0, 3)
    )
    return tier.when(F.instr(F.lower(F.coalesce(body, F.lit(""))), q) > 0, 4) if len(q) >= 3 else tier
