"""Named queries over the test tables, each with an equivalent DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import merge, ring, runs, stats, vector
from ..sources.log import benchmark_keys, crash_writer, event_log, lineitem_log, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

KV = """WITH kv AS (SELECT event_id AS seq, CAST(floor(event_id / 1000) AS BIGINT) AS run, 'user:' || CAST(user_id AS VARCHAR) AS key,
 CASE WHEN event_type <> 'error' THEN event_type || '=' || props END AS value, event_type = 'error' AS is_tombstone FROM events),
latest AS (SELECT key, value, is_tombstone FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) r FROM kv) WHERE r = 1),
entries AS (SELECT run, key, value, is_tombstone, seq FROM (SELECT *, row_number() OVER (PARTITION BY run, key ORDER BY seq DESC) r FROM kv) WHERE r = 1),
merged AS (SELECT key, value, is_tombstone FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY run DESC) r FROM entries) WHERE r = 1)
"""
LIVE = "SELECT key, value FROM latest WHERE NOT is_tombstone"
PROBES = ["user:1", "user:2", "user:17", "user:42", "user:99", "user:100", "user:149", "user:9999", "nobody", ""]
NODES = ("a", "b", "c", "d")
VNODES = 256
WORDS = "the of and to in"
SEARCH = "the"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def kv(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, KV + sql)(lambda spark, d: f(event_log(spark, d)))


kv("kv_live_scan", LIVE, merge.scan)
kv("kv_raw_merge", "SELECT * FROM latest", merge.raw_scan)
kv("kv_get", LIVE + " AND key = 'user:42'", lambda log: merge.get(log, "user:42"))
kv("kv_multi_get", LIVE + f" AND key IN ({', '.join(repr(p) for p in PROBES)})", lambda log: merge.multi_get(log, PROBES))
kv("kv_range_scan", LIVE + " AND key >= 'user:1' AND key < 'user:2'", lambda log: merge.scan(log, "user:1", "user:2"))
kv("kv_range_scan_open_start", LIVE + " AND key < 'user:2'", lambda log: merge.scan(log, end="user:2"))
kv("kv_range_scan_open_end", LIVE + " AND key >= 'user:5'", lambda log: merge.scan(log, "user:5"))
kv("kv_range_scan_reversed", LIVE + " AND key >= 'user:2' AND key < 'user:1'", lambda log: merge.scan(log, "user:2", "user:1"))
kv("kv_prefix_scan", LIVE + " AND starts_with(key, 'user:1')", lambda log: merge.scan(log, prefix="user:1"))
kv("kv_prefix_scan_empty", LIVE, lambda log: merge.scan(log, prefix=""))
kv("kv_replay_prefix", "SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) r FROM kv WHERE seq < 5000) WHERE r = 1 AND NOT is_tombstone", lambda log: merge.scan(log, as_of=5000))
kv("kv_entry_count", "SELECT count(*) AS entries, count(*) FILTER (WHERE NOT is_tombstone) AS live_entries FROM latest", lambda log: merge.newest_wins(log).agg(F.count("*").alias("entries"), F.sum((~F.col("is_tombstone")).cast("bigint")).alias("live_entries")))
kv("run_entries", "SELECT * FROM entries", runs.run_entries)
kv("run_stats", """SELECT run, count(*) AS entries, CAST(sum(is_tombstone::INT) AS BIGINT) AS tombstones, min(key) AS min_key, max(key) AS max_key,
 CAST(sum(8 + strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS index_offset,
 CAST(sum(8 + strlen(key) + coalesce(strlen(value), 0)) + sum(12 + strlen(key)) + 8 AS BIGINT) AS file_size FROM entries GROUP BY run""", lambda log: runs.run_stats(runs.run_entries(log)))
kv("run_index_offsets", "SELECT run, key, CAST(coalesce(sum(8 + strlen(key) + coalesce(strlen(value), 0)) OVER (PARTITION BY run ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS entry_offset FROM entries", lambda log: runs.index_offsets(runs.run_entries(log)))
kv("run_next_id", "SELECT max(run) + 1 AS next_id, count(DISTINCT run) AS runs FROM entries", lambda log: log.agg((F.max("run") + 1).alias("next_id"), F.countDistinct("run").alias("runs")))
kv("layers_probed", "SELECT key, (SELECT max(run) FROM entries) - max(run) + 1 AS layers FROM entries GROUP BY key", lambda log: runs.layers_probed(runs.run_entries(log)))
kv("wal_record_bytes", "SELECT seq, CAST(8 + strlen(key) + coalesce(strlen(value), 0) AS BIGINT) AS record_bytes, CAST(sum(8 + strlen(key) + coalesce(strlen(value), 0)) OVER (PARTITION BY run ORDER BY seq) AS BIGINT) AS log_bytes FROM kv", runs.log_bytes)
kv("compact_output", "SELECT key, value FROM merged WHERE NOT is_tombstone", lambda log: runs.compact(runs.run_entries(log)))
kv("compact_stats", """SELECT (SELECT count(*) FROM entries) AS entries_in, count(*) FILTER (WHERE NOT is_tombstone) AS entries_out,
 (SELECT count(*) FROM entries) - count(*) AS superseded, count(*) FILTER (WHERE is_tombstone) AS tombstones_dropped FROM merged""", lambda log: runs.compact_stats(runs.run_entries(log)))
kv("compaction_invariant", "SELECT key, value FROM latest WHERE NOT is_tombstone EXCEPT SELECT key, value FROM merged WHERE NOT is_tombstone", runs.compaction_difference)

TRACE = """, sized AS (SELECT *, CAST(strlen(key) + coalesce(strlen(value), 0) AS BIGINT) AS sz FROM kv),
steps AS (SELECT *, lag(sz) OVER (PARTITION BY run, key ORDER BY seq) AS prev FROM sized),
trace AS (SELECT run, seq, key, CAST(sum(sz - coalesce(prev, 0)) OVER (PARTITION BY run ORDER BY seq) AS BIGINT) AS size_bytes,
 CAST(sum(CASE WHEN prev IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY seq) AS BIGINT) AS entries FROM steps)
"""
kv("memtable_size_trace", TRACE.lstrip() + " SELECT * FROM trace", runs.memtable_trace)
kv("flush_threshold", TRACE.lstrip() + " SELECT run, min(CASE WHEN size_bytes >= 3000 THEN seq END) AS full_at, max(size_bytes) AS peak_bytes FROM trace GROUP BY run", lambda log: runs.flush_points(log, 3000))


@query("kv_lookup_tristate", KV + ", probes AS (SELECT unnest([" + ", ".join(repr(p) for p in PROBES) + "]) AS key) SELECT p.key, CASE WHEN l.key IS NULL THEN 'NotFound' WHEN l.is_tombstone THEN 'Deleted' ELSE 'Found' END AS status, l.value FROM probes p LEFT JOIN latest l ON p.key = l.key")
def _lookup(spark, d):
    return merge.lookup(event_log(spark, d), spark.createDataFrame([(p,) for p in PROBES], "key string"), len(PROBES))


@query("kv_lookup_customers", KV + " SELECT 'user:' || CAST(c_custkey AS VARCHAR) AS key, CASE WHEN l.key IS NULL THEN 'NotFound' WHEN l.is_tombstone THEN 'Deleted' ELSE 'Found' END AS status, l.value FROM customer LEFT JOIN latest l ON l.key = 'user:' || CAST(c_custkey AS VARCHAR)")
def _lookup_customers(spark, d):
    return merge.lookup(event_log(spark, d), table(spark, d, "customer").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("key")))


@query("kv_live_scan_lineitem", """SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) r
 FROM (SELECT *, 'line:' || l_orderkey || ':' || l_linenumber AS key, CASE WHEN l_returnflag <> 'R' THEN l_partkey || '|' || l_suppkey END AS value FROM lineitem)) WHERE r = 1 AND l_returnflag <> 'R'""")
def _lineitem(spark, d):
    return merge.scan(lineitem_log(spark, d))


@query("kv_merge_layers", "SELECT * FROM (VALUES ('a', 'new', false), ('b', NULL, true), ('c', 'old', false), ('d', 'mid', false)) t(key, value, is_tombstone)")
def _layers(spark, _):
    rows = [[("a", "new"), ("b", None)], [("b", "mid"), ("d", "mid")], [("a", "old"), ("c", "old"), ("d", "old")]]
    return merge.merge_layers([spark.createDataFrame([(k, v, v is None) for k, v in r], "key string, value string, is_tombstone boolean") for r in rows])


# -- placement

HASH = """hx AS (SELECT id, '{domain}' || hex(encode(key)) || suffix AS h FROM src),
by AS (SELECT id, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::INT::UHUGEINT) AS b FROM hx),
f0 AS (SELECT id, list_reduce(list_prepend(14695981039346656037::UHUGEINT, b), lambda h, x: (xor(h, x) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h FROM by),
f1 AS (SELECT id, (xor(h, h // 8589934592::UHUGEINT) * 18397679294719823053::UHUGEINT) % 18446744073709551616::UHUGEINT AS h FROM f0),
f2 AS (SELECT id, (xor(h, h // 8589934592::UHUGEINT) * 14181476777654086739::UHUGEINT) % 18446744073709551616::UHUGEINT AS h FROM f1),
{out} AS (SELECT id, xor(h, h // 8589934592::UHUGEINT)::UBIGINT AS h FROM f2)"""


def _hash_sql(src: str, domain: str, out: str) -> str:
    body = HASH.format(domain=domain, out=out)
    for n in ("hx", "by", "f0", "f1", "f2"):
        body = body.replace(f"{n} AS", f"{n}_{out} AS").replace(f"FROM {n}", f"FROM {n}_{out}")
    return f"{body}".replace("FROM src", f"FROM ({src})")


def _ring_sql(nodes: tuple[str, ...], tag: str) -> str:
    listed = ", ".join(f"('{n}')" for n in nodes)
    le = "lpad(hex(i % 256), 2, '0') || lpad(hex(i // 256), 2, '0') || '0000'"
    src = f"SELECT node || '|' || i AS id, node AS key, {le} AS suffix FROM (VALUES {listed}) n(node), range({VNODES}) r(i)"
    return _hash_sql(src, "01", f"p_{tag}") + f", pos_{tag} AS (SELECT h, min(split_part(id, '|', 1)) AS node FROM p_{tag} GROUP BY h)"


def _owner_sql(tag: str) -> str:
    return f"own_{tag} AS (SELECT k.id AS key, coalesce(p.node, (SELECT node FROM pos_{tag} ORDER BY h LIMIT 1)) AS node_id FROM kh k ASOF LEFT JOIN pos_{tag} p ON k.h <= p.h)"


KEYS = "SELECT 'order:' || o_orderkey AS id, 'order:' || o_orderkey AS key, '' AS suffix FROM orders"
WITH_KEYS = "WITH " + _hash_sql(KEYS, "00", "kh")


def order_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("key"))


@query("ring_key_hash", WITH_KEYS + " SELECT id AS key, lower(lpad(hex(h), 16, '0')) AS hash FROM kh")
def _key_hash(spark, d):
    return ring.key_hashes(order_keys(spark, d))


@query("ring_positions", "WITH " + _ring_sql(NODES, "a") + " SELECT lower(lpad(hex(h), 16, '0')) AS hash, split_part(id, '|', 1) AS node_id, CAST(split_part(id, '|', 2) AS INT) AS vnode FROM p_a")
def _positions(spark, d):
    return ring.HashRing(VNODES, NODES).positions(spark)


@query("ring_owner", WITH_KEYS + ", " + _ring_sql(NODES, "a") + ", " + _owner_sql("a") + " SELECT * FROM own_a")
def _owner(spark, d):
    return ring.HashRing(VNODES, NODES).owners(order_keys(spark, d))


@query("ring_balance", WITH_KEYS + ", " + _ring_sql(NODES, "a") + ", " + _owner_sql("a") + " SELECT node_id, count(*) AS keys FROM own_a GROUP BY node_id")
def _balance(spark, d):
    return ring.balance(ring.HashRing(VNODES, NODES).owners(order_keys(spark, d)))


def _move_sql(other: tuple[str, ...]) -> str:
    return WITH_KEYS + ", " + _ring_sql(NODES, "a") + ", " + _ring_sql(other, "z") + ", " + _owner_sql("a") + ", " + _owner_sql("z") + """
 SELECT a.node_id AS from_node, z.node_id AS to_node, count(*) AS moved FROM own_a a JOIN own_z z USING (key) WHERE a.node_id <> z.node_id GROUP BY ALL"""


@query("ring_movement_add", _move_sql((*NODES, "e")))
def _move_add(spark, d):
    old = ring.HashRing(VNODES, NODES)
    return ring.movement(order_keys(spark, d), old, old.add_node("e")[0])


@query("ring_movement_remove", _move_sql(("a", "c", "d")))
def _move_remove(spark, d):
    old = ring.HashRing(VNODES, NODES)
    return ring.movement(order_keys(spark, d), old, old.remove_node("b")[0])


@query("ring_multi_get", KV + ", " + _hash_sql("SELECT key AS id, key, '' AS suffix FROM latest WHERE NOT is_tombstone", "00", "kh") + ", " + _ring_sql(NODES, "a") + ", " + _owner_sql("a") + " SELECT o.node_id, count(*) AS keys_found, max(l.key) AS max_key FROM own_a o JOIN latest l ON o.key = l.key GROUP BY o.node_id")
def _ring_get(spark, d):
    log = event_log(spark, d)
    found = ring.partitioned_multi_get(log, log.select("key"), ring.HashRing(VNODES, NODES)).filter("status = 'Found'")
    return found.groupBy("node_id").agg(F.count("*").alias("keys_found"), F.max("key").alias("max_key"))


# -- vectors

QUERY_VECTOR = [round(((i * 37) % 101 - 50) / 50, 2) for i in range(vector.DIM)]
_Q = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY_VECTOR) + "]"
TOPK = f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 8"


@query("vec_topk_cosine", TOPK)
def _topk(spark, d):
    return vector.topk_cosine(table(spark, d, "embeddings"), QUERY_VECTOR, 8)


@query("vec_topk_sharded", TOPK)
def _topk_sharded(spark, d):
    size = sum(x * x for x in QUERY_VECTOR) ** 0.5
    return vector.topk_per_shard(table(spark, d, "embeddings"), [x / size for x in QUERY_VECTOR], 8, F.col("vec_id") % 16)


EMBED = """WITH tok AS (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM documents),
feat AS (SELECT doc, 'w:' || tok AS f, 1.0::DOUBLE AS w FROM tok UNION ALL
 SELECT doc, 'g:' || substr('<' || tok || '>', j::INT, 3), 0.5::DOUBLE FROM (SELECT doc, tok, unnest(range(1, length(tok) + 1)) AS j FROM tok)),
hashed AS (SELECT f, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(f) + 1), lambda i: ascii(substr(f, i::INT, 1))::BIGINT)), lambda h, x: (xor(h, x) * 16777619) & 4294967295) AS h FROM (SELECT DISTINCT f FROM feat)),
emb AS (SELECT doc, h % 64 AS dim, sum(CASE WHEN h >= 2147483648 THEN -w ELSE w END) AS weight FROM feat JOIN hashed USING (f) GROUP BY ALL)
"""


@query("text_embed_hashed", EMBED + "SELECT * FROM emb")
def _embed(spark, d):
    return vector.embed(table(spark, d, "documents"))


@query("text_embed_vectors", EMBED + """, n AS (SELECT doc, sqrt(sum(weight * weight)) AS n FROM emb GROUP BY doc)
 SELECT d.doc_id, i AS dim, coalesce(CAST(weight / CASE WHEN n = 0 THEN 1 ELSE n END AS FLOAT), 0) AS x FROM documents d CROSS JOIN range(64) t(i) LEFT JOIN emb ON emb.doc = d.doc_id AND emb.dim = i LEFT JOIN n ON n.doc = d.doc_id""")
def _embed_vectors(spark, d):
    # In the SQL, no sums meet a row without an id.
    x = F.when(F.col("doc").isNotNull(), F.col("x")).otherwise(F.lit(0.0).cast("float"))
    return vector.embed_vectors(table(spark, d, "documents")).select("doc", F.posexplode("embedding").alias("dim", "x")).select(F.col("doc").alias("doc_id"), "dim", x.alias("x"))


@query("text_topk_hashed", EMBED + ", q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {x!r}::DOUBLE)" for i, x in enumerate(vector.embed_local(WORDS))) + ") t(dim, qw)) SELECT doc AS doc_id, round(sum(weight * qw) / CASE WHEN sum(weight * weight) = 0 THEN 1 ELSE sqrt(sum(weight * weight)) END, 6) AS score FROM emb JOIN q USING (dim) GROUP BY doc ORDER BY score DESC, doc_id LIMIT 8")
def _topk_text(spark, d):
    return vector.topk_text(table(spark, d, "documents"), WORDS, 8)


@query("text_trigrams", "WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM documents) SELECT tok, list_transform(range(1, length(tok) + 1), lambda j: substr('<' || tok || '>', j::INT, 3)) AS grams FROM t")
def _trigrams(spark, d):
    tok = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(vector.TOKEN), F.lit(0))).alias("tok")).distinct()
    return tok.select("tok", vector.trigrams("tok").alias("grams"))


def _tier_sql(q: str) -> str:
    fold = ".*".join(q)
    body = f" WHEN contains(lower(p_type), '{q}') THEN 4" if len(q) >= 3 else ""
    return f"""SELECT * FROM (SELECT p_partkey, p_name, CASE WHEN starts_with(lower(p_name), '{q}') THEN 0 WHEN contains(lower(p_name), '{q}') THEN 1
 WHEN regexp_matches(lower(p_name), '{fold}') THEN 2 WHEN contains(lower(p_brand), '{q}') THEN 3{body} END AS tier FROM part) WHERE tier IS NOT NULL"""


def _tiers(name: str, q: str) -> None:
    @query(name, _tier_sql(q))
    def run(spark, d):
        tier = scalars.search_tier(q, F.col("p_name"), F.col("p_brand"), F.col("p_type"))
        return table(spark, d, "part").select("p_partkey", "p_name", tier.alias("tier")).filter(F.col("tier").isNotNull())


_tiers("search_tiers", "ar")
_tiers("search_tiers_body", "tee")
_tiers("search_tiers_hint", "#1")


# -- workloads and statistics


@query("workload_mix", "SELECT i AS op, CASE WHEN (i * 37) % 100 < 90 THEN 'read' ELSE 'write' END AS kind, 'k' || lpad(CAST((i * 7919) % 16384 AS VARCHAR), 8, '0') AS key FROM range(5000) t(i)")
def _mix(spark, d):
    return stats.workload_mix(spark, 5000, 90, 16384)


@query("latency_percentiles", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(n) AS n, max(CASE WHEN i = (n - 1) * 50 // 100 THEN value END) AS p50, max(CASE WHEN i = (n - 1) * 95 // 100 THEN value END) AS p95, max(CASE WHEN i = (n - 1) * 99 // 100 THEN value END) AS p99 FROM r GROUP BY event_type")
def _percentiles(spark, d):
    return stats.floor_rank_percentiles(table(spark, d, "events"), "event_type", "value")


@query("ops_per_second", "SELECT event_type, count(*) AS ops, round(count(*) / sum(1 + event_id % 7), 6) AS ops_per_sec FROM events GROUP BY event_type")
def _ops(spark, d):
    e = table(spark, d, "events").withColumn("elapsed", 1 + F.col("event_id") % 7)
    return stats.ops_per_second(e, "event_type", "elapsed").withColumn("ops_per_sec", F.round("ops_per_sec", 6))


@query("cost_model", """SELECT docs, val, keys, qps, hit, docs * val AS corpus_bytes, keys * val AS per_query_bytes, qps * keys * val AS read_bandwidth, (qps * keys * val * (100 - hit)) // 100 AS disk_bandwidth, (docs * val * hit) // 100 AS ram_bytes, least(keys, 3) AS partitions_touched, CASE WHEN keys > 0 THEN ((keys - least(keys, 3)) * 100) // keys ELSE 0 END AS saved_pct
 FROM (SELECT (1 + i % 20) * 1000000 AS docs, (1 + i % 16) * 1024 AS val, i % 129 AS keys, (1 + i % 50) * 1000 AS qps, i % 101 AS hit FROM range(4000) t(i))""")
def _cost(spark, d):
    i = F.col("id")
    grid = spark.range(4000).select(((1 + i % 20) * 1000000).alias("docs"), ((1 + i % 16) * 1024).alias("val"), (i % 129).alias("keys"), ((1 + i % 50) * 1000).alias("qps"), (i % 101).alias("hit"))
    model = scalars.cost_model(*(F.col(c) for c in ("docs", "val", "keys", "qps", "hit")))
    return grid.select("*", *(c.alias(n) for n, c in model.items()))


def _bytes_sql() -> str:
    cases = ""
    for i, unit in enumerate(scalars.UNITS):
        v = f"(n::DOUBLE / {1024**i})"
        text = f"CASE WHEN {v} >= 100 THEN format('{{:.0f}}', {v}) WHEN {v} >= 10 THEN format('{{:.1f}}', {v}) ELSE format('{{:.2f}}', {v}) END || ' {unit}'"
        cases += f" WHEN n < {1024 ** (i + 1)} THEN {text}" if i + 1 < len(scalars.UNITS) else f" ELSE {text}"
    return f"CASE{cases} END"


SIZES = "SELECT (j % 997 * 2 + 1) * CAST(pow(7, j // 125) AS BIGINT) AS n FROM range(2000) t(j)"


@query("format_sizes", f"""SELECT n, {_bytes_sql()} AS bytes, CASE WHEN n >= 1e9 THEN format('{{:.1f}}B', n / 1e9) WHEN n >= 1e6 THEN format('{{:.1f}}M', n / 1e6)
 WHEN n >= 1000 THEN format('{{:.0f}}', n / 1000) || 'k' ELSE CAST(n AS VARCHAR) END AS number FROM ({SIZES})""")
def _formats(spark, d):
    n = (F.col("id") % 997 * 2 + 1) * F.pow(F.lit(7.0), F.floor(F.col("id") / 125)).cast("bigint")
    return spark.range(2000).select(n.alias("n")).select("n", scalars.fmt_bytes(F.col("n")).alias("bytes"), scalars.fmt_num(F.col("n")).alias("number"))


@query("crash_writer_fixture", "SELECT i AS seq, 'key:' || i AS key, substr(repeat(i || ':', CAST(ceil(64 / length(i || ':')) AS INT)), 1, 64) AS value, false AS is_tombstone FROM range(500) t(i)")
def _crash(spark, d):
    return crash_writer(spark, 500, 64)


@query("benchmark_fixture", "SELECT i AS seq, 'k' || lpad(CAST(i AS VARCHAR), 8, '0') AS key, repeat('v', 256) AS value, false AS is_tombstone FROM range(16384) t(i)")
def _bench_keys(spark, d):
    return benchmark_keys(spark)


SIGNUPS = "SELECT event_id AS arrival, CASE user_id % 3 WHEN 0 THEN ' User' || user_id || '@Mail.Example ' WHEN 1 THEN 'user' || user_id || '@mail.example' ELSE 'broken address ' || user_id END AS email, CASE WHEN event_id % 4 > 0 THEN event_type END AS source, props AS user_agent FROM events"


@query("dedupe_first_wins", f"SELECT email, source, user_agent, arrival FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY arrival) r FROM (SELECT arrival, lower(trim(email)) AS email, substr(coalesce(source, 'unknown'), 1, 40) AS source, substr(user_agent, 1, 400) AS user_agent FROM ({SIGNUPS})) WHERE regexp_matches(email, '^[^@\\s]+@[^@\\s.]+\\.[^@\\s]+$') AND length(email) BETWEEN 6 AND 254) WHERE r = 1")
def _signups(spark, d):
    e = table(spark, d, "events")
    u = F.col("user_id").cast("string")
    email = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit(" User"), u, F.lit("@Mail.Example "))).when(F.col("user_id") % 3 == 1, F.concat(F.lit("user"), u, F.lit("@mail.example"))).otherwise(F.concat(F.lit("broken address "), u))
    rows = e.select(F.col("event_id").alias("arrival"), email.alias("email"), F.when(F.col("event_id") % 4 > 0, F.col("event_type")).alias("source"), F.col("props").alias("user_agent"))
    return stats.first_wins(rows)


# -- relational subset, as Spark SQL


def _sql(name: str, text: str) -> None:
    def run(spark, d):
        body = text
        for t in ("orders", "customer", "events", "region", "nation"):
            body = body.replace(f"FROM {t}", f"FROM parquet.`{d}/{t}.parquet`")
        return spark.sql(body)

    query(name, text)(run)


_sql("sql_project", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
_sql("sql_star", "SELECT * FROM nation")
_sql("sql_filter_eq", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
_sql("sql_filter_gt", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000")
_sql("sql_filter_lt", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0")
_sql("sql_order_limit", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
_sql("sql_table_counts", "SELECT 'orders' AS table_name, count(*) AS row_count FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'events', count(*) FROM events")
