"""What the operators share: words, the shared work folder, cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


#: Keys that hold more than 1 / HOT_KEYS of all rows are fewer than HOT_KEYS, whatever the data.
HOT_KEYS = 10_000


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured, a local session gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="keystrata-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/keystrata-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write to the shared folder and read again: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by cut() that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(t._cut_path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def join_counted(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """`rows` with the columns of `table`, which has a row for a key and `n`, how many of `rows` have it; null where there is none.

    Hot keys are joined by broadcast, the others by shuffle, so that no key meets in one task.
    """
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") > total / HOT_KEYS
    extra = [c for c in table.columns if c not in (key, "n")]
    hot, calm = (table.filter(c).select(F.col(key).alias("k_"), *extra) for c in (often, ~often))
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("k_"), "left")
    found = met.filter(F.col("k_").isNotNull()).select(*rows.columns, *extra)
    rest = met.filter(F.col("k_").isNull()).select(*rows.columns).join(calm, F.col(key) == F.col("k_"), "left")
    return found.unionByName(rest.select(*rows.columns, *extra))


def in_order(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(row, k, text) with k unique and in order of doc_id, nulls first; and whether k is the doc_id itself.

    Rows that share an id, or have none, are ordered by text; `row` holds all columns, whatever their names.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("k"), "text")
    n, ids = rows.select("k").groupBy("k").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("k")).first()
    if n == ids:
        return rows, True
    return cut(rows.repartitionByRange("k").sortWithinPartitions("k", "text").withColumn("k", F.monotonically_increasing_id()), "keyed"), False


def all_columns(docs: DataFrame) -> list[Column]:
    """The columns of `docs` out of its `row`."""
    return [F.col("row")[c].alias(c) for c in docs.columns]


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5
