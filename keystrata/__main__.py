"""Command line: `python -m keystrata kv DIR` or `python -m keystrata sql [--tables DIR] [--store DIR]`."""

from __future__ import annotations

import argparse
import sys

from .sources.shell import SqlSession, register, repl
from .sources.store import KVStore


def session(master: str):
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master(master).appName("keystrata").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prompted(prompt: str):
    while True:
        print(prompt, end="", file=sys.stderr, flush=True)
        line = sys.stdin.readline()
        if not line:
            return
        yield line


def main(args: list[str] | None = None, spark=None) -> int:
    p = argparse.ArgumentParser(prog="keystrata", description="Versioned key-value data on Spark.")
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="mode", required=True)
    kv = sub.add_parser("kv", help="key-value commands over a store")
    kv.add_argument("store", nargs="?", default="data")
    sql = sub.add_parser("sql", help="SQL statements")
    sql.add_argument("--tables", help="folder of Parquet tables to register")
    sql.add_argument("--store", help="store whose pairs are the view kv")
    for q in (kv, sql):
        q.add_argument("-c", "--command", help="run this and exit")
    a = p.parse_args(args)
    store = None
    try:
        spark = spark or session(a.master)
        if a.store:
            store = KVStore.open(spark, a.store)
        if a.mode == "sql" and a.tables:
            register(spark, a.tables)
    except Exception as e:  # busy, damaged or missing: nothing to talk to
        print(f"cannot open: {e}", file=sys.stderr)
        return 2
    try:
        lines = [a.command] if a.command else prompted("> ") if sys.stdin.isatty() else sys.stdin
        if a.mode == "kv":
            return repl(store, lines)
        if store is not None:
            store.scan().createOrReplaceTempView("kv")
        shell = SqlSession(spark, store)
        shell.timing = not a.command and sys.stdin.isatty()
        return shell.run(lines)
    finally:
        if store is not None:
            store.close()


if __name__ == "__main__":
    sys.exit(main())
