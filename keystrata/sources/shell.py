"""Two line interfaces: key-value commands over a store, and SQL over registered tables.

`python -m keystrata kv DIR` and `python -m keystrata sql` read commands from a terminal or a pipe;
`-c` runs one and exits. Exit codes: 0 all succeeded, 1 a command failed, 2 nothing to talk to (the
store is busy or damaged, or there is no session).
"""

from __future__ import annotations

import os
import re
import sys
import time
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession

from .store import KVStore

USAGE = "commands: put KEY VALUE | get KEY | delete KEY | scan | flush | compact | quit"


def run_command(store: KVStore, line: str) -> str | None:
    """One command; None means quit. The value of `put` keeps its inner spaces."""
    parts = line.strip().split(" ", 2)
    name = parts[0]
    if name in ("quit", "exit"):
        return None
    if name == "":
        return ""
    if name == "put" and len(parts) == 3:
        store.put(parts[1], parts[2])
        return "OK"
    if name == "get" and len(parts) >= 2:
        value = store.get(parts[1])
        return "(not found)" if value is None else value
    if name == "delete" and len(parts) >= 2:
        store.delete(parts[1])
        return "OK"
    if name == "scan":
        rows = [f"{r.key} = {r.value}" for r in store.scan().toLocalIterator()]
        return "\n".join(rows) if rows else "(empty)"
    if name in ("flush", "compact"):
        getattr(store, name)()
        return f"OK ({store.run_count()} runs)"
    return USAGE


def repl(store: KVStore, lines: Iterable[str] = (), out=None, err=None) -> int:
    """Commands until they end or quit; 1 after a read or write that failed, which ends the loop."""
    out, err = out or sys.stdout, err or sys.stderr
    for line in lines or sys.stdin:
        try:
            answer = run_command(store, line)
        except (OSError, PySparkException, Py4JJavaError) as e:
            print(f"ERROR: {e}", file=err)
            return 1
        if answer is None:
            break
        if answer:
            print(answer, file=out)
    return 0


def split_statements(text: str) -> list[str]:
    """Statements between semicolons; a semicolon inside quotes does not split."""
    out, cur, quote = [], "", ""
    for ch in text:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"`":
            quote = ch
        elif ch == ";":
            out.append(cur)
            cur = ""
            continue
        cur += ch
    return [s.strip() for s in [*out, cur] if s.strip()]


def render(columns: list[str], rows: list[list], expanded: bool = False) -> str:
    """Rows as an aligned table with their number, or a record each."""
    cells = [["NULL" if v is None else str(v) for v in r] for r in rows]
    if expanded:
        wide = max(map(len, columns), default=0)
        return "\n".join(line for i, r in enumerate(cells, 1) for line in (f"-[ RECORD {i} ]", *(f"{c:<{wide}} | {v}" for c, v in zip(columns, r, strict=True))))
    wide = [max(map(len, column)) for column in zip(columns, *cells, strict=True)]
    head = " | ".join(f"{c:^{w}}" for c, w in zip(columns, wide, strict=True))
    body = [" | ".join(f"{v:<{w}}" for v, w in zip(r, wide, strict=True)) for r in cells]
    return "\n".join([f" {head}", "-" + "-+-".join("-" * w for w in wide) + "-", *(f" {b}" for b in body), f"({len(rows)} row{'' if len(rows) == 1 else 's'})"])


def message(e: PySparkException) -> str:
    """An error in the words of the SQL shells people know."""
    kind, said = e.getCondition() or "", e.getMessageParameters() or {}
    bare = lambda name: said.get(name, "").replace("`", "").replace("'", "")
    if kind.startswith("TABLE_OR_VIEW_NOT_FOUND"):
        return f'relation "{bare("relationName")}" does not exist'
    if kind.startswith("UNRESOLVED_COLUMN"):
        return f'column "{bare("objectName")}" does not exist'
    if isinstance(e, ParseException):
        return f'syntax error at or near "{bare("error")}"' if "error" in said else f"syntax error: {e.getMessage()}"
    return e.getMessage() or str(e)


class SqlSession:
    """Statements and `\\` commands over a Spark session, and over a store where there is one."""

    def __init__(self, spark: SparkSession, store: KVStore | None = None, out=None, err=None):
        self.spark, self.store, self.out, self.err = spark, store, out or sys.stdout, err or sys.stderr
        self.timing, self.expanded, self.done = False, False, False
        self.commands: dict[str, tuple[str, Callable]] = {
            "\\l": ("list databases", lambda _: self._show(self.spark.sql("SHOW DATABASES"))),
            "\\dt": ("list tables", lambda _: self._show(self.spark.sql("SHOW TABLES"))),
            "\\d": ("describe a table, or list tables", lambda t: self._show(self.spark.sql(f"DESCRIBE TABLE {t}" if t else "SHOW TABLES"))),
            "\\du": ("the session's user", lambda _: self._show(self.spark.sql("SELECT current_user() AS role"))),
            "\\dn": ("the session's executors", lambda _: self._nodes()),
            "\\dr": ("runs of the store", lambda _: self._storage()),
            "\\timing": ("toggle query timing", lambda _: self._toggle("timing", "Timing")),
            "\\x": ("toggle expanded output", lambda _: self._toggle("expanded", "Expanded display")),
            "\\conninfo": ("about the session", lambda _: self._say(f"Spark {self.spark.version} at {self.spark.conf.get('spark.master', 'unknown')}, store {self.store.path if self.store else 'none'}.")),
            "\\?": ("this help", lambda _: self._say("\n".join(f"  {c:<10} {what}" for c, (what, _f) in self.commands.items()))),
            "\\q": ("quit", lambda _: setattr(self, "done", True)),
        }

    def _say(self, text: str) -> None:
        print(text, file=self.out)

    def _fail(self, text: str) -> int:
        print(f"ERROR: {text}", file=self.err)
        return 1

    def _show(self, df: DataFrame) -> None:
        self._say(render(df.columns, [list(r) for r in df.toLocalIterator()], self.expanded))

    def _toggle(self, name: str, title: str) -> None:
        setattr(self, name, not getattr(self, name))
        self._say(f"{title} is {'on' if getattr(self, name) else 'off'}.")

    def _nodes(self) -> None:
        found = self.spark.sparkContext._jsc.sc().getExecutorMemoryStatus().keySet().mkString(",")
        self._say(render(["node"], [[n] for n in sorted(found.split(","))], self.expanded))

    def _storage(self) -> None:
        if self.store is None:
            self._say("no store is open")
        else:
            self._say(f"memtable: {len(self.store._mem)} entries, {self.store._bytes} of {self.store.capacity} bytes")
            self._show(self.store.storage())

    def execute(self, text: str) -> int:
        """One statement or command: 0, or 1 after an error."""
        text, began = text.strip().rstrip(";").strip(), time.time()
        if not text:
            return 0
        try:
            if text.startswith("\\"):
                name, _, rest = text.partition(" ")
                if name not in self.commands:
                    return self._fail(f"invalid command {name}, try \\?")
                self.commands[name][1](rest.strip())
                return 0
            df = self.spark.sql(text)
            if re.match(r"insert\b", text, re.I):
                self._say(f"INSERT 0 {_inserted(df)}")
            elif re.match(r"explain\b", text, re.I):
                self._say(df.first()[0])
            elif df.columns:
                self._show(df)
            else:
                self._say("OK")
        except PySparkException as e:
            return self._fail(message(e))
        except (OSError, Py4JJavaError) as e:
            return self._fail(str(e))
        if self.timing:
            self._say(f"Time: {1000 * (time.time() - began):.2f} ms")
        return 0

    def run(self, lines: Iterable[str]) -> int:
        """Lines until they end or quit. A line that begins with a backslash is a command, others go on to a semicolon."""
        code, waiting = 0, ""
        for line in lines:
            if not waiting.strip() and line.lstrip().startswith("\\"):
                code |= self.execute(line)
            else:
                waiting += line
                if line.rstrip().endswith(";") and len(split_statements(waiting + "\0")) > len(split_statements(waiting)):
                    code |= self._all(waiting)
                    waiting = ""
            if self.done:
                return code
        return code | self._all(waiting)

    def _all(self, text: str) -> int:
        code = 0
        for statement in split_statements(text):
            code |= self.execute(statement)
        return code


def _inserted(df: DataFrame) -> int | str:
    """Rows that an INSERT wrote, as its plan counted them."""
    try:
        metrics = df._jdf.queryExecution().executedPlan().commandPhysicalPlan().metrics()
        return int(metrics.apply("numOutputRows").value())
    except Exception:  # a catalogue without that count
        return "?"


def run_sql(spark: SparkSession, text: str, out=None, err=None) -> int:
    """Run statements in turn; 0 when all succeeded, 1 after a query error."""
    return SqlSession(spark, None, out, err)._all(text)


def register(spark: SparkSession, folder: str) -> list[str]:
    """Views over the Parquet tables of a folder, named as their files."""
    names = []
    for file in sorted(os.listdir(folder)):
        name, ext = os.path.splitext(file)
        if ext == ".parquet":
            spark.read.parquet(os.path.join(folder, file)).createOrReplaceTempView(name)
            names.append(name)
    return names
