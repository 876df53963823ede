"""Tables of a stream's state, switched from one micro-batch to the next by a single pointer.

A batch reads the tables that the pointer of the batch before names, writes new folders beside them, and then its own
pointer, a small file that is put in place by a rename. Whatever a lost attempt left behind is in no pointer, so a batch may
be repeated at any point. Two pointers are kept, as the last batch may run again; folders that neither names are
deleted.

A table is either replaced as a whole (open fights, kept heals), or grows: then every batch adds one folder, and ``FANOUT``
folders of one level are merged into one of the next level, so a table of N batches has at most FANOUT x log N folders and
each row is rewritten log N times.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

FANOUT = 8
KEPT = 2


@dataclass
class Pointer:
    """The folders of each table by level, as of the end of a batch, and a note of the sink's settings."""

    batch: int = -1
    tables: dict[str, list[list]] = field(default_factory=dict)
    note: str = ""

    def folders(self) -> set[str]:
        return {path for entries in self.tables.values() for _, path in entries}


class StateTables:
    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder.rstrip("/"), fanout

    # -- files -------------------------------------------------------------

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def _delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    # -- pointers ----------------------------------------------------------

    def newest(self, before: int | None = None) -> Pointer:
        """The last complete pointer, or the last one of a batch under ``before``."""
        done = sorted(int(n[:-5]) for n in self._names("pointers") if n.endswith(".json"))
        done = [n for n in done if before is None or n < before]
        if not done:
            return Pointer()
        fs, p = self._at(f"pointers/{done[-1]}.json")
        stream = fs.open(p)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return Pointer(**json.loads(text))

    def commit(self, now: Pointer) -> None:
        """Put ``now`` in place, then delete what the last two pointers do not name."""
        fs, draft = self._at(f"pointers/{now.batch}-{uuid.uuid4().hex}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"batch": now.batch, "tables": now.tables, "note": now.note}).encode()))
        out.close()
        _, place = self._at(f"pointers/{now.batch}.json")
        fs.delete(place, False)
        fs.rename(draft, place)
        before = self.newest(now.batch)
        used = now.folders() | before.folders()
        for name in self._names("pointers"):
            if name not in (f"{now.batch}.json", f"{before.batch}.json"):
                self._delete(f"pointers/{name}")
        for table in set(self._names("")) - {"pointers"}:
            for name in self._names(table):
                if f"{table}/{name}" not in used:
                    self._delete(f"{table}/{name}")

    # -- tables ------------------------------------------------------------

    def read(self, pointer: Pointer, table: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{path}" for _, path in pointer.tables.get(table, [])]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _write(self, df: DataFrame, table: str) -> str:
        path = f"{table}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{path}")
        return path

    def replace(self, now: Pointer, table: str, df: DataFrame) -> None:
        now.tables[table] = [[0, self._write(df, table)]]

    def add(self, now: Pointer, table: str, df: DataFrame, merge: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """One more folder; full levels are merged, by ``merge`` if rows can be dropped then."""
        entries = [*now.tables.get(table, []), [0, self._write(df, table)]]
        schema = df.schema
        level = 0
        while len(full := [e for e in entries if e[0] == level]) >= self.fanout:
            rows = self.spark.read.schema(schema).parquet(*[f"{self.folder}/{path}" for _, path in full])
            merged = self._write(merge(rows) if merge else rows, table)
            entries = [e for e in entries if e[0] != level] + [[level + 1, merged]]
            level += 1
        now.tables[table] = entries
