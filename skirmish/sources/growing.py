"""Logs that grow, as a data source: batch scan and stream by byte offsets.

Format ``growing_logs``, columns ``log_id``, ``ord`` (byte offset of the line's start) and ``raw`` (Latin-1). A stream's offset is the
place behind the last complete line of every file, so a line that is still being written waits for its end, wherever
the writer stopped. A batch of a stream, and a scan, are cut in byte ranges of ``splitBytes``; a line belongs to the range in
which it starts, so one large log is read by many tasks, and a restart reads exactly the bytes behind the checkpoint's offset.

Files are reached through ``pyarrow.fs`` (local, hdfs, s3, gcs). Lines end at ``\\n`` only. A scan also gives a last line without
an end. A file that is shorter than what has been read of it was replaced, which is an error. The offset has one
entry for each file.

Small ranges share a task: a batch has about ``TASKS`` tasks, more only where one would read over 64 MiB, so many short logs do not
make as many tasks.

Options: ``path`` (a folder), ``glob`` (names, default ``*``), ``splitBytes`` (default 64 MiB), ``startAtEnd`` (``true``: a new stream
skips what is there).
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "growing_logs"
SCHEMA = "log_id string, ord long, raw string"
SPLIT_BYTES = 64 << 20
READ_BYTES = 1 << 20
#: Tasks of a batch, unless one range makes one or a task would read over ``SPLIT_BYTES``.
TASKS = 256
NEWLINE = 10


@dataclass
class ByteRange:
    """Lines that start in start..stop; ``aligned``: a line starts at ``start``; none reaches beyond ``end``."""

    name: str
    start: int
    stop: int
    end: int
    aligned: bool


@dataclass
class Share(InputPartition):
    """The ranges of one task."""

    ranges: list[ByteRange]


def dealt(ranges: list[ByteRange], tasks: int = TASKS) -> list[Share]:
    """``ranges`` in order, put together to about ``tasks`` shares of equal size; a range stays whole."""
    most = min(SPLIT_BYTES, sum(r.stop - r.start for r in ranges) // tasks)
    out, room = [], 0
    for r in ranges:
        size = r.stop - r.start
        if not out or size > room:
            out.append(Share([]))
            room = most
        out[-1].ranges.append(r)
        room -= size
    return out


def open_folder(path: str) -> tuple[arrow_fs.FileSystem, str]:
    fs, folder = arrow_fs.FileSystem.from_uri(path)
    return fs, folder.rstrip("/")


class Folder:
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("the option path names the folder of the logs")
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))

    def sizes(self) -> dict[str, int]:
        fs, folder = open_folder(self.path)
        files = fs.get_file_info(arrow_fs.FileSelector(folder))
        return {f.base_name: f.size for f in sorted(files, key=lambda f: f.base_name) if f.is_file and fnmatch.fnmatch(f.base_name, self.glob)}

    def last_line_end(self, name: str, known: int, size: int) -> int:
        """The place behind the last line end of the bytes known..size, read from the end."""
        fs, folder = open_folder(self.path)
        with fs.open_input_file(f"{folder}/{name}") as f:
            stop = size
            while stop > known:
                start = max(known, stop - READ_BYTES)
                at = f.read_at(stop - start, start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                stop = start
        return known

    def ranges(self, start: dict, end: dict) -> list[ByteRange]:
        out = []
        for name, stop in sorted(end.items()):
            first = int(start.get(name, 0))
            if stop < first:
                raise ValueError(f"{name} is shorter than what has been read of it")
            out += [ByteRange(name, at, min(at + self.split, stop), stop, at == first) for at in range(first, stop, self.split)]
        return out

    def lines(self, part: ByteRange | Share) -> Iterator[pa.RecordBatch]:
        """The lines of a range, or of a task's ranges, in batches of about ``READ_BYTES``."""
        fs, folder = open_folder(self.path)
        for one in [part] if isinstance(part, ByteRange) else part.ranges:
            yield from self._lines(one, fs, folder)

    def _lines(self, part: ByteRange, fs: arrow_fs.FileSystem, folder: str) -> Iterator[pa.RecordBatch]:
        with fs.open_input_file(f"{folder}/{part.name}") as f:
            at, held, skip = (part.start, b"", False) if part.aligned else (part.start - 1, b"", True)
            while at < part.stop:
                ahead = at + len(held)
                data = held + (f.read_at(min(READ_BYTES, part.end - ahead), ahead) if ahead < part.end else b"")
                whole = len(data) == len(held)  # the end, without a line end
                if skip:
                    here = data.find(b"\n")
                    if here < 0:
                        if whole:
                            return
                        at, held = ahead + len(data) - len(held), b""
                        continue
                    at, data, skip = at + here + 1, data[here + 1 :], False
                ends = np.flatnonzero(np.frombuffer(data, np.uint8) == NEWLINE)
                if whole and (not len(ends) or ends[-1] + 1 < len(data)):
                    ends = np.append(ends, len(data))
                begins = np.append(0, ends[:-1] + 1) if len(ends) else ends
                mine = int(np.searchsorted(begins, part.stop - at))
                if mine:
                    text = data[: ends[mine - 1]].decode("latin-1").split("\n")
                    yield pa.RecordBatch.from_arrays([pa.array([part.name] * mine, pa.string()), pa.array(begins[:mine] + at), pa.array(text, pa.string())], ["log_id", "ord", "raw"])
                if mine < len(ends) or whole:
                    return
                used = int(ends[-1]) + 1 if len(ends) else 0
                at, held = at + used, data[used:]


class Scan(DataSourceReader):
    def __init__(self, folder: Folder):
        self.folder = folder

    def partitions(self) -> list[Share]:
        return dealt(self.folder.ranges({}, self.folder.sizes())) or [Share([])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        yield from self.folder.lines(partition)


class Follow(DataSourceStreamReader):
    def __init__(self, folder: Folder, at_end: bool):
        self.folder, self.at_end = folder, at_end
        self.seen: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.at_end else {}

    def latestOffset(self) -> dict:
        """Files that did not change are not opened."""
        out = {}
        for name, size in self.folder.sizes().items():
            last, end = self.seen.get(name, (0, 0))
            if size < last:
                raise ValueError(f"{name} is shorter than what has been read of it")
            if size > last:
                end = self.folder.last_line_end(name, end, size)
            self.seen[name] = (size, end)
            out[name] = end
        return out

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return dealt(self.folder.ranges(start, end))

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        yield from self.folder.lines(partition)


class GrowingLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Scan(Folder(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Follow(Folder(self.options), str(self.options.get("startatend", self.options.get("startAtEnd", "false"))).lower() == "true")


def scan_logs(spark: SparkSession, path: str, **options) -> DataFrame:
    """Every line of the logs in a folder, by byte offset."""
    spark.dataSource.register(GrowingLogs)
    return spark.read.format(FORMAT).options(path=path, **options).load()


def follow_logs(spark: SparkSession, path: str, **options) -> DataFrame:
    """The lines of the logs in a folder as they are written."""
    spark.dataSource.register(GrowingLogs)
    return spark.readStream.format(FORMAT).options(path=path, **options).load()


def _append(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_folder(path)
        for batch in batches:
            names, pieces = batch.column("log_id").to_pylist(), batch.column("piece").to_pylist()
            low = 0
            while low < len(names):
                high = low
                while high < len(names) and names[high] == names[low]:
                    high += 1
                with fs.open_append_stream(f"{folder}/{names[low]}") as out:
                    out.write("".join(pieces[low:high]).encode("latin-1"))
                low = high
            yield pa.RecordBatch.from_arrays([pa.array([len(names)], pa.int64())], ["pieces"])

    return run


def write_in_steps(lines: DataFrame, path: str, steps: int) -> Iterator[int]:
    """Stands in for a game that writes its logs: appends ``lines`` (log_id, ord, raw) to one file for each log, by steps.

    Every step but the last ends in the middle of a line of each log that is long enough.
    """
    fs, folder = open_folder(path)
    fs.create_dir(folder)
    at = [i / steps for i in range(1, steps)]
    cuts = lines.groupBy("log_id").agg(F.percentile_approx("ord", at, 10_000).alias("cuts")) if at else None
    pieces = F.array(
        F.struct((F.col("ord") * 2).alias("place"), F.expr("left(raw, cast(length(raw) / 2 as int))").alias("piece")),
        F.struct((F.col("ord") * 2 + 1).alias("place"), F.concat(F.expr("substring(raw, cast(length(raw) / 2 as int) + 1)"), F.lit("\n")).alias("piece")),
    )
    rows = lines.select("log_id", F.explode(pieces).alias("p")).select("log_id", "p.place", "p.piece")
    if cuts is None:
        rows = rows.withColumn("step", F.lit(0))
    else:
        rows = rows.join(cuts, "log_id").withColumn("step", F.size(F.filter("cuts", lambda c: F.col("place") > c * 2))).drop("cuts")
    for step in range(steps):
        now = rows.where(F.col("step") == step).repartition("log_id").sortWithinPartitions("log_id", "place")
        yield int(now.select("log_id", "piece").mapInArrow(_append(path), "pieces long").agg(F.sum("pieces")).first()[0] or 0)


def staged_folder(folder: str) -> str:
    """A new folder below ``folder`` as a URI that tasks can open."""
    return f"{folder if '://' in folder or folder.startswith('file:') else 'file://' + folder}/skirmish/logs-{uuid.uuid4().hex}"
