"""Lineage cuts: intermediate tables written once to the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


_local: dict[str, str] = {}


def staging_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or the one set on the context.

    Only a local session without either gets a folder of its own.
    """
    folder = spark.conf.get(KEY, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {KEY} to a folder that all executors share")
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        folder = _local[app]
    return folder.rstrip("/")


class _Owners(threading.local):
    """Paths of the tables cut inside each open ``owned`` block of the current thread."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_owners = _Owners()


@contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """Delete the tables cut inside the block by the same thread at its end, also after an error.

    For jobs that write their result themselves: a DataFrame that still reads a cut table must not
    leave the block.
    """
    _owners.open.append([])
    try:
        yield
    finally:
        for path in _owners.open.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table and go on from the files.

    A result used by several branches is computed once, later plans stay small, column pruning and
    pushdown work on the files, and a lost executor costs a re-read instead of a recomputation.
    """
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/skirmish/{name}-{uuid.uuid4().hex}"
    if _owners.open:
        _owners.open[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
