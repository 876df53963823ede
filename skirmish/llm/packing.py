"""Texts as zstandard frames for the way through a shuffle, where the cluster's block codec saves less."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .words import BLOCK


def _pack(column: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3, write_checksum=False)
        for batch in batches:
            texts = batch.column(column).cast(pa.large_binary())
            packed = pa.array([None if not x.is_valid else small.compress(x.as_buffer()) for x in texts], pa.binary())
            at = batch.schema.get_field_index(column)
            yield pa.RecordBatch.from_arrays([packed if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return run


def pack(rows: DataFrame, column: str = "text") -> DataFrame:
    """``rows`` with the text column as compressed binary; nulls stay."""
    fields = ", ".join(f"`{f.name}` {'binary' if f.name == column else f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_pack(column), fields)


def unpack(values: Iterable[bytes | None]) -> Iterator[bytes]:
    """The texts' bytes; a null is empty."""
    open_ = zstandard.ZstdDecompressor()
    for v in values:
        yield b"" if v is None else open_.decompress(v)


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As ``words.blocks``, from a packed column."""
    low, held, total = 0, [], 0
    for i, text in enumerate(unpack(column.to_pylist())):
        held.append(text)
        total += len(text)
        if total >= size or i + 1 == len(column):
            offsets = np.zeros(len(held) + 1, np.int64)
            np.cumsum([len(t) for t in held], out=offsets[1:])
            yield low, i + 1, np.frombuffer(b"".join(held), np.uint8), offsets
            low, held, total = i + 1, [], 0
