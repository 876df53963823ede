"""Operator 3: removal of lines that are within a few edits of an earlier line.

A line is a ``\\n``-split piece of a text; lines under ``LEAST`` code points (blank lines, headings, single
words) say too little and always stay. A line goes when an earlier one (smaller doc_id, or same
document and smaller number) is equal or, for lines of ``NEAR`` code points at least, within
``EDITS`` edits. Lines are judged on the input, not on what is left.

Equal lines meet by a 128-bit hash; each distinct line goes on once, however many copies there are.
The edit join is a segment-partition join: a line of length n is cut in ``EDITS`` + 1 even segments, of
which one must occur unchanged in any line within ``EDITS`` edits, and the place where it may occur is
known up to the number of edits and the difference of the lengths. Keys are (length, segment
number, content). Rows of one key are streamed in sorted order with the indexed lines first; a
62-bit parity signature of character pairs, of which an edit changes four bits at most, discards most
pairs without emitting them. A key that more than ``HOT`` indexed lines share (template lines) is only passed on by the task
that meets it: its rows are numbered in blocks of ``HOT``, and each pair of blocks is compared as a group of its own,
so that the work of a key spreads over many tasks of bounded memory. The rest is verified on the texts by a banded
bit-parallel automaton.

Documents with a null doc_id stay as they are. A null text has no lines. Rows with one doc_id and equal texts are one document;
different texts under one doc_id are judged in the order of their hashes (``shared_ids``). Lines and texts may have any length:
a line is hashed and cut as a whole, a text goes through in one block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.sources.staging import cut

from . import packing
from .shared_ids import bases, with_base
from .shared_ids import lines as line_count
from .words import BASE, STEP, blocks, mix, powers, ranges

EDITS = 2
LEAST = 20
NEAR = 30
#: Indexed lines of a key that are compared with streamed ones at a time.
TILE = 1 << 14
#: Indexed lines of a key up to which one task compares them with all its rows; also the rows of a block of a key with more.
HOT = 1 << 14


class Lines:
    """Lines of several texts as code points: row, number in the row, start, stop."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        text = data.tobytes().decode("utf-8", "replace")
        self.code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        at = lead[offsets]
        breaks = np.flatnonzero(self.code == 10)
        n = len(offsets) - 1
        row = np.concatenate([np.arange(n), np.searchsorted(at, breaks, "right") - 1])
        start = np.concatenate([at[:-1], breaks + 1])
        order = np.lexsort((start, row))
        self.row, self.start = row[order], start[order]
        last = np.append(self.row[1:] != self.row[:-1], True) if len(row) else np.zeros(0, bool)
        following = np.append(self.start[1:], len(self.code))
        self.stop = np.where(last, at[self.row + 1], following - 1)
        self.first = np.searchsorted(self.row, np.arange(n + 1))
        self.number = np.arange(len(self.row)) - self.first[self.row]
        self._sums = {}

    def hashes(self, start: np.ndarray, stop: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
        """64-bit hashes of the code points start..stop."""
        up, down = powers(base, len(self.code) + 1)
        if base not in self._sums:
            sums = np.zeros(len(self.code) + 1, np.uint64)
            np.cumsum((self.code.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
            self._sums[base] = sums
        sums = self._sums[base]
        return mix((sums[stop] - sums[start]) * down[start])

    def signatures(self, lines: np.ndarray) -> np.ndarray:
        """Parities of the pairs of neighbouring characters, 62 bits."""
        code = self.code.astype(np.uint64)
        pair = mix(code[:-1] * STEP + code[1:]) % np.uint64(62) if len(code) > 1 else np.zeros(0, np.uint64)
        bits = np.left_shift(np.uint64(1), pair)
        run = np.zeros(len(bits) + 1, np.uint64)
        np.bitwise_xor.accumulate(bits, out=run[1:]) if len(bits) else None
        a = self.start[lines]
        b = np.maximum(self.stop[lines] - 1, a)
        return run[np.minimum(b, len(bits))] ^ run[np.minimum(a, len(bits))]


def segments(length: np.ndarray, parts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, length) of each of the even segments; the last ones take the remainder."""
    small = length // parts
    longer = length - small * parts
    out, at = [], np.zeros_like(length)
    for i in range(parts):
        size = small + (i >= parts - longer)
        out.append((at, size))
        at = at + size
    return out


def _occurrences(least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            base = np.asarray(batch.column("base")).astype(np.int64)
            parts = []
            for low, _, data, offsets in blocks(batch.column("text")):
                lines = Lines(data, offsets)
                keep = np.flatnonzero(lines.stop - lines.start >= least)
                a, b = lines.start[keep], lines.stop[keep]
                parts.append((lines.hashes(a, b), lines.hashes(a, b, STEP), b - a, ids[low + lines.row[keep]], lines.number[keep] + base[low + lines.row[keep]]))
            if parts:
                one, two, size, doc, number = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(doc), pa.array(number.astype(np.int32)), pa.array(size.astype(np.int32))],
                    ["one", "two", "doc_id", "line", "size"],
                )

    return run


def _keys(edits: int, near: int):
    """Index and probe keys of the lines listed for each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("lines")
            begin, flat = np.asarray(listed.offsets), np.asarray(listed.values)
            base = np.asarray(batch.column("base")).astype(np.int64)
            for low, high, data, offsets in packing.blocks(batch.column("text")):
                lines = Lines(data, offsets)
                owner, i = ranges(begin[low:high], begin[low + 1 : high + 1])
                number = flat[i].astype(np.int64) - base[low + owner]
                fits = (number >= 0) & (number < np.diff(lines.first)[owner])
                at = np.unique(lines.first[owner[fits]] + number[fits])
                size = lines.stop[at] - lines.start[at]
                at, size = at[size >= near], size[size >= near]
                start, own, sign = lines.start[at], lines.hashes(lines.start[at], lines.stop[at]), lines.signatures(at)
                keys, ids, signs = [], [], []

                def add(which: np.ndarray, shorter: np.ndarray, part: int, place: np.ndarray, length: np.ndarray, probe: int) -> None:
                    a = start[which] + place
                    salt = mix(shorter.astype(np.uint64) * np.uint64(64) + np.uint64(part))
                    keys.append(mix(lines.hashes(a, a + length) ^ salt))
                    ids.append(own[which])
                    signs.append((sign[which] << np.uint64(1)) | np.uint64(probe))

                every = np.arange(len(at))
                for less in range(edits + 1):
                    for part, (place, length) in enumerate(segments(size - less, edits + 1)):
                        if less == 0:
                            add(every, size, part, place, length, 0)
                        low_ = max(-part, less - (edits - part))
                        high_ = min(part, less + (edits - part))
                        for shift in range(low_, high_ + 1):
                            moved = place + shift
                            ok = (moved >= 0) & (moved + length <= size)
                            # an unmoved segment of an equal length is the index key itself
                            if (less or shift) and ok.any():
                                which = every[ok]
                                add(which, (size - less)[ok], part, moved[ok], length[ok], 1)
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(x).view(np.int64)) for x in (keys, ids, signs)], ["key", "id", "sign"]
                    )

    return run


def _close(edits: int, id_a: np.ndarray, sign_a: np.ndarray, id_b: np.ndarray, sign_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two sets of lines whose signatures (above the probe bit) are close."""
    a, b = [], []
    sign_a, sign_b = sign_a >> np.uint64(1), sign_b >> np.uint64(1)
    step = max(1, (1 << 22) // max(1, min(TILE, len(id_a))))
    for i in range(0, len(id_a), TILE):
        for j in range(0, len(id_b), step):
            near = np.bitwise_count(sign_a[i : i + TILE, None] ^ sign_b[None, j : j + step]) <= 4 * edits
            x, y = np.nonzero(near)
            a.append(id_a[i : i + TILE][x])
            b.append(id_b[j : j + step][y])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64),) * 2


def _ordered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each unequal pair once, the smaller id first."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    both = np.unique(np.stack([low, high], 1)[low != high], axis=0) if len(low) else np.zeros((0, 2), np.uint64)
    return tuple(both[:, k].copy().view(np.int64) for k in (0, 1))


CANDIDATES = "a long, b long, key long, block int"


def _candidates(edits: int, hot: int):
    """Rows sorted by key, index rows first, to pairs of ids with close signatures.

    Rows of a key with more than ``hot`` index rows come out as they are: id, sign, key and number of their block.
    """

    def found(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        a, b = _ordered(a, b)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32())], ["a", "b", "key", "block"])

    def passed(key: np.ndarray, id_: np.ndarray, sign: np.ndarray, first: int) -> pa.RecordBatch:
        block = (np.arange(first, first + len(key)) // hot).astype(np.int32)
        return pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (id_, sign, key)), pa.array(block)], ["a", "b", "key", "block"])

    def solve(key: np.ndarray, id_: np.ndarray, sign: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole groups."""
        if not len(key):
            return
        probe = (sign & np.uint64(1)).astype(bool)
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(head, len(key)))
        n_index = np.add.reduceat((~probe).astype(np.int64), head)
        # groups of one indexed line: all rows meet it
        single = (size > 1) & (n_index == 1)
        owner, at = ranges(head[single] + 1, head[single] + size[single])
        first = head[single][owner]
        close = np.bitwise_count((sign[first] ^ sign[at]) >> np.uint64(1)) <= 4 * edits
        out = [(id_[first][close], id_[at][close])]
        for h, n, k in zip(*(x[n_index > 1] for x in (head, size, n_index)), strict=True):
            if k > hot:
                yield passed(key[h : h + n], id_[h : h + n], sign[h : h + n], 0)
            else:
                out.append(_close(edits, id_[h : h + k], sign[h : h + k], id_[h : h + n], sign[h : h + n]))
        yield found(*(np.concatenate(x) for x in zip(*out, strict=True)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.uint64)] * 3
        passing, number = None, 0  # the key whose rows go on unseen, and how many have gone
        for batch in batches:
            new = [np.asarray(batch.column(c)).view(np.uint64) for c in ("key", "id", "sign")]
            if passing is not None and len(new[0]):
                same = int(np.searchsorted(new[0] != passing, True))
                if same:
                    yield passed(*(x[:same] for x in new), number)
                    number += same
                    new = [x[same:] for x in new]
                if len(new[0]):
                    passing = None
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            change = np.flatnonzero(held[0][1:] != held[0][:-1])
            if len(change):
                done = change[-1] + 1
                yield from solve(*(x[:done] for x in held))
                held = [x[done:] for x in held]
            n = len(held[0])
            if n > hot:  # one unfinished group; its index rows come first
                index = int(np.searchsorted(held[2] & np.uint64(1), 1))
                if index > hot:
                    yield passed(*held, 0)
                    passing, number = held[0][0], n
                    held = [x[:0] for x in held]
                elif index < n:
                    yield found(*_close(edits, *(x[:index] for x in held[1:]), *(x[index:] for x in held[1:])))
                    held = [x[:index] for x in held]
        yield from solve(*held)

    return run


def _cells(edits: int):
    """Rows sorted by cell (key, i, j) and side to pairs of ids with close signatures between the sides."""

    def solve(cell: list[np.ndarray]) -> pa.RecordBatch:
        side, id_, sign = cell[3], cell[4].view(np.uint64), cell[5].view(np.uint64)
        head = np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in cell[:3]], axis=0)))
        out = [(np.zeros(0, np.uint64),) * 2]
        for h, stop in zip(head, np.append(head[1:], len(side)), strict=True):
            m = h + int(np.searchsorted(side[h:stop], 1))
            out.append(_close(edits, id_[h:m], sign[h:m], id_[m:stop], sign[m:stop]))
        a, b = _ordered(*(np.concatenate(x) for x in zip(*out, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [np.asarray(batch.column(c)) for c in ("key", "i", "j", "side", "id", "sign")]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in held[:3]], axis=0))
            if len(change):
                done = change[-1] + 1
                yield solve([x[:done] for x in held])
                held = [x[done:] for x in held]
        if held is not None and len(held[0]):
            yield solve(held)

    return run


def _pairs(keys: DataFrame, edits: int, hot: int) -> DataFrame:
    """(a, b): lines with a key in common and close signatures."""
    # key and probe bit in one number, which Spark sorts by radix; the key's first bit is given up for it
    placed = keys.select(F.shiftleft("key", 1).bitwiseOR(F.col("sign").bitwiseAND(F.lit(1))).alias("place"), "id", "sign")
    key = F.shiftright("place", 1).alias("key")
    dealt = placed.repartition(F.shiftright("place", 1)).sortWithinPartitions("place").select(key, "id", "sign")
    found = cut(dealt.mapInArrow(_candidates(edits, hot), CANDIDATES), "met")
    pairs = found.where("block IS NULL").select("a", "b")
    rows = found.where("block IS NOT NULL").select("key", "block", F.col("a").alias("id"), F.col("b").alias("sign"))
    if not rows.isEmpty():
        index = F.col("sign").bitwiseAND(F.lit(1)) == 0
        per = rows.groupBy("key").agg(F.max("block").alias("last"), F.max(F.when(index, F.col("block"))).alias("last_index"))
        rows = rows.join(per, "key")
        # an index row meets the blocks from its own on, as probe rows lie behind all index rows
        one = rows.where(index).select("key", F.col("block").alias("i"), F.explode(F.sequence("block", "last")).alias("j"), F.lit(0).alias("side"), "id", "sign")
        two = rows.select("key", F.explode(F.sequence(F.lit(0), F.least("block", "last_index"))).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "id", "sign")
        spark = keys.sparkSession
        # a cell is little data and much work: a stated number of partitions is not merged by size
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        cells = one.unionByName(two).repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
        pairs = pairs.unionByName(cells.mapInArrow(_cells(edits), "a long, b long"))
    return cut(pairs.distinct(), "candidates")


def within(a: str, b: str, edits: int) -> bool:
    """Whether two lines are within ``edits`` edits.

    State e is a bit vector over the diagonals -edits..edits: those reached with e edits after the
    characters of ``a`` so far.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    stop = min(len(a), len(b))
    same = 0
    while same < stop and a[same] == b[same]:
        same += 1
    a, b, stop = a[same:], b[same:], stop - same
    same = 0
    while same < stop and a[-1 - same] == b[-1 - same]:
        same += 1
    a, b = a[: len(a) - same], b[: len(b) - same]
    width = 2 * edits + 1
    full = (1 << width) - 1
    state = [0] * (edits + 1)
    for e in range(edits + 1):
        state[e] = (1 << edits) | (state[e - 1] << 1 & full if e else 0)
    for i, c in enumerate(a):
        equal = 0
        for d in range(width):
            j = i + d - edits
            if 0 <= j < len(b) and b[j] == c:
                equal |= 1 << d
        old, state = state, [state[0] & equal]
        for e in range(1, edits + 1):
            state.append((old[e] & equal) | old[e - 1] | (old[e - 1] >> 1) | (state[e - 1] << 1 & full))
        if not state[edits]:
            return False
    at = len(b) - len(a) + edits
    return any(s >> at & 1 for s in state)


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines asked for, by id."""
    for batch in batches:
        ids, found = [], []
        for text, asked, base in zip(packing.unpack(batch.column("text").to_pylist()), *(batch.column(c).to_pylist() for c in ("asked", "base")), strict=True):
            lines = text.decode("utf-8", "replace").split("\n")
            for x in asked:
                if 0 <= x["line"] - base < len(lines):
                    ids.append(x["id"])
                    found.append(lines[x["line"] - base])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["id", "line_text"])


def _verify(edits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [within(x, y, edits) for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _bases(docs: DataFrame) -> DataFrame | None:
    return bases(docs, line_count)


def _placed(docs: DataFrame, found: DataFrame | None) -> DataFrame:
    """(doc_id, text, base) of the rows with a doc_id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).where("doc_id IS NOT NULL")
    return with_base(texts, found, "doc_id", "text")


def near_lines(texts: DataFrame, edits: int = EDITS, least: int = LEAST, near: int = NEAR, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of texts with their bases: all lines of ``least`` code points (doc_id, line, id), the first place of each distinct one, and its close pairs (a, b)."""
    if least <= edits or near <= edits:
        raise ValueError("lines must be longer than the number of edits")
    lines = cut(texts.mapInArrow(_occurrences(least), "one long, two long, doc_id long, line int, size int"), "lines")
    distinct = cut(lines.groupBy("one", "two").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.max("size").alias("size")), "distinct")
    first = distinct.select(F.col("one").alias("id"), "first.doc_id", "first.line", "size")
    packed = packing.pack(texts)
    listed = first.where(F.col("size") >= near).groupBy("doc_id").agg(F.collect_list("line").alias("lines"))
    keys = packed.join(listed, "doc_id").select("text", "base", "lines").mapInArrow(_keys(edits, near), "key long, id long, sign long")
    pairs = _pairs(keys, edits, hot)
    need = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(first, "id")
    asked = need.groupBy("doc_id").agg(F.collect_list(F.struct("line", "id")).alias("asked"))
    spelled = cut(packed.join(asked, "doc_id").select("text", "base", "asked").mapInArrow(_texts, "id long, line_text string").dropDuplicates(["id"]), "texts")
    both = pairs.join(spelled.select(F.col("id").alias("a"), F.col("line_text").alias("text_a")), "a").join(spelled.select(F.col("id").alias("b"), F.col("line_text").alias("text_b")), "b")
    return lines, distinct, cut(both.mapInArrow(_verify(edits), "a long, b long"), "close")


def removed_lines(texts: DataFrame, edits: int = EDITS, least: int = LEAST, near: int = NEAR, hot: int = HOT) -> DataFrame:
    """(doc_id, line): the lines that an earlier one makes redundant, by number from the base of their text."""
    lines, distinct, close = near_lines(texts, edits, least, near, hot)
    copies = lines.join(distinct, ["one", "two"]).where(F.struct(lines.doc_id, lines.line) != F.col("first")).select(lines.doc_id, lines.line)
    where = distinct.select(F.col("one").alias("id"), "first")
    placed = close.join(where.select(F.col("id").alias("a"), F.col("first").alias("at_a")), "a").join(where.select(F.col("id").alias("b"), F.col("first").alias("at_b")), "b")
    later = placed.select(F.greatest("at_a", "at_b").alias("at")).select("at.doc_id", "at.line")
    return copies.unionByName(later).distinct()


def _drop(at: int):
    """Takes the lines listed in the last column out of the texts in column ``at``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            out = []
            for text, gone in zip(texts.to_pylist(), batch.columns[-1].to_pylist(), strict=True):
                if text is not None and gone:
                    drop = set(gone)
                    text = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in drop)
                out.append(text)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(out, texts.type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return run


def _own(gone: str) -> Column:
    """A text's own part of the line numbers under its doc_id; numbers beyond its end are dropped with the text at hand."""
    return F.filter(F.transform(gone, lambda x: x - F.col("_base")), lambda x: x >= 0)


def dedup(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with all columns, the redundant lines taken out of ``text``."""
    found = _bases(docs)
    gone = removed_lines(_placed(docs, found), **how).groupBy("doc_id").agg(F.collect_list("line").alias("gone")).select(F.col("doc_id").alias("doc"), "gone")
    # columns by number, so that no name of a caller's column can clash
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    key = f"c{docs.columns.index('doc_id')}"
    named = with_base(named, found, key, f"c{docs.columns.index('text')}", "_base")
    joined = named.join(gone, F.col(key).cast("long") == F.col("doc"), "left").withColumn("gone", _own("gone")).drop("doc", "_base")
    kept = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    return joined.mapInArrow(_drop(docs.columns.index("text")), kept).toDF(*docs.columns)


def digest(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed (line numbers from 0)."""
    found = _bases(docs)
    gone = removed_lines(_placed(docs, found), **how).groupBy("doc_id").agg(F.array_sort(F.collect_list("line")).alias("removed"))
    texts = with_base(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")), found, "doc_id", "text", "_base")
    rows = texts.select("doc_id", "_base", F.coalesce(line_count(F.col("text")), F.lit(0)).cast("long").alias("n_lines")).join(gone, "doc_id", "left")
    removed = F.coalesce(F.filter(_own("removed"), lambda x: x < F.col("n_lines")), F.array().cast("array<int>"))
    return rows.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def brute(docs: dict[int, str | None], edits: int = EDITS, least: int = LEAST, near: int = NEAR) -> dict[int, list[int]]:
    """The rule itself, for tests: every line against all earlier ones, by the full table of distances."""

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    seen: dict[str, None] = {}
    out = {}
    for d in sorted(docs):
        out[d] = []
        for i, line in enumerate(docs[d].split("\n") if docs[d] is not None else []):
            if len(line) >= least:
                close = line in seen or (len(line) >= near and any(len(o) >= near and abs(len(o) - len(line)) <= edits and distance(line, o) <= edits for o in seen))
                if close:
                    out[d].append(i)
                seen[line] = None
    return out
