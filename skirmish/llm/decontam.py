"""Operator 2: benchmark decontamination by template windows.

Words are reduced to a template: numbers (digits or number words), names (capitalised inside a
sentence) and units become typed placeholders, other words lose case and outer punctuation. Windows of
``WINDOW`` template words are joined by hash with the windows of the benchmark items; items shorter
than that match as a whole, and items under three windows have windows of ``NARROW`` words as well, as
one changed word could break all the wider ones. Windows with fewer than ``LITERAL`` plain words are not specific and do
not count, on either side.

A window with capitals is indexed in up to three forms on both sides, so that neither layout nor case decides: with
NAME for capitalised words inside a sentence only; for all capitalised words, as a name may begin a sentence;
and for none. Where a capital begins a sentence it may be no name, so other values there are counted as
changed, but need not be consistent. Other names in a text without capitals are not recognised as names.

Hits of a document and an item on one diagonal (place in the document minus place in the item), or on
diagonals that follow each other by at most ``SHIFT`` words (inserted or removed ones), are one occurrence. It
counts when they cover at least ``NEED`` of the item's words (those in specific windows), or a run of ``RUN`` of
them or of half of them if that is less, but not under ``WINDOW``; and its slots must be consistent: wherever the item repeats a value, the document repeats its own value, so 3 ... 3 may become 7 ... 7
but not 7 ... 8. ``changed`` tells how many of the item's values were replaced: 0 is a verbatim copy, more a
re-parameterised question.

The benchmark's hashes filter the documents inside the scan while there are at most ``BOUND`` of them;
a larger benchmark takes an ordinary join of all windows instead. Both ways give the same rows.

Different texts under one item_id are all searched for, each by itself; equal rows count once. Different
texts under one doc_id are searched as one document's, equal rows change nothing.

A null text has no words; items with a null item_id or without a specific window match nothing; documents
with a null doc_id are never flagged.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skirmish.sources.staging import cut

from .words import Words, blocks, mix, ranges

WINDOW = 8
LITERAL = 3
NEED = 0.6
#: Width of the windows that items under three wide ones have besides.
NARROW = 5
#: Words between neighbouring diagonals of one occurrence.
SHIFT = 4
#: Words on end that make an occurrence by themselves.
RUN = 13
BOUND = 2_000_000

# Number words and units.
NUMBER_WORDS = frozenset(
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half quarter dozen".split()
)
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons pound pounds ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees celsius fahrenheit volt volts watt watts joule joules newton newtons".split()
)
NUMBER = re.compile(r"[$€£+-]?[0-9][0-9.,:/]*(?:%|st|nd|rd|th)?\Z")
OUTER = "\"'`()[]{}<>.,;:!?*_#~|"
PLAIN, VALUE, NAME, UNIT = 0, 1, 2, 3


class Templates:
    """Template classes of words, kept from block to block."""

    def __init__(self, most: int = 1 << 20):
        self.known: dict[int, tuple[int, int, int]] = {}
        self.most = most

    def _class(self, word: bytes) -> tuple[int, int, int]:
        """(hash of the plain form, kind, 2 if capitalised plus 1 if it ends a sentence)."""
        text = word.decode("utf-8", "replace")
        bare = text.strip(OUTER)
        low = bare.lower()
        kind = VALUE if NUMBER.match(bare) or low in NUMBER_WORDS else UNIT if low in UNITS else PLAIN
        ends = text.rstrip("\"'`)]}").endswith((".", "!", "?", ":"))
        capital = len(bare) > 1 and bare[0].isupper() and bare[1:].islower()
        return xxhash.xxh64_intdigest(low.encode()), kind, 2 * capital + ends

    def of(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By word: hash of the plain form, kind, and whether a capital says nothing there."""
        unique, at, back = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self.known.clear()
        out = np.zeros((3, len(unique)), np.uint64)
        for i, (h, w) in enumerate(zip(unique.tolist(), at.tolist(), strict=True)):
            found = self.known.get(h)
            if found is None:
                found = self.known[h] = self._class(words.data[words.start[w] : words.end[w]].tobytes())
            out[0, i], out[1, i], out[2, i] = found
        plain, kind, flags = out[0][back], out[1][back].astype(np.int64), out[2][back].astype(np.int64)
        # capitals at the start of a text, a line or a sentence say nothing
        broken = np.append(0, np.cumsum(words.data == 10))
        opens = np.ones(len(words), bool)
        opens[1:] = (words.row[1:] != words.row[:-1]) | (flags[:-1] & 1 == 1) | (broken[words.start[1:]] > broken[words.end[:-1]])
        capital = (kind == PLAIN) & (flags >= 2)
        return plain, np.where(capital & ~opens, NAME, kind), capital & opens


def _forms(kind: np.ndarray, soft: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Kinds of the words in each form, and the words at which the form differs from the first."""
    yield kind, None
    if soft.any():
        yield np.where(soft, NAME, kind), soft
    if (name := kind == NAME).any():
        yield np.where(name, PLAIN, kind), name


def _windows(window: int, literal: int, short: tuple[int, ...], wanted: np.ndarray | None, ids: str):
    """Windows of each text: id, place, width, hash, and the slots inside as (offset, value)."""
    narrow = min(NARROW, window)
    widths = sorted({window, narrow, *short}, reverse=True)
    seen = np.zeros(0, bool)
    if wanted is not None:  # most windows end at this table of the hashes' last bits
        seen = np.zeros(1 << max(16, min(26, int(len(wanted) * 16).bit_length())), bool)
        seen[(wanted & np.uint64(len(seen) - 1)).astype(np.int64)] = True

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in batches:
            names = np.asarray(batch.column(ids))
            for low, high, data, offsets in blocks(batch.column("text")):
                words = Words(data, offsets)
                if not len(words):
                    continue
                plain, first, soft = templates.of(words)
                for (kind, other), width in product(_forms(first, soft), widths):
                    words.replaced(np.where(kind == PLAIN, plain, mix(kind.astype(np.uint64))))
                    literals = np.append(0, np.cumsum(kind == PLAIN))
                    at, h = words.grams(width)
                    if other is not None:
                        others = np.append(0, np.cumsum(other))
                        keep = others[at + width] > others[at]
                        at, h = at[keep], h[keep]
                    if ids == "item_id" and width < window:  # whole short items, and narrow windows of items under three wide ones
                        n = np.diff(words.first)[words.row[at]]
                        keep = (n == width) | ((n >= window) & (n < 3 * window) & (width == narrow))
                        at, h = at[keep], h[keep]
                    keep = literals[at + width] - literals[at] >= min(literal, width)
                    if wanted is not None:
                        keep &= seen[(h & np.uint64(len(seen) - 1)).astype(np.int64)]
                        at, h = at[keep], h[keep]
                        slot = np.minimum(np.searchsorted(wanted, h), max(len(wanted) - 1, 0))
                        keep = (wanted[slot] == h) if len(wanted) else np.zeros(len(h), bool)
                    at, h = at[keep], h[keep]
                    if not len(at):
                        continue
                    owner, i = ranges(at, at + width)
                    is_slot = kind[i] != PLAIN
                    owner, i = owner[is_slot], i[is_slot]
                    bounds = pa.array(np.searchsorted(owner, np.arange(len(at) + 1)).astype(np.int32))
                    slots = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in ((i - at[owner]).astype(np.int32), plain[i].view(np.int64), soft[i])]
                    row = words.row[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[low + row]), pa.array((at - words.first[row]).astype(np.int32)), pa.array(np.full(len(at), width, np.int32)), pa.array(h.view(np.int64)), *slots],
                        [ids, "place", "width", "hash", "offset", "value", "soft"],
                    )

    return run


def _schema(ids: str) -> str:
    return f"{ids} long, place int, width int, hash long, offset array<int>, value array<long>, soft array<boolean>"


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literal: int = LITERAL, need: float = NEED, bound: int = BOUND, shift: int = SHIFT, enough: int = RUN) -> DataFrame:
    """(doc_id, item_id, place, share, slots, changed): the occurrences of items in documents."""
    texts = benchmark.select(F.col("item_id").cast("long").alias("named"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    # each text of an item is searched by itself, under a number of its own
    items = cut(texts.withColumn("item_id", F.monotonically_increasing_id()), "items")
    n = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    short = tuple(sorted(r.n for r in items.select(n.alias("n")).where(f"n > 0 AND n < {window}").distinct().collect()))  # under ``window`` values
    own = cut(items.select("item_id", "text").mapInArrow(_windows(window, literal, short, None, "item_id"), _schema("item_id")), "templates")
    hashes = own.select("hash").distinct()
    wanted = None
    if hashes.limit(bound + 1).count() <= bound:
        wanted = np.sort(np.array([r.hash for r in hashes.toLocalIterator()], np.int64).view(np.uint64))
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL")
    found = texts.mapInArrow(_windows(window, literal, short, wanted, "doc_id"), _schema("doc_id"))
    theirs = own.select("item_id", F.col("place").alias("item_place"), "width", "hash")
    hits = found.drop("width").join(theirs, "hash").withColumn("diagonal", F.col("place") - F.col("item_place"))
    hits = cut(hits.select("doc_id", "item_id", "diagonal", "item_place", "width", "offset", "value", "soft"), "hits")
    pair = ["doc_id", "item_id"]
    # neighbouring diagonals get one number
    along = Window.partitionBy(*pair).orderBy("diagonal")
    ahead = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > shift).cast("int"), F.lit(0))
    diagonals = hits.groupBy(*pair, "diagonal").agg(F.countDistinct("item_place").alias("n")).withColumn("ahead", ahead)
    diagonals = diagonals.withColumn("occurrence", F.sum("ahead").over(along)).drop("ahead")
    # where diagonals overlap, the one with more windows counts
    diagonals = diagonals.withColumn("rank", F.col("n") * (1 << 32) - F.col("diagonal"))
    hits = cut(hits.join(diagonals, [*pair, "diagonal"]), "hits")
    key = [*pair, "occurrence"]
    inside = F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("i")
    total = own.select("item_id", "place", inside).groupBy("item_id").agg(F.countDistinct(F.col("place") + F.col("i")).alias("words"))
    places = hits.select(*key, "item_place", inside).select(*key, (F.col("item_place") + F.col("i")).alias("at")).distinct()
    island = F.col("at") - F.row_number().over(Window.partitionBy(*key).orderBy("at"))
    runs = places.withColumn("island", island).groupBy(*key, "island").count()
    covered = runs.groupBy(*key).agg(F.sum("count").alias("covered"), F.max("count").alias("run")).join(total, "item_id")
    covered = covered.withColumn("share", F.col("covered") / F.col("words"))
    long = F.col("run") >= F.least(F.lit(enough), F.greatest(F.lit(window), F.floor(F.col("words") / 2)))
    covered = covered.where((F.col("share") >= need) | long)
    covered = covered.join(hits.groupBy(*key).agg(F.max_by("diagonal", "rank").alias("diagonal")), key)
    slot = F.explode(F.arrays_zip("offset", "value", "soft")).alias("s")
    asked = own.select("item_id", "place", slot).select("item_id", (F.col("place") + F.col("s.offset")).alias("at"), F.col("s.value").alias("said"), F.col("s.soft").alias("loose")).distinct()
    given = hits.select(*key, "item_place", "rank", slot).select(*key, "rank", (F.col("item_place") + F.col("s.offset")).alias("at"), F.col("s.value").alias("value"), "s.soft")
    given = given.groupBy(*key, "at").agg(F.max_by("value", "rank").alias("value"), F.max_by("soft", "rank").alias("soft"))
    filled = given.join(asked, ["item_id", "at"]).withColumn("firm", F.when(~F.col("soft") & ~F.col("loose"), F.col("value")))
    by_value = filled.groupBy(*key, "said").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.min("firm").alias("least"), F.max("firm").alias("most"), F.count(F.lit(1)).alias("n"))
    slots = by_value.groupBy(*key).agg(
        F.sum("n").alias("slots"), F.sum(((F.col("low") != F.col("said")) | (F.col("high") != F.col("said"))).cast("long")).alias("changed"), F.max((F.col("least") != F.col("most")).cast("int")).alias("clash")
    )
    out = covered.join(slots, key, "left").where("coalesce(clash, 0) = 0").join(items.select("item_id", "named"), "item_id")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", F.col("named").alias("item_id"), F.col("diagonal").cast("long").alias("place"), "share", F.coalesce("slots", zero).alias("slots"), F.coalesce("changed", zero).alias("changed"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` with all columns, without the documents that hold a benchmark item."""
    bad = matches(docs, benchmark, **how).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == bad["_bad"], "left_anti")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that it holds."""
    found = matches(docs, benchmark).groupBy("doc_id", "item_id")
    return found.agg(F.count(F.lit(1)).alias("occurrences"), F.min("place").alias("place"), F.max("share").alias("share"), F.min("changed").alias("changed"))


def brute(docs: dict[int, str | None], items: dict[int, str | None]) -> set[tuple[int, int]]:
    """Whole-template search word by word, for tests: (doc_id, item_id) of items that occur in full with consistent slots."""

    def template(text: str | None) -> tuple[list, list]:
        t, shape, plain, opens = Templates(), [], [], True
        for line in (text or "").split("\n"):
            opens = True
            for word in re.findall(r"[^\x20\x09-\x0D]+", line):
                h, kind, flags = t._class(word.encode())
                if kind == PLAIN and flags >= 2 and not opens:
                    kind = NAME
                shape.append((kind, h if kind == PLAIN else 0))
                plain.append(h)
                opens = flags & 1 == 1
        return shape, plain

    out = set()
    known = {i: template(x) for i, x in items.items()}
    for d, text in docs.items():
        shape, plain = template(text)
        for i, (want, said) in known.items():
            for a in range(len(shape) - len(want) + 1) if want else ():
                if shape[a : a + len(want)] == want:
                    given: dict = {}
                    if all(given.setdefault(s, plain[a + j]) == plain[a + j] for j, (s, (k, _)) in enumerate(zip(said, want, strict=True)) if k != PLAIN):
                        out.add((d, i))
                        break
    return out
