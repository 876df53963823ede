"""Operator 4: Jaccard join on word shingles by token-combination prefixes.

A document's tokens are its distinct 5-word shingles (64-bit hashes, A-Z lower-cased); shorter texts
have one token, their whole word sequence. Documents with equal token sets are one *class*,
represented by its smallest doc_id; only representatives are joined.

Candidates. Tokens are ordered by hash, the same order for all documents. Two linked sets of size s
differ in at most d = floor(s (1 - t) / t) tokens, so the first d + 1 tokens of both contain a common
one. Of these prefixes at most ``PREFIX`` tokens are indexed; where that cuts a prefix short, the chance
that fewer than ``LEAST`` + ``LEAST`` - 1 of its tokens are common is under 1e-13.

* A token in at most ``RARE`` prefixes is *rare* and indexed by itself. Documents with a cut prefix must share
  ``LEAST`` rare tokens, others one.
* A pair that shares fewer rare tokens shares frequent ones. Documents with ``LEAST`` frequent prefix tokens
  (one, if the prefix is not cut) get the prefix extended to all their tokens, ordered anew by each of
  ``KEYED`` multiplicative hashes; the first tokens in ``TOGETHER`` orders are one combination key.
  All combinations of a linked pair differ with a chance of (1 - t**4)**64 = 2e-15. Two documents that only
  share a passage hardly ever share a combination.

Verification. Each key's documents are first compared with its smallest; links become components. A key
whose documents are then in one component needs no more, so a group of near copies costs one
comparison per member and key. Otherwise its pairs across components are candidates, unless their
sizes differ too much or, for combinations (a pair is taken at its first common one), two bits of the first token in each of ``ORDERS`` orders agree less often
than a linked pair's do with a chance of 1 - 1e-12. What is left is compared in full, so no link that
matters for a component is left out.

A null text or one without words has no tokens and no links. A null doc_id gets no component and
links nothing. Rows that repeat a doc_id with equal text are one document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.sources.staging import cut

from . import packing
from .components import components
from .words import STEP, Words, blocks, mix

SHINGLE = 5
PERCENT = 80
PREFIX = 40
RARE = 32
LEAST = 6
#: Orders of the tokens: the first KEYED make the combinations, all of them the symbols.
ORDERS = 1024
KEYED = 256
TOGETHER = 4
#: Symbols of two bits that may differ between linked documents: 0.15 of ORDERS and seven deviations.
DIFFER = 233
#: Members that are compared with one leader in a row; a larger group is spread over several tasks.
CHUNK = 512


def shingles(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct tokens of all texts, and where each text's begin."""
    at, h = words.grams(k)
    row = words.row[at]
    n = words.first[1:] - words.first[:-1]
    short = np.flatnonzero((n > 0) & (n < k))
    row = np.concatenate([row, short])
    h = np.concatenate([h, words.windows(words.first[short], words.first[short + 1])])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    row, h = row[new], h[new]
    return h, np.searchsorted(row, np.arange(len(n) + 1))


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, one, two, head = [], [], [], []
        for low, high, data, offsets in blocks(batch.column("text")):
            h, begin = shingles(Words(data, offsets, lower=True))
            size.append(np.diff(begin))
            for out, salt in ((one, np.uint64(1)), (two, STEP)):
                sums = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(mix(h ^ salt), out=sums[1:])
                out.append(sums[begin[1:]] - sums[begin[:-1]])
            head.extend(h[a : min(b, a + PREFIX)].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True))
        if size:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(size)), *(pa.array(np.concatenate(x).view(np.int64)) for x in (one, two)), pa.array(head, pa.binary())],
                ["doc_id", "n_shingles", "one", "two", "head"],
            )


def _differ(n: int, percent: int) -> int:
    return n * (100 - percent) // percent


def _prefixes(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key, full = [], [], []
            for d, n, head in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_shingles", "head")), strict=True):
                own = _differ(n, percent) + 1
                tokens = np.frombuffer(head, np.uint64)[:own]
                doc.append(np.full(len(tokens), d, np.int64))
                full.append(np.full(len(tokens), own <= PREFIX))
                key.append(tokens)
            if doc:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(doc)), pa.array(np.concatenate(full))], ["key", "doc", "whole"])

    return run


SIGNS = [f"s{i}" for i in range(2 * ORDERS // 64)]


def _combinations(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Combination keys, and two bits of the first token in each order."""
    factors = mix(np.arange(1, ORDERS + 1, dtype=np.uint64)) | np.uint64(1)
    salts = mix(np.arange(TOGETHER, dtype=np.uint64) + np.uint64(7))
    for batch in batches:
        ids = np.asarray(batch.column("doc_id"))
        for low, high, data, offsets in packing.blocks(batch.column("text")):
            h, begin = shingles(Words(data, offsets, lower=True))
            some = np.flatnonzero(np.diff(begin) > 0)
            if not len(some):
                continue
            first = np.stack([np.minimum.reduceat(h * f, begin[:-1][some]) for f in factors], 1)
            groups = first[:, :KEYED].reshape(len(some), -1, TOGETHER)
            keys = mix((mix(groups ^ salts)).sum(2, dtype=np.uint64) + np.arange(groups.shape[1], dtype=np.uint64))
            symbols = (mix(first) & np.uint64(3)).reshape(len(some), len(SIGNS), 32)
            signs = (symbols << (2 * np.arange(32, dtype=np.uint64))).sum(2, dtype=np.uint64).view(np.int64)
            bounds = pa.array(np.arange(len(some) + 1, dtype=np.int32) * keys.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[low + some]), pa.ListArray.from_arrays(bounds, pa.array(keys.reshape(-1).view(np.int64))), *(pa.array(signs[:, i].copy()) for i in range(len(SIGNS)))],
                ["doc", "keys", *SIGNS],
            )


def _shared(keys: DataFrame, name: str) -> DataFrame:
    """Rows of keys that several documents have, with their number and the smallest document."""
    many = keys.groupBy("key").agg(F.count(F.lit(1)).alias("df"), F.min("doc").alias("lead")).where("df > 1")
    return cut(keys.join(many, "key"), name)


def _mixed(rows: DataFrame, component: DataFrame) -> DataFrame:
    """Rows (with their component) of those keys that documents of several components have."""
    placed = cut(rows.join(component, "doc", "left").withColumn("component", F.coalesce("component", "doc")), "placed")
    split = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    return cut(placed.join(split, "key"), "mixed")


def _across(rows: DataFrame, percent: int, more: list[str], near=None) -> DataFrame:
    """Pairs (lead, doc) of rows with one key and different components, of sizes that may be similar."""
    other = rows.select("key", *[F.col(c).alias(f"{c}_") for c in ("doc", "component", "n_shingles", *more)])
    fits = (F.col("component") != F.col("component_")) & (F.col("doc") < F.col("doc_"))
    fits &= (F.col("n_shingles") * 100 >= F.col("n_shingles_") * percent) & (F.col("n_shingles_") * 100 >= F.col("n_shingles") * percent)
    if near is not None:
        fits &= near
    joined = rows.alias("x").join(other.alias("y"), (F.col("x.key") == F.col("y.key")) & fits)
    return joined.select(F.col("doc").alias("lead"), F.col("doc_").alias("doc"), *[F.col(c) for c in ("whole", "whole_") if c in joined.columns])


def _first_common():
    """Whether the rows' documents share no combination before this one, so that a pair comes once."""
    before = F.zip_with(F.slice("keys", 1, F.col("place")), F.slice("keys_", 1, F.col("place")), lambda a, b: a == b)
    return ~F.exists(before, lambda same: same)


def _close():
    """Whether the two-bit symbols of two rows differ in at most DIFFER places."""
    total = F.lit(0)
    for s in SIGNS:
        x = F.col(s).bitwiseXOR(F.col(f"{s}_"))
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return total <= DIFFER


def _verify(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, own = None, None
        for batch in batches:
            leads, chunks, docs, member = (batch.column(c).to_pylist() for c in ("lead", "chunk", "doc", "member"))
            a, b = [], []
            for low, high, data, offsets in packing.blocks(batch.column("text")):
                h, begin = shingles(Words(data, offsets, lower=True))
                for i in range(low, high):
                    mine = h[begin[i - low] : begin[i - low + 1]]
                    if not member[i]:
                        lead, own = (leads[i], chunks[i]), mine
                    elif lead == (leads[i], chunks[i]):
                        small, large = (mine, own) if len(mine) < len(own) else (own, mine)
                        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                        both = int((large[at] == small).sum()) if len(large) else 0
                        if both and 100 * both >= percent * (len(mine) + len(own) - both):
                            a.append(leads[i])
                            b.append(docs[i])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def verified(texts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (lead, doc) whose documents are similar, as (a, b).

    A leader's members are dealt in chunks of about CHUNK by hash; each chunk gets the leader's text.
    """
    n = pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("n"))
    members = pairs.join(n, "lead").select("lead", F.pmod(F.xxhash64("doc"), F.col("n")).cast("int").alias("chunk"), "doc", F.lit(1).alias("member"))
    leads = n.select("lead", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("chunk"), F.col("lead").alias("doc"), F.lit(0).alias("member"))
    need = members.unionByName(leads)
    sent = texts.withColumnRenamed("doc_id", "doc").join(need, "doc").select("lead", "chunk", "doc", "member", "text")
    dealt = sent.repartition("lead", "chunk").sortWithinPartitions("lead", "chunk", "member")
    return dealt.mapInArrow(_verify(percent), "a long, b long")


def classes(docs: DataFrame, percent: int = PERCENT, rare: int = RARE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    ``percent`` is ``PERCENT`` or more: below it the fixed values of this module would lose links, so that is an error.
    """
    if not PERCENT <= percent <= 100:
        raise ValueError(f"percent must be from {PERCENT} to 100")
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    sets = cut(texts.mapInArrow(_sets, "doc_id long, n_shingles long, one long, two long, head binary"), "sets")
    full = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = full.groupBy("n_shingles", "one", "two").agg(F.min("doc_id").alias("rep"))
    members = cut(full.select("doc_id", "n_shingles", "one", "two").join(same, ["n_shingles", "one", "two"]).select("doc_id", "n_shingles", "rep"), "members")
    reps = full.join(members.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi")
    reps = cut(reps.select("doc_id", "n_shingles", "head").dropDuplicates(["doc_id"]), "reps")
    size = reps.select(F.col("doc_id").alias("doc"), "n_shingles")
    prefixes = _shared(reps.mapInArrow(_prefixes(percent), "key long, doc long, whole boolean"), "prefixes")
    frequent = prefixes.where(F.col("df") > rare).groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.max("whole").alias("whole"))
    frequent = frequent.where(F.col("whole") | (F.col("n") >= LEAST)).select(F.col("doc").alias("doc_id"))
    packed = packing.pack(texts.where("doc_id IS NOT NULL"))
    signed = ", ".join(f"{s} long" for s in SIGNS)
    sketch = cut(packed.join(frequent, "doc_id", "left_semi").mapInArrow(_combinations, f"doc long, keys array<long>, {signed}"), "sketches")
    combined = _shared(sketch.select(F.posexplode("keys").alias("place", "key"), "doc").distinct(), "combinations")
    single = prefixes.where(F.col("df") <= rare)
    # a first round against the smallest document of each key; what it misses is left to the second
    star = single.where("doc <> lead").groupBy("lead", "doc").agg(F.count(F.lit(1)).alias("n"), F.max("whole").alias("whole"))
    star = star.where(F.col("whole") | (F.col("n") >= LEAST)).select("lead", "doc")
    tested = cut(star.unionByName(combined.where("doc <> lead").select("lead", "doc")).distinct(), "tested")
    links = cut(verified(packed, tested, percent), "verified")
    comp = components(links)
    place = comp.withColumnRenamed("node", "doc")
    left = _mixed(single.select("key", "doc", "whole").join(size, "doc"), place)
    pairs = _across(left, percent, ["whole"]).groupBy("lead", "doc").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("whole") | F.col("whole_")).alias("whole"))
    pairs = pairs.where(F.col("whole") | (F.col("n") >= LEAST)).select("lead", "doc")
    right = _mixed(combined.select("key", "doc", "place").join(size, "doc"), place).join(sketch.distinct(), "doc")
    pairs = pairs.unionByName(_across(right, percent, ["keys", *SIGNS], _close() & _first_common())).distinct()
    open_ = cut(pairs.join(tested, ["lead", "doc"], "left_anti"), "across")
    if not open_.isEmpty():
        more = cut(verified(packed, open_, percent), "verified")
        comp = components(links.unionByName(more))
    comp = comp.withColumnRenamed("node", "rep")
    known = members.join(comp, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id")).distinct()
    out = sets.select("doc_id", "n_shingles").join(known, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with all columns, of each component the document with the smallest doc_id."""
    gone = classes(docs, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def brute(docs: dict[int, str | None], percent: int = PERCENT) -> dict[int, tuple[int, int]]:
    """The rule itself, for tests: all pairs that share a shingle."""
    sets, index = {}, {}
    for d, text in docs.items():
        words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
        sets[d] = {tuple(words[i : i + SHINGLE]) for i in range(max(len(words) - SHINGLE + 1, 1))} if words else set()
        for s in sets[d]:
            index.setdefault(s, []).append(d)
    up = {d: d for d in docs}

    def top(d):
        while up[d] != d:
            up[d] = up[up[d]]
            d = up[d]
        return d

    for d in sorted(docs):
        shared: dict[int, int] = {}
        for s in sets[d]:
            for o in index[s]:
                if o < d:
                    shared[o] = shared.get(o, 0) + 1
        for o, n in shared.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[o]) - n):
                x, y = sorted((top(d), top(o)))
                up[y] = x
    return {d: (len(sets[d]), top(d)) for d in docs}
