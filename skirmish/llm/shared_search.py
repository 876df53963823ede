"""Operator 11: ranked lexical search for many queries at once, with shared partial sums.

Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased, over whole texts. The score is the contract's
integer form of a length-normalised term weighting; each item gets its ``top`` best documents.

1. One scan counts each document's terms and keeps those that occur in an item (``postings``, a written table); N, L and
   each term's df are sums over it, whatever a term's share of the rows.
2. Items are dealt in blocks. In each block, terms that occur in the same items equally often form a class; an item is
   the sequence of its classes from the most shared one, and neighbours that several items have in common become a node, round
   after round (``share``). The result is a DAG whose nodes are term sets shared among items.
3. The postings are read once more. A document's partial sum is computed once for each class and each node of the DAG, level by
   level for a block of documents, and an item's score is the sum of its few remaining nodes. A task keeps the ``top`` best
   rows of an item, and ranks are taken over the tasks' rows in two steps.

Items go through in turns of about ``PAIRS`` (item, term) pairs, blocks hold about ``ITEMS`` items; both bound what a task holds,
beside the longest item, and change no result. Terms meet by 64-bit hashes of their bytes: the chance that any of D distinct
words of a corpus meets one of V item terms wrongly is D V / 2**64.

Every row of ``documents`` is a document of its own, also with a repeated or null doc_id (null last among equal scores). Rows
of ``benchmark`` with the same item_id, null included, are one item with the terms of all. Null and empty texts have no terms; an
item without terms or without a document above 0 has no rows. Other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skirmish.sources.staging import cut

from .words import ALNUM, Words, blocks, ranges

TOP = 20
PAIRS = 400_000
ITEMS = 256
#: Cells of the partial sums that a task holds at once.
CELLS = 1 << 21
SALT = 64


def _terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, term, times) of the items' texts."""
    for batch in batches:
        for low, high, data, offsets in blocks(batch.column("text")):
            words = Words(data, offsets, ALNUM, lower=True)
            item = batch.column("item_id").slice(low, high - low)
            yield pa.RecordBatch.from_arrays([item.take(pa.array(words.row)), pa.array(words.hash.view(np.int64))], ["item_id", "term"])


def _postings(vocabulary: np.ndarray):
    """Per document with a term: number of terms, and its terms of the sorted ``vocabulary`` by place with their number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.int64(max(len(vocabulary), 1))
        for batch in batches:
            for low, high, data, offsets in blocks(batch.column("text")):
                words = Words(data, offsets, ALNUM, lower=True)
                n = np.diff(words.first)
                h = words.hash.view(np.int64)
                at = np.minimum(np.searchsorted(vocabulary, h), max(len(vocabulary) - 1, 0))
                hit = vocabulary[at] == h if len(vocabulary) else np.zeros(len(h), bool)
                cell, times = np.unique(words.row[hit] * size + at[hit], return_counts=True)
                bounds = np.searchsorted(cell // size, np.arange(high - low + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(v.astype(np.int32))) for v in (cell % size, times)]
                out = pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(n.astype(np.int64)), *lists], ["doc_id", "n", "terms", "times"])
                yield out.filter(pa.array(n > 0))

    return run


def share(sequences: list[list[int]], first: int) -> list[tuple[int, int]]:
    """Replaces neighbours that several sequences have in common by new symbols from ``first`` on, in place.

    Returns the two parts of each new symbol; parts come before what they are part of. Every round is
    linear in the sequences and shortens them.
    """
    nodes: list[tuple[int, int]] = []
    while True:
        count = Counter(pair for s in sequences for pair in zip(s, s[1:]))
        made: dict[tuple[int, int], int] = {}
        for i, s in enumerate(sequences):
            out, j = [], 0
            while j < len(s):
                pair = (s[j], s[j + 1]) if j + 1 < len(s) else None
                if pair and count[pair] > 1 and not (j + 2 < len(s) and count[s[j + 1], s[j + 2]] > count[pair]):
                    out.append(made.setdefault(pair, first + len(nodes) + len(made)))
                    j += 2
                else:
                    out.append(s[j])
                    j += 1
            sequences[i] = out
        if not made:
            return nodes
        nodes += made


PLAN = (
    "items array<long>, terms array<long>, classes array<int>, leaf_class array<int>, leaf_times array<long>, "
    "left array<int>, right array<int>, item array<int>, symbol array<int>"
)


def mine(block: pd.DataFrame) -> pd.DataFrame:
    """The query-sharing DAG of one block of items: rows (item_id, term, times)."""
    names: dict = {}
    own: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for item, term, times in sorted(zip(block["item_id"].astype(object).where(block["item_id"].notna(), None), block["term"].tolist(), block["times"].tolist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        own[term].append((names.setdefault(item, len(names)), times))
    class_of: dict[tuple, int] = {}
    classes = [class_of.setdefault(tuple(x), len(class_of)) for x in own.values()]
    leaves: dict[tuple[int, int], int] = {}
    sequences: list[list[int]] = [[] for _ in names]
    for members, c in sorted(class_of.items(), key=lambda x: (-len(x[0]), x[1])):  # the most shared come first
        for item, times in members:
            sequences[item].append(leaves.setdefault((c, times), len(leaves)))
    nodes = share(sequences, len(leaves))
    flat = [(i, s) for i, q in enumerate(sequences) for s in q]
    row = {
        "items": [None if i is None else int(i) for i in names], "terms": list(own), "classes": classes, "leaf_class": [c for c, _ in leaves], "leaf_times": [t for _, t in leaves],
        "left": [a for a, _ in nodes], "right": [b for _, b in nodes], "item": [i for i, _ in flat], "symbol": [s for _, s in flat],
    }
    return pd.DataFrame({k: [v] for k, v in row.items()})


@dataclass
class Block:
    """A DAG as arrays: class of each vocabulary term (-1: none), leaves, levels of nodes, and each item's remaining symbols by turn."""

    items: list
    class_of: np.ndarray
    classes: int
    leaf_class: np.ndarray
    leaf_times: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    turns: list[tuple[np.ndarray, np.ndarray]]
    symbols: int

    @staticmethod
    def of(plan: dict, vocabulary: np.ndarray) -> Block:
        class_of = np.full(len(vocabulary), -1, np.int64)
        class_of[np.searchsorted(vocabulary, np.array(plan["terms"], np.int64))] = plan["classes"]
        leaves = len(plan["leaf_class"])
        depth, by_level = [0] * leaves, defaultdict(list)
        for k, (a, b) in enumerate(zip(plan["left"], plan["right"], strict=True)):
            depth.append(1 + max(depth[a], depth[b]))
            by_level[depth[-1]].append((leaves + k, a, b))
        seen, turns = Counter(), defaultdict(list)
        for i, s in zip(plan["item"], plan["symbol"], strict=True):
            turns[seen[i]].append((i, s))
            seen[i] += 1
        pick = lambda rows, n: tuple(np.array([r[j] for r in rows], np.int64) for j in range(n))
        return Block(
            list(plan["items"]), class_of, max(plan["classes"], default=-1) + 1, np.array(plan["leaf_class"], np.int64), np.array(plan["leaf_times"], np.int64)[:, None],
            [pick(by_level[k], 3) for k in sorted(by_level)], [pick(turns[k], 2) for k in sorted(turns)], len(depth),
        )

    def additions(self) -> int:
        """Additions a document for all items, above the classes."""
        return sum(len(t) for t, _, _ in self.levels) + sum(len(i) for i, _ in self.turns)

    def scores(self, owner: np.ndarray, term: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
        """(item, document) scores from the documents' (owner, term, value) rows."""
        of = self.class_of[term]
        mine = of >= 0
        sums = np.zeros(self.classes * docs, np.int64)
        np.add.at(sums, of[mine] * docs + owner[mine], value[mine])
        part = np.empty((self.symbols, docs), np.int64)
        part[: len(self.leaf_class)] = sums.reshape(self.classes, docs)[self.leaf_class] * self.leaf_times
        for target, left, right in self.levels:
            part[target] = part[left] + part[right]
        out = np.zeros((len(self.items), docs), np.int64)
        for item, symbol in self.turns:
            out[item] += part[symbol]
        return out


class Best:
    """The ``top`` best (score, doc_id) of each item so far."""

    def __init__(self, items: int, top: int):
        self.top, self.items = top, items
        self.rows = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]  # item, score, null, doc
        self.least = np.zeros(items, np.int64)
        self.null = np.zeros(items, bool)
        self.doc = np.full(items, np.iinfo(np.int64).min)

    def add(self, scores: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        least = self.least[:, None]
        better = scores > least
        equal = (scores == least) & (least > 0)
        if equal.any():
            better |= equal & ((self.null[:, None] > null) | ((self.null[:, None] == null) & (doc < self.doc[:, None])))
        item, at = np.nonzero(better)
        if len(item):
            self.rows = [np.concatenate(x) for x in zip(self.rows, (item, scores[item, at], null[at], doc[at]), strict=True)]
            self.trim()

    def trim(self) -> None:
        item, score, null, doc = self.rows
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        first = np.searchsorted(item, np.arange(self.items))
        place = np.arange(len(item)) - first[item]
        keep = order[place < self.top]
        self.rows = [x[keep] for x in self.rows]
        last = order[place == self.top - 1]
        which = self.rows[0][:0] if not len(last) else item[place == self.top - 1]
        self.least[which], self.null[which], self.doc[which] = score[last], null[last], doc[last]


def values(n: np.ndarray, owner: np.ndarray, term: np.ndarray, times: np.ndarray, weight: np.ndarray, count: int, length: int) -> np.ndarray:
    """What each (document, term) adds to a score."""
    if len(n) and 25 * int(n.max()) * count >= 1 << 62:
        m = np.array([75 + 25 * int(x) * count // length for x in n], np.int64)
    else:
        m = 75 + 25 * n * count // length
    return weight[term] * (1_000_000_000 * times // (1000 * times + 12 * m[owner]))


def _best(plans: list[Block], weight: np.ndarray, count: int, length: int, top: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(len(p.items), top) for p in plans]
        step = max(16, CELLS // max(p.symbols + len(p.items) for p in plans))
        for batch in batches:
            for low in range(0, len(batch), step):
                piece = batch.slice(low, step)
                n = piece.column("n").to_numpy()
                null = np.asarray(piece.column("doc_id").is_null())
                doc = piece.column("doc_id").fill_null(0).to_numpy()
                lists = [piece.column(c) for c in ("terms", "times")]
                offsets = lists[0].offsets.to_numpy()
                owner, at = ranges(offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64))
                term, times = (x.values.to_numpy()[at].astype(np.int64) for x in lists)
                value = values(n, owner, term, times, weight, count, length)
                for p, b in zip(plans, best, strict=True):
                    b.add(p.scores(owner, term, value, len(piece)), null, doc)
        for p, b in zip(plans, best, strict=True):
            item, score, null, doc = b.rows
            if len(item):
                names = pa.array(p.items, pa.int64()).take(pa.array(item))
                yield pa.RecordBatch.from_arrays([names, pa.array(doc, mask=null), pa.array(score)], ["item_id", "doc_id", "score"])

    return run


SCHEMA = "item_id long, rank int, doc_id long, score long"


def search(docs: DataFrame, items: DataFrame, top: int = TOP, pairs: int = PAIRS, per_block: int = ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``top`` best documents of each item."""
    spark = docs.sparkSession
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    asked = cut(texts.mapInArrow(_terms, "item_id long, term long").groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times")), "item_terms")
    size = asked.agg(F.count(F.lit(1)).alias("pairs"), (F.countDistinct("item_id") + F.max(F.col("item_id").isNull().cast("int"))).alias("items")).first()
    if not size["pairs"]:
        return spark.createDataFrame([], SCHEMA)
    turns = math.ceil(size["pairs"] / pairs)
    split = math.ceil(size["items"] / turns / per_block)
    dealt = asked.withColumn("turn", F.pmod(F.xxhash64("item_id"), F.lit(turns * split)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = []
    for turn in range(turns):
        mined = dealt.where(F.pmod("turn", F.lit(turns)) == turn).groupBy("turn").applyInPandas(lambda block: mine(block), PLAN)
        mined = mined.toPandas()
        if not len(mined):
            continue
        vocabulary = np.unique(np.concatenate([np.array(x, np.int64) for x in mined["terms"]]))
        postings = cut(rows.mapInArrow(_postings(vocabulary), "doc_id long, n long, terms array<int>, times array<int>"), "postings")
        whole = postings.agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("length")).first()
        if not whole["count"]:
            continue
        count, length = int(whole["count"]), int(whole["length"])
        held = postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        df = {r["term"]: r["count"] for r in held}
        weight = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
        plans = [Block.of(r, vocabulary) for r in mined.to_dict("records")]
        found.append(postings.mapInArrow(_best(plans, weight, count, length, top), "item_id long, doc_id long, score long"))
    if not found:
        return spark.createDataFrame([], SCHEMA)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = out.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SALT)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= top)
    some = some.drop("part", "rank").withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top)
    return some.select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), q AS (
  SELECT item_id, term, count(*) AS repeats FROM i GROUP BY ALL
), whole AS (
  SELECT count(*) AS n, sum(len(words))::BIGINT AS l FROM d WHERE len(words) > 0
), p AS (
  SELECT row, doc_id, size, term, count(*) AS tf FROM (SELECT row, doc_id, len(words) AS size, unnest(words) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, whole GROUP BY term
), s AS (
  SELECT item_id, row, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * size * n) // l))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term), whole GROUP BY item_id, row, doc_id
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM s WHERE score > 0
) WHERE rank <= 20
"""


def brute(docs: list[tuple[int | None, str | None]], items: list[tuple[int | None, str | None]], top: int = TOP) -> list[tuple]:
    """The contract's rule as it stands, for tests."""
    find = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    held = [(d, find(t)) for d, t in docs]
    held = [(d, Counter(w), len(w)) for d, w in held if w]
    count, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked: dict = defaultdict(list)
    for i, t in items:
        asked[i] += find(t)
    out = []
    for i, terms in asked.items():
        scored = []
        for d, c, n in held:
            m = 75 + 25 * n * count // length
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return out
