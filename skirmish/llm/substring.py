"""Operator 1: removal of word sequences that also start earlier in the corpus.

A window is ``window`` consecutive words. Every window selects its least gram of ``gram`` words
(leftmost on ties) as its anchor; equal windows select equal anchors, so all occurrences of a window
meet under one anchor. A run of neighbouring windows with one anchor is a *passage*.

1. Count anchors; one that occurs once has no repeated window.
2. Passages with repeated anchors go to their documents, which supply the words. Equal passages
   within a batch collapse to the earliest, so a passage that a third of all documents share is sent
   once per batch. A frequent anchor is split further: its passages are cut in single windows with
   the window's hash as key.
3. The passages of one key, in corpus order, are a reference shard. A suffix automaton over the
   earlier passages streams the later ones; after each word it knows the matching statistic, the
   longest suffix seen before. A window is removed where the statistic reaches ``window``.
4. The spans go back to the documents.

Instead of sending every document through the automaton of every shard of the corpus (quadratic in
the corpus), only passages with a common anchor meet. Passages that are equal in one batch meet by a 64-bit hash of their
words and are decided there; all others meet by hashes as well, and the automaton decides on words.

Documents are compared by (doc_id, start of the window). Rows with one doc_id and equal texts are one
document; different texts under one doc_id are compared in the order of their hashes (``shared_ids``). A null text has no words; a document with a null doc_id keeps all words and removes
nothing elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.sources.staging import cut

from . import packing
from .packing import pack
from .shared_ids import bases, with_base
from .shared_ids import words as word_count
from .words import Words, blocks, mix, ranges

#: Occurrences from which an anchor is split by window.
FREQUENT = 2000


class Automaton:
    """Suffix automaton of a growing sequence; ``read`` returns the matching statistic of each symbol."""

    def __init__(self) -> None:
        self.after: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]
        self.last = 0
        self.marks = 0

    def _grow(self, symbol) -> int:
        after, link, size = self.after, self.link, self.size
        new = len(size)
        after.append({})
        size.append(size[self.last] + 1)
        link.append(0)
        at = self.last
        self.last = new
        while at >= 0 and symbol not in after[at]:
            after[at][symbol] = new
            at = link[at]
        if at < 0:
            return 0
        to = after[at][symbol]
        if size[to] == size[at] + 1:
            link[new] = to
            return size[to]
        copy = len(size)
        after.append(dict(after[to]))
        size.append(size[at] + 1)
        link.append(link[to])
        while at >= 0 and after[at].get(symbol) == to:
            after[at][symbol] = copy
            at = link[at]
        link[to] = link[new] = copy
        return size[copy]

    def read(self, words: list) -> list[int]:
        """Add a passage; per word, the length of the longest suffix that ended earlier."""
        seen = [self._grow(w) for w in words]
        self.marks += 1
        self._grow(self.marks)  # a separator that never repeats
        return seen


def _anchors(words: Words, window: int, gram: int):
    """Runs of windows with one anchor: (text row, anchor hash, first window as word index, windows)."""
    at, h = words.grams(gram)
    full = np.zeros(len(words), np.uint64)
    full[at] = h
    starts, _ = words.grams(window)
    best, where = full[starts].copy(), starts.copy()
    for j in range(1, window - gram + 1):
        other = full[starts + j]
        less = other < best
        best[less] = other[less]
        where[less] = starts[less] + j
    if len(starts) == 0:
        return (np.zeros(0, np.int64), best, starts, starts)
    new = np.ones(len(starts), bool)
    new[1:] = (where[1:] != where[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    return words.row[starts[head]], best[head], starts[head], np.diff(np.append(head, len(starts)))


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    col = batch.column("doc_id")
    return np.asarray(col.fill_null(0).cast(pa.int64())), np.asarray(col.is_valid())


def _occurrences(window: int, gram: int, count: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, known = _ids(batch)
            base = np.asarray(batch.column("base")).astype(np.int64)
            parts = []
            for low, _, data, offsets in blocks(batch.column("text")):
                words = Words(data, offsets)
                row, anchor, first, _ = _anchors(words, window, gram)
                keep = known[low + row]
                parts.append((anchor[keep], ids[low + row[keep]], (first - words.first[row] + base[low + row])[keep]))
            if not parts:
                continue
            anchor, doc, first = (np.concatenate(x) for x in zip(*parts, strict=True))
            if count:
                anchor, times = np.unique(anchor, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(times)], ["anchor", "times"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(doc), pa.array(first.astype(np.int32))],
                    ["anchor", "doc_id", "first"],
                )

    return run


def _merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document, touching ones merged."""
    if len(doc) == 0:
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    group = np.cumsum(np.append(0, doc[1:] != doc[:-1])).astype(np.int64)
    reach = np.maximum.accumulate(stop + group * (1 << 40)) - group * (1 << 40)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
    head = np.flatnonzero(new)
    return doc[head], start[head], np.maximum.reduceat(stop, head)


SENT = "key long, doc_id long, first int, stop int, text binary"


def _passages(window: int, gram: int):
    """Documents with the places of their repeated anchors (2 * first window, plus 1 if split) to passages.

    Passages that repeat in the batch are decided here.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, _ = _ids(batch)
            base = np.asarray(batch.column("base")).astype(np.int64)
            places = batch.column("places")
            begin = np.asarray(places.offsets)
            flat = np.asarray(places.values)
            parts, texts = [], []
            for low, high, data, offsets in packing.blocks(batch.column("text")):
                words = Words(data, offsets)
                owner, i = ranges(begin[low:high], begin[low + 1 : high + 1])
                asked = words.first[owner] + (flat[i] >> 1) - base[low + owner]
                row, anchors, heads, runs = _anchors(words, window, gram)
                # a place without a run here belongs to another text with the same doc_id
                at = np.searchsorted(heads, asked)
                fits = at < len(heads)
                fits[fits] = (heads[at[fits]] == asked[fits]) & (row[at[fits]] == owner[fits])
                at, owner, split = at[fits], owner[fits], (flat[i] & 1).astype(bool)[fits]
                key, first, n = anchors[at], heads[at] - words.first[owner], runs[at]
                # windows of split anchors, passages of the others
                once = ~split
                single, at = ranges(first[split], first[split] + n[split])
                owner = np.concatenate([owner[once], owner[split][single]])
                first = np.concatenate([first[once], at])
                n = np.concatenate([n[once], np.ones(len(at), np.int64)])
                key = np.concatenate([key[once], np.zeros(len(at), np.uint64)])
                split = np.concatenate([np.zeros(int(once.sum()), bool), np.ones(len(at), bool)])
                begin_word = words.first[owner] + first
                digest = words.windows(begin_word, begin_word + n + window - 1)
                key = np.where(split, digest, key)
                doc = ids[low + owner]
                first = first + base[low + owner]
                order = np.lexsort((first, doc, digest, key))
                key, digest, doc, first, n, begin_word = (x[order] for x in (key, digest, doc, first, n, begin_word))
                parts.append((key, digest, doc, first, n))
                head = np.ones(len(key), bool)
                head[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
                texts.extend(words.joined(a, a + m + window - 1) if h else None for a, m, h in zip(begin_word.tolist(), n.tolist(), head.tolist(), strict=True))
            if not parts or not texts:
                continue
            key, digest, doc, first, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((first, doc, digest, key))
            key, digest, doc, first, n = (x[order] for x in (key, digest, doc, first, n))
            same = np.zeros(len(key), bool)
            same[1:] = (key[1:] == key[:-1]) & (digest[1:] == digest[:-1])
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
            again = (doc != doc[head]) | (first != first[head])  # else a row that repeats a document
            h = np.flatnonzero(~same)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[h].view(np.int64)), pa.array(doc[h]), pa.array(first[h].astype(np.int32)), pa.array((first + n)[h].astype(np.int32)), pa.array([texts[j] for j in order[h]], pa.binary())],
                ["key", "doc_id", "first", "stop", "text"],
            )
            d, a, b = _merged(doc[again], first[again], (first + n)[again] + window - 1)
            if len(d):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mix(d.view(np.uint64)).view(np.int64)), pa.array(d), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.nulls(len(d), pa.binary())],
                    ["key", "doc_id", "first", "stop", "text"],
                )

    return run


def _repeats_itself(words: list, n: int, window: int) -> bool:
    return any(words[i : i + window] == words[j : j + window] for j in range(1, n) for i in range(j) if words[i] == words[j])


def _match(window: int):
    """Passages in the order of key, document and place to removed spans."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, machine, known, held, last = None, None, {}, None, None
        for batch in batches:
            doc, first, stop = [], [], []

            def add(d: int, a: int, ends: list[int], n: int) -> None:
                for i in range(n):
                    if ends[i + window - 1] >= window:
                        if doc and doc[-1] == d and first[-1] <= a + i <= stop[-1]:
                            stop[-1] = a + i + window
                        else:
                            doc.append(d), first.append(a + i), stop.append(a + i + window)

            for k, d, a, b, text in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "first", "stop", "text")), strict=True):
                if text is None:
                    doc.append(d), first.append(a), stop.append(b)
                    continue
                if k != key:
                    key, machine, known, held, last = k, None, {}, None, None
                if last == (d, a):
                    continue
                last = (d, a)
                n = b - a
                if text in known:  # an earlier passage with the same words
                    doc.append(d), first.append(a), stop.append(b + window - 1)
                    continue
                known[text] = True
                words = text.split()
                if held is None and machine is None:
                    held = words
                    if n > 1 and _repeats_itself(words, n, window):
                        machine = Automaton()
                        add(d, a, machine.read(words), n)
                    continue
                if machine is None:
                    machine = Automaton()
                    machine.read(held)
                add(d, a, machine.read(words), n)
            if doc:
                d, a, b = _merged(np.array(doc, np.int64), np.array(first, np.int64), np.array(stop, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["doc_id", "start", "stop"])

    return run


def _placed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, base)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return with_base(texts, bases(texts, word_count), "doc_id", "text")


def repeated_spans(docs: DataFrame, window: int = 20, gram: int = 5, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, start, stop): words of windows that start earlier too, as half-open word spans; they may overlap.

    Words count from the base of their text.
    """
    return _spans(_placed(docs), window, gram, frequent)


def _spans(texts: DataFrame, window: int, gram: int, frequent: int) -> DataFrame:
    counted = texts.mapInArrow(_occurrences(window, gram, True), "anchor long, times long")
    # as a table of its own, so that both sides of the join are plain exchanges and a frequent anchor can be split
    repeated = cut(counted.groupBy("anchor").agg(F.sum("times").alias("times")).where("times > 1"), "anchors")
    places = texts.mapInArrow(_occurrences(window, gram, False), "anchor long, doc_id long, first int")
    places = places.join(repeated.select("anchor", (F.col("times") > frequent).cast("int").alias("split")), "anchor")
    listed = places.groupBy("doc_id").agg(F.collect_list(F.col("first").cast("long") * 2 + F.col("split")).alias("places"))
    sent = pack(texts).join(listed, "doc_id").select("doc_id", "base", "text", "places").mapInArrow(_passages(window, gram), SENT)
    dealt = sent.repartition("key").sortWithinPartitions("key", "doc_id", "first")
    return dealt.mapInArrow(_match(window), "doc_id long, start int, stop int")


def _kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("spans")
        begin = np.asarray(spans.offsets)
        base = np.asarray(batch.column("base")).astype(np.int64)
        s, e = (np.asarray(spans.values.field(k)).astype(np.int64) for k in ("start", "stop"))
        total, gone, kept = [], [], []
        for low, high, data, offsets in packing.blocks(batch.column("text")):
            words = Words(data, offsets)
            size = words.first[1:] - words.first[:-1]
            owner, i = ranges(begin[low:high], begin[low + 1 : high + 1])
            delta = np.zeros(len(words) + 1, np.int64)
            stop = np.clip(e[i] - base[low + owner], 0, size[owner])
            start = np.clip(s[i] - base[low + owner], 0, stop)
            np.add.at(delta, words.first[owner] + start, 1)
            np.add.at(delta, words.first[owner] + stop, -1)
            drop = np.cumsum(delta[:-1]) > 0
            total.extend(size.tolist())
            sums = np.append(0, np.cumsum(drop))
            gone.extend((sums[words.first[1:]] - sums[words.first[:-1]]).tolist())
            text = data.tobytes()
            for r in range(high - low):
                found = text[offsets[r] : offsets[r + 1]].split()
                if gone[low + r]:
                    flags = drop[words.first[r] : words.first[r + 1]]
                    found = [found[j] for j in np.flatnonzero(~flags)]
                kept.append(b" ".join(found).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_text"],
        )


def remove_repeats(docs: DataFrame, window: int = 20, gram: int = 5, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row."""
    texts = _placed(docs)
    spans = _spans(texts, window, gram, frequent).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    empty = F.array().cast("array<struct<start:int,stop:int>>")
    joined = pack(texts).join(spans, "doc_id", "left").select("doc_id", "base", "text", F.coalesce("spans", empty).alias("spans"))
    return joined.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_text string")


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    out = remove_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def brute(docs: dict[int, str], window: int = 20) -> dict[int, tuple[int, int, str]]:
    """The rule itself, for tests: all windows in one dictionary."""
    seen, out = set(), {}
    for doc in sorted(docs):
        words = (docs[doc] or "").encode().split()
        drop = set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                drop.update(range(i, i + window))
            seen.add(w)
        kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
        out[doc] = (len(words), len(drop), hashlib.sha256(kept).hexdigest())
    return out


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS nth FROM p),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM g WHERE nth > 1),
one AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
kept AS (
  SELECT one.doc_id, string_agg(word, ' ' ORDER BY one.k) AS t, count(*) AS n
  FROM one LEFT JOIN gone ON one.doc_id = gone.doc_id AND one.k = gone.k WHERE gone.k IS NULL GROUP BY one.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id"""
