"""Operator 7: document quality by a linear-chain conditional random field over lines.

Every ``\\n``-split line is good or bad. A line's features are counts by class of character, word
lengths, repetition inside the line and of the line in its document, each squashed to [-1, 1], together
with the features of the line before and behind it; the chain adds weights for the change between
two lines. The field is fitted by gradient steps on the full likelihood of a bounded labelled sample,
whose lines take their document's label.

A document's score is the length-weighted mean of the forward-backward marginals of its lines, put on
the scale of the labels by a logistic fit on the same sample. A null or empty text is one empty line.
Without labelled rows of both classes every score is 1. Nothing but the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import held_out, labelled, logistic
from .words import Words, blocks

#: Bounds of the labelled sample: rows of each class, and code points of each text.
SAMPLE = 2500
CHARS = 20_000
STEPS = 250
SYMBOLS = b"#*$%&|<>{}[]=/\\^~_@"


def _class(chars: bytes) -> np.ndarray:
    flags = np.zeros(256, np.int64)
    flags[list(chars)] = 1
    return flags


CLASSES = (
    _class(SYMBOLS), _class(b"|"), _class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class(b"!"), _class(b"0123456789"),
    _class(b".,;:?"), np.where(np.arange(256) >= 128, 1, 0),
)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by line, bytes in words by line, first line of each text and the number of all)."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10) + 1
    owner = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks - 1, "right") - 1])
    starts = np.concatenate([offsets[:-1], breaks])
    order = np.lexsort((starts, owner))
    owner, starts = owner[order], starts[order]
    bounds = np.append(starts, len(data))
    words = Words(data, bounds)
    first = np.searchsorted(owner, np.arange(n + 1))
    size = words.end - words.start
    count = np.diff(words.first)
    upto = np.append(0, np.cumsum(size))
    chars = upto[words.first[1:]] - upto[words.first[:-1]]
    some, many = np.maximum(chars, 1), np.maximum(count, 1)
    columns = []
    for flags in CLASSES:
        sums = np.append(0, np.cumsum(flags[data]))
        columns.append(np.tanh(4 * (sums[bounds[1:]] - sums[bounds[:-1]]) / some))
    columns.append(np.tanh((chars / many - 5) / 4))
    columns.append(np.tanh((np.log1p(count) - 3) / 2))
    # words of the line that repeat an earlier one, or the one just before
    by = np.lexsort((words.hash, words.row))
    again = np.zeros(len(words), np.int64)
    again[1:] = (words.hash[by][1:] == words.hash[by][:-1]) & (words.row[by][1:] == words.row[by][:-1])
    just = np.zeros(len(words), np.int64)
    just[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
    repeats = np.bincount(words.row[by], again, len(owner))
    columns += [repeats / many, np.bincount(words.row, just, len(owner)) / many]
    # lines that equal an earlier one of their text
    h = words.windows(words.first[:-1], words.first[1:])
    by = np.lexsort((np.arange(len(h)), h, owner))
    same = np.zeros(len(h), bool)
    same[by[1:]] = (h[by][1:] == h[by][:-1]) & (owner[by][1:] == owner[by][:-1])
    columns.append((same & (count > 0)).astype(float))
    columns.append((count == 0).astype(float))
    own = np.column_stack(columns)
    before, behind = np.zeros_like(own), np.zeros_like(own)
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    before[inner + 1], behind[inner] = own[inner], own[inner + 1]
    edge = np.zeros((len(own), 2))
    edge[first[:-1], 0] = 1
    edge[first[1:] - 1, 1] = 1
    return np.column_stack([np.ones(len(own)), own, own**2, before, behind, edge]), chars.astype(float), first


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    change: np.ndarray
    scale: np.ndarray


def marginals(good: np.ndarray, change: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of log potentials of "good" by line: the probability of good, and by pair of neighbouring lines.

    All texts advance by one line at a time, longest first, so the steps are array operations.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    starts, n = first[:-1][order], n[order]
    m = np.exp(change - change.max())
    emit = np.stack([np.ones(len(good)), np.exp(np.clip(good, -30, 30))], 1)
    emit /= emit.sum(1, keepdims=True)
    ahead, back = np.zeros_like(emit), np.ones_like(emit)
    steps = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(steps), "left")
    for t in range(steps):
        at = starts[: active[t]] + t
        a = emit[at] * (ahead[at - 1] @ m if t else 1.0)
        ahead[at] = a / a.sum(1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        b = (emit[at + 1] * back[at + 1]) @ m.T
        back[at] = b / b.sum(1, keepdims=True)
    p = ahead * back
    p /= p.sum(1, keepdims=True)
    inner = np.ones(len(good), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    i = np.flatnonzero(inner)
    pair = ahead[i - 1][:, :, None] * m[None] * (emit[i] * back[i])[:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    return p[:, 1], pair


def _mean(p: np.ndarray, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length-weighted mean marginal and log length, as inputs of the final scale."""
    weight = chars + 1e-3
    top, low = (np.add.reduceat(x, first[:-1]) if len(first) > 1 else np.zeros(0) for x in (p * weight, weight))
    share = np.clip(top / low, 1e-4, 1 - 1e-4)
    return np.column_stack([np.log(share / (1 - share)), np.log1p(low)])


def train(sample: list[tuple[int, str]], steps: int = STEPS) -> Model | None:
    y = np.array([label for label, _ in sample], float)
    if len(set(y.tolist())) < 2:
        return None
    parts = [lines(data, offsets) for _, _, data, offsets in blocks(pa.array([t for _, t in sample], pa.string()))]
    x, chars = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    first = np.append(0, np.cumsum(np.concatenate([np.diff(p[2]) for p in parts])))
    label = np.repeat(y, np.diff(first))
    inner = np.ones(len(x), bool)
    inner[first[:-1]] = False
    i = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[i - 1].astype(int), label[i].astype(int)), 1)
    w, change = np.zeros(x.shape[1]), np.zeros((2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(change), np.zeros_like(change)]
    for t in range(1, steps + 1):
        p, pair = marginals(x @ w, change, first)
        slopes = (x.T @ (p - label) / len(x) + 1e-4 * w, (pair.sum(0) - seen) / len(x) + 1e-3 * change)
        for k, (target, g) in enumerate(zip((w, change), slopes, strict=True)):
            one, two = state[2 * k], state[2 * k + 1]
            one += 0.1 * (g - one)
            two += 0.01 * (g * g - two)
            target -= 0.05 * (one / (1 - 0.9**t)) / (np.sqrt(two / (1 - 0.99**t)) + 1e-8)
    p, _ = marginals(x @ w, change, first)
    return Model(w, change, logistic(_mean(p, chars, first), y))


def _score(model: Model | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, number, bad = [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for low, high, data, offsets in blocks(batch.column("text")):
                if model is None:
                    score.append(np.ones(high - low))
                    number.append(np.zeros(high - low, np.int64))
                    bad.append(np.zeros(high - low, np.int64))
                    continue
                x, chars, first = lines(data, offsets)
                p, _ = marginals(x @ model.weights, model.change, first)
                z = np.column_stack([_mean(p, chars, first), np.ones(high - low)]) @ model.scale
                score.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                number.append(np.diff(first))
                bad.append(np.add.reduceat((p < 0.5).astype(np.int64), first[:-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(np.concatenate(c)) for c in (score, number, bad))], ["doc_id", "score", "lines", "bad_lines"]
            )

    return run


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, chars: int = CHARS) -> Model | None:
    return train(labelled(docs, labels, "quality", most, chars))


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, lines, bad_lines) of every row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(model), "doc_id long, score double, lines long, bad_lines long")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns."""
    out = scores(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "lines", "bad_lines")
