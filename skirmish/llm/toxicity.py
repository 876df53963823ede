"""Operator 8: toxicity by compression distance.

Two zstandard dictionaries are trained on a bounded labelled sample. Both end with the words that most
documents use, at the same offsets; the toxic one begins with the strings that are typical for toxic
texts (whole words and word beginnings by document frequency, at least ``TIMES`` times as frequent
as in ordinary texts). A window of ``WIDTH`` words is compressed with either; the difference of the
two lengths is large only where the toxic part of the dictionary helps. Every window is led by a run
of one byte, as a block that does not shrink would be stored plainly and all lengths be alike.

Thresholds are calibrated on the ordinary sample: for each, the share of ordinary windows whose
difference reaches it. A document's features are the log ratios of its windows over the thresholds to
what these shares predict; a logistic regression turns them into a score.

A null or empty text has no windows and gets the score of a text without evidence. Without labelled
rows of both classes nothing can be learnt, and every score is 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import held_out, labelled, logistic

WIDTH = 6
LEVEL = 5
LEAST_MATCH = 4
LEAD = b"~" * 96 + b" "
#: Words in the common part and strings in the toxic part of the dictionaries.
COMMON = 500
TYPICAL = 24
TIMES = 4.0
#: Share of the toxic sample that a typical string occurs in, so that strings of one group of copies stay out.
SUPPORT = 0.03
THRESHOLDS = (1, 2, 3, 4, 5, 6, 8)
#: Bounds of the labelled sample: rows of each class, and code points of each text.
SAMPLE = 2500
CHARS = 20_000


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    rates: tuple[float, ...]
    weights: tuple[float, ...]


def windows(text: bytes) -> list[bytes]:
    words = text.lower().split()
    return [LEAD + b" ".join(words[i : i + WIDTH]) + b" " for i in range(0, len(words), WIDTH)]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=256, dict_size=len(content), min_match=LEAST_MATCH, write_checksum=False, write_content_size=False, write_dict_id=False
    )
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.pair = _compressor(model.ordinary), _compressor(model.toxic)

    def differences(self, text: bytes) -> np.ndarray:
        plain, toxic = self.pair
        return np.array([len(plain.compress(w)) - len(toxic.compress(w)) for w in windows(text)], np.int64)

    def features(self, differences: np.ndarray) -> np.ndarray:
        over = np.array([(differences >= c).sum() for c in THRESHOLDS])
        return np.log((over + 0.5) / (len(differences) * np.array(self.model.rates) + 0.5))

    def score(self, differences: np.ndarray) -> float:
        z = float(np.append(self.features(differences), 1.0) @ np.array(self.model.weights))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _strings(text: bytes) -> set[bytes]:
    whole = {w.strip(b".,;:!?\"'()") for w in text.lower().split()}
    # word beginnings stand for inflected and compound forms; they are cut between code points
    return whole | {w.decode("utf-8", "ignore")[:k].encode() for w in whole for k in (4, 5, 6) if len(w) > k}


def train(sample: list[tuple[int, str]]) -> Model | None:
    texts = {y: [t.encode() for t in dict.fromkeys(t for label, t in sample if label == y)] for y in (0, 1)}
    if not texts[0] or not texts[1]:
        return None
    df = {y: Counter(s for t in texts[y] for s in _strings(t)) for y in (0, 1)}
    words = Counter(w for y in (0, 1) for t in texts[y] for w in {x.strip(b".,;:!?\"'()") for x in t.lower().split()})
    n = {y: len(texts[y]) for y in (0, 1)}

    def gain(s: bytes) -> float:
        return math.log((df[1][s] + 0.5) / n[1]) - math.log((df[0][s] + 0.5) / n[0])

    least = max(3, math.ceil(SUPPORT * n[1]))
    found = [s for s, k in df[1].items() if k >= least and len(s) >= LEAST_MATCH and gain(s) > math.log(TIMES)]
    typical: list[bytes] = []
    for s in sorted(found, key=lambda s: (-df[1][s] * gain(s) * len(s) ** 0.25, s)):
        if len(typical) < TYPICAL and not any(s in o or o.startswith(s) or s.startswith(o) for o in typical):
            typical.append(s)
    common = [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0])) if w and w not in typical][:COMMON]
    tail = b" ".join(reversed(common)) + b" "
    # a dictionary has eight bytes at least
    model = Model(b" " * 8 + tail, b" " * 8 + b" ".join(reversed(typical)) + b" " + tail, (1.0,) * len(THRESHOLDS), ())
    scorer = Scorer(model)
    found_ = {y: [scorer.differences(t) for t in texts[y]] for y in (0, 1)}
    every = np.concatenate(found_[0]) if found_[0] else np.zeros(0)
    rates = tuple(float((every >= c).mean() + 1e-6) if len(every) else 1e-6 for c in THRESHOLDS)
    scorer = Scorer(Model(model.ordinary, model.toxic, rates, ()))
    x = np.array([scorer.features(d) for y in (0, 1) for d in found_[y]])
    y = np.array([y for y in (0, 1) for _ in found_[y]], float)
    return Model(model.ordinary, model.toxic, rates, tuple(logistic(x, y).tolist()))


def _score(model: Model | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for batch in batches:
            score, number, over = [], [], []
            for x in batch.column("text").cast(pa.large_binary()):
                d = scorer.differences(x.as_buffer().to_pybytes() if x.is_valid else b"") if scorer else np.zeros(0, np.int64)
                score.append(scorer.score(d) if scorer else 0.0)
                number.append(len(d))
                over.append(int((d >= 4).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(number, pa.int64()), pa.array(over, pa.int64())],
                ["doc_id", "score", "windows", "toxic_windows"],
            )

    return run


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, chars: int = CHARS) -> Model | None:
    """The model, its constant set for the classes' shares among all labelled rows."""
    model = train(sample := labelled(docs, labels, "toxic", most, chars))
    if model is None:
        return None
    rows = labels.where(~held_out(F.col("doc_id"))).agg(*[F.sum((F.col("toxic") == y).cast("long")) for y in (0, 1)]).first()
    drawn = [sum(y == k for y, _ in sample) for k in (0, 1)]
    shift = math.log(rows[1] / rows[0]) - math.log(drawn[1] / drawn[0])
    return replace(model, weights=(*model.weights[:-1], model.weights[-1] + shift))


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, windows, toxic_windows) of every row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(model), "doc_id long, score double, windows long, toxic_windows long")


def _keep(model: Model | None, limit: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for batch in batches:
            if scorer is None:
                yield batch
                continue
            texts = batch.column("text").cast(pa.large_binary())
            keep = [scorer.score(scorer.differences(x.as_buffer().to_pybytes() if x.is_valid else b"")) < limit for x in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def reject(docs: DataFrame, model: Model | None, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``limit``."""
    return docs.mapInArrow(_keep(model, limit), docs.schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns."""
    out = scores(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "windows", "toxic_windows")
