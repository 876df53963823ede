"""Bounded samples of labelled rows, the only data that a fit sees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, chars: int) -> list[tuple[int, str]]:
    """(label, text) of at most ``most`` labelled rows of each class outside the held-out part.

    The rows are those with the smallest id hash, so reruns agree. Texts are cut at ``chars``; both
    bounds hold for the fit only. The chosen ids are few by construction and so are broadcast. A doc_id with
    several labels has the smallest one, a doc_id with several texts the smallest text, so each gives one row.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    rows = rows.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    order = F.xxhash64("doc_id")
    chosen = [r for y in (0, 1) for r in rows.where(F.col("label") == y).orderBy(order, "doc_id").limit(most).collect()]
    if not chosen:
        return []
    spark = docs.sparkSession
    ids = spark.createDataFrame([(int(r.doc_id), int(r.label)) for r in chosen], "doc_id long, label int")
    found = docs.select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("text")).join(F.broadcast(ids), "doc_id")
    found = found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return [(r.label, r.text) for r in found.orderBy("doc_id").collect()]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (the last is the constant) of a logistic regression by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    keep = np.full(len(w), ridge * len(x))
    keep[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (p - y) + keep * w
        curve = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(keep)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w
