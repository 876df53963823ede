"""Classifiers by held-out accuracy on the given tables, and their edge cases."""

import zlib

import numpy as np
import pytest
from conftest import SF_DIR
from llm import corpus

from skirmish.llm import crf, queries, samples, toxicity

LABELS = "doc_id long, quality int, toxic int"


def scored(spark, name, label):
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, "/root/testdata/sf0.01").collect()}
    labels = queries.table(spark, "/root/testdata/sf0.01", "labels").collect()
    return got, [(got[r.doc_id].score, r[label]) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r[label] is not None]


def test_quality(spark):
    got, pairs = scored(spark, "op7_line_crf", "quality")
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in got.items())
    assert np.mean([(s >= 0.3) == (y == 1) for s, y in pairs]) > 0.95


def test_toxicity(spark):
    got, pairs = scored(spark, "op8_toxicity", "toxic")
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    clean = [s for s, y in pairs if y == 0]
    assert np.mean([s < 0.5 for s in clean]) > 0.95 and np.mean([s for s, y in pairs if y == 1]) > 3 * np.mean(clean)


def test_marginals_are_those_of_all_labelings():
    from itertools import product

    rnd = np.random.default_rng(1)
    good, change, first = rnd.normal(size=7), rnd.normal(size=(2, 2)), np.array([0, 3, 4, 7])
    p, _ = crf.marginals(good, change, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        weights = {y: np.exp(sum(good[a + i] * s for i, s in enumerate(y)) + sum(change[y[i], y[i + 1]] for i in range(len(y) - 1))) for y in product((0, 1), repeat=b - a)}
        for i in range(b - a):
            assert p[a + i] == pytest.approx(sum(w for y, w in weights.items() if y[i]) / sum(weights.values()))


@pytest.mark.parametrize("module", [crf, toxicity])
def test_without_labels_and_with_nulls(spark, module):
    docs = corpus.table(spark, corpus.texts(1, 20), [(None, None, None, None, None, None, None, None, None)])
    none = spark.createDataFrame([], LABELS)
    out = module.digest(docs, none).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert module.digest(docs.limit(0), none).collect() == []
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (1, 0, 0), (1, 0, 0)], LABELS)
    assert len(module.digest(docs, odd).collect()) == docs.count()


def test_rejected_documents_keep_their_columns(spark):
    docs = queries.table(spark, SF_DIR, "documents").withColumns({"score": samples.F.lit(1), "windows": samples.F.lit("x")})
    model = toxicity.fit(docs, queries.table(spark, SF_DIR, "labels"))
    kept = toxicity.reject(docs, model)
    assert kept.schema == docs.schema and 0.8 * docs.count() < kept.count() <= docs.count()


def test_sample_leaves_held_out_rows_alone(spark):
    docs = spark.createDataFrame([(d, str(d)) for d in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2, 0) for d in range(200)], LABELS)
    got = samples.labelled(docs, labels, "quality", 30, 5)
    assert sum(y for y, _ in got) == 30 and len(got) == 60
    assert all(zlib.crc32(t.encode()) % 5 and int(t) % 2 == y for y, t in got)


def test_sample_is_bounded_by_ids(spark):
    from skirmish.llm.samples import labelled

    ids = [d for d in range(1, 200) if __import__("zlib").crc32(str(d).encode()) % 5][:2]
    docs = spark.createDataFrame([(ids[0], f"text {i}") for i in range(50)] + [(ids[1], "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(ids[0], 1), (ids[0], 0), (ids[0], 1), (ids[1], 1), (None, 1)], "doc_id long, toxic int")
    assert sorted(labelled(docs, labels, "toxic", 1, 100)) == [(0, "text 0"), (1, "other")]
