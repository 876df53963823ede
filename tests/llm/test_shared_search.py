"""Ranked search with shared sums against the plain rule."""

import random

import pytest
from llm import corpus

from skirmish.llm import shared_search as s

ITEMS = "item_id long, text string, score long, rank string, terms int"


def items_table(spark, items):
    return spark.createDataFrame([(i, t, 1, "mine", 2) for i, t in items], ITEMS).repartition(2)


def questions(seed, n=30):
    rnd = random.Random(seed)
    stem = " ".join(corpus.words(rnd, 9))
    out = [(i, f"{stem} {' '.join(corpus.words(rnd, rnd.randint(0, 12)))}") for i in range(n)]
    out += [(100, None), (101, ""), (102, "nowhere to be found"), (103, "W1 w1 w1 W2-w2"), (None, "w3 w4"), (None, "w5"), (104, "again"), (0, "w9 w9"), (105, "é w7 É")]
    return out


def told(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"pairs": 60, "per_block": 3}), (3, {"per_block": 2, "top": 5})])
def test_ranks(spark, seed, options):
    docs = corpus.texts(seed, 90) | {500: "É w7 é", 501: "again " * 3000 + "w1"}
    rows = list(docs.items()) + [(None, docs[6]), (None, docs[7]), (6, docs[6]), (7, docs[6])]
    items = questions(seed)
    df = spark.createDataFrame([(d, t, None, 1, "x") for d, t in rows], "doc_id long, text string, source string, n int, terms string").repartition(5)
    got = told(s.search(df, items_table(spark, items), **options))
    want = sorted(s.brute(rows, items, options.get("top", s.TOP)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert got == want


def test_many_equal_documents(spark):
    """A large group of copies: the smallest ids win, whatever the order of the rows."""
    rows = [(d, "w1 w2 w3") for d in range(400, 0, -1)] + [(d, "w1 other words") for d in range(1000, 1300)]
    got = told(s.search(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), items_table(spark, [(1, "w1 w3 w3")])))
    assert [r[2] for r in got] == list(range(1, 21)) and len({r[3] for r in got}) == 1
    assert got == s.brute(rows, [(1, "w1 w3 w3")])


def test_shared_sets_are_summed_once():
    rnd = random.Random(4)
    sets = [sorted(rnd.sample(range(40), 12)) for _ in range(6)]
    sequences = [sets[i % 6] + [100 + i] for i in range(60)]
    work = [list(x) for x in sequences]
    nodes = s.share(work, 1000)
    parts = dict(enumerate(nodes, 1000))

    def spell(x):
        return [x] if x not in parts else [z for y in parts[x] for z in spell(y)]

    assert [[z for y in x for z in spell(y)] for x in work] == sequences
    assert len(nodes) + sum(map(len, work)) < 0.3 * sum(map(len, sequences))


def test_empty_tables(spark):
    docs, items = corpus.table(spark, {1: "w1", 2: None}), items_table(spark, [(1, "w1")])
    assert s.search(docs.limit(0), items).collect() == [] and s.search(docs, items.limit(0)).collect() == []
    assert s.search(docs, items_table(spark, [(1, None), (2, "--")])).collect() == []
    assert s.search(corpus.table(spark, {1: None, 2: ""}), items).columns == ["item_id", "rank", "doc_id", "score"]
