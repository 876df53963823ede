"""The pipeline against its operators' rules, stage by stage."""

import duckdb
import pytest
from conftest import SF_DIR

import __spark_entry__ as entry
import corpus_pipeline
from skirmish.llm import decontam, jaccard, lines, queries


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = queries.table(spark, SF_DIR, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF_DIR).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_decide_as_their_rules(spark, stages):
    for before, after in stages[:-1]:
        assert after.columns == list(corpus_pipeline.COLUMNS)
    toxic, line, near, leak, mixed = [(texts(a), b) for a, b in stages]
    assert set(texts(toxic[1])) <= set(toxic[0])
    gone = lines.brute(line[0])
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in set(gone[d])) for d, t in line[0].items()}
    assert texts(line[1]) == want
    component = jaccard.brute(near[0])
    assert set(texts(near[1])) == {d for d in near[0] if component[d][1] == d}
    items = {r.item_id: r.text for r in queries.table(spark, SF_DIR, "benchmark").collect()}
    hit = {d for d, _ in decontam.brute(leak[0], items)}
    assert hit.isdisjoint(texts(leak[1]))
    assert {r.doc_id for r in mixed[1].collect()} <= set(mixed[0])


def test_run_gives_the_last_stage(spark, stages):
    rows = corpus_pipeline.run(spark, SF_DIR)
    key = lambda r: (r.doc_id, r.copy)
    assert sorted(map(key, rows.collect())) == sorted(map(key, stages[-1][1].collect()))


def test_registered_with_sql_where_sql_can_express_it(spark):
    names = set(entry.queries())
    assert {"pipeline", *queries.QUERIES} <= names and len(queries.QUERIES) == 13
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    for name, sql in queries.ORACLES.items():
        got = entry.queries()[name](spark, SF_DIR)
        cur = con.execute(sql)
        head = [d[0] for d in cur.description]
        assert sorted(head) == sorted(got.columns)
        plain = lambda v: round(v, 6) if isinstance(v, float) else v
        want = sorted(repr([plain(r[head.index(c)]) for c in sorted(head)]) for r in cur.fetchall())
        assert sorted(repr([plain(r[c]) for c in sorted(head)]) for r in got.collect()) == want
