"""Work that must spread over tasks whatever the layout of the input."""

import datetime as dt

import pytest
from helpers import event, frame
from pyspark.sql import functions as F

from skirmish.functions.sliced import time_slice
from skirmish.operators import fights as D
from skirmish.operators import timeline
from skirmish.plans.analysis import Options, detect
from skirmish.sources import sinks, staging, tables
from skirmish.streaming import fights as streaming
from skirmish.streaming.fights import _outside


@pytest.fixture
def one_file(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    kinds = ("click", "view", "error", "signup", "purchase")
    rows = [(i, start + dt.timedelta(seconds=i), i % 40, kinds[i % 5], float(i), f'{{"k": {i % 97}}}') for i in range(2_000)]
    rows += [(None, None, None, None, None, None), rows[0], rows[0]]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_events_of_one_file_are_dealt_over_tasks(spark, one_file):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        events = tables.combat_events(spark, one_file)
        sizes = [len(p) for p in events.select("ord").rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) > 1 and max(sizes) < 2 * sum(sizes) / len(sizes)
    assert sum(sizes) == 2_003


def test_series_of_any_length_are_filled_and_misses_keep_theirs(spark):
    width, rows = 5, []
    for t, actor, kind, amount in ((0, "a", "melee_hit", 3), (4, "a", "melee_hit", 4), (2_600, "a", "melee_hit", 5), (7, "b", "melee_miss", None), (9, None, "melee_hit", 8)):
        rows.append(("l", 1, actor, kind, t, amount, 0, 3_000))
    rows += [("l", 2, "a", "melee_hit", 11, 7, 0, 12), ("l", 2, "a", "melee_hit", -3, 1, 0, 12)]
    schema = "log_id string, fight_id long, actor string, event_type string, t long, amount long, fight_start_t long, fight_end_t long"
    acts = spark.createDataFrame(rows, schema)
    packed = timeline.packed_timeline(acts, width)
    got = {}
    for r in packed.orderBy("chunk").collect():
        assert r.first_bucket == r.chunk * timeline.CHUNK and len(r.amount) <= timeline.CHUNK
        got.setdefault((r.fight_id, r.actor), []).extend(r.amount)
    long = [0] * 601
    assert got[1, "b"] == long and got[1, None] == long
    long[0], long[520] = 7, 5
    assert got[1, "a"] == long and got[2, "a"] == [1, 0, 7]


def test_series_join_no_spine(spark):
    schema = "log_id string, fight_id long, actor string, event_type string, t long, amount long, fight_start_t long, fight_end_t long"
    acts = spark.createDataFrame([("l", 1, "a", "melee_hit", 1, 2, 0, 9)], schema)
    plan = timeline.packed_timeline(acts)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_slices_of_sparse_tables_hold_many_rows(spark):
    """One fight an hour: the summaries of a log's slices must stay far smaller than its rows."""
    rows = spark.range(720).select((F.col("id") * 3_600).alias("start_t"))
    assert rows.select(time_slice("start_t")).distinct().count() <= 4


def test_borders_outside_spans_are_found_without_pairs(spark):
    fit = spark.createDataFrame([("l", b) for b in (0, 10, 15, 20, 21, 30, 2_000_000)] + [("m", 15)], "log_id string, border_t long")
    spans = spark.createDataFrame([("l", 0, 9, 20), ("l", 1, 10, 12), ("l", 2, 30, 1_900_000), ("l", 3, None, None), ("n", 0, 0, 99)], "log_id string, group_no long, first_t long, last_t long")
    free = _outside(fit, spans)
    assert {tuple(r) for r in free.collect()} == {("l", 0), ("l", 21), ("l", 30), ("l", 2_000_000), ("m", 15)}


def test_a_section_is_read_from_its_own_files(spark):
    rows = {name: spark.createDataFrame([("l", 1, name, "{}")], "log_id string, encounter_id long, section string, payload string") for name in ("header", "hit")}
    docs = sinks._written(rows)
    assert sorted(r.section for r in docs.collect()) == ["header", "hit"]
    read = sinks.read_section(docs, "hit", "x long")
    assert read.inputFiles() and all("/doc_hit-" in path for path in read.inputFiles())
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and "Union" not in plan


def test_a_stream_writes_and_sums_its_rows_once_and_narrow(spark, tmp_path, monkeypatch):
    """No step carries event columns that the sink does not use, or reads the tagged rows or the numbered fights over and over."""
    tables_read, columns = {}, {}

    def watched(df, name):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        tables_read[name], columns[name] = plan.count("parquet"), set(df.columns)
        return staging.cut(df, name)

    for module in (D, streaming):
        monkeypatch.setattr(module, "cut", watched)
    rows = [event(i, 7 * i, "death" if i % 5 == 4 else "melee_hit", actor="A", target="BC"[i // 9 % 2], amount=i, spell="s") for i in range(30)]
    sink = streaming.FightStream(spark, str(tmp_path / "t"), 15, encounter_gap_seconds=0, min_damage=0)
    sink.process(frame(spark, rows), 0)
    assert all(not names & {"modifiers", "spell", "verb", "damage_type", "outcome", "body"} for names in columns.values())
    assert tables_read["fight_sums"] == 1 and tables_read["stream_fights"] <= 3
    assert tables_read["stream_groups"] <= 4
    want = detect(frame(spark, rows), Options(min_damage=0)).fights
    view = lambda df: sorted((r.target, r.fight_id, r.start_t, r.end_t, r.fight_complete, r.total_damage) for r in df.collect())
    assert view(sink.fights(min_damage=0)) == view(want)
