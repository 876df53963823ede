import random
from datetime import datetime

import pytest
from helpers import BASE, event, frame, seconds

from skirmish.operators import fights as D
from skirmish.operators.encounters import group_fights
from skirmish.plans.analysis import Options, detect
from skirmish.schema import EVENTS, MANUAL_GROUPS
from skirmish.sources.logs import ordered_chunks, stream_lines
from skirmish.streaming.fights import MEMBERS, FightStream, gap_sessions
from skirmish.streaming.state import Pointer, StateTables

STAMP = "%a %b %d %H:%M:%S %Y"


def seconds_of(at):
    return int((BASE - datetime(1970, 1, 1)).total_seconds()) + at


def listed(df):
    return sorted(
        (r.log_id, r.fight_id, r.target, seconds(r.start), seconds(r.end), r.fight_complete, r.total_damage, r.hits, r.misses)
        for r in df.collect()
    )


def random_rows(seed, n, logs=("x", "y")):
    rng, rows = random.Random(seed), []
    for log in logs:
        at = 0
        for o in range(n):
            at += rng.choice([0, 1, 2, 3, 8, 13, 20])
            target = rng.choice(["a", "b", "You"])
            kind = rng.choice(["melee_hit", "melee_hit", "melee_miss", "death", "heal"])
            more = dict(outcome="miss") if kind == "melee_miss" else {}
            amount = rng.randint(1, 99) if kind in ("melee_hit", "heal") else None
            rows.append(event(o, at, kind, log=log, actor=rng.choice(["You", "Bo"]), target=target, amount=amount, **more))
    return rows


def test_batches_give_the_fights_of_one_batch(spark, tmp_path):
    rows = random_rows(7, 90)
    sink = FightStream(spark, str(tmp_path / "t"), 15, encounter_gap_seconds=0, min_damage=0)
    sink.process(frame(spark, [r for r in rows if r[1] < 45]), 0)
    sink.process(frame(spark, [r for r in rows if r[1] >= 45]), 1)
    want = detect(frame(spark, rows), Options(min_damage=0)).fights
    assert listed(sink.fights(min_damage=0)) == listed(want)
    # a repeated batch changes nothing
    sink.process(frame(spark, [r for r in rows if r[1] >= 45]), 1)
    assert listed(sink.fights(min_damage=0)) == listed(want)
    assert sink.members().count() == sink.fights(min_damage=0, in_progress=False).count()
    open_now = sink.fights(min_damage=0).where("in_progress")
    ends = detect(frame(spark, rows), Options(min_damage=0, open_policy="include")).fights.where("in_progress")
    assert open_now.count() >= ends.count()


def test_regrouping_is_that_of_a_batch_job(spark, tmp_path):
    rows = [
        event(0, 0, "melee_hit", actor="A", target="rat", amount=5),
        event(1, 1, "death", actor="A", target="rat"),
        event(2, 2, "melee_hit", actor="A", target="Boss", amount=50_000),
        event(3, 9, "death", actor="A", target="Boss"),
        event(4, 60, "melee_hit", actor="A", target="Add", amount=20_000),
        event(5, 70, "death", actor="A", target="Add"),
        event(6, 75, "melee_hit", actor="A", target="Late", amount=90_000),
    ]
    groups = None
    for manual in (False, True):
        batch = detect(frame(spark, [r for r in rows if r[1] < 6]), Options()).fights
        if manual:
            keys = [r.fight_key for r in batch.orderBy("fight_id").collect()]
            groups = spark.createDataFrame([("l", 0, "both", i, k) for i, k in enumerate(keys)], MANUAL_GROUPS)
        sink = FightStream(spark, str(tmp_path / f"t{manual}"), 15, encounter_gap_seconds=0, manual_groups=groups)
        sink.process(frame(spark, rows[:3]), 0)
        sink.process(frame(spark, rows[3:]), 1)
        want = group_fights(batch, 0, groups)
        view = lambda df: sorted((r.target, r.fight_id, r.encounter_id, r.manual_name) for r in df.collect())
        assert view(sink.members()) == view(want)
        assert [t for t, *_ in view(want)] == ["Add", "Boss"]


def test_batches_out_of_order_are_an_error(spark, tmp_path):
    sink = FightStream(spark, str(tmp_path / "t"), 15)
    sink.process(frame(spark, [event(5, 0, "melee_hit", actor="A", target="B", amount=9)]), 0)
    with pytest.raises(ValueError, match="before the end"):
        sink.process(frame(spark, [event(4, 1, "melee_hit", actor="A", target="B", amount=9)]), 1)


def test_order_of_chunks_does_not_wrap(spark):
    schema = "file_name string, block_start long, raw string"
    places = [("x.txt.0", 0), ("x.txt.0", 9 << 30), ("x.txt.0", 100 << 30), ("x.txt.1", 0), ("x.txt.900000", 0)]
    got = [ordered_chunks(spark.createDataFrame([(f, b, "x")], schema).coalesce(1)).first().ord for f, b in places]
    assert got == sorted(set(got)) and min(got) >= 0
    for f, b in (("x.txt.0", 200 << 30), ("x.txt.2000000", 0)):
        with pytest.raises(Exception, match="needs more than"):
            ordered_chunks(spark.createDataFrame([(f, b, "x")], schema)).collect()


def test_late_death_reaches_an_earlier_batch(spark, tmp_path):
    first = [event(0, 0, "melee_hit", actor="A", target="B", amount=9), event(1, 16, "melee_hit", actor="A", target="B", amount=9)]
    second = [event(2, 17, "death", actor="A", target="B"), event(3, 25, "death", actor="A", target="B")]
    sink = FightStream(spark, str(tmp_path / "t"), 15)
    sink.process(frame(spark, first), 0)
    assert [r[5] for r in listed(sink.fights(min_damage=0))] == [False, False]
    sink.process(frame(spark, second), 1)
    assert [r[5] for r in listed(sink.fights(min_damage=0))] == [True, True]


def test_idle_fights_close_when_the_log_moves_on(spark, tmp_path):
    first = [event(0, 0, "melee_hit", actor="A", target="B", amount=9), event(1, 16, "unknown", body="x")]
    for idle, want in ((True, 0), (False, 1)):
        sink = FightStream(spark, str(tmp_path / f"t{idle}"), 15, expire_idle=idle)
        sink.process(frame(spark, first), 0)
        assert sink.fights(min_damage=0).where("in_progress").count() == want


def test_batches_with_manual_groups_and_a_lost_attempt(spark, tmp_path, monkeypatch):
    """Kept borders, merged levels and a repeated batch give what one batch job gives."""
    rows = random_rows(21, 110)
    found = detect(frame(spark, rows), Options(min_damage=0)).fights
    keys = [(r.log_id, r.fight_key) for r in found.orderBy("log_id", "fight_id").collect()]
    groups = spark.createDataFrame([(log, i // 8, f"g{i // 8}", i, k) for i, (log, k) in enumerate(keys) if i % 8 in (1, 2)], MANUAL_GROUPS)
    sink = FightStream(spark, str(tmp_path / "t"), 15, encounter_gap_seconds=0, min_damage=0, manual_groups=groups)
    sink.state.fanout = 2
    for b in range(3):
        part = frame(spark, [r for r in rows if b * 37 <= r[1] < (b + 1) * 37])
        if b == 1:
            with monkeypatch.context() as m, pytest.raises(ZeroDivisionError):
                m.setattr(sink.state, "commit", lambda now: 1 / 0)
                sink.process(part, b)
        sink.process(part, b)
    assert listed(sink.fights(min_damage=0)) == listed(found)
    want = group_fights(D.number_fights(found.where(f"close_ord <> {D.OPEN_END}")), 0, groups).collect()
    view = lambda rows: sorted((r.log_id, r.fight_id, r.target, r.encounter_id, r.manual_name or "", r.fight_complete) for r in rows)
    assert view(sink.members().collect()) == view(want) and {r.manual_name for r in want} > {None}
    pointer = sink.state.newest()
    assert pointer.batch == 2 and max(len(e) for e in pointer.tables.values()) <= 2
    assert 0 < sink.state.read(pointer, "members", MEMBERS).count() < len(want)


def test_a_table_of_many_batches_has_few_folders(spark, tmp_path):
    state = StateTables(spark, str(tmp_path / "s"), fanout=3)
    for b in range(20):
        now = Pointer(b, dict(state.newest(b).tables))
        state.add(now, "rows", spark.range(b, b + 1).coalesce(1))
        state.replace(now, "last", spark.range(b, b + 1).coalesce(1))
        if b % 7 == 5:  # lost before its pointer, then repeated
            now = Pointer(b, dict(state.newest(b).tables))
            state.add(now, "rows", spark.range(b, b + 1).coalesce(1))
            state.replace(now, "last", spark.range(b, b + 1).coalesce(1))
        state.commit(now)
    pointer = state.newest()
    assert sorted(r.id for r in state.read(pointer, "rows", "id long").collect()) == list(range(20))
    assert [r.id for r in state.read(pointer, "last", "id long").collect()] == [19]
    assert len(pointer.tables["rows"]) <= 6 and state.newest(19).batch == 18
    assert sum(1 for _ in (tmp_path / "s").glob("rows/*")) <= 12 and sum(1 for _ in (tmp_path / "s").glob("pointers/*.json")) == 2


def test_idle_fights_close_by_the_wall_clock(spark, tmp_path):
    """No line comes after the last hit; beats run the batches that close the fight."""
    import time

    clock = [seconds_of(5)]
    sink = FightStream(spark, str(tmp_path / "t"), 15, clock=lambda: clock[0])
    frame(spark, [event(0, 0, "melee_hit", actor="A", target="B", amount=9), event(1, 5, "zone", zone="z")]).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    query = sink.start(stream, str(tmp_path / "c"), every="0 seconds")
    try:
        def reached(wanted):
            until = time.time() + 120
            while time.time() < until:
                assert query.isActive, query.exception()
                if sink.state.newest().batch >= 0 and [r.in_progress for r in sink.fights(min_damage=0).collect()] == [wanted]:
                    return True
                time.sleep(0.5)
            return False

        assert reached(True)
        clock[0] = seconds_of(30)
        assert reached(False)
    finally:
        query.stop()
    (f,) = sink.all_fights().collect()
    assert (f.close_ord, f.fight_complete) == (1, False)
    # a later hit opens a new fight
    sink.process(frame(spark, [event(2, 40, "melee_hit", actor="A", target="B", amount=9)]), sink.state.newest().batch + 1)
    assert [r[5] for r in listed(sink.fights(min_damage=0))] == [False, False]


def test_active_view(spark, tmp_path):
    log = "eqlog_Ayla_north.txt"
    rows = [
        event(0, 0, "melee_hit", log=log, actor="You", target="Boss", amount=100),
        event(1, 1, "melee_hit", log=log, actor="Ayla`s pet", target="Boss", amount=50),
        event(2, 2, "melee_hit", log=log, actor="Boss", target="YOU", amount=30),
        event(3, 3, "heal", log=log, actor="Cleric", target="you", amount=20),
        event(4, 4, "melee_hit", log=log, actor="You", target="Add", amount=10),
    ]
    sink = FightStream(spark, str(tmp_path / "t"), 15)
    sink.process(frame(spark, rows[:3]), 0)
    sink.process(frame(spark, rows[3:]), 1)
    (v,) = sink.active_view().collect()
    assert (v.target, v.total_damage, v.window_seconds) == ("Boss", 150, 4)
    assert (v.damage_out, v.damage_in, v.healing_in, v.hp_delta_per_sec) == (160, 30, 20, -2)
    top = [(r.place, r.name, r.damage, r.pct, r.is_your_pet) for r in sink.active_top_damage().collect()]
    assert sorted(top) == [(1, "You", 100, 66.7, False), (2, "Ayla`s pet", 50, 33.3, True)]
    assert [(r.place, r.name, r.healing, r.hps) for r in sink.active_top_healing().collect()] == [(1, "Cleric", 20, 5)]


def test_text_chunks_through_structured_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [
        (0, "You slash Boss for 9000 points of damage."),
        (5, "Boss tries to hit YOU, but YOU parry!"),
        (9, "You slash Boss for 2000 points of damage. (Critical)"),
        (12, "You have slain Boss!"),
        (40, "Bo slashes Wolf for 30000 points of damage."),
        (80, "Bo slashes Wolf for 1 point of damage."),
    ]
    import time
    from datetime import timedelta

    for i in range(3):
        text = "".join(f"[{(BASE + timedelta(seconds=s)).strftime(STAMP)}] {b}\r\n" for s, b in lines[2 * i : 2 * i + 2])
        (tmp_path / "in" / f"eqlog_Ayla_north.txt.{i}").write_bytes(text.encode("latin-1"))
        time.sleep(0.05)
    lines = stream_lines(spark, str(tmp_path / "in"), max_files_per_trigger=1)
    sink = FightStream(spark, str(tmp_path / "t"), 15)
    sink.start(lines, str(tmp_path / "c"), available_now=True, from_lines=True).awaitTermination()
    assert [(r[2], r[5], r[6]) for r in listed(sink.fights())] == [("Boss", True, 11_000), ("Wolf", False, 30_000)]


def test_gap_sessions(spark):
    rows = [event(i, t, "melee_hit", actor="A", target="B", amount=1) for i, t in enumerate([0, 15, 31])]
    got = sorted((seconds(r.start), seconds(r.end), r.events) for r in gap_sessions(frame(spark, rows), 15).collect())
    assert got == [(0, 15, 2), (31, 31, 1)]


def test_gap_sessions_over_slices(spark):
    """Sessions longer than a slice, ties, other targets; the same as by the engine's own windows."""
    from pyspark.sql import functions as F

    rng, at, rows = random.Random(3), 0, []
    for i in range(500):
        at += rng.choice([0, 1, 14, 15, 16, 40, 3000]) if i % 100 else 4000
        rows.append(event(i, at, "melee_hit", actor="A", target=rng.choice("BBBC"), amount=i))
    df = frame(spark, rows)
    for gap in (15, 3000):
        want = df.groupBy("target", F.session_window("ts", f"{gap} seconds").alias("w")).agg(F.min("ts"), F.max("ts"), F.count("*"), F.sum("amount")).drop("w")
        got = gap_sessions(df, gap).select("target", "start", "end", "events", "damage")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
