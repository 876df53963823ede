import pytest
from helpers import event, frame, seconds
from pyspark.sql import functions as F

from skirmish.operators import encounters as E
from skirmish.operators import overrides as V
from skirmish.operators import player, sides, stats, timeline
from skirmish.plans.analysis import Options, analyze, detect, group
from skirmish.schema import MANUAL_GROUPS, PET_OWNERS
from skirmish.sources import overrides as files
from skirmish.sources.sinks import (
    coverage_documents, diff_documents, encounter_documents, fight_documents, read_section, session_documents, write_documents,
)

ENC = ("log_id", "encounter_id")


def hit(o, at, actor, target, amount, **k):
    k.setdefault("verb", "slashes")
    return event(o, at, "melee_hit", actor=actor, target=target, amount=amount, **k)


BATTLE = [
    hit(0, 0, "Ann", "Boss", 40_000, modifiers=["Lucky Critical Headshot"]),
    hit(1, 1, "Boss", "Ann", 12_000),
    hit(2, 2, "Imp", "Boss", 20_000),
    event(3, 3, "heal", actor="Cleric", target="Ann", amount=500, spell="Mend", modifiers=["Critical"]),
    event(4, 4, "melee_miss", actor="Boss", target="Ann", outcome="parry"),
    event(5, 4, "melee_miss", actor="Bob", target="Boss", outcome="miss"),
    hit(6, 5, "Vortex", "Ann", 15_000),
    hit(7, 6, "Bob", "Add", 11_000),
    hit(8, 7, "Boss`s corpse", "Ann", 10),
    event(9, 8, "death", actor="Ann", target="Boss", you_died=False),
    event(10, 60, "heal", actor="Cleric", target="Ann", amount=70),
    hit(11, 100, "Ann", "Wolf", 30_000),
    event(12, 101, "death", actor="Ann", target="Wolf", you_died=False),
]


@pytest.fixture(scope="module")
def battle(spark):
    return analyze(frame(spark, BATTLE))


def test_grouping_and_names(battle):
    rows = battle.encounters.orderBy("encounter_id").collect()
    assert [(r.encounter_id, r.name, r.total_damage, r.total_healing, r.fight_complete) for r in rows] == [
        (1, "Boss +2", 98_010, 500, True),
        (2, "Wolf", 30_000, 0, True),
    ]
    assert rows[0].attacker_count == 6 and rows[0].member_count == 3 and rows[0].duration_seconds == 8


def test_heals_outside_are_dropped(battle):
    assert [(r.ord, r.encounter_id) for r in battle.heals.collect()] == [(3, 1)]


def test_manual_group_overrides_time(spark):
    found = detect(frame(spark, BATTLE))
    keys = {r.target: r.fight_key for r in found.fights.collect()}
    groups = spark.createDataFrame(
        [("l", 0, "Phase 1", 0, keys["Wolf"]), ("l", 0, "Phase 1", 1, keys["Boss"]), ("l", 0, "Phase 1", 2, "gone|x"),
         ("l", 1, None, 0, keys["Add"]), ("l", 2, "Later", 0, keys["Boss"]), ("l", 2, "Later", 1, keys["Ann"])],
        MANUAL_GROUPS,
    )
    got = group(found, manual_groups=groups)
    rows = got.encounters.orderBy("encounter_id").collect()
    assert [(r.name, r.member_count) for r in rows] == [("Phase 1 +1", 2), ("Later", 1), ("Add", 1)]
    flags = {r.encounter_id: r.is_manual for r in E.manual_flags(got.members, groups).collect()}
    assert flags == {1: False, 2: False, 3: True}


def test_gap_merges(spark):
    assert analyze(frame(spark, BATTLE), Options(encounter_gap_seconds=92)).encounters.count() == 1
    assert analyze(frame(spark, BATTLE), Options(encounter_gap_seconds=91)).encounters.count() == 2


def test_overlapping_manual_heals_go_to_the_lowest_id(spark):
    members = spark.createDataFrame(
        [("l", 1, 0, 100), ("l", 2, 10, 20), ("l", 3, 90, 150), ("l", 4, 200, 200)],
        "log_id string, encounter_id long, start_t long, end_t long",
    )
    times = [0, 15, 100, 101, 150, 151, 200, 201]
    heals = spark.createDataFrame([("l", i, t) for i, t in enumerate(times)], "log_id string, ord long, t long")
    for width in (7, 60, 1000):
        got = {r.t: r.encounter_id for r in E.assign_heals(heals, members, width).collect()}
        assert got == {0: 1, 15: 1, 100: 1, 101: 3, 150: 3, 200: 4}


def test_sides(battle):
    attackers = stats.attackers(battle.acts, ENC)
    got = sides.encounter_sides(attackers, stats.damage_matrix(battle.acts), battle.members, battle.heals)
    named = {r.actor: r.side for r in got.where("encounter_id = 1").collect()}
    # the vortex is never a target, but hits friendlies only
    assert named["Boss"] == "enemy" and named["Vortex"] == "enemy"
    assert named["Ann"] == named["Imp"] == "friendly" and "Boss`s corpse" not in named


def test_pet_damage_moves_to_the_owner(spark, battle):
    owners = spark.createDataFrame([("l", 0, "IMP", "Other"), ("l", 1, "imp", "Ann")], PET_OWNERS)
    got = analyze(frame(spark, BATTLE), pet_owners=owners)
    before = {r.actor: r.damage for r in stats.attackers(battle.acts, ENC).where("encounter_id = 1").collect()}
    after = {r.actor: r.damage for r in stats.attackers(got.acts, ENC).where("encounter_id = 1").collect()}
    assert "Imp" not in after and after["Ann"] == before["Ann"] + before["Imp"]
    assert sum(after.values()) == sum(before.values())
    sources = {r.source for r in stats.hit_details(got.acts).where("attacker_key = 'ann'").collect()}
    assert sources == {"Headshot", "Imp", "Slashes"}
    raw = {r.attacker for r in stats.raw_attackers(got.acts, got.members).collect()}
    assert "Imp" in raw


@pytest.mark.parametrize("width", [1, 2, 5, 600])
def test_series_add_up(battle, width):
    series = timeline.timeline(battle.acts, width).groupBy("log_id", "fight_id").agg(F.sum("amount").alias("s"))
    both = series.join(battle.members, ["log_id", "fight_id"]).select("s", "total_damage").collect()
    assert len(both) == 4 and all(r.s == r.total_damage for r in both)


def test_long_series_are_packed_in_chunks(spark):
    rows = [hit(0, 0, "Ann", "Boss", 20_000), hit(1, 700, "Ann", "Boss", 1), event(2, 900, "melee_miss", actor="Bob", target="Boss", outcome="miss")]
    acts = analyze(frame(spark, rows), Options(gap_seconds=1000)).acts
    packed = timeline.packed_timeline(acts, 1)
    assert sorted((r.actor, r.chunk, len(r.amount), sum(r.amount)) for r in packed.collect()) == [
        ("Ann", 0, 256, 20_000), ("Ann", 1, 256, 0), ("Ann", 2, 256, 1), ("Ann", 3, 133, 0),
        ("Bob", 0, 256, 0), ("Bob", 1, 256, 0), ("Bob", 2, 256, 0), ("Bob", 3, 133, 0),
    ]


def owner_rows(df):
    return sorted((r.actor, r.owner) for r in df.collect())


def test_owner_edits(spark):
    base = spark.createDataFrame([("l", 0, "Imp", "Ann"), ("l", 1, "IMP", "Bob"), ("l", 2, "Cat", "Dan")], PET_OWNERS)

    def edit(*pairs):
        rows = [("l", i, a, o) for i, (a, o) in enumerate(pairs)]
        return owner_rows(V.set_pet_owners(base, spark.createDataFrame(rows, PET_OWNERS)))

    assert edit(("imp", None)) == [("Cat", "Dan")]
    assert edit((" Cat ", " Eve "), ("  ", "x")) == [("Cat", "Eve"), ("IMP", "Bob"), ("Imp", "Ann")]
    assert edit(("cat", "Eve")) == [("Cat", "Dan"), ("IMP", "Bob"), ("Imp", "Ann"), ("cat", "Eve")]
    assert edit(("imp", ""), ("Imp", "Zed")) == [("Cat", "Dan"), ("Imp", "Zed")]
    with pytest.raises(Exception, match="missing"):
        edit((None, "x"), ("Cat", "Eve"))


def test_merge_and_split(spark):
    base = spark.createDataFrame(
        [("l", 0, "A", i, k) for i, k in enumerate("abc")] + [("l", 1, None, i, k) for i, k in enumerate("de")], MANUAL_GROUPS
    )
    new = spark.createDataFrame([("l", 0, "N", 0, "c"), ("l", 0, "N", 1, "d")], MANUAL_GROUPS)

    def shape(df):
        out = {}
        for r in df.orderBy("group_no", "pos").collect():
            out.setdefault((r.group_no, r.name), []).append(r.fight_key)
        return out

    assert shape(V.merge_groups(base, new)) == {(0, "A"): ["a", "b"], (2, "N"): ["c", "d"]}
    assert shape(V.merge_groups(base, new.where("fight_key = 'c'"))) == {(0, "A"): ["a", "b", "c"], (1, None): ["d", "e"]}
    assert shape(V.split_groups(base, new)) == {(0, "A"): ["a", "b"]}


def test_override_files(spark, tmp_path):
    (tmp_path / "a.txt.overrides.json").write_text(
        '{"version": 1, "pet_owners": {"Onyx Golem": "Ann"},\n "manual_encounters": [{"fight_keys": ["a|t1", "b|t2"], "name": "Phase 1"}]}'
    )
    (tmp_path / "b.txt.overrides.json").write_text("{broken")
    (tmp_path / "c.txt.overrides.json").write_text("[1, 2]")
    (tmp_path / "d.txt.overrides.json").write_text("{}")
    owners, groups = files.load_overrides(spark, str(tmp_path / "*.json"))
    assert [tuple(r) for r in owners.collect()] == [("a.txt", 0, "Onyx Golem", "Ann")]
    assert [tuple(r) for r in groups.orderBy("pos").collect()] == [
        ("a.txt", 0, "Phase 1", 0, "a|t1"), ("a.txt", 0, "Phase 1", 1, "b|t2"),
    ]
    none = files.load_overrides(spark, str(tmp_path / "nothing" / "*.json"))
    assert none[0].count() == none[1].count() == 0
    files.save_overrides(owners, groups, str(tmp_path / "saved"))
    again = files.load_overrides(spark, str(tmp_path / "saved"))
    assert owner_rows(again[0]) == owner_rows(owners)
    assert sorted(map(tuple, again[1].collect())) == sorted(map(tuple, groups.collect()))
    # a save that broke off leaves no marker and changes nothing; the next one counts
    (tmp_path / "saved" / "v=00000002").mkdir()
    (tmp_path / "saved" / "v=00000002" / "part-0.json").write_text('{"log_id": "z", "pet_owners": {"A": "B"}}')
    assert owner_rows(files.load_overrides(spark, str(tmp_path / "saved"))[0]) == owner_rows(owners)
    files.save_overrides(owners.where("false"), groups, str(tmp_path / "saved"))
    newest = files.load_overrides(spark, str(tmp_path / "saved"))
    assert newest[0].count() == 0 and newest[1].count() == groups.count()


def test_documents(spark, battle, tmp_path):
    docs = encounter_documents(battle)
    counts = {r.section: r["count"] for r in docs.groupBy("section").count().collect()}
    assert counts["header"] == 2 and counts["hit"] == 6 and counts["biggest_hit"] == 7
    write_documents(docs, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == docs.count()
    assert fight_documents(battle).where("section = 'header'").count() == 4
    pairs = spark.createDataFrame([("p", "l", 1, "l", 2)], "pair_id string, a_log string, a_encounter long, b_log string, b_encounter long")
    actors = diff_documents(battle, pairs).where("section = 'actor'")
    assert actors.count() == 9


def test_series_of_avoided_swings_and_heals(spark):
    """A pair that only avoids is all zeros; long series go over several rows; heals by pair and by side."""
    rows = [
        event(0, 0, "melee_hit", actor="You", target="Boss", amount=20_000),
        event(1, 1, "melee_miss", actor="Boss", target="Tank", outcome="parry"),
        event(2, 2, "heal", actor="Cleric", target="tank", amount=7),
        event(3, 3, "heal", actor="cleric", target="You", amount=5),
        *(event(4 + i, 10 * i, "melee_hit", actor="You", target="Boss", amount=1) for i in range(1, 140)),
    ]
    a = analyze(frame(spark, rows), Options(gap_seconds=15, min_damage=0))
    got = {(r.attacker_key, r.target_key, r.first_bucket): r.amount for r in timeline.packed_pair_series(a.acts).collect()}
    assert len(got[("you", "boss", 0)]) == 256 and got[("you", "boss", 0)][:3] == [20_000, 0, 1]
    assert len(got[("you", "boss", 256)]) == 23 and sum(got[("you", "boss", 256)]) == 12
    assert set(got[("boss", "tank", 0)]) == {0} and len(got) == 4
    heals = {(r.attacker_key, r.target_key, r.first_bucket): sum(r.amount) for r in timeline.packed_heal_series(a.heals).collect()}
    assert heals == {("cleric", "tank", 0): 7, ("cleric", "you", 0): 5, ("cleric", "tank", 256): 0, ("cleric", "you", 256): 0}
    by_healer = timeline.packed_heal_series(a.heals, who=("actor",)).where("first_bucket = 0").collect()
    assert [(r.attacker_key, r.amount[0]) for r in by_healer] == [("cleric", 12)]
    docs = encounter_documents(a)
    pairs = read_section(docs, "heal_pair", "healer string, target string, damage bigint")
    assert sorted((r.healer, r.target, r.damage) for r in pairs.collect()) == [("Cleric", "You", 5), ("Cleric", "tank", 7)]
    members = read_section(docs, "member", "target string, attacker_count bigint").collect()
    assert sorted((r.target, r.attacker_count) for r in members) == [("Boss", 1), ("Tank", 1)]
    tank = read_section(docs, "defender", "defender string, heals_total bigint").where("defender = 'Tank'").collect()
    assert [r.heals_total for r in tank] == [7]


def test_session_documents(spark, battle):
    docs = session_documents(battle)
    (head,) = read_section(docs, "header", "encounter_count bigint, total_damage bigint").collect()
    totals = [r.total_damage for r in battle.encounters.collect()]
    assert (head.encounter_count, head.total_damage) == (len(totals), sum(totals))
    series = read_section(docs, "series", "mode string, field string, name_key string, amount array<bigint>").collect()
    assert series and all(len(r.amount) == len(totals) for r in series)
    rows = read_section(docs, "actor", "mode string, name_key string, total bigint").collect()
    for r in rows:
        (values,) = [x.amount for x in series if (x.mode, x.field, x.name_key) == (r.mode, "value", r.name_key)]
        assert sum(values) == r.total
    assert {x.field for x in series if x.mode == "tanking"} == {"value", "rate", "heals_value", "heals_rate"}
    none = session_documents(battle, chosen=battle.encounters.where("false").select("log_id", "encounter_id"))
    assert none.count() == 0


def test_recap_lists(spark, battle):
    last = battle.encounters.orderBy("end", ascending=False).first()
    rows = player.recap_top_damage(
        stats.attackers(battle.acts, ENC), stats.defense_pairs(battle.acts, ENC), battle.heals, battle.encounters
    ).collect()
    assert rows and {r.encounter_id for r in rows} == {last.encounter_id}
    assert [r.place for r in rows] == list(range(1, len(rows) + 1))


def test_coverage_documents(spark):
    parsed = spark.createDataFrame(
        [("l", 0, "unknown", "Note 1 of 2"), ("l", 1, "unknown", "Note 33 of 4"), ("l", 2, "zone", None), ("l", 3, None, None), ("m", 0, "zone", None)],
        "log_id string, ord bigint, event_type string, body string",
    )
    docs = coverage_documents(parsed)
    head = read_section(docs, "header", "total_lines bigint, no_timestamp bigint, unknown_lines bigint, unknown_total_groups bigint")
    assert sorted(map(tuple, head.collect())) == [("l", 4, 1, 2, 1), ("m", 1, 0, 0, 0)]
    groups = read_section(docs, "unknown_group", "place bigint, shape string, lines bigint, example string")
    assert [tuple(r) for r in groups.collect()] == [("l", 1, "Note N of N", 2, "Note 1 of 2")]
