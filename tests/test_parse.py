from datetime import datetime

import pytest

from skirmish.operators.coverage import line_counts, shape_totals, top_shapes, unknown_shapes
from skirmish.operators.parse import parse_lines
from skirmish.sources.logs import last_stamp, ordered_chunks, read_lines, since_hours, with_character

STAMP = "[Mon Apr 14 19:37:24 2025] "


def hit(actor, verb, target, amount, *mods):
    return dict(event_type="melee_hit", actor=actor, verb=verb, target=target, amount=amount, modifiers=list(mods))


def miss(actor, verb, target, outcome, *mods):
    return dict(event_type="melee_miss", actor=actor, verb=verb, target=target, outcome=outcome, modifiers=list(mods))


def spell(actor, target, amount, kind, name, *mods):
    return dict(event_type="spell_damage", actor=actor, target=target, amount=amount, damage_type=kind, spell=name,
                modifiers=list(mods))


def heal(actor, target, amount, name=None, *mods):
    return dict(event_type="heal", actor=actor, target=target, amount=amount, spell=name, modifiers=list(mods))


def death(target, actor, you=False):
    return dict(event_type="death", target=target, actor=actor, you_died=you)


def unknown(body):
    return dict(event_type="unknown", body=body)


CASES = [
    ("You slash Old Grizzle for 282413 points of damage. (Critical)", hit("You", "slash", "Old Grizzle", 282413, "Critical")),
    ("You hit a rat for 1 point of damage.", hit("You", "hit", "a rat", 1)),
    ("Rowan slashes  Sig Windwalker for 245 points of damage. (Riposte)", hit("Rowan", "slashes", "Sig Windwalker", 245, "Riposte")),
    ("A Vale Sentry  punches Rim for 3 points of damage.", hit("A Vale Sentry", "punches", "Rim", 3)),
    ("Tol, Last Word hits Rowan for 31158 points of damage. (Riposte Strikethrough)",
     hit("Tol, Last Word", "hits", "Rowan", 31158, "Riposte Strikethrough")),
    ("a lava crab frenzies on Rowan for 7 points of damage. (Lucky Critical) (Twincast)",
     hit("a lava crab", "frenzies on", "Rowan", 7, "Lucky Critical", "Twincast")),
    ("Rowan`s pet slashes Old Grizzle for 54 points of damage.", hit("Rowan`s pet", "slashes", "Old Grizzle", 54)),
    ("Cor-Thul backstabs D'Vinn for 9 points of damage.", hit("Cor-Thul", "backstabs", "D'Vinn", 9)),
    ("You try to slash a rat, but miss!", miss("You", "slash", "a rat", "miss")),
    ("A rat tries to hit YOU, but YOU parry! (Rampage)", miss("A rat", "hit", "YOU", "parry", "Rampage")),
    ("A rat tries to bite Rowan, but misses!", miss("A rat", "bite", "Rowan", "miss")),
    ("A rat tries to bite Rowan, but fails!", miss("A rat", "bite", "Rowan", "miss")),
    ("A rat tries to bite Rowan, but Rowan ripostes!", miss("A rat", "bite", "Rowan", "riposte")),
    ("You try to hit a foot soldier, but a foot soldier dodges!", miss("You", "hit", "a foot soldier", "dodge")),
    ("A rat tries to bite Tira, but Tira blocks with her shield!", miss("A rat", "bite", "Tira", "block")),
    ("A rat tries to bite YOU, but YOUR magical skin absorbs the blow!", miss("A rat", "bite", "YOU", "rune")),
    ("A rat tries to bite Rowan, but Rowan is INVULNERABLE!", miss("A rat", "bite", "Rowan", "invulnerable")),
    ("Onyx hit a foot soldier for 14605 points of fire damage by Flame VII.", spell("Onyx", "a foot soldier", 14605, "fire", "Flame VII")),
    ("You hit a rat for 10 points of cold damage by Ice. (Critical)", spell("You", "a rat", 10, "cold", "Ice", "Critical")),
    ("an ember mage hit Rowan for 9 points of magic damage by Spark.", spell("an ember mage", "Rowan", 9, "magic", "Spark")),
    ("Rowan has been hit by Sol for 1234 points of cold damage by Strike of Ice.",
     unknown("Rowan has been hit by Sol for 1234 points of cold damage by Strike of Ice.")),
    ("You have taken 152563 damage from Gouging Strike by Feather Sheen.", spell("Feather Sheen", "You", 152563, "dot", "Gouging Strike")),
    ("A rat has taken 5 damage from Mt. Fire by You.", spell("You", "A rat", 5, "dot", "Mt. Fire")),
    ("A hawk is pierced by YOUR thorns for 298136 points of non-melee damage.", spell("You", "A hawk", 298136, "non-melee", "thorns")),
    ("A hawk is burned by Rowan's flames for 26 points of non-melee damage.", spell("Rowan", "A hawk", 26, "non-melee", "flames")),
    ("Rowan was chilled to the bone for 45 points of non-melee damage. (Critical)", spell("(unattributed)", "Rowan", 45, "non-melee", None)),
    ("You were hit by non-melee for 10 damage.", spell("(unattributed)", "You", 10, "non-melee", None)),
    ("You take 7 points of falling damage.", spell("(falling)", "You", 7, "falling", None)),
    ("Pain and suffering strikes you for 9 damage!", spell("(unconscious)", "You", 9, "unconscious", "Pain and suffering")),
    ("An imp resisted your Rime's Binding!", dict(event_type="resist", actor="You", target="An imp", spell="Rime's Binding")),
    ("Rowan healed Hac for 8000 (12000) hit points by Healing Light.", heal("Rowan", "Hac", 8000, "Healing Light")),
    ("You have healed Rowan over time for 5 hit points.", heal("You", "Rowan", 5)),
    ("Rowan healed herself for 5 hit points by Mend. (Critical)", heal("Rowan", "Rowan", 5, "Mend", "Critical")),
    ("Lun has been healed over time by Rowan for 86000 hit points by Touch.", heal("Rowan", "Lun", 86000, "Touch")),
    ("Hac`s pet has been healed for 0 (45000) hit points by Theft XVI.", heal("Hac`s pet", "Hac`s pet", 0, "Theft XVI")),
    ("Old Grizzle has been slain by Rowan!", death("Old Grizzle", "Rowan")),
    ("a rat was slain by Rowan!", death("a rat", "Rowan")),
    ("You have been slain by Old Grizzle!", death("You", "Old Grizzle", True)),
    ("You have slain Pli!", death("Pli", "You")),
    ("You have entered Ka Veth.", dict(event_type="zone", zone="Ka Veth")),
    ("You have entered an area where levitation fails.", unknown("You have entered an area where levitation fails.")),
    ("You say, 'hello'", unknown("You say, 'hello'")),
]


def test_every_form(spark):
    rows = [("l", i, STAMP + body + "\r") for i, (body, _) in enumerate(CASES)]
    got = parse_lines(spark.createDataFrame(rows, "log_id string, ord long, raw string")).orderBy("ord").collect()
    assert len(got) == len(CASES)
    for row, (body, want) in zip(got, CASES):
        seen = {k: v for k, v in row.asDict().items() if v is not None and k not in ("log_id", "ord", "ts", "raw")}
        assert seen == {k: v for k, v in want.items() if v is not None}, body
        assert row.ts == datetime(2025, 4, 14, 19, 37, 24)
        assert row.raw == STAMP + body


def test_envelope(spark):
    lines = ["", "   ", "no stamp", STAMP + "x", "[Mon Apr  4 01:02:03 2025] padded", "[Mon Foo 14 19:37:24 2025] x",
             "[Xyz Apr 14 19:37:24 2025] x", "[Mon Apr 31 19:37:24 2025] x", "[Mon Apr 14 19:37:24 2025]"]
    df = spark.createDataFrame([("l", i, s) for i, s in enumerate(lines)], "log_id string, ord long, raw string")
    assert [(r.ord, r.body, r.ts.day) for r in parse_lines(df).orderBy("ord").collect()] == [(3, "x", 14), (4, "padded", 4)]
    counts = line_counts(parse_lines(df, keep_unstamped=True)).first()
    assert (counts.total_lines, counts.no_timestamp, counts.unknown_lines) == (9, 7, 2)


def test_long_body_with_quotes_is_linear(spark):
    body = "a" + "'b`" * 20000 + " hit damage by  of damage."
    df = spark.createDataFrame([("l", 0, STAMP + body)], "log_id string, ord long, raw string")
    assert parse_lines(df).first().event_type == "unknown"


def test_shapes(spark):
    bodies = ["hit 12 of 3", "other", "hit 4 of 55", "hit x"]
    df = spark.createDataFrame([("l", i, STAMP + b) for i, b in enumerate(bodies)], "log_id string, ord long, raw string")
    events = parse_lines(df)
    shapes = unknown_shapes(events)
    top = [(r.place, r["shape"], r.lines, r.example) for r in top_shapes(events, 2).orderBy("place").collect()]
    assert top == [(1, "hit N of N", 2, "hit 12 of 3"), (2, "other", 1, "other")]
    assert shape_totals(shapes).first()[1:] == (3, 4)


@pytest.fixture()
def log_file(tmp_path):
    path = tmp_path / "eqlog_Ayla_north.txt"
    body = STAMP + "caf\xe9 one\r\n" + "lone\rreturn\n\n" + "[Mon Apr 14 23:37:24 2025] two\r\n" + "[Mon Apr 14 22:00:00 2025] last, no line end"
    path.write_bytes(body.encode("latin-1"))
    return str(path)


def test_read_lines(spark, log_file):
    lines = read_lines(spark, log_file)
    got = [r.raw for r in lines.orderBy("ord").collect()]
    assert got == [STAMP + "caf\xe9 one\r", "lone\rreturn", "", "[Mon Apr 14 23:37:24 2025] two\r",
                   "[Mon Apr 14 22:00:00 2025] last, no line end"]
    events = parse_lines(lines)
    assert with_character(events).first().char_name == "Ayla"
    assert last_stamp(events).first().last_ts == datetime(2025, 4, 14, 22)
    kept = since_hours(events, 1.0).orderBy("ord").collect()
    assert [r.body for r in kept] == ["two", "last, no line end"]
    assert since_hours(events, 0).count() == 3


def test_order_across_blocks(spark, tmp_path):
    path = tmp_path / "big.txt"
    with open(path, "w") as f:
        for i in range(400_000):
            f.write(f"{i:07d} some filler text\n")
    lines = read_lines(spark, str(path))
    assert lines.rdd.getNumPartitions() > 1
    n = lines.selectExpr("int(substr(raw, 1, 7)) AS i", "ord")
    assert n.selectExpr("corr(i, ord) AS c", "count(DISTINCT ord) AS d").first().d == 400_000
    wrong = n.selectExpr("i", "row_number() OVER (ORDER BY ord) - 1 AS r").where("i <> r").count()
    assert wrong == 0


def test_chunk_order(spark):
    df = spark.createDataFrame([("a.txt.2", 5, "x"), ("a.txt.10", 1, "y"), ("b.txt", 3, "z")], "file_name string, block_start long, raw string")
    got = ordered_chunks(df).orderBy("log_id", "ord").collect()
    assert [(r.log_id, r.raw) for r in got] == [("a.txt", "x"), ("a.txt", "y"), ("b.txt", "z")]
