import random

import pytest
from helpers import event, frame, seconds

from skirmish.operators import fights as D
from skirmish.sources.staging import cut


def detect(spark, rows, gap=15, min_damage=10_000, policy="close", heals=False, **more):
    ev = frame(spark, rows)
    tagged, sessions = D.tag_fights(ev, gap, heals)
    tagged = cut(tagged, "tagged")
    return D.detect_fights(
        ev, tagged, sessions, gap_seconds=gap, min_damage=min_damage, open_policy=policy, **more
    )


def rows_of(df):
    return [
        (r.fight_id, r.target, seconds(r.start), seconds(r.end), r.fight_complete, r.total_damage)
        for r in df.orderBy("log_id", "fight_id").collect()
    ]


def hit(o, at, target="Boss", amount=50_000, actor="Ann", **k):
    return event(o, at, "melee_hit", actor=actor, target=target, amount=amount, **k)


def miss(o, at, target="Boss", actor="Ann", **k):
    return event(o, at, "melee_miss", actor=actor, target=target, outcome="miss", **k)


def death(o, at, target="Boss", **k):
    return event(o, at, "death", actor="Ann", target=target, you_died=False, **k)


def heal(o, at, **k):
    return event(o, at, "heal", actor="Cleric", target="Ann", amount=10, **k)


CASES = {
    "kill": ([hit(0, 0), hit(1, 1, amount=60_000), death(2, 2)], [("Boss", 0, 2, True, 110_000)]),
    "log ends open": ([hit(0, 0), hit(1, 1)], [("Boss", 0, 1, False, 100_000)]),
    "equal gap stays, greater splits": (
        [hit(0, 0), hit(1, 15), hit(2, 31)],
        [("Boss", 0, 15, False, 100_000), ("Boss", 31, 31, False, 50_000)],
    ),
    "misses open and extend": (
        [miss(0, 0), hit(1, 12), miss(2, 24), hit(3, 36), death(4, 37)],
        [("Boss", 0, 37, True, 100_000)],
    ),
    "death has no gap test": ([hit(0, 0), death(1, 500)], [("Boss", 0, 500, True, 50_000)]),
    "targets at the same time, by start": (
        [hit(0, 0), hit(1, 1, target="Add", amount=20_000), death(2, 2, target="Add"), death(3, 5)],
        [("Boss", 0, 5, True, 50_000), ("Add", 1, 2, True, 20_000)],
    ),
    "casing makes two fights": (
        [hit(0, 0, target="A rat"), hit(1, 1, target="a rat")],
        [("A rat", 0, 0, False, 50_000), ("a rat", 1, 1, False, 50_000)],
    ),
    "small, own and pet targets are not listed": (
        [hit(0, 0, target="rat", amount=5), hit(1, 0, target="You"), hit(2, 0, target="Bo`s pet"), hit(3, 0, target="YOU")],
        [("YOU", 0, 0, False, 50_000)],
    ),
    # fight 1 runs out, fight 2 is killed, and a second death completes fight 1
    "late death in time": (
        [hit(0, 0), hit(1, 16), death(2, 17), death(3, 25)],
        [("Boss", 0, 0, True, 50_000), ("Boss", 16, 17, True, 50_000)],
    ),
    "late death too late": (
        [hit(0, 0), hit(1, 16), death(2, 17), death(3, 26)],
        [("Boss", 0, 0, False, 50_000), ("Boss", 16, 17, True, 50_000)],
    ),
}


def test_cases(spark):
    rows = [(log, *r[1:]) for log, (case, _) in CASES.items() for r in case]
    got = {log: [] for log in CASES}
    for r in detect(spark, rows).orderBy("log_id", "fight_id").collect():
        got[r.log_id].append((r.fight_id, r.target, seconds(r.start), seconds(r.end), r.fight_complete, r.total_damage))
    for log, (_, want) in CASES.items():
        assert got[log] == [(i, *w) for i, w in enumerate(want, 1)], log


def test_min_duration(spark):
    assert rows_of(detect(spark, [hit(0, 0), death(1, 5)], min_duration_seconds=10)) == []


def test_open_policies(spark):
    rows = [hit(0, 0), hit(1, 100, target="Other"), event(2, 110, "unknown", body="x")]
    assert [r[1] for r in rows_of(detect(spark, rows))] == ["Boss", "Other"]
    assert [r[1] for r in rows_of(detect(spark, rows, policy="drop"))] == ["Boss"]
    listed = detect(spark, rows, policy="include").orderBy("fight_id").collect()
    assert [(r.target, r.in_progress) for r in listed] == [("Boss", False), ("Other", True)]


def test_single_target(spark):
    rows = [
        hit(0, 0, target="boss"),
        hit(1, 900),
        miss(2, 901),
        death(3, 902, target="BOSS"),
        hit(4, 903),
        death(0, 0, log="m"),
        hit(1, 1, log="m"),
    ]
    got = D.analyze_fight(frame(spark, rows), "Boss").collect()
    assert [(r.log_id, seconds(r.start), seconds(r.end), r.total_damage, r.hits, r.misses) for r in got] == [
        ("l", 0, 902, 100_000, 2, 1)
    ]


# --- property test: random logs against a plain fold ------------------------


def fold(rows, gap, heals_extend, min_damage=0):
    """Row-by-row account of one log: (target, start, end, complete, damage) by start."""
    live, done = {}, []

    def shut(t, end, killed):
        f = live.pop(t)
        f["end"], f["killed"] = end, killed
        done.append(f)

    def check(t, now):
        if t in live and now - live[t]["seen"] > gap:
            shut(t, live[t]["seen"], False)

    for kind, at, target, amount in rows:
        if kind in ("hit", "miss"):
            check(target, at)
            f = live.setdefault(target, dict(target=target, start=at, seen=at, damage=0))
            f["seen"] = at
            f["damage"] += amount
        elif kind == "death":
            if target in live:
                shut(target, at, True)
            else:
                # the newest incomplete fight of the target behind all that ended too long ago
                barrier = max((i for i, f in enumerate(done) if at - f["end"] > gap + 10), default=-1)
                waiting = [f for f in done[barrier + 1 :] if f["target"] == target and not f["killed"]]
                if waiting:
                    waiting[-1]["killed"] = True
        elif heals_extend:
            for t in list(live):
                check(t, at)
            for f in live.values():
                f["seen"] = max(f["seen"], at)
    for t in list(live):
        shut(t, live[t]["seen"], False)
    kept = sorted((f for f in done if f["damage"] >= min_damage and f["end"] >= f["start"]), key=lambda f: f["start"])
    return [(f["target"], f["start"], f["end"], f["killed"], f["damage"]) for f in kept]


@pytest.mark.parametrize(
    "gap,heals_extend,slice_bits,falling",
    [(3, False, 2, False), (12, False, 20, False), (3, True, 20, False), (12, True, 2, False), (3, False, 20, True), (12, False, 2, True)],
)
def test_random_logs_match_the_fold(spark, monkeypatch, gap, heals_extend, slice_bits, falling):
    """``falling``: the clock is set back now and then, by seconds or by more than a fight."""
    monkeypatch.setattr("skirmish.functions.sliced.SLICE_BITS", slice_bits)
    monkeypatch.setattr("skirmish.operators.fights.BLOCK_BITS", slice_bits // 10 + 1)
    rng = random.Random(f"{gap}{heals_extend}{falling}")
    rows, want = [], {}
    for n in range(400):
        log, at, plain = f"log{n:04d}", 0, []
        for o in range(rng.randint(5, 40)):
            at += rng.choice([0, 0, 1, 1, 2, 3, 4, 5, 8, 13])
            if falling and rng.random() < 0.12:
                at -= rng.choice([1, 5, 20, 60])
            kind = rng.choice(["hit", "hit", "miss", "death", "heal"])
            target = rng.choice(["a", "b", "c"])
            amount = rng.randint(1, 9) if kind == "hit" else 0
            plain.append((kind, at, target, amount))
            make = {
                "hit": lambda: hit(o, at, target=target, amount=amount, log=log),
                "miss": lambda: miss(o, at, target=target, log=log),
                "death": lambda: death(o, at, target=target, log=log),
                "heal": lambda: heal(o, at, log=log),
            }[kind]
            rows.append(make())
        want[log] = fold(plain, gap, heals_extend)
    got = {log: [] for log in want}
    for r in (
        detect(spark, rows, gap=gap, min_damage=0, heals=heals_extend)
        .orderBy("log_id", "fight_id")
        .collect()
    ):
        got[r.log_id].append(
            (r.target, seconds(r.start), seconds(r.end), r.fight_complete, r.total_damage)
        )
    wrong = [log for log in want if got[log] != want[log]]
    assert not wrong, (len(wrong), want[wrong[0]], got[wrong[0]])
