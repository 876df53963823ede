"""Small event tables for tests."""

from datetime import datetime, timedelta

from skirmish.schema import EVENTS

BASE = datetime(2025, 4, 14, 19, 0, 0)


def event(ord_, at, kind, *, log="l", actor=None, target=None, amount=None, **more):
    row = {f.name: None for f in EVENTS}
    row.update(
        log_id=log,
        ord=ord_,
        ts=BASE + timedelta(seconds=at),
        event_type=kind,
        actor=actor,
        target=target,
        amount=amount,
    )
    if kind in ("melee_hit", "melee_miss", "spell_damage", "heal"):
        row["modifiers"] = []
    row.update(more)
    return tuple(row[f.name] for f in EVENTS)


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def seconds(ts):
    return int((ts - BASE).total_seconds())
