"""From events to the tables every report reads.

``detect`` finds the fights once; ``group`` applies the user's overrides and builds encounters, so a
changed override re-runs only from there. The combat rows, fights and heals are written once (see
``sources.staging``) and every report branches from those tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.functions import scalars as S
from skirmish.operators import encounters as E
from skirmish.operators import fights as D
from skirmish.operators import overrides as V
from skirmish.sources.logs import since_hours
from skirmish.sources.staging import cut


@dataclass(frozen=True)
class Options:
    gap_seconds: int = 15
    min_damage: int = 10_000
    min_duration_seconds: int = 0
    heals_extend_fights: bool = False
    open_policy: str = "close"
    since_hours: float = 0
    encounter_gap_seconds: int = 0
    specials: Sequence[str] = S.DEFAULT_SPECIALS


@dataclass(frozen=True)
class Detected:
    options: Options
    events: DataFrame
    tagged: DataFrame
    fights: DataFrame


@dataclass(frozen=True)
class Analysis:
    """``members``: fights with encounter ids; ``acts``: their hits and misses; ``heals``: assigned."""

    options: Options
    members: DataFrame
    acts: DataFrame
    heals: DataFrame
    encounters: DataFrame


def detect(events: DataFrame, options: Options = Options()) -> Detected:
    events = since_hours(events, options.since_hours)
    tagged, sessions = D.tag_fights(events, options.gap_seconds, options.heals_extend_fights)
    tagged = cut(tagged, "tagged")
    fights = D.detect_fights(
        events,
        tagged,
        sessions,
        gap_seconds=options.gap_seconds,
        min_damage=options.min_damage,
        min_duration_seconds=options.min_duration_seconds,
        open_policy=options.open_policy,
    )
    return Detected(options, events, tagged, cut(fights, "fights"))


def group(
    found: Detected, pet_owners: DataFrame | None = None, manual_groups: DataFrame | None = None
) -> Analysis:
    options = found.options
    members = cut(
        E.group_fights(found.fights, options.encounter_gap_seconds, manual_groups), "members"
    )
    spans = members.join(E.encounter_bounds(members), list(E.ENCOUNTER)).select(
        *D.FIGHT,
        "fight_id",
        "encounter_id",
        F.col("start_t").alias("fight_start_t"),
        F.col("end_t").alias("fight_end_t"),
        "enc_start_t",
        "enc_end_t",
    )
    rows = found.tagged.where(~F.col("is_death")).join(spans, list(D.FIGHT))
    rows = V.apply_pet_owners(rows, pet_owners)
    acts = rows.select(
        "log_id", "fight_id", "encounter_id", "ord", "ts", "t", "event_type", "actor", "raw_actor",
        "pet_origin", "target", "amount", "verb", "spell", "damage_type", "outcome", "modifiers",
        F.when(F.col("event_type") != "melee_miss", S.specials("modifiers", options.specials)).alias("specials"),
        "fight_start_t", "fight_end_t", "enc_start_t", "enc_end_t",
    )
    acts = cut(acts, "acts")
    heal_rows = found.events.where(F.col("event_type") == "heal").select(
        "log_id", "ord", "ts", S.epoch("ts").alias("t"), "actor", "target", "amount", "spell", "modifiers",
    )
    # Encounters last some gaps, so the bins of the heal join scale with the gap.
    width = max(E.BIN_SECONDS, 4 * options.gap_seconds)
    heals = cut(E.assign_heals(V.apply_pet_owners(heal_rows, pet_owners), members, width), "heals")
    return Analysis(options, members, acts, heals, cut(E.encounters(members, acts, heals), "encounters"))


def analyze(
    events: DataFrame,
    options: Options = Options(),
    pet_owners: DataFrame | None = None,
    manual_groups: DataFrame | None = None,
) -> Analysis:
    return group(detect(events, options), pet_owners, manual_groups)


def analyze_target(
    events: DataFrame,
    target: str,
    pet_owners: DataFrame | None = None,
    specials: Sequence[str] = S.DEFAULT_SPECIALS,
) -> DataFrame:
    """The rows of one named target's fight per log, in the layout of ``Analysis.acts``.

    Feeds the per-fight statistics, series and top hits; each log has one fight, number 1.
    """
    rows = D.single_target(events, target)
    spans = D.analyze_fight(events, target).select(
        "log_id",
        S.epoch("start").alias("fight_start_t"),
        S.epoch("end").alias("fight_end_t"),
    )
    rows = V.apply_pet_owners(rows.join(spans, "log_id"), pet_owners)
    return rows.select(
        "log_id", F.lit(1).cast("long").alias("fight_id"), "ord", "ts", S.epoch("ts").alias("t"), "event_type", "actor",
        "raw_actor", "pet_origin", "target", "amount", "verb", "spell", "damage_type", "outcome", "modifiers",
        F.when(F.col("event_type") != "melee_miss", S.specials("modifiers", specials)).alias("specials"),
        "fight_start_t", "fight_end_t",
    )
