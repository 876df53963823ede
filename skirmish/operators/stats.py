"""Aggregates over the combat rows of fights or encounters.

``by`` names the grouping: ``("log_id", "fight_id")`` or ``("log_id", "encounter_id")``. All are
plain hash aggregations, so every group is pre-aggregated before its shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions import scalars as S

FIGHT_ID = ("log_id", "fight_id")
ENCOUNTER = ("log_id", "encounter_id")


def _hit():
    return F.col("event_type") != "melee_miss"


def _sum(c="amount"):
    return F.coalesce(F.sum(c), F.lit(0))


def _merged(per_fight: DataFrame, by: Sequence[str], keys: Sequence[str], peak: str) -> DataFrame:
    """Per-fight rows merged into ``by``: sums, the peak's maximum, and the earliest place.

    Names count as met by fight, then by position. Rows are reduced per fight first, where all
    buffers are plain numbers and the aggregation hashes; the struct is left to the few rows here.
    """
    sums = [c for c in per_fight.columns if c not in {*by, *keys, peak, "fight_id", "first_ord"}]
    return per_fight.groupBy(*by, *keys).agg(
        *[F.sum(c).alias(c) for c in sums],
        F.max(peak).alias(peak),
        F.min(F.struct("fight_id", "first_ord")).alias("first_seen"),
    )


def attackers(acts: DataFrame, by: Sequence[str] = FIGHT_ID, who: str = "actor") -> DataFrame:
    """Per attacker: damage, hits, misses, crits, biggest hit; miss-only attackers keep a row."""
    rows = acts.groupBy(*dict.fromkeys([*by, "fight_id", who])).agg(
        _sum().alias("damage"),
        F.count_if(_hit()).alias("hits"),
        F.count_if(~_hit()).alias("misses"),
        F.count_if(_hit() & S.is_crit("modifiers")).alias("crits"),
        F.coalesce(F.max("amount"), F.lit(0)).alias("biggest"),
        F.min("ord").alias("first_ord"),
    )
    if "fight_id" in by:
        return rows.withColumn("first_seen", F.struct("fight_id", "first_ord")).drop("first_ord")
    return _merged(rows, by, [who], "biggest")


def attacker_shares(rows: DataFrame, totals: DataFrame, by: Sequence[str] = FIGHT_ID) -> DataFrame:
    """Rates and percentages of attacker rows; ``totals`` gives duration and damage per group."""
    t = totals.select(*by, "duration_seconds", F.col("total_damage").alias("_total"))
    return rows.join(t, list(by)).select(
        *rows.columns,
        S.whole(S.actor_rate("damage", "duration_seconds")).alias("dps"),
        S.pct_of("damage", "_total").alias("pct_of_total"),
    )


def without_corpses(rows: DataFrame, by: Sequence[str] = ENCOUNTER) -> DataFrame:
    """Attacker rows without corpses; percentages refer to the rows that are left."""
    left = rows.where(~S.is_corpse("actor"))
    total = left.groupBy(*by).agg(F.sum("damage").alias("_shown"))
    return left.join(total, list(by)).withColumn("pct_of_total", S.pct_of("damage", "_shown")).drop(
        "_shown"
    )


def special_stats(acts: DataFrame, by: Sequence[str] = FIGHT_ID) -> DataFrame:
    """Per attacker and special: hits and damage; a hit counts for each of its specials."""
    rows = acts.where(_hit()).select(*by, "actor", "amount", F.explode("specials").alias("special"))
    per = rows.groupBy(*by, "actor", "special").agg(
        F.count("*").alias("hits"), F.sum("amount").alias("damage")
    )
    whole = acts.groupBy(*by, "actor").agg(_sum().alias("_damage"))
    return per.join(whole, [*by, "actor"]).select(
        *by,
        "actor",
        "special",
        "hits",
        "damage",
        F.when(F.col("_damage") == 0, 0.0)
        .otherwise(S.pct_of("damage", "_damage"))
        .alias("pct_of_attacker"),
    )


def defense_pairs(acts: DataFrame, by: Sequence[str] = FIGHT_ID) -> DataFrame:
    """Per attacker and defender: damage taken, hits, biggest hit, avoided swings by outcome."""
    avoided = [
        F.count_if(~_hit() & (F.col("outcome") == o)).alias(f"avoided_{o}") for o in S.OUTCOMES
    ]
    rows = acts.groupBy(*dict.fromkeys([*by, "fight_id", "actor", "target"])).agg(
        _sum().alias("damage_taken"),
        F.count_if(_hit()).alias("hits_landed"),
        F.coalesce(F.max("amount"), F.lit(0)).alias("biggest_taken"),
        *avoided,
        F.count_if(~_hit()).alias("total_avoided"),
        F.count("*").alias("total_swings"),
        F.min("ord").alias("first_ord"),
    )
    if "fight_id" in by:
        return rows.withColumn("first_seen", F.struct("fight_id", "first_ord")).drop("first_ord")
    return _merged(rows, by, ["actor", "target"], "biggest_taken")


def session_totals(encounters: DataFrame) -> DataFrame:
    """Per log: encounters, kills and damage."""
    return encounters.groupBy("log_id").agg(
        F.count("*").alias("encounter_count"),
        F.count_if("fight_complete").alias("killed_count"),
        _sum("total_damage").alias("total_damage"),
    )


def heals_by_name(heals: DataFrame) -> DataFrame:
    """Per encounter and exact healer name."""
    return heals.groupBy(*ENCOUNTER, "actor").agg(
        F.sum("amount").alias("amount"),
        F.count("*").alias("casts"),
        F.count_if(S.is_heal_crit("modifiers")).alias("crits"),
        F.max("amount").alias("biggest"),
        F.min("ord").alias("first_ord"),
        F.first(F.col("enc_end_t") - F.col("enc_start_t")).alias("duration_seconds"),
    )


def healers(heals: DataFrame) -> DataFrame:
    """Per encounter and healer (any casing): amount, casts, crits, biggest, rate and share."""
    per = heals_by_name(heals).groupBy(*ENCOUNTER, S.fold("actor").alias("healer_key")).agg(
        F.min_by("actor", "first_ord").alias("healer"),
        F.sum("amount").alias("amount"),
        F.sum("casts").alias("casts"),
        F.sum("crits").alias("crits"),
        F.max("biggest").alias("biggest"),
        F.first("duration_seconds").alias("_d"),
    )
    total = per.groupBy(*ENCOUNTER).agg(F.sum("amount").alias("_total"))
    per = per.join(total, list(ENCOUNTER))
    return per.select(
        *ENCOUNTER,
        "healer_key",
        "healer",
        "amount",
        "casts",
        "crits",
        "biggest",
        S.whole(S.actor_rate("amount", "_d")).alias("hps"),
        S.pct_of("amount", "_total").alias("pct_of_total"),
    )


def healer_spells(heals: DataFrame) -> DataFrame:
    return heals.groupBy(
        *ENCOUNTER, S.fold("actor").alias("healer_key"), F.coalesce("spell", F.lit("Heal")).alias("spell")
    ).agg(F.sum("amount").alias("amount"), F.count("*").alias("casts"))


def canonical_names(acts: DataFrame) -> DataFrame:
    """First spelling of every name met in the non-corpse hits of an encounter."""
    pairs = _matrix_hits(acts).groupBy(*ENCOUNTER, "fight_id", "actor", "target").agg(
        F.min("ord").alias("ord")
    )
    names = pairs.select(
        *ENCOUNTER,
        F.explode(
            F.array(
                F.struct(F.col("actor").alias("name"), "fight_id", "ord", F.lit(0).alias("role")),
                F.struct(F.col("target").alias("name"), "fight_id", "ord", F.lit(1).alias("role")),
            )
        ).alias("n"),
    )
    return names.groupBy(*ENCOUNTER, S.fold("n.name").alias("name_key")).agg(
        F.min_by("n.name", F.struct("n.fight_id", "n.ord", "n.role")).alias("name")
    )


def _matrix_hits(acts: DataFrame) -> DataFrame:
    return acts.where(_hit() & ~S.is_corpse("actor") & ~S.is_corpse("target"))


def damage_matrix(acts: DataFrame) -> DataFrame:
    """Per encounter, attacker and target (any casing): damage and hits."""
    return (
        _matrix_hits(acts)
        .groupBy(*ENCOUNTER, S.fold("actor").alias("attacker_key"), S.fold("target").alias("target_key"))
        .agg(F.sum("amount").alias("damage"), F.count("*").alias("hits"))
    )


def hit_details(acts: DataFrame) -> DataFrame:
    """The single hits behind the damage matrix."""
    return _matrix_hits(acts).select(
        *ENCOUNTER,
        "ord",
        S.fold("actor").alias("attacker_key"),
        S.fold("target").alias("target_key"),
        (F.col("t") - F.col("enc_start_t")).alias("offset_s"),
        F.col("amount").alias("damage"),
        F.col("modifiers").alias("mods"),
        F.when(F.col("event_type") == "melee_hit", "melee").otherwise("spell").alias("kind"),
        "spell",
        S.hit_source().alias("source"),
    )


def heal_details(heals: DataFrame) -> DataFrame:
    """The single heals of an encounter; ``received_source`` labels them on the receiver's list."""
    return heals.select(
        *ENCOUNTER,
        "ord",
        S.fold("actor").alias("attacker_key"),
        S.fold("target").alias("target_key"),
        (F.col("t") - F.col("enc_start_t")).alias("offset_s"),
        F.col("amount").alias("damage"),
        F.col("modifiers").alias("mods"),
        "spell",
        S.heal_source().alias("source"),
        F.col("actor").alias("received_source"),
    )


def heal_matrix(heals: DataFrame) -> DataFrame:
    """Per encounter, healer and target (any casing): amount and casts."""
    return heals.groupBy(
        *ENCOUNTER, S.fold("actor").alias("attacker_key"), S.fold("target").alias("target_key")
    ).agg(F.sum("amount").alias("damage"), F.count("*").alias("hits"))


def heal_pairs(heals: DataFrame) -> DataFrame:
    """``heal_matrix`` with the first spelling of each name among the encounter's heals."""
    first = heals.groupBy(*ENCOUNTER, "actor", "target").agg(F.min("ord").alias("ord"))
    met = first.select(
        *ENCOUNTER,
        F.explode(
            F.array(
                F.struct(F.col("actor").alias("name"), "ord", F.lit(0).alias("role")),
                F.struct(F.col("target").alias("name"), "ord", F.lit(1).alias("role")),
            )
        ).alias("n"),
    )
    names = met.groupBy(*ENCOUNTER, S.fold("n.name").alias("_key")).agg(
        F.min_by("n.name", F.struct("n.ord", "n.role")).alias("_name")
    )
    out = heal_matrix(heals)
    for key, name in (("attacker_key", "healer"), ("target_key", "target")):
        out = out.join(names.select(*ENCOUNTER, F.col("_key").alias(key), F.col("_name").alias(name)), [*ENCOUNTER, key])
    return out


def healed_defenders(defenders: DataFrame, heals: DataFrame) -> DataFrame:
    """Defenders with the heals they received; those without any count 0."""
    out = defenders.join(heals_received(heals), [*ENCOUNTER, "defender_key"], "left")
    return out.fillna(0, ["heals_total", "heals_count"])


def directed_breakdown(rows: DataFrame, matrix: DataFrame, names: DataFrame) -> DataFrame:
    """Matrix cells under each listed actor, as ``dealt_to`` and ``taken_from``."""
    listed = rows.select(*ENCOUNTER, "actor", S.fold("actor").alias("_who"))
    cells = matrix.select(
        *ENCOUNTER,
        "damage",
        "hits",
        F.explode(
            F.array(
                F.struct(F.col("attacker_key").alias("me"), F.col("target_key").alias("other"),
                         F.lit("dealt_to").alias("direction")),
                F.struct(F.col("target_key").alias("me"), F.col("attacker_key").alias("other"),
                         F.lit("taken_from").alias("direction")),
            )
        ).alias("c"),
    ).select(*ENCOUNTER, "damage", "hits", F.col("c.me").alias("_who"), F.col("c.other").alias("name_key"),
             F.col("c.direction").alias("direction"))
    out = listed.join(cells, [*ENCOUNTER, "_who"]).join(names, [*ENCOUNTER, "name_key"])
    return out.select(*ENCOUNTER, "actor", "direction", F.col("name").alias("other"), "damage", "hits")


def defender_pairs(acts: DataFrame, sides: DataFrame) -> DataFrame:
    """Attacker rows under each non-enemy defender, corpses left out."""
    pairs = defense_pairs(acts, ENCOUNTER).where(~S.is_corpse("actor") & ~S.is_corpse("target"))
    enemies = sides.where(F.col("side") == "enemy").select(
        *ENCOUNTER, F.col("name_key").alias("defender_key")
    )
    return pairs.withColumn("defender_key", S.fold("target")).join(
        enemies, [*ENCOUNTER, "defender_key"], "left_anti"
    )


def defenders(acts: DataFrame, sides: DataFrame) -> DataFrame:
    """Per friendly defender: damage taken, hits, biggest hit, avoidance by outcome, avoid %."""
    outcomes = [F.sum(f"avoided_{o}").alias(f"avoided_{o}") for o in S.OUTCOMES]
    out = (
        defender_pairs(acts, sides)
        .groupBy(*ENCOUNTER, "defender_key")
        .agg(
            F.min_by("target", "first_seen").alias("defender"),
            F.sum("damage_taken").alias("damage_taken"),
            F.sum("hits_landed").alias("hits_landed"),
            F.max("biggest_taken").alias("biggest_taken"),
            *outcomes,
            F.sum("total_avoided").alias("total_avoided"),
            F.sum("total_swings").alias("total_swings"),
        )
    )
    return out.withColumn("avoid_pct", S.avoid_pct("total_avoided", "hits_landed"))


def heals_received(heals: DataFrame) -> DataFrame:
    return heals.groupBy(*ENCOUNTER, S.fold("target").alias("defender_key")).agg(
        F.sum("amount").alias("heals_total"), F.count("*").alias("heals_count")
    )


def source_breakdown(
    details: DataFrame, start_bucket: int | None = None, end_bucket: int | None = None, width: int = 5
) -> DataFrame:
    """Damage and hits per pair and source label, optionally inside a range of buckets."""
    if start_bucket is not None:
        details = in_bucket_range(details, start_bucket, end_bucket, width)
    return details.groupBy(*ENCOUNTER, "attacker_key", "target_key", "source").agg(
        F.sum("damage").alias("damage"), F.count("*").alias("hits")
    )


def in_bucket_range(details: DataFrame, start_bucket: int, end_bucket: int, width: int) -> DataFrame:
    return details.where(
        (F.col("offset_s") >= start_bucket * width) & (F.col("offset_s") < (end_bucket + 1) * width)
    )


def with_source(details: DataFrame, source: str | None) -> DataFrame:
    return details if source is None else details.where(F.col("source") == source)


def raw_attackers(acts: DataFrame, members: DataFrame) -> DataFrame:
    """Attackers under their written names, with the plain received-over-dealt side."""
    dealt = acts.groupBy(*ENCOUNTER, "raw_actor").agg(_sum().alias("damage")).where(
        ~S.is_corpse("raw_actor")
    )
    received = members.groupBy(*ENCOUNTER, S.fold("target").alias("_who")).agg(
        F.sum("total_damage").alias("_received")
    )
    out = dealt.withColumn("_who", S.fold("raw_actor")).join(received, [*ENCOUNTER, "_who"], "left")
    enemy = ~S.is_pet("raw_actor") & (F.coalesce("_received", F.lit(0)) > F.col("damage"))
    return out.select(
        *ENCOUNTER,
        F.col("raw_actor").alias("attacker"),
        "damage",
        F.when(enemy, "enemy").otherwise("friendly").alias("side"),
    )


def owner_choices(raw: DataFrame, pet_owners: DataFrame | None = None) -> DataFrame:
    """Raw attackers with their current owner and whether they may own pets.

    Listed mapped ones first, then by damage (``orderBy("owner IS NULL", "damage DESC")``).
    Who may own whom is a matter of ``side``: every ``can_own`` row of the same encounter and side
    other than the actor itself, plus the current owner. The pairs are not spelled out.
    """
    from skirmish.operators.overrides import owner_lookup

    rows = raw.withColumn("_who", S.fold("attacker"))
    if pet_owners is None:
        rows = rows.withColumn("_owner", F.lit(None).cast("string"))
    else:
        rows = rows.join(owner_lookup(pet_owners), ["log_id", "_who"], "left")
    can_own = ~S.is_pet("attacker") & ~F.col("attacker").endswith("'s pet")
    return rows.select(
        *ENCOUNTER,
        "attacker",
        "damage",
        "side",
        F.col("_owner").alias("owner"),
        can_own.alias("can_own"),
    )


def biggest_hits(acts: DataFrame, by: Sequence[str] = FIGHT_ID, k: int = 10) -> DataFrame:
    """Top ``k`` hits per group, ties by time and position; each task keeps ``k`` before the shuffle."""
    start = "fight_start_t" if "fight_id" in by else "enc_start_t"
    order = Window.partitionBy(*by).orderBy(F.col("amount").desc(), "t", "fight_id", "ord")
    hits = acts.where(_hit()).withColumn("place", F.row_number().over(order)).where(
        F.col("place") <= k
    )
    return hits.select(
        *by, F.col("place").cast("long").alias("place"), (F.col("t") - F.col(start)).alias("offset_s"), "actor", "target",
        F.col("amount").alias("damage"), "specials",
    )


def biggest_heals(heals: DataFrame, k: int = 10) -> DataFrame:
    order = Window.partitionBy(*ENCOUNTER).orderBy(F.col("amount").desc(), "ord")
    top = heals.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return top.select(
        *ENCOUNTER, F.col("place").cast("long").alias("place"), (F.col("t") - F.col("enc_start_t")).alias("offset_s"), "actor", "target",
        F.col("amount").alias("damage"), "spell",
    )
