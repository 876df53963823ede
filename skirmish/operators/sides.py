"""Friend or foe: who received more than they dealt and healed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.functions import scalars as S

ENCOUNTER = ("log_id", "encounter_id")


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def _side(enemy: Column) -> Column:
    return F.when(enemy, "enemy").otherwise("friendly")


def healed_by(heals: DataFrame) -> DataFrame:
    return heals.groupBy(*ENCOUNTER, S.fold("actor").alias("name_key")).agg(
        F.sum("amount").alias("healed")
    )


def received_by(members: DataFrame) -> DataFrame:
    return members.groupBy(*ENCOUNTER, S.fold("target").alias("name_key")).agg(
        F.sum("total_damage").alias("received")
    )


def encounter_sides(
    attackers: DataFrame, matrix: DataFrame, members: DataFrame, heals: DataFrame
) -> DataFrame:
    """``side`` per attacker row of an encounter, by two passes.

    First: more received than dealt and healed makes an enemy, pets never. Second: a friendly
    non-pet that healed nothing and hit friendlies harder than enemies turns into an enemy; the
    first pass decides who counts as what, unlisted targets are friendly.
    """
    rows = (
        attackers.where(~S.is_corpse("actor"))
        .withColumn("name_key", S.fold("actor"))
        .join(received_by(members), [*ENCOUNTER, "name_key"], "left")
        .join(healed_by(heals), [*ENCOUNTER, "name_key"], "left")
    )
    enemy = ~S.is_pet("actor") & (_zero("received") > F.col("damage") + _zero("healed"))
    rows = rows.withColumn("_enemy", enemy)
    first = _by_name(rows, F.col("_enemy"))
    aimed = (
        matrix.join(
            first.select(*ENCOUNTER, F.col("name_key").alias("target_key"), "_is_enemy"),
            [*ENCOUNTER, "target_key"],
            "left",
        )
        .groupBy(*ENCOUNTER, F.col("attacker_key").alias("name_key"))
        .agg(
            F.sum(F.when(F.coalesce("_is_enemy", F.lit(False)), F.col("damage")).otherwise(0)).alias("_to_e"),
            F.sum(F.when(F.coalesce("_is_enemy", F.lit(False)), 0).otherwise(F.col("damage"))).alias("_to_f"),
        )
    )
    rows = rows.join(aimed, [*ENCOUNTER, "name_key"], "left")
    flips = (
        ~F.col("_enemy")
        & ~S.is_pet("actor")
        & (_zero("healed") <= 0)
        & (_zero("_to_f") > _zero("_to_e"))
    )
    return rows.select(
        *ENCOUNTER, "actor", "name_key", "damage", "first_seen", _side(F.col("_enemy") | flips).alias("side")
    )


def _by_name(rows: DataFrame, enemy: Column) -> DataFrame:
    """One verdict per folded name: of several spellings the last in damage order counts."""
    return rows.groupBy(*ENCOUNTER, "name_key").agg(
        F.max_by(enemy, F.struct(-F.col("damage"), F.col("first_seen"))).alias("_is_enemy")
    )


def sides_by_name(sides: DataFrame) -> DataFrame:
    return _by_name(sides, F.col("side") == "enemy").select(
        *ENCOUNTER, "name_key", _side(F.col("_is_enemy")).alias("side")
    )


def healer_sides(healers: DataFrame, sides: DataFrame) -> DataFrame:
    """Healers keep their damage side; unknown ones and pets are friendly."""
    named = sides_by_name(sides).withColumnRenamed("name_key", "healer_key")
    out = healers.join(named, [*ENCOUNTER, "healer_key"], "left")
    enemy = (F.col("side") == "enemy") & ~S.is_pet("healer")
    return out.withColumn("side", _side(F.coalesce(enemy, F.lit(False))))


def recap_enemies(attackers: DataFrame, pairs: DataFrame, heals: DataFrame) -> DataFrame:
    """Folded names that read as enemies in an encounter, judged from defense pairs.

    The first pass does not spare pets; the second uses the first pass's names only.
    """
    dealt = attackers.groupBy(*ENCOUNTER, S.fold("actor").alias("name_key")).agg(
        F.sum("damage").alias("dealt")
    )
    received = pairs.groupBy(*ENCOUNTER, S.fold("target").alias("name_key")).agg(
        F.sum("damage_taken").alias("received")
    )
    names = (
        dealt.join(received, [*ENCOUNTER, "name_key"], "full_outer")
        .join(healed_by(heals), [*ENCOUNTER, "name_key"], "left")
        .withColumn("_first", _zero("received") > _zero("dealt") + _zero("healed"))
    )
    aim = (
        pairs.select(*ENCOUNTER, S.fold("actor").alias("_who"), S.fold("target").alias("name_key"), "damage_taken")
        .join(names.where("_first").select(*ENCOUNTER, "name_key", "_first"), [*ENCOUNTER, "name_key"], "left")
        .groupBy(*ENCOUNTER, F.col("_who").alias("name_key"))
        .agg(
            F.sum(F.when(F.col("_first"), F.col("damage_taken")).otherwise(0)).alias("_to_e"),
            F.sum(F.when(F.col("_first"), 0).otherwise(F.col("damage_taken"))).alias("_to_f"),
        )
    )
    out = names.join(aim, [*ENCOUNTER, "name_key"], "left")
    second = (
        F.col("dealt").isNotNull()
        & ~S.is_pet("name_key")
        & (_zero("healed") <= 0)
        & (_zero("_to_f") > _zero("_to_e"))
    )
    return out.where(F.col("_first") | second).select(*ENCOUNTER, "name_key")


def pooled_sides(
    attackers: DataFrame, members: DataFrame, heals: DataFrame, by: list[str]
) -> DataFrame:
    """One verdict per folded name over all encounters of a pool (a session or a compared pair)."""
    parts = (
        attackers.select(*by, S.fold("actor").alias("name_key"), F.col("damage").alias("v"), F.lit("d").alias("m"))
        .unionByName(
            members.select(*by, S.fold("target").alias("name_key"), F.col("total_damage").alias("v"), F.lit("r").alias("m"))
        )
        .unionByName(heals.select(*by, S.fold("actor").alias("name_key"), F.col("amount").alias("v"), F.lit("h").alias("m")))
    )

    def part(m: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("m") == m, F.col("v"))), F.lit(0))

    sums = parts.groupBy(*by, "name_key").agg(
        part("r").alias("received"), part("d").alias("dealt"), part("h").alias("healed")
    )
    enemy = ~S.is_pet("name_key") & (F.col("received") > F.col("dealt") + F.col("healed"))
    return sums.select(*by, "name_key", _side(enemy).alias("side"))
