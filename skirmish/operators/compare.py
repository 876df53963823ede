"""Two encounters side by side, within a log or across logs.

``pairs(pair_id, a_log, a_encounter, b_log, b_encounter)`` names the comparisons; all run at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions import scalars as S
from skirmish.operators import session
from skirmish.operators.sides import pooled_sides

MEASURES = ("damage", "damage_taken", "healing")
BIGGEST = ("biggest_dmg", "biggest_taken", "biggest_heal")
RATES = ("dps", "dtps", "hps")
#: A rise is good news for these.
HIGHER_IS_BETTER = {"damage": True, "damage_taken": False, "healing": True}


def pair_sides(pairs: DataFrame) -> DataFrame:
    """One row per pair and side: (pair_id, side_no, log_id, encounter_id)."""
    return pairs.select(
        "pair_id",
        F.explode(
            F.array(
                F.struct(F.lit("a").alias("slot"), F.col("a_log").alias("log_id"),
                         F.col("a_encounter").alias("encounter_id")),
                F.struct(F.lit("b").alias("slot"), F.col("b_log").alias("log_id"),
                         F.col("b_encounter").alias("encounter_id")),
            )
        ).alias("x"),
    ).select("pair_id", "x.*")


def _measures(attackers: DataFrame, pairs: DataFrame, heals: DataFrame) -> DataFrame:
    """Long table: one row per encounter, folded name and measure."""
    parts = []
    for i, values in enumerate(
        (session.damage_values(attackers), session.tanking_values(pairs), session.healing_values(heals))
    ):
        parts.append(values.withColumn("measure", F.lit(i)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def diff_actors(
    pairs: DataFrame,
    encounters: DataFrame,
    attackers: DataFrame,
    defense: DataFrame,
    heals: DataFrame,
    members: DataFrame,
) -> DataFrame:
    """Per pair and actor of either encounter: nine measures and ``present`` for both sides."""
    slots = pair_sides(pairs)
    sized = slots.join(
        encounters.select("log_id", "encounter_id", "duration_seconds"), ["log_id", "encounter_id"]
    )
    rows = _measures(attackers, defense, heals).join(sized, ["log_id", "encounter_id"])

    def cell(slot: str, i: int, c: str) -> Column:
        here = (F.col("slot") == slot) & (F.col("measure") == i)
        return F.coalesce(F.max(F.when(here, F.col(c))), F.lit(0))

    aggs = []
    for slot in ("a", "b"):
        for i, m in enumerate(MEASURES):
            aggs.append(cell(slot, i, "value").alias(f"{slot}_{m}"))
            aggs.append(cell(slot, i, "biggest").alias(f"{slot}_{BIGGEST[i]}"))
        aggs.append(F.bool_or(F.col("slot") == slot).alias(f"{slot}_present"))
    wide = rows.groupBy("pair_id", "name_key").agg(
        F.min_by("name", F.struct("slot", "measure")).alias("name"), *aggs
    )
    durations = sized.groupBy("pair_id").agg(
        F.max(F.when(F.col("slot") == "a", F.col("duration_seconds"))).alias("_a"),
        F.max(F.when(F.col("slot") == "b", F.col("duration_seconds"))).alias("_b"),
    )
    wide = wide.join(durations, "pair_id")
    rates = [
        S.whole(S.actor_rate(f"{slot}_{m}", f"_{slot}")).alias(f"{slot}_{RATES[i]}")
        for slot in ("a", "b")
        for i, m in enumerate(MEASURES)
    ]

    def pooled(df: DataFrame) -> DataFrame:
        return df.join(slots, ["log_id", "encounter_id"])

    sides = pooled_sides(pooled(attackers), pooled(members), pooled(heals), ["pair_id"])
    return (
        wide.select(*[c for c in wide.columns if c not in ("_a", "_b")], *rates)
        .join(sides, ["pair_id", "name_key"], "left")
        .withColumn("side", F.coalesce("side", F.lit("friendly")))
    )


def visible_actors(diff: DataFrame, measure: str = "damage", show_enemies: bool = False) -> DataFrame:
    """Rows with the measure on either side, ``place`` 1 for the largest together; enemies only if asked."""
    both = F.col(f"a_{measure}") + F.col(f"b_{measure}")
    rows = diff if show_enemies else diff.where(F.col("side") != "enemy")
    delta = F.col(f"b_{measure}") - F.col(f"a_{measure}")
    return (
        rows.where(both > 0)
        .withColumn("combined", both)
        .withColumn("delta", delta)
        .withColumn("pct_change", S.one_decimal(S.pct_change(f"a_{measure}", f"b_{measure}")))
        .withColumn("trend", S.trend_class("delta", HIGHER_IS_BETTER[measure]))
        .withColumn("place", F.row_number().over(Window.partitionBy("pair_id").orderBy(F.col("combined").desc(), "name_key")))
    )


def diff_headers(pairs: DataFrame, encounters: DataFrame) -> DataFrame:
    """Both encounters' headline numbers and their differences."""
    e = encounters.select(
        "log_id", "encounter_id", "name", "duration_seconds", "total_damage", "total_healing",
        S.whole("raid_dps").alias("raid_dps"), "fight_complete",
    )
    out = pairs
    for slot in ("a", "b"):
        out = out.join(
            e.select(
                F.col("log_id").alias(f"{slot}_log"),
                F.col("encounter_id").alias(f"{slot}_encounter"),
                *[F.col(c).alias(f"{slot}_{c}") for c in e.columns[2:]],
            ),
            [f"{slot}_log", f"{slot}_encounter"],
        )
    for m in ("duration_seconds", "total_damage", "total_healing", "raid_dps"):
        out = out.withColumn(f"d_{m}", F.col(f"b_{m}") - F.col(f"a_{m}"))
    for m in ("total_damage", "total_healing", "raid_dps"):
        out = out.withColumn(f"pct_{m}", S.one_decimal(S.pct_change(f"a_{m}", f"b_{m}")))
    return out.withColumn("cross_log", F.col("a_log") != F.col("b_log"))
