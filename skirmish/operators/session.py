"""Rollups over the encounters of a log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions import scalars as S
from skirmish.functions.sliced import numbered, time_slice
from skirmish.operators.sides import pooled_sides
from skirmish.operators.stats import heals_by_name
from skirmish.operators.timeline import packed

ENCOUNTER = ("log_id", "encounter_id")
ACTOR = ("log_id", "name_key")


def choose(encounters: DataFrame, killed_only: bool = False, chosen: DataFrame | None = None) -> DataFrame:
    """Encounters of a session: kills only if asked, then the explicit choice (log_id, encounter_id)."""
    out = encounters.where("fight_complete") if killed_only else encounters
    return out if chosen is None else out.join(chosen.select(*ENCOUNTER).distinct(), list(ENCOUNTER), "left_semi")


def within(rows: DataFrame, encounters: DataFrame) -> DataFrame:
    return rows.join(encounters.select(*ENCOUNTER), list(ENCOUNTER), "left_semi")


@dataclass(frozen=True)
class Summary:
    """The session page of a selection: every part is computed over the chosen encounters only."""

    encounters: DataFrame
    sides: DataFrame
    damage: DataFrame
    healing: DataFrame
    tanking: DataFrame

    @property
    def header(self) -> DataFrame:
        return session_header(self.encounters, self.tanking)


def summary(
    encounters: DataFrame,
    attackers: DataFrame,
    pairs: DataFrame,
    members: DataFrame,
    heals: DataFrame,
    killed_only: bool = False,
    chosen: DataFrame | None = None,
) -> Summary:
    """Rollups and sides over kills only if asked, then over the chosen (log_id, encounter_id)."""
    mine = choose(encounters, killed_only, chosen)
    attackers, pairs, members, heals = (within(x, mine) for x in (attackers, pairs, members, heals))
    side = pooled_sides(attackers, members, heals, ["log_id"])
    values = (damage_values(attackers), healing_values(heals), tanking_values(pairs))
    return Summary(mine, side, *(actor_rollup(v, mine, side) for v in values))


def damage_values(attackers: DataFrame) -> DataFrame:
    """Per actor and encounter: damage dealt. Spellings of one name are summed."""
    return attackers.groupBy(*ENCOUNTER, S.fold("actor").alias("name_key")).agg(
        F.min_by("actor", "first_seen").alias("name"),
        F.sum("damage").alias("value"),
        F.max("biggest").alias("biggest"),
    )


def healing_values(heals: DataFrame) -> DataFrame:
    return heals_by_name(heals).groupBy(*ENCOUNTER, S.fold("actor").alias("name_key")).agg(
        F.min_by("actor", "first_ord").alias("name"),
        F.sum("amount").alias("value"),
        F.max("biggest").alias("biggest"),
    )


def tanking_values(pairs: DataFrame) -> DataFrame:
    return (
        pairs.where(F.col("damage_taken") != 0)
        .groupBy(*ENCOUNTER, S.fold("target").alias("name_key"))
        .agg(
            F.min_by("target", "first_seen").alias("name"),
            F.sum("damage_taken").alias("value"),
            F.max("biggest_taken").alias("biggest"),
        )
    )


def encounter_rates(values: DataFrame, encounters: DataFrame) -> DataFrame:
    """Whole per-second rate of each actor in each encounter."""
    e = encounters.select(*ENCOUNTER, "duration_seconds")
    return values.join(e, list(ENCOUNTER)).withColumn(
        "rate", S.whole(S.actor_rate("value", "duration_seconds"))
    ).drop("duration_seconds")


def _ranked_rates(rates: DataFrame) -> DataFrame:
    """Median and 95th percentile of the positive rates, from counted distinct rates.

    Of n rates in falling order, p95 is the one at place floor(n * 0.05), or the best below 20.
    """
    counted = rates.where(F.col("rate") > 0).groupBy(*ACTOR, "rate").agg(F.count("*").alias("_c"))
    fall = Window.partitionBy(*ACTOR).orderBy(F.col("rate").desc())
    counted = counted.withColumn(
        "_upto", F.sum("_c").over(fall.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    n = counted.groupBy(*ACTOR).agg(F.sum("_c").alias("_n"))
    counted = counted.join(n, list(ACTOR))

    def at(place: Column) -> Column:
        return F.max(F.when(F.col("_upto") > place, F.col("rate")))

    low, high = F.floor(F.col("_n") / 2), F.floor((F.col("_n") - 1) / 2)
    p95 = F.when(F.col("_n") >= 20, F.floor(F.col("_n") * 0.05)).otherwise(0)
    return counted.groupBy(*ACTOR).agg(
        S.whole((at(low) + at(high)) / 2).alias("median_rate"), at(p95).alias("p95_rate")
    )


def actor_rollup(values: DataFrame, encounters: DataFrame, sides: DataFrame) -> DataFrame:
    """Per actor over the session: total, biggest, and average, median, p95 and best positive rate."""
    rates = encounter_rates(values, encounters)
    positive = F.when(F.col("rate") > 0, F.col("rate"))
    rows = (
        rates.groupBy(*ACTOR)
        .agg(
            F.min_by("name", "encounter_id").alias("name"),
            F.sum("value").alias("total"),
            F.max("biggest").alias("biggest"),
            F.count(positive).alias("encounters_present"),
            S.whole(F.avg(positive)).alias("avg_rate"),
            F.max(positive).alias("best_rate"),
        )
        .where(F.col("encounters_present") > 0)
    )
    return (
        rows.join(_ranked_rates(rates), list(ACTOR))
        .join(sides, list(ACTOR), "left")
        .withColumn("side", F.coalesce("side", F.lit("friendly")))
    )


def numbered_encounters(encounters: DataFrame) -> DataFrame:
    """``slot``: 0-based place of each chosen encounter in time order."""
    return numbered(
        encounters, ["log_id"], time_slice("start_t"), ["start_t", "encounter_id"], "_n"
    ).withColumn("slot", F.col("_n") - 1).drop("_n")


def aligned_series(
    values: DataFrame, rollup: DataFrame, encounters: DataFrame, value: str = "rate"
) -> DataFrame:
    """Zero-filled series per actor, aligned to the encounters in time order, packed by chunks."""
    slots = numbered_encounters(encounters)
    n = slots.groupBy("log_id").agg(F.count("*").alias("n_buckets"))
    sparse = (
        encounter_rates(values, encounters)
        .join(slots.select(*ENCOUNTER, "slot"), list(ENCOUNTER))
        .select(*ACTOR, F.col("slot").alias("bucket"), value)
    )
    spine = rollup.select(*ACTOR).join(n, "log_id")
    return packed(sparse, spine, list(ACTOR), value)


def by_mode(whole: Summary) -> DataFrame:
    """The three rollups of a session as one table."""
    parts = [getattr(whole, mode).withColumn("mode", F.lit(mode)) for mode in ("damage", "healing", "tanking")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def all_series(
    attackers: DataFrame, heals: DataFrame, pairs: DataFrame, encounters: DataFrame, rollup: DataFrame
) -> DataFrame:
    """Zero-filled series of every row of ``rollup`` (``by_mode``) over the encounters in time order.

    Fields: ``value`` and ``rate`` in each mode, ``heals_value`` and ``heals_rate`` of tanks; packed
    by chunks, all in one pass.
    """
    got = heals.groupBy(*ENCOUNTER, S.fold("target").alias("name_key")).agg(F.sum("amount").alias("value"))

    def cells(values: DataFrame, mode: str, prefix: str = "") -> DataFrame:
        fields = [F.struct(F.lit(f"{prefix}{f}").alias("field"), F.col(f).cast("long").alias("amount")) for f in ("value", "rate")]
        rates = encounter_rates(values.select(*ENCOUNTER, "name_key", "value"), encounters)
        return rates.select(*ENCOUNTER, "name_key", F.lit(mode).alias("mode"), F.inline(F.array(*fields)))

    sparse = (
        cells(damage_values(attackers), "damage")
        .unionByName(cells(healing_values(heals), "healing"))
        .unionByName(cells(tanking_values(pairs), "tanking"))
        .unionByName(cells(got, "tanking", "heals_"))
    )
    slots = numbered_encounters(encounters).select(*ENCOUNTER, F.col("slot").alias("bucket"))
    n = encounters.groupBy("log_id").agg(F.count("*").alias("n_buckets"))
    fields = F.array(F.lit("value"), F.lit("rate"))
    fields = F.when(F.col("mode") == "tanking", F.concat(fields, F.array(F.lit("heals_value"), F.lit("heals_rate")))).otherwise(fields)
    spine = rollup.select(*ACTOR, "mode", F.explode(fields).alias("field")).join(n, "log_id")
    keys = [*ACTOR, "mode", "field"]
    return packed(sparse.join(slots, list(ENCOUNTER)).select(*keys, "bucket", "amount"), spine, keys, "amount")


def received_rates(
    values: DataFrame, heals: DataFrame, encounters: DataFrame, rollup: DataFrame
) -> DataFrame:
    """Per tanking actor and encounter: damage and heals received, their rates and the life delta.

    ``values`` are ``tanking_values``; encounters without either are left out and count 0.
    """
    got = heals.groupBy(*ENCOUNTER, S.fold("target").alias("name_key")).agg(
        F.sum("amount").alias("heals_value")
    )
    key = [*ENCOUNTER, "name_key"]
    both = (
        values.select(*key, F.col("value").alias("damage_value"))
        .join(got, key, "full_outer")
        .join(rollup.select(*ACTOR), list(ACTOR), "left_semi")
        .join(encounters.select(*ENCOUNTER, "duration_seconds"), list(ENCOUNTER))
    )
    damage, healing = F.coalesce("damage_value", F.lit(0)), F.coalesce("heals_value", F.lit(0))
    damage_rate = S.whole(S.actor_rate(damage, "duration_seconds"))
    heals_rate = S.whole(S.actor_rate(healing, "duration_seconds"))
    return both.select(
        *key,
        damage.alias("damage_value"),
        healing.alias("heals_value"),
        damage_rate.alias("damage_rate"),
        heals_rate.alias("heals_rate"),
        (heals_rate - damage_rate).alias("life_delta"),
    )


def session_header(
    encounters: DataFrame, tanking_rollup: DataFrame | None = None
) -> DataFrame:
    """Per log: span, summed durations, counts and totals of the chosen encounters."""
    head = encounters.groupBy("log_id").agg(
        S.stamp(F.min("start")).alias("start"),
        S.stamp(F.max("end")).alias("end"),
        F.sum("duration_seconds").alias("duration_seconds"),
        F.count("*").alias("encounter_count"),
        F.count_if("fight_complete").alias("killed_count"),
        F.sum("total_damage").alias("total_damage"),
        F.sum("total_healing").alias("total_healing"),
    )
    if tanking_rollup is None:
        return head
    taken = tanking_rollup.groupBy("log_id").agg(F.sum("total").alias("total_damage_taken"))
    return head.join(taken, "log_id", "left").withColumn(
        "total_damage_taken", F.coalesce("total_damage_taken", F.lit(0))
    )


def share_of_raid(rollup: DataFrame, min_rate: int = 0) -> DataFrame:
    """Friendlies at or above an average rate, with their share of the shown total."""
    shown = rollup.where((F.col("side") == "friendly") & (F.col("avg_rate") >= min_rate))
    total = shown.groupBy("log_id").agg(F.sum("total").alias("_all"))
    return shown.join(total, "log_id").withColumn("pct_of_raid", S.pct_of("total", "_all")).drop("_all")


def trend(rates: DataFrame, rollup: DataFrame, top: int = 10) -> DataFrame:
    """Rates per encounter of the ``top`` friendlies by total, the rest summed as ``Other``.

    Encounters in which a line has no row count 0.
    """
    friendly = rollup.where(F.col("side") == "friendly").select(*ACTOR, "name", "total")
    order = Window.partitionBy("log_id").orderBy(F.col("total").desc(), "name_key")
    best = friendly.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= top)
    label = F.when(F.col("_place").isNotNull(), F.col("name")).otherwise("Other")
    lines = friendly.select(*ACTOR, "name").join(best.select(*ACTOR, "_place"), list(ACTOR), "left")
    lines = lines.select(*ACTOR, label.alias("label"), F.col("_place").isNull().alias("is_other"))
    return (
        rates.select(*ENCOUNTER, "name_key", "rate")
        .join(lines, list(ACTOR))
        .groupBy(*ENCOUNTER, "label", "is_other")
        .agg(F.sum("rate").alias("rate"))
    )
