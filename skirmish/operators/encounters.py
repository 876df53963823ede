"""Encounters: overlapping fights of a log, with manual groups taking precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.functions import scalars as S
from skirmish.functions.sliced import numbered, running, time_slice

ENCOUNTER = ("log_id", "encounter_id")
#: Default bin width of the interval join between heals and encounters.
BIN_SECONDS = 60


def auto_groups(fights: DataFrame, gap_seconds: int = 0) -> DataFrame:
    """``group_id`` per fight: a fight starting more than the gap after every earlier end opens one.

    Admitted fights end no earlier than they start, so the running maximum may span groups.
    """
    out = running(
        fights, ["log_id"], time_slice("start_t"), ["fight_id"], largest={"_end_before": F.col("end_t")}
    )
    fresh = F.col("_end_before").isNull() | (F.col("start_t") - F.col("_end_before") > gap_seconds)
    out = running(
        out.withColumn("_fresh", fresh.cast("long")),
        ["log_id"],
        time_slice("start_t"),
        ["fight_id"],
        total={"_groups": F.col("_fresh")},
    )
    return out.withColumn("group_id", F.col("_groups") + F.col("_fresh")).drop(
        "_end_before", "_fresh", "_groups"
    )


def valid_groups(manual_groups: DataFrame) -> DataFrame:
    """Distinct keys of the manual groups with at least two of them."""
    keys = manual_groups.groupBy("log_id", "group_no", "fight_key").agg(F.first("name").alias("name"))
    big = keys.groupBy("log_id", "group_no").agg(F.count("*").alias("group_keys")).where(
        F.col("group_keys") >= 2
    )
    return keys.join(big, ["log_id", "group_no"])


def group_fights(
    fights: DataFrame, gap_seconds: int = 0, manual_groups: DataFrame | None = None
) -> DataFrame:
    """Fights with ``encounter_id`` (by start) and the manual name, if any."""
    none = F.lit(None).cast("string")
    if manual_groups is None:
        return auto_groups(fights, gap_seconds).withColumnRenamed("group_id", "encounter_id").withColumn(
            "manual_name", none
        )
    claims = valid_groups(manual_groups)
    names = claims.groupBy("log_id", "group_no").agg(F.first("name").alias("manual_name"))
    claimed_by = (
        fights.select("log_id", "fight_key")
        .join(claims.select("log_id", "fight_key", "group_no"), ["log_id", "fight_key"])
        .groupBy("log_id", "fight_key")
        .agg(F.min("group_no").alias("group_no"))
    )
    claimed = fights.join(claimed_by, ["log_id", "fight_key"])
    rest = fights.join(claimed_by, ["log_id", "fight_key"], "left_anti")
    members = (
        auto_groups(rest, gap_seconds)
        .withColumn("is_claimed", F.lit(False))
        .unionByName(
            claimed.withColumn("group_id", F.col("group_no").cast("long"))
            .drop("group_no")
            .withColumn("is_claimed", F.lit(True))
        )
    )
    key = ["log_id", "is_claimed", "group_id"]
    groups = members.groupBy(*key).agg(
        F.min("start_t").alias("group_start_t"), F.min("fight_id").alias("first_fight")
    )
    groups = numbered(
        groups,
        ["log_id"],
        time_slice("group_start_t"),
        ["group_start_t", "is_claimed", "first_fight"],
        "encounter_id",
    )
    members = members.join(groups.select(*key, "encounter_id"), key)
    return (
        members.join(
            names.withColumn("is_claimed", F.lit(True)).withColumnRenamed("group_no", "group_id"),
            key,
            "left",
        )
        .withColumn("manual_name", F.nullif("manual_name", F.lit("")))
        .drop("group_id", "is_claimed")
    )


def encounter_bounds(members: DataFrame) -> DataFrame:
    return members.groupBy(*ENCOUNTER).agg(
        F.min("start_t").alias("enc_start_t"), F.max("end_t").alias("enc_end_t")
    )


def encounter_names(members: DataFrame, acts: DataFrame) -> DataFrame:
    """The enemy member that took the most damage, else the largest member; a manual name wins."""
    dealt = acts.groupBy(*ENCOUNTER, S.fold("actor").alias("_who")).agg(
        F.coalesce(F.sum("amount"), F.lit(0)).alias("_dealt")
    )
    rows = members.withColumn("_who", S.fold("target")).join(dealt, [*ENCOUNTER, "_who"], "left")
    enemy = (
        (S.fold("target") != "you")
        & ~S.is_pet("target")
        & (F.col("total_damage") > F.coalesce("_dealt", F.lit(0)))
    )
    best = F.max_by("target", F.struct(enemy, F.col("total_damage"), -F.col("fight_id")))
    return rows.groupBy(*ENCOUNTER).agg(
        F.coalesce(F.first("manual_name", ignorenulls=True), best).alias("base_name")
    )


def encounters(members: DataFrame, acts: DataFrame, heals: DataFrame) -> DataFrame:
    """One summary row per encounter."""
    base = members.groupBy(*ENCOUNTER).agg(
        F.min("start_t").alias("start_t"),
        F.max("end_t").alias("end_t"),
        F.sum("total_damage").alias("total_damage"),
        F.bool_or("fight_complete").alias("fight_complete"),
        F.count("*").alias("member_count"),
    )
    # Distinct counts in two steps, so that no group's names meet in one task.
    targets = (
        members.select(*ENCOUNTER, S.fold("target").alias("_t")).distinct()
        .groupBy(*ENCOUNTER).agg(F.count("*").alias("target_count"))
    )
    attackers = (
        acts.select(*ENCOUNTER, "actor").distinct()
        .groupBy(*ENCOUNTER).agg(F.count("*").alias("attacker_count"))
    )
    healing = heals.groupBy(*ENCOUNTER).agg(F.sum("amount").alias("total_healing"))
    out = (
        base.join(targets, list(ENCOUNTER))
        .join(attackers, list(ENCOUNTER), "left")
        .join(healing, list(ENCOUNTER), "left")
        .join(encounter_names(members, acts), list(ENCOUNTER))
    )
    duration = F.col("end_t") - F.col("start_t")
    more = F.col("target_count") - 1
    return out.select(
        *ENCOUNTER,
        "base_name",
        F.when(more > 0, F.concat("base_name", F.lit(" +"), more.cast("string")))
        .otherwise(F.col("base_name"))
        .alias("name"),
        S.from_epoch("start_t").alias("start"),
        S.from_epoch("end_t").alias("end"),
        "start_t",
        "end_t",
        duration.alias("duration_seconds"),
        "total_damage",
        F.coalesce("total_healing", F.lit(0)).alias("total_healing"),
        S.raid_rate("total_damage", duration).alias("raid_dps"),
        "fight_complete",
        F.coalesce("attacker_count", F.lit(0)).alias("attacker_count"),
        "target_count",
        "member_count",
    )


def manual_flags(members: DataFrame, manual_groups: DataFrame) -> DataFrame:
    """Encounters whose fight keys are exactly the keys of some manual group."""
    have = members.select(*ENCOUNTER, "fight_key").distinct()
    sizes = have.groupBy(*ENCOUNTER).agg(F.count("*").alias("_n"))
    keys = manual_groups.select("log_id", "group_no", "fight_key").distinct()
    key_counts = keys.groupBy("log_id", "group_no").agg(F.count("*").alias("_k"))
    shared = (
        have.join(keys, ["log_id", "fight_key"])
        .groupBy(*ENCOUNTER, "group_no")
        .agg(F.count("*").alias("_both"))
    )
    equal = (
        shared.join(sizes, list(ENCOUNTER))
        .join(key_counts, ["log_id", "group_no"])
        .where((F.col("_both") == F.col("_n")) & (F.col("_both") == F.col("_k")))
        .select(*ENCOUNTER)
        .distinct()
        .withColumn("_manual", F.lit(True))
    )
    return sizes.join(equal, list(ENCOUNTER), "left").select(
        *ENCOUNTER, F.coalesce("_manual", F.lit(False)).alias("is_manual")
    )


def own_spans(members: DataFrame) -> DataFrame:
    """Disjoint time spans: the seconds in which an encounter is the lowest-numbered one running.

    Ids follow the start times, so encounter *k* owns what lies after every earlier end.
    """
    bounds = encounter_bounds(members)
    spans = running(
        bounds,
        ["log_id"],
        time_slice("enc_start_t"),
        ["encounter_id"],
        largest={"_ended": F.col("enc_end_t")},
    )
    own_start = F.greatest(F.col("enc_start_t"), F.col("_ended") + 1)
    return spans.withColumn("own_start_t", own_start).where(
        F.col("own_start_t") <= F.col("enc_end_t")
    ).drop("_ended")


def assign_heals(heals: DataFrame, members: DataFrame, bin_seconds: int = BIN_SECONDS) -> DataFrame:
    """Heals with the lowest encounter whose closed time span holds them; others are left out.

    The spans are disjoint, so a heal meets at most one, and a log's spans fill no more bins than
    its time holds: an equi-join on (log, bin), which Spark can split when skewed. Bins about as
    long as an encounter keep both the bin rows and the candidates per heal few.
    """

    def bin_of(c: Column) -> Column:
        return F.floor(c / bin_seconds)

    spans = own_spans(members).withColumn(
        "_bin", F.explode(F.sequence(bin_of(F.col("own_start_t")), bin_of(F.col("enc_end_t"))))
    )
    h = heals.withColumn("_bin", bin_of(F.col("t")))
    return (
        h.join(spans, ["log_id", "_bin"])
        .where(F.col("t").between(F.col("own_start_t"), F.col("enc_end_t")))
        .drop("_bin", "own_start_t")
    )
