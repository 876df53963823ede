"""The logging player's counters, the recap of the latest encounter, and the view of open fights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions import scalars as S
from skirmish.operators.sides import recap_enemies

ENCOUNTER = ("log_id", "encounter_id")


def _rates(df: DataFrame, duration: str = "duration_seconds") -> DataFrame:
    def per_second(c) -> Column:
        return S.whole(S.live_rate(c, duration))

    return (
        df.withColumn("dps_out", per_second("damage_out"))
        .withColumn("dtps_in", per_second("damage_in"))
        .withColumn("hps_out", per_second("healing_out"))
        .withColumn("hps_in", per_second("healing_in"))
        .withColumn("hp_delta_per_sec", per_second(F.col("healing_in") - F.col("damage_in")))
    )


def player_counters(
    attackers: DataFrame, pairs: DataFrame, heals: DataFrame, spans: DataFrame, by: list[str]
) -> DataFrame:
    """Damage and healing of the player, out and in, per group of ``spans(by, duration_seconds)``.

    The player's own pets count for damage dealt.
    """
    mine = S.is_you("actor") | S.is_your_pet("actor", S.char_name("log_id"))

    def total(df: DataFrame, value: str, name: str) -> DataFrame:
        return df.groupBy(*by).agg(F.sum(value).alias(name))

    out = (
        spans.select(*by, "duration_seconds")
        .join(total(attackers.where(mine), "damage", "damage_out"), by, "left")
        .join(total(pairs.where(S.is_you("target")), "damage_taken", "damage_in"), by, "left")
        .join(total(heals.where(S.is_you("actor")), "amount", "healing_out"), by, "left")
        .join(total(heals.where(S.is_you("target")), "amount", "healing_in"), by, "left")
    )
    return _rates(
        out.fillna(0, ["damage_out", "damage_in", "healing_out", "healing_in"])
    )


def top_damage(
    attackers: DataFrame,
    spans: DataFrame,
    by: list[str],
    n: int = 8,
    excluded: DataFrame | None = None,
) -> DataFrame:
    """The ``n`` largest positive damage dealers per group.

    ``excluded(by, name_key)`` are left out; without it an attacker named like the target is.
    ``spans`` carries ``duration_seconds``, ``total_damage`` and, for the latter rule, ``target``.
    """
    rows = attackers.where(F.col("damage") > 0).withColumn("name_key", S.fold("actor"))
    s = spans.select(*by, "duration_seconds", F.col("total_damage").alias("_total"),
                     *([] if excluded is not None else [S.fold("target").alias("_target")]))
    rows = rows.join(s, by)
    if excluded is not None:
        rows = rows.join(excluded, [*by, "name_key"], "left_anti")
    else:
        rows = rows.where(F.col("name_key") != F.col("_target"))
    order = Window.partitionBy(*by).orderBy(F.col("damage").desc(), "first_seen")
    return (
        rows.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= n)
        .select(
            *by,
            F.col("place").cast("long").alias("place"),
            F.col("actor").alias("name"),
            "damage",
            "duration_seconds",
            S.whole(S.live_rate("damage", "duration_seconds")).alias("dps"),
            S.pct_of("damage", "_total").alias("pct"),
            S.is_you("actor").alias("is_you"),
            S.is_your_pet("actor", S.char_name("log_id")).alias("is_your_pet"),
        )
    )


def top_healing(heals: DataFrame, spans: DataFrame, by: list[str], n: int = 5) -> DataFrame:
    """The ``n`` largest healers (by exact name) per group."""
    per = heals.groupBy(*by, F.col("actor").alias("name")).agg(
        F.sum("amount").alias("healing"), F.min("ord").alias("_first")
    )
    order = Window.partitionBy(*by).orderBy(F.col("healing").desc(), "_first")
    return (
        per.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= n)
        .join(spans.select(*by, "duration_seconds"), by)
        .select(
            *by,
            F.col("place").cast("long").alias("place"),
            "name",
            "healing",
            S.is_you("name").alias("is_you"),
            S.whole(S.live_rate("healing", "duration_seconds")).alias("hps"),
        )
    )


def combine_pets(rows: DataFrame, by: list[str]) -> DataFrame:
    """Fold the player's pet rows of a top list into the player's row and rank again.

    Nothing changes in a list without the player or without pet damage.
    """
    group = Window.partitionBy(*by)
    pets = F.sum(F.when(F.col("is_your_pet"), F.col("damage")).otherwise(0)).over(group)
    total = F.sum("damage").over(group)
    has_you = F.max(F.col("is_you")).over(group)
    marked = rows.withColumn("_pets", pets).withColumn("_all", total).withColumn(
        "_on", has_you & (pets != 0)
    )
    mine = F.col("_on") & F.col("is_you")
    damage = F.col("damage") + F.when(mine, F.col("_pets")).otherwise(0)

    def up(x: Column) -> Column:
        return F.floor(x + 0.5)

    out = marked.where(~(F.col("_on") & F.col("is_your_pet"))).withColumn("_damage", damage)
    out = out.withColumn(
        "dps",
        F.when(mine, up(S.live_rate("_damage", "duration_seconds")).cast("long")).otherwise(F.col("dps")),
    ).withColumn(
        "pct", F.when(mine, up(F.col("_damage") / F.col("_all") * 1000) / 10).otherwise(F.col("pct"))
    )
    again = Window.partitionBy(*by).orderBy(F.col("_damage").desc(), "place")
    return out.withColumn("place", F.row_number().over(again).cast("long")).select(
        *by, "place", "name", F.col("_damage").alias("damage"), "dps", "pct", "is_you"
    )


def latest_encounter(encounters: DataFrame) -> DataFrame:
    """Per log: the encounter with the latest end; the first of several."""
    best = encounters.groupBy("log_id").agg(
        F.max_by("encounter_id", F.struct("end_t", -F.col("encounter_id"))).alias("encounter_id")
    )
    return encounters.join(best, list(ENCOUNTER), "left_semi")


def recap_top_damage(
    attackers: DataFrame, pairs: DataFrame, heals: DataFrame, encounters: DataFrame, n: int = 10
) -> DataFrame:
    """The ``n`` largest damage dealers of each log's latest encounter, enemies left out."""
    last = latest_encounter(encounters)

    def of_last(df: DataFrame) -> DataFrame:
        return df.join(last.select(*ENCOUNTER), list(ENCOUNTER), "left_semi")

    rows = of_last(attackers)
    foes = recap_enemies(rows, of_last(pairs), of_last(heals))
    return top_damage(rows, last, list(ENCOUNTER), n, excluded=foes)


def recap_top_healing(heals: DataFrame, encounters: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` largest healers of each log's latest encounter."""
    last = latest_encounter(encounters)
    return top_healing(heals.join(last.select(*ENCOUNTER), list(ENCOUNTER), "left_semi"), last, list(ENCOUNTER), n)


def open_window(open_fights: DataFrame) -> DataFrame:
    """Per log: first start and last end of the fights still running."""
    return open_fights.groupBy("log_id").agg(
        F.min("start_t").alias("window_start_t"), F.max("end_t").alias("window_end_t")
    )


def heals_in_window(open_fights: DataFrame, heals: DataFrame) -> DataFrame:
    return heals.join(open_window(open_fights), "log_id").where(
        F.col("t").between(F.col("window_start_t"), F.col("window_end_t"))
    )


def active_target(open_fights: DataFrame, open_acts: DataFrame, heals: DataFrame) -> DataFrame:
    """Per log: the open fight with the enemy that took the most damage; of several, the latest one."""
    dealt = open_acts.groupBy("log_id", S.fold("actor").alias("name_key")).agg(
        F.coalesce(F.sum("amount"), F.lit(0)).alias("dealt")
    )
    received = open_fights.groupBy("log_id", S.fold("target").alias("name_key")).agg(
        F.sum("total_damage").alias("received")
    )
    healed = (
        heals_in_window(open_fights, heals)
        .groupBy("log_id", S.fold("actor").alias("name_key"))
        .agg(F.sum("amount").alias("healed"))
    )
    foes = (
        open_fights.withColumn("name_key", S.fold("target"))
        .join(received, ["log_id", "name_key"], "left")
        .join(dealt, ["log_id", "name_key"], "left")
        .join(healed, ["log_id", "name_key"], "left")
        .where(
            ~S.is_you("target")
            & ~S.is_pet("target")
            & (F.col("received") > F.coalesce("dealt", F.lit(0)) + F.coalesce("healed", F.lit(0)))
        )
    )
    return foes.groupBy("log_id").agg(
        F.max_by(
            F.struct("target", "open_ord", "start_t", "end_t", "total_damage"),
            F.struct("total_damage", "end_t", -F.col("open_ord")),
        ).alias("m")
    ).select("log_id", "m.*")


def active_view(open_fights: DataFrame, open_acts: DataFrame, heals: DataFrame) -> DataFrame:
    """Per log: the enemy being fought and the player's counters over the window of open fights.

    ``open_fights`` are all fights still running, also small ones; ``open_acts`` their rows;
    ``heals`` any heals of the log (those inside the window count).
    """
    main = active_target(open_fights, open_acts, heals)
    inside = heals_in_window(open_fights, heals)
    spans = open_window(open_fights).withColumn("duration_seconds", F.col("window_end_t") - F.col("window_start_t"))
    hits = open_acts.groupBy("log_id", "actor", "target").agg(
        F.coalesce(F.sum("amount"), F.lit(0)).alias("damage")
    )
    counters = player_counters(
        hits, hits.withColumnRenamed("damage", "damage_taken"), inside, spans, ["log_id"]
    ).withColumnRenamed("duration_seconds", "window_seconds")
    return main.join(counters, "log_id")


def active_top_damage(target: DataFrame, open_acts: DataFrame, n: int = 8) -> DataFrame:
    """Per log: the ``n`` largest damage dealers of the open fight with the ``active_target``.

    ``open_acts`` carry ``ord``, the place of a row or of the first of summed rows.
    """
    fight = ["log_id", "target", "open_ord"]
    rows = (
        open_acts.join(target.select(*fight), fight, "left_semi")
        .groupBy("log_id", "actor")
        .agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("damage"), F.min("ord").alias("first_seen"))
    )
    spans = target.withColumn("duration_seconds", F.col("end_t") - F.col("start_t"))
    return top_damage(rows, spans, ["log_id"], n)


def active_top_healing(open_fights: DataFrame, target: DataFrame, heals: DataFrame, n: int = 5) -> DataFrame:
    """Per log with an ``active_target``: the ``n`` largest healers over the window of open fights."""
    spans = open_window(open_fights).withColumn("duration_seconds", F.col("window_end_t") - F.col("window_start_t"))
    inside = heals_in_window(open_fights, heals).join(target.select("log_id"), "log_id", "left_semi")
    return top_healing(inside, spans, ["log_id"], n)
