"""User overrides: pet owners and manual encounters, as table edits and rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.functions import scalars as S


def owner_lookup(pet_owners: DataFrame) -> DataFrame:
    """One owner per folded actor name; the last of several spellings wins."""
    return (
        pet_owners.where((F.col("actor") != "") & (F.col("owner") != ""))
        .groupBy("log_id", S.fold("actor").alias("_who"))
        .agg(F.max_by("owner", F.struct("pos", "actor")).alias("_owner"))
    )


def apply_pet_owners(rows: DataFrame, pet_owners: DataFrame | None) -> DataFrame:
    """Credit mapped actors to their owner, one step; ``raw_actor`` keeps the written name.

    Spark broadcasts the lookup when its measured size allows and shuffles otherwise.
    """
    if pet_owners is None:
        return rows.withColumn("raw_actor", F.col("actor")).withColumn(
            "pet_origin", F.lit(None).cast("string")
        )
    out = rows.withColumn("_who", S.fold("actor")).join(
        owner_lookup(pet_owners), ["log_id", "_who"], "left"
    )
    mapped = F.col("_owner").isNotNull()
    return (
        out.withColumn("raw_actor", F.col("actor"))
        .withColumn("pet_origin", F.when(mapped, F.col("raw_actor")))
        .withColumn("actor", F.coalesce("_owner", "raw_actor"))
        .drop("_who", "_owner")
    )


def set_pet_owners(pet_owners: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply edits (log_id, pos, actor, owner) in ``pos`` order.

    A blank owner clears every spelling of the actor, another one sets exactly this spelling; the
    last word on a spelling counts. Blank actors are ignored. A null actor rejects the whole batch.
    """
    e = edits.select(
        "log_id",
        "pos",
        F.when(F.col("actor").isNull(), F.raise_error(F.lit('missing "actor" in update')))
        .otherwise(F.trim("actor"))
        .alias("actor"),
        F.trim(F.coalesce("owner", F.lit(""))).alias("owner"),
    ).where(F.col("actor") != "")
    clears = (
        e.where(F.col("owner") == "")
        .groupBy("log_id", S.fold("actor").alias("_who"))
        .agg(F.max("pos").alias("_cleared"))
    )
    stated = pet_owners.select("log_id", F.lit(-1).cast("long").alias("_at"), "pos", "actor", "owner").unionByName(
        e.where(F.col("owner") != "").select("log_id", F.col("pos").alias("_at"), "pos", "actor", "owner")
    )
    live = (
        stated.withColumn("_who", S.fold("actor"))
        .join(clears, ["log_id", "_who"], "left")
        .where(F.col("_cleared").isNull() | (F.col("_at") > F.col("_cleared")))
    )
    return live.groupBy("log_id", "actor").agg(
        F.max_by("owner", F.struct("_at", "pos")).alias("owner"),
        F.min(F.struct("_at", "pos")).getField("pos").alias("pos"),
    ).select("log_id", "pos", "actor", "owner")


def encounter_keys(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """Fight keys of the chosen encounters (log_id, encounter_id[, group_no, name]), first place kept."""
    picked = members.join(chosen, ["log_id", "encounter_id"])
    extra = [c for c in ("group_no", "name") if c in chosen.columns]
    return picked.groupBy("log_id", *extra, "fight_key").agg(F.min("fight_id").alias("pos"))


def split_groups(manual_groups: DataFrame, keys: DataFrame) -> DataFrame:
    """Take fight keys out of all groups and drop groups left with fewer than two keys."""
    rest = manual_groups.join(keys.select("log_id", "fight_key").distinct(), ["log_id", "fight_key"], "left_anti")
    counts = rest.groupBy("log_id", "group_no").agg(F.count("*").alias("_n")).where(F.col("_n") >= 2)
    return rest.join(counts, ["log_id", "group_no"]).select(*manual_groups.columns)


def merge_groups(manual_groups: DataFrame, new_keys: DataFrame) -> DataFrame:
    """Append groups (log_id, group_no, name, pos, fight_key) of two or more keys.

    The new keys leave older groups first; new groups are numbered behind the existing ones.
    """
    sizes = new_keys.groupBy("log_id", "group_no").agg(F.count("*").alias("_n")).where(F.col("_n") >= 2)
    fresh = new_keys.join(sizes, ["log_id", "group_no"]).drop("_n")
    top = manual_groups.groupBy("log_id").agg((F.max("group_no") + 1).alias("_base"))
    fresh = fresh.join(top, "log_id", "left").withColumn(
        "group_no", F.col("group_no") + F.coalesce("_base", F.lit(0))
    )
    kept = split_groups(manual_groups, fresh)
    return kept.unionByName(fresh.select(*manual_groups.columns))
