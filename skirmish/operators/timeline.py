"""Bucketed series, counted from the start of a fight or encounter.

Dense series are packed into arrays of at most ``CHUNK`` buckets per row, so that neither a long
fight nor its zero buckets meet in one row; ``long_form`` unpacks them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions import scalars as S

CHUNK = 256


def bucketed(
    rows: DataFrame, keys: Sequence[str], start: str, end: str, width: int, value: str = "amount"
) -> DataFrame:
    """Sparse sums per key and bucket; offsets before the start fall into bucket 0."""
    n = S.bucket_count(F.col(end) - F.col(start), width)
    return rows.groupBy(
        *keys, S.bucket_index(F.col("t") - F.col(start), width, n).alias("bucket")
    ).agg(F.sum(value).alias(value))


def packed(sparse: DataFrame, spine: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Zero-filled series: ``spine`` names each key with ``n_buckets``; one row per chunk."""
    parts = (
        sparse.withColumn("chunk", F.floor(F.col("bucket") / CHUNK).cast("long"))
        .groupBy(*keys, "chunk")
        .agg(F.collect_list(F.struct("bucket", F.col(value).alias("_a"))).alias("_cells"))
    )
    grid = spine.select(
        *keys,
        "n_buckets",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_buckets") - 1) / CHUNK))).alias("chunk"),
    )
    return _filled(grid.join(parts, [*keys, "chunk"], "left"), keys, value)


def _filled(parts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Chunks with their ``_cells`` (bucket, amount) as arrays; buckets without a cell count 0.

    Every cell in order brings the zeros behind the cell before it, the end of the list those behind the last one: a
    chunk costs its buckets once, not a look through all cells for each bucket.
    """
    first = F.col("chunk") * CHUNK
    last = F.least(F.col("n_buckets"), first + CHUNK) - 1
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<struct<bucket:bigint,_a:bigint>>")
    cells = F.sort_array(F.coalesce("_cells", none))
    before = F.concat(F.array(F.struct((first - 1).alias("bucket"), zero.alias("_a"))), cells)

    def fill(cell: Column, prev: Column) -> Column:
        at = prev["bucket"]
        filled = F.concat(F.array_repeat(zero, (cell["bucket"] - at - 1).cast("int")), F.array(F.coalesce(cell["_a"], zero)))
        return F.when(cell.isNull(), F.array_repeat(zero, (last - at).cast("int"))).otherwise(filled)

    return parts.select(
        *keys,
        "chunk",
        first.alias("first_bucket"),
        F.flatten(F.zip_with(cells, before, fill)).alias(value),
    )


def long_form(series: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return series.select(
        *keys, "first_bucket", F.posexplode(value).alias("_i", "_v")
    ).select(
        *keys,
        (F.col("first_bucket") + F.col("_i")).cast("long").alias("bucket"),
        F.col("_v").alias(value),
    )


def timeline(
    acts: DataFrame,
    width: int = 5,
    by: Sequence[str] = ("log_id", "fight_id"),
    start: str = "fight_start_t",
    end: str = "fight_end_t",
) -> DataFrame:
    """Damage per attacker and bucket, zeros included; miss-only attackers get zero rows."""
    keys = [*by, "actor"]
    return long_form(packed_timeline(acts, width, by, start, end), keys, "amount")


def packed_timeline(
    acts: DataFrame,
    width: int = 5,
    by: Sequence[str] = ("log_id", "fight_id"),
    start: str = "fight_start_t",
    end: str = "fight_end_t",
) -> DataFrame:
    return _packed_by(acts, [*by, "actor"], width, start, end)


def _packed_by(acts: DataFrame, keys: Sequence[str], width: int, start: str, end: str) -> DataFrame:
    """Dense damage series per key; only as many zeros as the keys themselves span.

    Misses keep their cells, without an amount, so every key of at most ``CHUNK`` buckets brings its only chunk
    along; the chunks of longer series, which may hold no cell, are added as rows. No spine is joined.
    """
    n = S.bucket_count(F.col(end) - F.col(start), width)
    hit = F.col("event_type") != "melee_miss"
    cells = acts.groupBy(*keys, S.bucket_index(F.col("t") - F.col(start), width, n).alias("bucket")).agg(
        F.sum(F.when(hit, F.col("amount"))).alias("amount"), F.first(n).alias("n_buckets")
    )
    cells = cells.withColumn("chunk", F.floor(F.col("bucket") / CHUNK).cast("long"))
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_buckets") - 1) / CHUNK).cast("long"))
    long = acts.select(*keys, n.alias("n_buckets")).where(F.col("n_buckets") > CHUNK).distinct()
    empty = long.select("*", F.explode(chunks).alias("chunk"))
    # An actor without a name counts 0 throughout.
    named = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    cell = F.when(named & F.col("amount").isNotNull(), F.struct("bucket", F.col("amount").alias("_a")))
    parts = (
        cells.unionByName(empty, allowMissingColumns=True)
        .groupBy(*keys, "chunk")
        .agg(F.first("n_buckets").alias("n_buckets"), F.collect_list(cell).alias("_cells"))
    )
    return _filled(parts, keys, "amount")


def raid_series(
    acts: DataFrame,
    width: int = 5,
    by: Sequence[str] = ("log_id", "fight_id"),
    start: str = "fight_start_t",
    end: str = "fight_end_t",
) -> DataFrame:
    """All attackers together per bucket, and the rate of each bucket."""
    series = long_form(packed_raid_series(acts, width, by, start, end), by, "amount")
    return series.withColumn("dps", F.col("amount") / F.lit(width))


def packed_raid_series(
    acts: DataFrame,
    width: int = 5,
    by: Sequence[str] = ("log_id", "fight_id"),
    start: str = "fight_start_t",
    end: str = "fight_end_t",
) -> DataFrame:
    return _packed_by(acts, by, width, start, end)


def top_and_other(
    acts: DataFrame,
    width: int = 5,
    top: int = 8,
    by: Sequence[str] = ("log_id", "fight_id"),
    start: str = "fight_start_t",
    end: str = "fight_end_t",
) -> DataFrame:
    """Per-second series of the ``top`` actors, the rest summed as ``Other``.

    Rows are summed by actor and bucket before the top list is joined, so the join moves cells, not rows,
    and actors are relabeled before filling, so only the shown lines are filled with zeros.
    """
    own = [*by, "actor"]
    hits = acts.where(F.col("event_type") != "melee_miss")
    cells = bucketed(hits, own, start, end, width)
    actors = acts.groupBy(*own).agg(
        F.coalesce(F.sum("amount"), F.lit(0)).alias("_total"),
        F.first(S.bucket_count(F.col(end) - F.col(start), width)).alias("n_buckets"),
    )
    order = Window.partitionBy(*by).orderBy(F.col("_total").desc(), "actor")
    best = actors.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= top).select(*own, "_place")
    keys = [*by, "label", "is_other"]

    def labeled(rows: DataFrame) -> DataFrame:
        rest = F.col("_place").isNull()
        label = F.when(rest, "Other").otherwise(F.col("actor"))
        return rows.join(best, own, "left").withColumn("label", label).withColumn("is_other", rest)

    spine = labeled(actors).groupBy(*keys).agg(F.first("n_buckets").alias("n_buckets"))
    sparse = labeled(cells).groupBy(*keys, "bucket").agg(F.sum("amount").alias("amount"))
    series = long_form(packed(sparse, spine, keys, "amount"), keys, "amount")
    return series.select(*keys, "bucket", (F.col("amount") / F.lit(width)).alias("rate"))


def visible_rows(totals: DataFrame, min_dps: int = 100) -> DataFrame:
    """Attacker rows of a timeline worth showing: damage of at least ``min_dps`` over the duration."""
    return totals.where(F.col("damage") >= F.col("duration_seconds") * min_dps)


def pair_series(acts: DataFrame, width: int = 5) -> DataFrame:
    """Sparse damage series per attacker and target of an encounter (corpses left out)."""
    hits = acts.where(
        (F.col("event_type") != "melee_miss") & ~S.is_corpse("actor") & ~S.is_corpse("target")
    ).select(
        "log_id", "encounter_id", S.fold("actor").alias("attacker_key"), S.fold("target").alias("target_key"),
        "t", "amount", "enc_start_t", "enc_end_t",
    )
    keys = ["log_id", "encounter_id", "attacker_key", "target_key"]
    return bucketed(hits, keys, "enc_start_t", "enc_end_t", width)


def packed_pair_series(acts: DataFrame, width: int = 5) -> DataFrame:
    """Dense damage series of every attacker and target; a pair whose swings were all avoided is all zeros."""
    rows = acts.where(~S.is_corpse("actor") & ~S.is_corpse("target")).select(
        "log_id", "encounter_id", S.fold("actor").alias("attacker_key"), S.fold("target").alias("target_key"),
        "event_type", "t", "amount", "enc_start_t", "enc_end_t",
    )
    keys = ["log_id", "encounter_id", "attacker_key", "target_key"]
    return _packed_by(rows, keys, width, "enc_start_t", "enc_end_t")


def packed_heal_series(heals: DataFrame, width: int = 5, who: Sequence[str] = ("actor", "target")) -> DataFrame:
    """Dense healing series per healer and receiver, or of one side: ``who`` names the sides kept."""
    names = {"actor": "attacker_key", "target": "target_key"}
    rows = heals.select(
        "log_id", "encounter_id", *(S.fold(w).alias(names[w]) for w in who), F.lit("heal").alias("event_type"),
        "t", "amount", "enc_start_t", "enc_end_t",
    )
    return _packed_by(rows, ["log_id", "encounter_id", *(names[w] for w in who)], width, "enc_start_t", "enc_end_t")


def heal_series(heals: DataFrame, who: str = "actor", width: int = 5) -> DataFrame:
    """Sparse healing series per healer (``actor``) or receiver (``target``) of an encounter."""
    rows = heals.withColumn("name_key", S.fold(who))
    return bucketed(rows, ["log_id", "encounter_id", "name_key"], "enc_start_t", "enc_end_t", width)


def all_row(pairs: DataFrame, key: str = "attacker_key") -> DataFrame:
    """The ``All`` row of a breakdown: the series of one actor over all its partners."""
    return pairs.groupBy("log_id", "encounter_id", key, "bucket").agg(F.sum("amount").alias("amount"))


def pair_stats(acts: DataFrame, width: int = 5) -> DataFrame:
    """Per pair: peak rate and its first bucket, mean active rate, active buckets, biggest, crit %."""
    keys = ["log_id", "encounter_id", "attacker_key", "target_key"]
    cells = pair_series(acts, width).groupBy(*keys).agg(
        F.max("amount").alias("_peak"),
        F.max_by("bucket", F.struct("amount", -F.col("bucket"))).alias("_peak_bucket"),
        F.avg(F.when(F.col("amount") > 0, F.col("amount"))).alias("_avg"),
        F.count_if(F.col("amount") > 0).alias("active_buckets"),
    )
    hits = (
        acts.where((F.col("event_type") != "melee_miss") & ~S.is_corpse("actor") & ~S.is_corpse("target"))
        .groupBy("log_id", "encounter_id", S.fold("actor").alias("attacker_key"), S.fold("target").alias("target_key"))
        .agg(
            F.max("amount").alias("biggest"),
            F.count("*").alias("hits"),
            F.count_if(S.is_pair_crit("modifiers")).alias("_crits"),
            F.first(S.bucket_count(F.col("enc_end_t") - F.col("enc_start_t"), width)).alias("buckets"),
        )
    )

    def up(x: Column) -> Column:
        return F.floor(x + 0.5).cast("long")

    return cells.join(hits, keys).select(
        *keys,
        up(F.col("_peak") / width).alias("peak_rate"),
        F.when(F.col("_peak") > 0, F.col("_peak_bucket") * width).otherwise(0).cast("long").alias("peak_offset_s"),
        up(F.coalesce("_avg", F.lit(0.0)) / width).alias("avg_active_rate"),
        "active_buckets",
        "buckets",
        "biggest",
        up(F.col("_crits") * 100 / F.col("hits")).alias("crit_pct"),
    )


def life_delta(taken: DataFrame, healed: DataFrame, width: int = 5) -> DataFrame:
    """Heals received minus damage taken per defender and bucket; a missing side counts 0.

    Inputs are sparse series ``(log_id, encounter_id, name_key, bucket, amount)``.
    """
    keys = ["log_id", "encounter_id", "name_key", "bucket"]
    d = taken.select(*keys, F.col("amount").alias("damage"))
    h = healed.select(*keys, F.col("amount").alias("healing"))
    out = d.join(h, keys, "full_outer")
    damage, healing = F.coalesce("damage", F.lit(0)), F.coalesce("healing", F.lit(0))
    return out.select(*keys, damage.alias("damage"), healing.alias("healing"), (healing - damage).alias("delta"))
