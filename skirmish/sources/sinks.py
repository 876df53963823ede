"""JSON result sinks.

A document is a set of keyed rows ``(log_id[, encounter_id | fight_id], section, payload)``: one JSON
object per attacker, pair, hit, bucket chunk and so on. No document is put together in one task, so
an encounter of any size can be written; a reader picks the sections of one id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.operators import compare, coverage, session, sides, stats, timeline
from skirmish.plans.analysis import Analysis
from skirmish.sources.staging import cut

ENC = ("log_id", "encounter_id")


def section(df: DataFrame, name: str, keys: tuple[str, ...] = ENC) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.lit(name).alias("section"), F.to_json(F.struct(*rest)).alias("payload"))


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _written(parts: dict[str, DataFrame]) -> DataFrame:
    """The sections as one table, each written by itself.

    In one job adaptive execution shares its tasks out among all sections by bytes, so a section of costly rows gets
    one task or two. The section's name is no column of the files, so a reader of one section opens no other.
    """
    tables = [cut(df.drop("section"), f"doc_{name}").withColumn("section", F.lit(name)) for name, df in parts.items()]
    return _together([t.select(*[c for c in t.columns if c not in ("section", "payload")], "section", "payload") for t in tables])


def read_section(documents: DataFrame, name: str, schema: str) -> DataFrame:
    """The rows of one section again, with the payload's fields as columns."""
    keys = [c for c in documents.columns if c not in ("section", "payload")]
    rows = documents.where(F.col("section") == name)
    return rows.select(*keys, F.from_json("payload", schema).alias("p")).select(*keys, "p.*")


def encounter_documents(a: Analysis, width: int = 5, pet_owners: DataFrame | None = None) -> DataFrame:
    """All sections of every encounter: the widest report, for all encounters at once.

    What several sections share is written once, and so is every section. Series are packed, 256 buckets a row.
    """
    attackers = cut(stats.attackers(a.acts, ENC), "doc_attackers")
    matrix = cut(stats.damage_matrix(a.acts), "doc_matrix")
    sided = cut(sides.encounter_sides(attackers, matrix, a.members, a.heals), "doc_sides")
    names = sides.sides_by_name(sided)
    listed = stats.without_corpses(stats.attacker_shares(attackers, a.encounters, ENC)).join(
        sided.select(*ENC, "actor", "side"), [*ENC, "actor"]
    )
    counts = a.acts.groupBy("log_id", "fight_id", "actor").agg(F.lit(1)).groupBy("log_id", "fight_id").agg(
        F.count("*").alias("attacker_count")
    )
    members = a.members.join(counts, ["log_id", "fight_id"], "left").fillna(0, ["attacker_count"])
    raw = stats.owner_choices(stats.raw_attackers(a.acts, a.members), pet_owners)
    over = (width, ENC, "enc_start_t", "enc_end_t")
    sections = {
        "header": a.encounters,
        "member": members.drop("start_t", "end_t", "close_ord"),
        "attacker": listed.drop("first_seen"),
        "special": stats.special_stats(a.acts, ENC),
        "timeline": timeline.packed_timeline(a.acts, *over),
        "raid_series": timeline.packed_raid_series(a.acts, *over),
        "biggest_hit": stats.biggest_hits(a.acts, ENC),
        "damage_pair": matrix,
        "breakdown": stats.directed_breakdown(listed, matrix, stats.canonical_names(a.acts)),
        "damage_series": timeline.packed_pair_series(a.acts, width),
        "hit": stats.hit_details(a.acts),
        "healer": sides.healer_sides(stats.healers(a.heals), sided),
        "heal_pair": stats.heal_pairs(a.heals),
        "heal_series": timeline.packed_heal_series(a.heals, width),
        "healer_series": timeline.packed_heal_series(a.heals, width, ("actor",)),
        "heal": stats.heal_details(a.heals),
        "biggest_heal": stats.biggest_heals(a.heals),
        "defender": stats.healed_defenders(stats.defenders(a.acts, names), a.heals),
        "defender_pair": stats.defender_pairs(a.acts, names).drop("first_seen"),
        "heals_received": stats.heals_received(a.heals),
        "heals_received_series": timeline.packed_heal_series(a.heals, width, ("target",)),
        "raw_attacker": raw,
    }
    return _written({name: section(rows, name) for name, rows in sections.items()})


def session_documents(a: Analysis, killed_only: bool = False, chosen: DataFrame | None = None) -> DataFrame:
    """Every log's session: totals, encounters in time order, actor rows by mode, and their series.

    A series row covers 256 encounters of one actor: values and rates in each mode, and for tanks
    also the heals received.
    """
    attackers = cut(stats.attackers(a.acts, ENC), "doc_attackers")
    pairs = cut(stats.defense_pairs(a.acts, ENC), "doc_pairs")
    whole = session.summary(a.encounters, attackers, pairs, a.members, a.heals, killed_only, chosen)
    mine = cut(whole.encounters, "doc_encounters")
    rollup = cut(session.by_mode(whole), "doc_rollup")
    places = session.numbered_encounters(mine).select(
        *ENC, "slot", "name", "start", "duration_seconds", "fight_complete"
    )
    key = ("log_id",)
    tanking = rollup.where(F.col("mode") == "tanking")
    return _together(
        [
            section(session.session_header(mine, tanking), "header", key),
            section(places, "encounter", key),
            section(rollup, "actor", key),
            section(session.all_series(attackers, a.heals, pairs, mine, rollup), "series", key),
        ]
    )


def coverage_documents(parsed: DataFrame, limit: int = 200) -> DataFrame:
    """Per log: line counts, lines by event type, and the most frequent shapes of unknown lines."""
    totals = coverage.shape_totals(coverage.unknown_shapes(parsed))
    head = coverage.line_counts(parsed).join(totals, "log_id", "left").fillna(
        0, ["unknown_total_groups", "unknown_total_lines"]
    )
    key = ("log_id",)
    return _together(
        [
            section(head, "header", key),
            section(coverage.type_counts(parsed), "type", key),
            section(coverage.top_shapes(parsed, limit).drop("first_ord"), "unknown_group", key),
        ]
    )


def fight_documents(a: Analysis, width: int = 5) -> DataFrame:
    """Sections of every single fight."""
    key = ("log_id", "fight_id")
    return _together(
        [
            section(a.members.drop("start_t", "end_t", "close_ord"), "header", key),
            section(stats.attacker_shares(stats.attackers(a.acts), a.members).drop("first_seen"), "attacker", key),
            section(stats.special_stats(a.acts), "special", key),
            section(timeline.packed_timeline(a.acts, width), "timeline", key),
            section(stats.biggest_hits(a.acts), "biggest_hit", key),
        ]
    )


def diff_documents(a: Analysis, pairs: DataFrame) -> DataFrame:
    """Headers and actor rows of every compared pair."""
    actors = compare.diff_actors(
        pairs, a.encounters, stats.attackers(a.acts, ENC), stats.defense_pairs(a.acts, ENC), a.heals, a.members
    )
    key = ("pair_id",)
    return _together(
        [section(compare.diff_headers(pairs, a.encounters), "header", key), section(actors, "actor", key)]
    )


def write_documents(documents: DataFrame, path: str) -> None:
    """JSON lines in one folder per section."""
    documents.write.mode("overwrite").partitionBy("section").json(path)
