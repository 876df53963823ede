"""The registered queries: one per operator, over the whole provided tables.

Detection runs once per table folder and session; every query branches from the written tables, as
a user's reports would.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.functions import scalars as S
from skirmish.functions.sliced import numbered, ord_slice
from skirmish.operators import compare, coverage, encounters, fights, overrides, parse, player, session, sides, stats, timeline
from skirmish.plans.analysis import Analysis, Detected, Options, analyze_target, detect, group
from skirmish.plans.oracles import CTE, GAP, MIN_DAMAGE, WIDTH, _fights, corpse, sql
from skirmish.functions.scalars import OUTCOMES
from skirmish.sources import growing, logs, sinks, tables
from skirmish.sources import overrides as override_files
from skirmish.sources.staging import cut, staging_dir
from skirmish.streaming.fights import FightStream, gap_sessions, replay

ENC = ("log_id", "encounter_id")
SCALED = Options(gap_seconds=GAP, min_damage=MIN_DAMAGE)


class Workspace:
    """The shared tables of one folder, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def raw(self) -> DataFrame:
        return tables.combat_events(self.spark, self.sf_dir)

    @cached_property
    def events(self) -> DataFrame:
        return cut(self.raw.select(*tables.EVENT_COLUMNS), "events")

    @cached_property
    def owners(self) -> DataFrame:
        return tables.pet_owner_table(self.events)

    @cached_property
    def found(self) -> Detected:
        return detect(self.events, SCALED)

    @cached_property
    def main(self) -> Analysis:
        return group(self.found, self.owners)

    @cached_property
    def manual_groups(self) -> DataFrame:
        """Of every ten fights of a log, the third and the eighth belong together."""
        n = F.col("fight_id")
        no = F.floor(n / 10).cast("long")
        return self.found.fights.where((n % 10).isin(2, 7)).select(
            "log_id",
            no.alias("group_no"),
            F.when(no % 2 == 0, F.concat(F.lit("Phase "), no.cast("string"))).alias("name"),
            n.cast("long").alias("pos"),
            "fight_key",
        )

    @cached_property
    def manual(self) -> Analysis:
        return group(self.found, self.owners, self.manual_groups)

    @cached_property
    def attackers(self) -> DataFrame:
        return stats.attackers(self.main.acts, ENC)

    @cached_property
    def pairs(self) -> DataFrame:
        return stats.defense_pairs(self.main.acts, ENC)

    @cached_property
    def matrix(self) -> DataFrame:
        return stats.damage_matrix(self.main.acts)

    @cached_property
    def sides(self) -> DataFrame:
        m = self.main
        return cut(sides.encounter_sides(self.attackers, self.matrix, m.members, m.heals), "sides")

    @cached_property
    def log_sides(self) -> DataFrame:
        m = self.main
        return cut(sides.pooled_sides(self.attackers, m.members, m.heals, ["log_id"]), "log_sides")

    @cached_property
    def running(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The fights still open, small ones too, their rows, and all heals."""
        live = cut(fights.open_fights(self.events, self.found.tagged, gap_seconds=GAP), "open_fights")
        acts = self.found.tagged.where(~F.col("is_death")).join(live.select(*fights.FIGHT), list(fights.FIGHT), "left_semi")
        heals = self.events.where(F.col("event_type") == "heal").withColumn("t", S.epoch("ts"))
        owned = [cut(overrides.apply_pet_owners(x, self.owners), "running") for x in (acts, heals)]
        return live, *owned

    @cached_property
    def documents(self) -> DataFrame:
        return sinks.encounter_documents(self.main, WIDTH, self.owners)

    @cached_property
    def session_documents(self) -> DataFrame:
        return cut(sinks.session_documents(self.main), "session_documents")

    @cached_property
    def coverage_documents(self) -> DataFrame:
        return cut(sinks.coverage_documents(self.parsed), "coverage_documents")

    @cached_property
    def streamed(self) -> FightStream:
        return replay(self.events, GAP, MIN_DAMAGE, parts=3, encounter_gap_seconds=0)

    @cached_property
    def streamed_owned(self) -> FightStream:
        return replay(self.events, GAP, MIN_DAMAGE, parts=3, pet_owners=self.owners, expire_idle=True)

    @cached_property
    def streamed_manual(self) -> FightStream:
        return replay(self.events, GAP, MIN_DAMAGE, parts=3, encounter_gap_seconds=0, manual_groups=self.manual_groups)

    @cached_property
    def parsed(self) -> DataFrame:
        lines = tables.log_lines(self.raw)
        return cut(parse.parse_lines(lines, keep_unstamped=True), "parsed")


_open: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _open:
        _open.clear()
        _open[key] = Workspace(spark, sf_dir)
    return _open[key]


QUERIES: dict[str, Callable[[Workspace], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None):
    def register(fn: Callable[[Workspace], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def _text(list_col: str) -> Column:
    return F.concat_ws("|", list_col)


STAMP = "strftime(make_timestamp({0} * 1000000), '%Y-%m-%d %H:%M:%S')"


def _stamp(c: str) -> str:
    return STAMP.format(c)


def _whole(x: str) -> str:
    return f"CAST(round_even({x}, 0) AS BIGINT)"


def _pct(part: str, total: str) -> str:
    return f"round_even(100.0 * {part} / CASE WHEN {total} = 0 THEN 1 ELSE {total} END, 1)"


def _sum(c: str) -> str:
    return f"CAST(sum({c}) AS BIGINT)"


FIGHT_SELECT = f"""
SELECT log_id, fight_id, target, {_stamp('start_t')} AS start, {_stamp('end_t')} AS "end", duration_seconds,
  fight_complete, total_damage, hits, misses,
  {_whole('CASE WHEN duration_seconds > 0 THEN total_damage / duration_seconds ELSE 0.0 END')} AS raid_dps, fight_key"""


def _fight_rows(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        "log_id", "fight_id", "target", S.stamp("start").alias("start"), S.stamp("end").alias("end"),
        "duration_seconds", "fight_complete", "total_damage", "hits", "misses",
        S.whole("raid_dps").alias("raid_dps"), "fight_key", *extra,
    )


# --- sources and parsing ------------------------------------------------------


@query("parse_roundtrip", sql("""
SELECT log_id, ord, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type, actor, target, amount, verb, spell,
  damage_type, outcome, array_to_string(modifiers, '|') AS modifiers, you_died, zone, body FROM ev"""))
def _(w: Workspace) -> DataFrame:
    cols = [c for c in tables.EVENT_COLUMNS if c not in ("ts", "modifiers")]
    marks = F.when(F.col("modifiers").isNotNull(), _text("modifiers"))
    return w.parsed.select(S.stamp("ts").alias("ts"), marks.alias("modifiers"), *cols)


_READ_BACK = sql("""
SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY ord) AS n, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type,
  actor, target, amount, verb, spell, damage_type, outcome, array_to_string(modifiers, '|') AS modifiers, zone, body FROM ev""")


def _read_back(lines: DataFrame) -> DataFrame:
    """Events of lines that came from files, by their place in the log."""
    found = numbered(parse.parse_lines(lines), ["log_id"], ord_slice("ord"), ["ord"], "n")
    marks = F.when(F.col("modifiers").isNotNull(), _text("modifiers"))
    kept = ("log_id", "n", "event_type", "actor", "target", "amount", "verb", "spell", "damage_type", "outcome", "zone", "body")
    return found.select(*kept, S.stamp("ts").alias("ts"), marks.alias("modifiers"))


@query("scan_lines", _READ_BACK)
def _(w: Workspace) -> DataFrame:
    """The lines as text files, one for each log, read by the scan."""
    folder = growing.staged_folder(staging_dir(w.spark))
    for _ in growing.write_in_steps(tables.log_lines(w.raw), folder, 1):
        pass
    return _read_back(cut(logs.read_lines(w.spark, folder), "scanned"))


@query("stream_growing_log", _READ_BACK)
def _(w: Workspace) -> DataFrame:
    """The same files while they grow, every step cut inside a line, followed by a stream that restarts from its checkpoint."""
    folder = growing.staged_folder(staging_dir(w.spark))
    out = f"{folder}-events"
    for _ in growing.write_in_steps(cut(tables.log_lines(w.raw), "lines"), folder, 3):
        stream = growing.follow_logs(w.spark, folder, splitBytes=1 << 16)
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}-checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
    return _read_back(w.spark.read.schema(growing.SCHEMA).parquet(out))


@query("parser_line_counts", sql("""
SELECT log_id, count(*) AS total_lines, CAST(0 AS BIGINT) AS no_timestamp,
  count(*) FILTER (event_type = 'unknown') AS unknown_lines FROM ev GROUP BY ALL"""))
def _(w: Workspace) -> DataFrame:
    return coverage.line_counts(w.parsed)


@query("parser_type_counts", sql("SELECT log_id, event_type, count(*) AS lines FROM ev GROUP BY ALL"))
def _(w: Workspace) -> DataFrame:
    return coverage.type_counts(w.parsed)


_SHAPES = """
SELECT log_id, regexp_replace(body, '\\d+', 'N', 'g') AS shape, count(*) AS lines, arg_min(body, ord) AS example,
  min(ord) AS first_ord FROM txt GROUP BY ALL"""
_TOP_SHAPES = """
SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY lines DESC, first_ord) AS place FROM shp QUALIFY place <= 200"""
_DOCS = "SELECT source AS log_id, doc_id AS ord, text AS body FROM documents"
_CONV = "SELECT role AS log_id, conv_id * 1000000 + turn AS ord, text AS body FROM conversations"


@query("unknown_shapes_documents", sql(_TOP_SHAPES, txt=_DOCS, shp=_SHAPES))
def _(w: Workspace) -> DataFrame:
    return coverage.top_shapes(tables.text_events(w.spark, w.sf_dir, "documents"))


@query("unknown_shapes_conversations", sql(_TOP_SHAPES, txt=_CONV, shp=_SHAPES))
def _(w: Workspace) -> DataFrame:
    return coverage.top_shapes(tables.text_events(w.spark, w.sf_dir, "conversations"))


@query("unknown_shape_totals", sql(
    "SELECT log_id, count(*) AS unknown_total_groups, CAST(sum(lines) AS BIGINT) AS unknown_total_lines FROM shp GROUP BY ALL",
    txt=_DOCS, shp=_SHAPES))
def _(w: Workspace) -> DataFrame:
    return coverage.shape_totals(coverage.unknown_shapes(tables.text_events(w.spark, w.sf_dir, "documents")))


@query("last_timestamp", sql(f"SELECT log_id, {_stamp('last_t')} AS last_ts FROM log_end"))
def _(w: Workspace) -> DataFrame:
    return logs.last_stamp(w.events).select("log_id", S.stamp("last_ts").alias("last_ts"))


@query("since_window", sql("""
SELECT e.log_id, e.ord, e.event_type FROM ev e JOIN log_end l ON l.log_id = e.log_id AND e.t >= l.last_t - 96 * 3600"""))
def _(w: Workspace) -> DataFrame:
    return logs.since_hours(w.events, 96).select("log_id", "ord", "event_type")


@query("characters", sql(r"""
SELECT log_id, nullif(regexp_extract(log_id, '(?i)^eqlog_([A-Za-z]+)_', 1), '') AS char_name, count(*) AS lines
FROM ev GROUP BY ALL"""))
def _(w: Workspace) -> DataFrame:
    return logs.with_character(w.events.select("log_id")).groupBy("log_id", "char_name").agg(
        F.count("*").alias("lines")
    )


# --- scalar functions ----------------------------------------------------------


@query("modifier_flags", sql(f"""
SELECT log_id, ord, len([m for m in modifiers if contains(m, 'Critical') OR contains(m, 'Crippling Blow')]) > 0 AS is_crit,
  len([m for m in modifiers if contains(lower(m), 'critical')]) > 0 AS is_heal_crit,
  len([m for m in modifiers if regexp_matches(m, '(?i)critical|crippling')]) > 0 AS is_pair_crit
FROM ev WHERE modifiers IS NOT NULL"""))
def _(w: Workspace) -> DataFrame:
    m = "modifiers"
    return w.events.where(F.col(m).isNotNull()).select(
        "log_id", "ord", S.is_crit(m).alias("is_crit"), S.is_heal_crit(m).alias("is_heal_crit"),
        S.is_pair_crit(m).alias("is_pair_crit"),
    )


_SOURCE = """coalesce(nullif(pet_origin, ''), nullif(spell, ''), specials[1],
  CASE verb WHEN 'frenzy on' THEN 'Frenzy On' WHEN 'frenzies on' THEN 'Frenzies On'
       ELSE upper(verb[1]) || verb[2:] END, 'Melee')"""


@query("hit_sources", sql(f"""
SELECT log_id, ord, array_to_string(specials, '|') AS specials, {_SOURCE} AS source FROM act WHERE hit"""))
def _(w: Workspace) -> DataFrame:
    return w.main.acts.where(F.col("event_type") != "melee_miss").select(
        "log_id", "ord", _text("specials").alias("specials"), S.hit_source().alias("source")
    )


@query("name_flags", sql(f"""
SELECT DISTINCT log_id, name, lower(name) IN ('you', 'yourself') AS is_you, ends_with(name, '`s pet') AS is_pet,
  lower(name) = lower(char_name) || '`s pet' AS is_your_pet, {corpse('name')} AS is_corpse
FROM (SELECT log_id, char_name, actor AS name FROM ev UNION ALL SELECT log_id, char_name, target FROM ev)
WHERE name IS NOT NULL"""))
def _(w: Workspace) -> DataFrame:
    names = w.events.select("log_id", F.explode(F.array("actor", "target")).alias("name")).where(
        F.col("name").isNotNull()
    ).distinct()
    return names.select(
        "log_id", "name", S.is_you("name").alias("is_you"), S.is_pet("name").alias("is_pet"),
        S.is_your_pet("name", S.char_name("log_id")).alias("is_your_pet"), S.is_corpse("name").alias("is_corpse"),
    )


# --- fights -----------------------------------------------------------------------


@query("fights", sql(FIGHT_SELECT + " FROM ft"))
def _(w: Workspace) -> DataFrame:
    return _fight_rows(w.found.fights)


@query("fights_all_unfiltered", sql("""
SELECT log_id, target, open_ord, start_t, end_t, fight_complete, total_damage, hits, misses FROM fx
WHERE target <> 'You' AND NOT ends_with(target, '`s pet')"""))
def _(w: Workspace) -> DataFrame:
    found = fights.detect_fights(w.events, w.found.tagged, gap_seconds=GAP, min_damage=0)
    return found.select(
        "log_id", "target", "open_ord", "start_t", "end_t", "fight_complete", "total_damage", "hits", "misses"
    )


@query("fights_min_duration", sql(FIGHT_SELECT + " FROM ft", ft=_fights("end_t - start_t >= 600")))
def _(w: Workspace) -> DataFrame:
    return _fight_rows(
        fights.detect_fights(
            w.events, w.found.tagged, gap_seconds=GAP, min_damage=MIN_DAMAGE, min_duration_seconds=600
        )
    )


@query("fights_open_dropped", sql(
    FIGHT_SELECT + " FROM ft", ft=_fights("(log_id, target, open_ord) NOT IN (SELECT (log_id, target, open_ord) FROM alive)")))
def _(w: Workspace) -> DataFrame:
    return _fight_rows(
        fights.detect_fights(
            w.events, w.found.tagged, gap_seconds=GAP, min_damage=MIN_DAMAGE, open_policy="drop"
        )
    )


@query("fights_open_included", sql(
    FIGHT_SELECT + ", a.open_ord IS NOT NULL AS in_progress FROM ft LEFT JOIN alive a USING (log_id, target, open_ord)"))
def _(w: Workspace) -> DataFrame:
    return _fight_rows(
        fights.detect_fights(
            w.events, w.found.tagged, gap_seconds=GAP, min_damage=MIN_DAMAGE, open_policy="include"
        ),
        "in_progress",
    )


_HEALS_EXTEND = {
    "hp": "SELECT log_id, ord, t, lag(t) OVER (PARTITION BY log_id ORDER BY ord) AS p FROM ev WHERE event_type = 'heal'",
    "hs": f"""SELECT log_id, ord, t, max(CASE WHEN p IS NULL OR t - p > {GAP} THEN ord END)
OVER (PARTITION BY log_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS ses FROM hp""",
    "hx": """SELECT log_id, ses, arg_max(t, ord) AS last_t, lead(ses) OVER (PARTITION BY log_id ORDER BY ses) AS next_ord
FROM hs GROUP BY log_id, ses""",
    "ah": """SELECT a.* EXCLUDE (pt, pd), b.t AS bt, b.ses AS bs, f.ord AS fo, f.t AS ft_, f.ses AS fs
FROM ad a ASOF LEFT JOIN hs b ON a.log_id = b.log_id AND a.ord >= b.ord
ASOF LEFT JOIN hs f ON a.log_id = f.log_id AND a.ord <= f.ord""",
    "pv": """SELECT *, lag(t) OVER w AS pt, lag(is_death) OVER w AS pd, lag(fo) OVER w AS pfo, lag(ft_) OVER w AS pft, lag(fs) OVER w AS pfs
FROM ah WINDOW w AS (PARTITION BY log_id, target ORDER BY ord)""",
    "br": f"""SELECT *, pt IS NULL OR pd OR CASE WHEN pfo < ord
  THEN NOT (pft - pt <= {GAP} AND pfs = bs AND (is_death OR t - bt <= {GAP})) ELSE NOT is_death AND t - pt > {GAP} END AS fresh FROM pv""",
    "tg": """SELECT *, is_death AND fresh AS late, max(CASE WHEN NOT is_death AND fresh THEN ord END)
OVER (PARTITION BY log_id, target ORDER BY ord ROWS UNBOUNDED PRECEDING) AS open_ord FROM br""",
    "fb": """SELECT log_id, target, open_ord, arg_min(t, ord) AS start_t, max(CASE WHEN is_death THEN t END) AS death_t,
  max(CASE WHEN is_death THEN ord END) AS death_ord, max(CASE WHEN NOT is_death THEN ord END) AS last_ord,
  CAST(coalesce(sum(amount), 0) AS BIGINT) AS total_damage, count(*) FILTER (event_type IN ('melee_hit', 'spell_damage')) AS hits,
  count(*) FILTER (event_type = 'melee_miss') AS misses FROM tg WHERE NOT late GROUP BY ALL""",
    "fn": """SELECT *, lead(open_ord) OVER (PARTITION BY log_id, target ORDER BY open_ord) AS nx FROM fb""",
    "fh": f"""SELECT f.*, l.t AS last_t, l.fo, x.last_t AS ses_t, x.next_ord,
  l.fo IS NOT NULL AND (nx IS NULL OR l.fo < nx) AS counts, coalesce(l.ft_ - l.t <= {GAP}, FALSE) AS in_time
FROM fn f JOIN pv l ON l.log_id = f.log_id AND l.ord = f.last_ord LEFT JOIN hx x ON x.log_id = f.log_id AND x.ses = l.fs""",
    "fc": """SELECT log_id, target, open_ord, start_t, death_ord, total_damage, hits, misses,
  coalesce(death_t, CASE WHEN counts AND in_time THEN greatest(last_t, ses_t) ELSE last_t END) AS end_t,
  coalesce(death_ord, least(CASE WHEN counts THEN CASE WHEN in_time THEN next_ord ELSE fo END END, nx), 9223372036854775807) AS close_ord
FROM fh""",
}


@query("fights_heals_extend", sql(FIGHT_SELECT + " FROM ft", **_HEALS_EXTEND))
def _(w: Workspace) -> DataFrame:
    tagged, sessions = fights.tag_fights(w.events, GAP, heals_extend_fights=True)
    found = fights.detect_fights(
        w.events, cut(tagged, "tagged_heals"), sessions, gap_seconds=GAP, min_damage=MIN_DAMAGE
    )
    return _fight_rows(found)


#: Every log's clock falls by this much half way, so a late death finds fights that ended "after" it.
SET_BACK = 100 * GAP
_SET_BACK = {
    "mid": "SELECT log_id, (min(ord) + max(ord)) // 2 AS mid FROM ev GROUP BY log_id",
    "ad": f"""
SELECT *, event_type = 'death' AS is_death, lag(t) OVER w AS pt, lag(event_type = 'death') OVER w AS pd
FROM (SELECT ev.* REPLACE (CASE WHEN ord > mid THEN t - {SET_BACK} ELSE t END AS t) FROM ev JOIN mid USING (log_id))
WHERE event_type IN ('melee_hit', 'spell_damage', 'melee_miss', 'death') WINDOW w AS (PARTITION BY log_id, target ORDER BY ord)""",
    "fb": CTE["fb"].replace("max(t)) AS end_t", "arg_max(t, ord)) AS end_t"),
    "ld": "SELECT log_id, target, ord, t, row_number() OVER (PARTITION BY log_id, target ORDER BY ord) AS n FROM tg WHERE late",
    "pr": f"""
SELECT d.log_id, d.target, d.n, f.open_ord, f.close_ord, d.t - f.end_t <= {GAP} + 10 AND NOT EXISTS (
  SELECT 1 FROM fc g WHERE g.log_id = f.log_id AND g.close_ord < d.ord AND d.t - g.end_t > {GAP} + 10
  AND (g.close_ord > f.close_ord OR (g.close_ord = f.close_ord AND g.open_ord > f.open_ord))) AS free
FROM ld d JOIN fc f ON f.log_id = d.log_id AND f.target = d.target AND f.death_ord IS NULL AND f.close_ord < d.ord""",
    "st": """
SELECT DISTINCT log_id, target, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS done FROM ld
UNION ALL
SELECT s.log_id, s.target, s.n + 1, CASE WHEN coalesce(arg_max(p.free, p.close_ord), FALSE)
  THEN list_append(any_value(s.done), arg_max(p.open_ord, p.close_ord)) ELSE any_value(s.done) END
FROM st s JOIN ld d ON d.log_id = s.log_id AND d.target = s.target AND d.n = s.n + 1
LEFT JOIN pr p ON p.log_id = s.log_id AND p.target = s.target AND p.n = s.n + 1 AND NOT list_contains(s.done, p.open_ord)
GROUP BY s.log_id, s.target, s.n""",
    "flip": "SELECT DISTINCT log_id, target, unnest(done) AS open_ord FROM st",
    "ft": _fights("end_t >= start_t"),
}


@query("fights_clock_set_back", sql(FIGHT_SELECT + " FROM ft", **_SET_BACK))
def _(w: Workspace) -> DataFrame:
    mid = w.events.groupBy("log_id").agg(F.floor((F.min("ord") + F.max("ord")) / 2).cast("long").alias("_mid"))
    back = F.when(F.col("ord") > F.col("_mid"), F.lit(SET_BACK)).otherwise(F.lit(0))
    falling = w.events.join(mid, "log_id").withColumn("ts", S.from_epoch(S.epoch("ts") - back)).drop("_mid")
    return _fight_rows(detect(falling, SCALED).fights)


@query("fights_since", sql(FIGHT_SELECT + " FROM ft", ad=CTE["ad"].replace(
    "FROM ev WHERE", "FROM ev JOIN log_end USING (log_id) WHERE t >= last_t - 240 * 3600 AND")))
def _(w: Workspace) -> DataFrame:
    return _fight_rows(
        detect(w.events, Options(gap_seconds=GAP, min_damage=MIN_DAMAGE, since_hours=240)).fights
    )


@query("single_target_fight", sql(f"""
WITH_MINE SELECT log_id, 'a MARSH rat' AS target, {_stamp('min(t)')} AS start,
  {_stamp('coalesce(max(death_t), arg_max(t, ord))')} AS "end", max(death_t) IS NOT NULL AS fight_complete,
  CAST(coalesce(sum(amount), 0) AS BIGINT) AS total_damage, count(*) FILTER (event_type <> 'melee_miss') AS hits,
  count(*) FILTER (event_type = 'melee_miss') AS misses
FROM mine LEFT JOIN died USING (log_id) WHERE death_ord IS NULL OR ord < death_ord GROUP BY ALL
""".replace("WITH_MINE ", ""),
    mine="SELECT * FROM ev WHERE lower(target) = 'a marsh rat' AND event_type IN ('melee_hit', 'spell_damage', 'melee_miss')",
    died="SELECT log_id, min(ord) AS death_ord, arg_min(t, ord) AS death_t FROM ev WHERE lower(target) = 'a marsh rat' AND event_type = 'death' GROUP BY ALL"))
def _(w: Workspace) -> DataFrame:
    return fights.analyze_fight(w.events, "a MARSH rat").select(
        "log_id", "target", S.stamp("start").alias("start"), S.stamp("end").alias("end"), "fight_complete",
        "total_damage", "hits", "misses",
    )


_TARGET = {
    "mine": "SELECT *, event_type <> 'melee_miss' AS hit FROM ev WHERE lower(target) = 'varn, last warden' AND event_type IN ('melee_hit', 'spell_damage', 'melee_miss')",
    "died": "SELECT log_id, min(ord) AS death_ord, arg_min(t, ord) AS death_t FROM ev WHERE lower(target) = 'varn, last warden' AND event_type = 'death' GROUP BY ALL",
    "one": """SELECT m.*, min(t) OVER w AS fs, coalesce(death_t, max(t) OVER w) AS fe FROM mine m LEFT JOIN died USING (log_id)
WHERE death_ord IS NULL OR ord < death_ord WINDOW w AS (PARTITION BY log_id)""",
}


@query("single_target_attackers", sql(f"""
SELECT log_id, CAST(1 AS BIGINT) AS fight_id, actor, CAST(coalesce(sum(amount), 0) AS BIGINT) AS damage, count(*) FILTER (hit) AS hits,
  count(*) FILTER (NOT hit) AS misses,
  count(*) FILTER (hit AND len([m for m in modifiers if contains(m, 'Critical') OR contains(m, 'Crippling Blow')]) > 0) AS crits,
  coalesce(max(amount), 0) AS biggest FROM one GROUP BY ALL""", **_TARGET))
def _(w: Workspace) -> DataFrame:
    return stats.attackers(analyze_target(w.events, "Varn, Last Warden")).drop("first_seen")


@query("single_target_timeline", sql(f"""
SELECT g.log_id, CAST(1 AS BIGINT) AS fight_id, g.actor, g.bucket, CAST(coalesce(v.amount, 0) AS BIGINT) AS amount
FROM (SELECT log_id, actor, unnest(range(CAST(any_value(fe - fs) // {WIDTH} + 1 AS BIGINT))) AS bucket FROM one GROUP BY log_id, actor) g
LEFT JOIN (SELECT log_id, actor, (t - fs) // {WIDTH} AS bucket, sum(amount) AS amount FROM one WHERE hit GROUP BY ALL) v
USING (log_id, actor, bucket)""", **_TARGET))
def _(w: Workspace) -> DataFrame:
    return timeline.timeline(analyze_target(w.events, "Varn, Last Warden"), WIDTH)


@query("fight_summary", sql(f"""
SELECT f.log_id, f.fight_id, f.target, f.duration_seconds, f.total_damage, f.fight_complete, count(DISTINCT a.actor) AS attacker_count,
  {_whole('any_value(CASE WHEN f.duration_seconds > 0 THEN f.total_damage / f.duration_seconds ELSE 0.0 END)')} AS raid_dps
FROM ft f JOIN act a USING (log_id, fight_id) GROUP BY f.log_id, f.fight_id, f.target, f.duration_seconds, f.total_damage, f.fight_complete"""))
def _(w: Workspace) -> DataFrame:
    count = stats.attackers(w.main.acts).groupBy("log_id", "fight_id").agg(F.count("*").alias("attacker_count"))
    return w.main.members.join(count, ["log_id", "fight_id"]).select(
        "log_id", "fight_id", "target", "duration_seconds", "total_damage", "fight_complete", "attacker_count",
        S.whole("raid_dps").alias("raid_dps"),
    )


@query("gap_sessions", sql(f"""
SELECT log_id, target, {_stamp('min(t)')} AS start, {_stamp('max(t)')} AS "end", count(*) AS events, {_sum('amount')} AS damage
FROM isl GROUP BY log_id, target, g""",
    gp=f"""SELECT *, lag(t) OVER (PARTITION BY log_id, target ORDER BY t, ord) AS p FROM ev
WHERE event_type IN ('melee_hit', 'spell_damage', 'melee_miss')""",
    isl=f"""SELECT *, sum(CASE WHEN p IS NULL OR t - p > {GAP} THEN 1 ELSE 0 END)
OVER (PARTITION BY log_id, target ORDER BY t, ord ROWS UNBOUNDED PRECEDING) AS g FROM gp"""))
def _(w: Workspace) -> DataFrame:
    return gap_sessions(w.events, GAP).select(
        "log_id", "target", S.stamp("start").alias("start"), S.stamp("end").alias("end"), "events", "damage"
    )


# --- fight statistics ----------------------------------------------------------

_BY_FIGHT = {"atk": CTE["atk"].replace("encounter_id", "fight_id"), "dp": CTE["dp"].replace("encounter_id", "fight_id")}


@query("attacker_stats", sql(f"""
SELECT a.log_id, a.fight_id, actor, damage, a.hits, a.misses, crits, biggest,
  {_whole('damage / CASE WHEN duration_seconds = 0 THEN 1 ELSE duration_seconds END')} AS dps,
  {_pct('damage', 'total_damage')} AS pct_of_total
FROM atk a JOIN ft USING (log_id, fight_id)""", **_BY_FIGHT))
def _(w: Workspace) -> DataFrame:
    return stats.attacker_shares(stats.attackers(w.main.acts), w.main.members).drop("first_seen")


@query("special_stats", sql(f"""
SELECT log_id, fight_id, actor, special, count(*) AS hits, {_sum('amount')} AS damage,
  CASE WHEN any_value(total) = 0 THEN 0.0 ELSE round_even(100.0 * sum(amount) / any_value(total), 1) END AS pct_of_attacker
FROM (SELECT log_id, fight_id, actor, amount, unnest(specials) AS special FROM act WHERE hit)
JOIN (SELECT log_id, fight_id, actor, sum(amount) AS total FROM act GROUP BY ALL) USING (log_id, fight_id, actor)
GROUP BY log_id, fight_id, actor, special"""))
def _(w: Workspace) -> DataFrame:
    return stats.special_stats(w.main.acts)


_AV = ", ".join(f"avoided_{o}" for o in OUTCOMES)


@query("defense_pairs", sql(f"""
SELECT log_id, fight_id, actor, target, damage_taken, hits_landed, biggest_taken, {_AV}, total_avoided, total_swings FROM dp""",
    **_BY_FIGHT))
def _(w: Workspace) -> DataFrame:
    return stats.defense_pairs(w.main.acts).drop("first_seen")


@query("biggest_hits", sql("""
SELECT log_id, fight_id, place, t - fs AS offset_s, actor, target, amount AS damage, array_to_string(specials, '|') AS specials
FROM (SELECT *, row_number() OVER (PARTITION BY log_id, fight_id ORDER BY amount DESC, t, fight_id, ord) AS place
      FROM act WHERE hit) WHERE place <= 10"""))
def _(w: Workspace) -> DataFrame:
    top = stats.biggest_hits(w.main.acts)
    return top.withColumn("specials", _text("specials"))


_GRID = f"""
SELECT log_id, fight_id, actor, unnest(range(CAST(greatest(1, any_value(fe - fs) // {WIDTH} + 1) AS BIGINT))) AS bucket
FROM act GROUP BY log_id, fight_id, actor"""
_TL = f"""
SELECT g.log_id, g.fight_id, g.actor, g.bucket, CAST(coalesce(v.amount, 0) AS BIGINT) AS amount FROM grid g LEFT JOIN (
  SELECT log_id, fight_id, actor, (t - fs) // {WIDTH} AS bucket, sum(amount) AS amount FROM act WHERE hit GROUP BY ALL) v
USING (log_id, fight_id, actor, bucket)"""


@query("timeline", sql("SELECT * FROM tl", grid=_GRID, tl=_TL))
def _(w: Workspace) -> DataFrame:
    return timeline.timeline(w.main.acts, WIDTH)


@query("raid_series", sql(f"""
SELECT log_id, fight_id, bucket, {_sum('amount')} AS amount, sum(amount) / {WIDTH} AS dps FROM tl GROUP BY log_id, fight_id, bucket""",
    grid=_GRID, tl=_TL))
def _(w: Workspace) -> DataFrame:
    return timeline.raid_series(w.main.acts, WIDTH)


@query("timeline_top_and_other", sql(f"""
SELECT t.log_id, t.fight_id, CASE WHEN place <= 2 THEN t.actor ELSE 'Other' END AS label, place > 2 AS is_other, bucket,
  sum(amount) / {WIDTH} AS rate
FROM tl t JOIN (SELECT log_id, fight_id, actor, row_number() OVER (PARTITION BY log_id, fight_id ORDER BY sum(amount) DESC, actor) AS place
  FROM tl GROUP BY log_id, fight_id, actor) p USING (log_id, fight_id, actor)
GROUP BY t.log_id, t.fight_id, label, is_other, bucket""", grid=_GRID, tl=_TL))
def _(w: Workspace) -> DataFrame:
    return timeline.top_and_other(w.main.acts, WIDTH, top=2)


@query("timeline_visible_rows", sql(f"""
SELECT a.log_id, a.fight_id, actor, damage FROM atk a JOIN ft USING (log_id, fight_id) WHERE damage >= duration_seconds * 1""",
    **_BY_FIGHT))
def _(w: Workspace) -> DataFrame:
    rows = stats.attackers(w.main.acts).join(
        w.main.members.select("log_id", "fight_id", "duration_seconds"), ["log_id", "fight_id"]
    )
    return timeline.visible_rows(rows, min_dps=1).select("log_id", "fight_id", "actor", "damage")


# --- encounters -----------------------------------------------------------------

ENC_SELECT = f"""
SELECT log_id, encounter_id, name, {_stamp('s')} AS start, {_stamp('x')} AS "end", dur AS duration_seconds, total_damage,
  total_healing, {_whole('raid_dps')} AS raid_dps, fight_complete, attacker_count, target_count, member_count"""


def _encounter_rows(df: DataFrame) -> DataFrame:
    return df.select(
        *ENC, "name", S.stamp("start").alias("start"), S.stamp("end").alias("end"), "duration_seconds",
        "total_damage", "total_healing", S.whole("raid_dps").alias("raid_dps"), "fight_complete", "attacker_count",
        "target_count", "member_count",
    )


@query("encounters", sql(ENC_SELECT + " FROM enc"))
def _(w: Workspace) -> DataFrame:
    return _encounter_rows(w.main.encounters)


@query("encounter_members", sql(
    "SELECT log_id, encounter_id, fight_id, target, total_damage, duration_seconds, fight_complete, fight_key FROM mb"))
def _(w: Workspace) -> DataFrame:
    return w.main.members.select(
        *ENC, "fight_id", "target", "total_damage", "duration_seconds", "fight_complete", "fight_key"
    )


_GAPPED = {"mb": CTE["mb"].replace("start_t - before_t > 0", "start_t - before_t > 1800")}


@query("encounters_with_gap", sql("SELECT log_id, fight_id, encounter_id FROM mb", **_GAPPED))
def _(w: Workspace) -> DataFrame:
    return encounters.group_fights(w.found.fights, gap_seconds=1800).select("log_id", "fight_id", "encounter_id")


_MANUAL = {
    "mg": """SELECT log_id, fight_id // 10 AS group_no, CASE WHEN fight_id // 10 % 2 = 0 THEN 'Phase ' || (fight_id // 10) END AS name,
fight_key FROM ft WHERE fight_id % 10 IN (2, 7)""",
    "vg": "SELECT log_id, group_no FROM mg GROUP BY ALL HAVING count(DISTINCT fight_key) >= 2",
    "cl": """SELECT f.log_id, f.fight_id, min(g.group_no) AS group_no FROM ft f JOIN mg g USING (log_id, fight_key)
JOIN vg v ON v.log_id = g.log_id AND v.group_no = g.group_no GROUP BY ALL""",
    "run": """SELECT f.*, max(end_t) OVER (PARTITION BY f.log_id ORDER BY f.fight_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_t
FROM ft f LEFT JOIN cl USING (log_id, fight_id) WHERE group_no IS NULL""",
    "au": """SELECT *, sum(CASE WHEN before_t IS NULL OR start_t - before_t > 0 THEN 1 ELSE 0 END)
OVER (PARTITION BY log_id ORDER BY fight_id ROWS UNBOUNDED PRECEDING) AS gid FROM run""",
    "al": """SELECT log_id, fight_id, FALSE AS man, CAST(gid AS BIGINT) AS gid, start_t FROM au UNION ALL
SELECT f.log_id, f.fight_id, TRUE, c.group_no, f.start_t FROM ft f JOIN cl c USING (log_id, fight_id)""",
    "gr": """SELECT log_id, man, gid, row_number() OVER (PARTITION BY log_id ORDER BY min(start_t), man, min(fight_id)) AS encounter_id
FROM al GROUP BY log_id, man, gid""",
    "mb": """SELECT f.*, g.encounter_id, CASE WHEN g.man AND g.gid % 2 = 0 THEN 'Phase ' || g.gid END AS manual_name
FROM ft f JOIN al a USING (log_id, fight_id) JOIN gr g ON g.log_id = a.log_id AND g.man = a.man AND g.gid = a.gid""",
}


@query("encounters_manual", sql(ENC_SELECT + " FROM enc", **_MANUAL))
def _(w: Workspace) -> DataFrame:
    return _encounter_rows(w.manual.encounters)


@query("encounters_is_manual", sql("""
SELECT e.log_id, e.encounter_id, e.encounter_id IN (SELECT eq.encounter_id FROM eq WHERE eq.log_id = e.log_id) AS is_manual FROM eb e""",
    **_MANUAL,
    eq="""SELECT m.log_id, m.encounter_id, g.group_no FROM mb m JOIN mg g USING (log_id, fight_key)
GROUP BY m.log_id, m.encounter_id, g.group_no
HAVING count(DISTINCT m.fight_key) = (SELECT count(DISTINCT x.fight_key) FROM mg x WHERE x.log_id = m.log_id AND x.group_no = g.group_no)
AND count(DISTINCT m.fight_key) = (SELECT count(DISTINCT y.fight_key) FROM mb y WHERE y.log_id = m.log_id AND y.encounter_id = m.encounter_id)"""))
def _(w: Workspace) -> DataFrame:
    return encounters.manual_flags(w.manual.members, w.manual_groups)


@query("heal_assignment", sql("SELECT log_id, ord, encounter_id, actor, target, amount FROM hl"))
def _(w: Workspace) -> DataFrame:
    return w.main.heals.select("log_id", "ord", "encounter_id", "actor", "target", "amount")


@query("heal_assignment_manual", sql("SELECT log_id, ord, encounter_id FROM hl", **_MANUAL))
def _(w: Workspace) -> DataFrame:
    return w.manual.heals.select("log_id", "ord", "encounter_id")


@query("session_totals", sql(f"""
SELECT log_id, count(*) AS encounter_count, count(*) FILTER (fight_complete) AS killed_count, {_sum('total_damage')} AS total_damage
FROM eb GROUP BY ALL"""))
def _(w: Workspace) -> DataFrame:
    return stats.session_totals(w.main.encounters)


_SHOWN = f"""
SELECT a.log_id, a.encounter_id, actor, damage, hits, misses, crits, biggest,
  {_whole('damage / CASE WHEN dur = 0 THEN 1 ELSE dur END')} AS dps,
  {_pct('damage', '(sum(damage) OVER (PARTITION BY a.log_id, a.encounter_id))')} AS pct_of_total
FROM atk a JOIN eb USING (log_id, encounter_id) WHERE NOT {corpse('actor')}"""


@query("encounter_attackers", sql(_SHOWN))
def _(w: Workspace) -> DataFrame:
    shares = stats.attacker_shares(w.attackers, w.main.encounters, ENC)
    return stats.without_corpses(shares).drop("first_seen")


@query("encounter_specials", sql(f"""
SELECT log_id, encounter_id, actor, special, count(*) AS hits, {_sum('amount')} AS damage,
  CASE WHEN any_value(total) = 0 THEN 0.0 ELSE round_even(100.0 * sum(amount) / any_value(total), 1) END AS pct_of_attacker
FROM (SELECT log_id, encounter_id, actor, amount, unnest(specials) AS special FROM act WHERE hit)
JOIN (SELECT log_id, encounter_id, actor, sum(amount) AS total FROM act GROUP BY ALL) USING (log_id, encounter_id, actor)
GROUP BY log_id, encounter_id, actor, special"""))
def _(w: Workspace) -> DataFrame:
    return stats.special_stats(w.main.acts, ENC)


@query("healers", sql(f"""
SELECT log_id, encounter_id, healer_key, healer, amount, casts, crits, biggest, hps,
  {_pct('amount', '(sum(amount) OVER (PARTITION BY log_id, encounter_id))')} AS pct_of_total, side FROM (
SELECT h.log_id, h.encounter_id, lower(actor) AS healer_key, arg_min(actor, ord) AS healer, {_sum('amount')} AS amount, count(*) AS casts,
  count(*) FILTER (len([m for m in modifiers if contains(lower(m), 'critical')]) > 0) AS crits, max(amount) AS biggest,
  {_whole('sum(amount) / CASE WHEN any_value(dur) = 0 THEN 1 ELSE any_value(dur) END')} AS hps,
  CASE WHEN any_value(s.side) = 'enemy' AND NOT ends_with(arg_min(actor, ord), '`s pet') THEN 'enemy' ELSE 'friendly' END AS side
FROM hl h LEFT JOIN sn s ON s.log_id = h.log_id AND s.encounter_id = h.encounter_id AND s.name_key = lower(h.actor)
GROUP BY h.log_id, h.encounter_id, lower(actor))"""))
def _(w: Workspace) -> DataFrame:
    return sides.healer_sides(stats.healers(w.main.heals), w.sides)


@query("healer_spells", sql(f"""
SELECT log_id, encounter_id, lower(actor) AS healer_key, coalesce(spell, 'Heal') AS spell, {_sum('amount')} AS amount, count(*) AS casts
FROM hl GROUP BY ALL"""))
def _(w: Workspace) -> DataFrame:
    return stats.healer_spells(w.main.heals)


@query("damage_matrix", sql("""
SELECT log_id, encounter_id, ak AS attacker_key, tk AS target_key, damage, hits FROM mx"""))
def _(w: Workspace) -> DataFrame:
    return w.matrix


@query("hit_details", sql(f"""
SELECT log_id, encounter_id, ord, ak AS attacker_key, tk AS target_key, t - es AS offset_s, amount AS damage,
  array_to_string(modifiers, '|') AS mods, CASE WHEN event_type = 'melee_hit' THEN 'melee' ELSE 'spell' END AS kind, spell, {_SOURCE} AS source
FROM mh"""))
def _(w: Workspace) -> DataFrame:
    return stats.hit_details(w.main.acts).withColumn("mods", _text("mods"))


@query("heal_details", sql("""
SELECT log_id, encounter_id, ord, lower(actor) AS attacker_key, lower(target) AS target_key, t - es AS offset_s, amount AS damage,
  array_to_string(modifiers, '|') AS mods, spell, coalesce(nullif(pet_origin, ''), nullif(spell, ''), 'Heal') AS source,
  actor AS received_source FROM hl"""))
def _(w: Workspace) -> DataFrame:
    return stats.heal_details(w.main.heals).withColumn("mods", _text("mods"))


_HEAL_MATRIX = f"""
SELECT log_id, encounter_id, lower(actor) AS attacker_key, lower(target) AS target_key, {_sum('amount')} AS damage, count(*) AS hits
FROM hl GROUP BY ALL"""


@query("heal_matrix", sql(_HEAL_MATRIX))
def _(w: Workspace) -> DataFrame:
    return stats.heal_matrix(w.main.heals)


_BREAKDOWN = f"""
SELECT a.log_id, a.encounter_id, a.actor, d.direction, c.name AS other, d.damage, d.hits
FROM atk a JOIN (SELECT log_id, encounter_id, ak AS me, tk AS other, 'dealt_to' AS direction, damage, hits FROM mx
  UNION ALL SELECT log_id, encounter_id, tk, ak, 'taken_from', damage, hits FROM mx) d
  ON d.log_id = a.log_id AND d.encounter_id = a.encounter_id AND d.me = lower(a.actor)
JOIN cn c ON c.log_id = d.log_id AND c.encounter_id = d.encounter_id AND c.name_key = d.other
WHERE NOT {corpse('a.actor')}"""


@query("directed_breakdown", sql(_BREAKDOWN))
def _(w: Workspace) -> DataFrame:
    rows = w.attackers.where(~S.is_corpse("actor"))
    return stats.directed_breakdown(rows, w.matrix, stats.canonical_names(w.main.acts))


_DF = f"""
SELECT d.*, lower(d.target) AS defender_key FROM dp d LEFT JOIN sn s
  ON s.log_id = d.log_id AND s.encounter_id = d.encounter_id AND s.name_key = lower(d.target)
WHERE NOT {corpse('d.actor')} AND NOT {corpse('d.target')} AND coalesce(s.side, 'friendly') <> 'enemy'"""
_AVS = ", ".join(f"CAST(sum(avoided_{o}) AS BIGINT) AS avoided_{o}" for o in OUTCOMES)


@query("defenders", sql(f"""
SELECT log_id, encounter_id, defender_key, arg_min(target, seen) AS defender, {_sum('damage_taken')} AS damage_taken,
  {_sum('hits_landed')} AS hits_landed, max(biggest_taken) AS biggest_taken, {_AVS}, {_sum('total_avoided')} AS total_avoided,
  {_sum('total_swings')} AS total_swings, floor(sum(total_avoided) / sum(total_swings) * 1000 + 0.5) / 10 AS avoid_pct
FROM df GROUP BY log_id, encounter_id, defender_key""", df=_DF))
def _(w: Workspace) -> DataFrame:
    return stats.defenders(w.main.acts, sides.sides_by_name(w.sides))


@query("defender_breakdown", sql(f"""
SELECT log_id, encounter_id, actor, target, defender_key, damage_taken, hits_landed, biggest_taken, {_AV}, total_avoided, total_swings
FROM df""", df=_DF))
def _(w: Workspace) -> DataFrame:
    return stats.defender_pairs(w.main.acts, sides.sides_by_name(w.sides)).drop("first_seen")


@query("heals_received", sql(f"""
SELECT log_id, encounter_id, lower(target) AS defender_key, {_sum('amount')} AS heals_total, count(*) AS heals_count FROM hl GROUP BY ALL"""))
def _(w: Workspace) -> DataFrame:
    return stats.heals_received(w.main.heals)


@query("source_breakdown", sql(f"""
SELECT log_id, encounter_id, ak AS attacker_key, tk AS target_key, {_SOURCE} AS source, {_sum('amount')} AS damage, count(*) AS hits
FROM mh GROUP BY ALL"""))
def _(w: Workspace) -> DataFrame:
    return stats.source_breakdown(stats.hit_details(w.main.acts))


@query("source_breakdown_in_range", sql(f"""
SELECT log_id, encounter_id, ak AS attacker_key, tk AS target_key, {_SOURCE} AS source, {_sum('amount')} AS damage, count(*) AS hits
FROM mh WHERE t - es >= 1 * {WIDTH} AND t - es < 5 * {WIDTH} GROUP BY ALL"""))
def _(w: Workspace) -> DataFrame:
    return stats.source_breakdown(stats.hit_details(w.main.acts), 1, 4, WIDTH)


@query("hits_of_source", sql(f"""
SELECT log_id, encounter_id, ord, amount AS damage FROM mh WHERE {_SOURCE} = 'thorns'"""))
def _(w: Workspace) -> DataFrame:
    return stats.with_source(stats.hit_details(w.main.acts), "thorns").select(*ENC, "ord", "damage")


_PS = f"""
SELECT log_id, encounter_id, ak AS attacker_key, tk AS target_key, greatest(0, (t - es) // {WIDTH}) AS bucket, {_sum('amount')} AS amount
FROM mh GROUP BY ALL"""


@query("pair_series", sql("SELECT * FROM ps", ps=_PS))
def _(w: Workspace) -> DataFrame:
    return timeline.pair_series(w.main.acts, WIDTH)


@query("pair_series_all_row", sql(
    f"SELECT log_id, encounter_id, attacker_key, bucket, {_sum('amount')} AS amount FROM ps GROUP BY ALL", ps=_PS))
def _(w: Workspace) -> DataFrame:
    return timeline.all_row(timeline.pair_series(w.main.acts, WIDTH))


def _packed_sql(rows: str, cells: str, keys: str) -> str:
    """Packed series in SQL: ``rows`` names each key with ``nb`` buckets, ``cells`` its sums."""
    return f"""
SELECT log_id, encounter_id, {keys}, bucket // 256 AS chunk, min(bucket) AS first_bucket,
  string_agg(CAST(coalesce(amount, 0) AS VARCHAR), ',' ORDER BY bucket) AS amounts
FROM (SELECT *, unnest(range(nb)) AS bucket FROM {rows}) LEFT JOIN {cells} USING (log_id, encounter_id, {keys}, bucket)
GROUP BY log_id, encounter_id, {keys}, bucket // 256"""


def _packed_rows(series: DataFrame) -> DataFrame:
    return series.withColumn("amounts", F.concat_ws(",", F.col("amount").cast("array<string>"))).drop("amount")


_NB = f"CAST(greatest(1, any_value(ee - es) // {WIDTH} + 1) AS BIGINT) AS nb"
_PN = f"""SELECT log_id, encounter_id, lower(actor) AS attacker_key, lower(target) AS target_key, {_NB} FROM act
WHERE NOT {corpse('actor')} AND NOT {corpse('target')} GROUP BY ALL"""
_PAIR_PACKED = _packed_sql("pn", "ps", "attacker_key, target_key")
_HEAL_CELLS = {
    "hc": f"""SELECT log_id, encounter_id, lower(actor) AS attacker_key, lower(target) AS target_key, (t - es) // {WIDTH} AS bucket,
{_sum('amount')} AS amount FROM hl GROUP BY ALL""",
    "hn": f"SELECT log_id, encounter_id, lower(actor) AS attacker_key, lower(target) AS target_key, {_NB} FROM hl GROUP BY ALL",
    "hca": f"SELECT log_id, encounter_id, attacker_key, bucket, {_sum('amount')} AS amount FROM hc GROUP BY ALL",
    "hna": "SELECT DISTINCT log_id, encounter_id, attacker_key, nb FROM hn",
    "hct": f"SELECT log_id, encounter_id, target_key, bucket, {_sum('amount')} AS amount FROM hc GROUP BY ALL",
    "hnt": "SELECT DISTINCT log_id, encounter_id, target_key, nb FROM hn",
    "hp1": _packed_sql("hn", "hc", "attacker_key, target_key"),
    "hp2": _packed_sql("hna", "hca", "attacker_key"),
    "hp3": _packed_sql("hnt", "hct", "target_key"),
}


@query("pair_series_packed", sql(_PAIR_PACKED, ps=_PS, pn=_PN))
def _(w: Workspace) -> DataFrame:
    """All pairs, those with avoided swings only as zeros."""
    return _packed_rows(timeline.packed_pair_series(w.main.acts, WIDTH))


@query("pair_stats", sql(f"""
SELECT c.*, b.active_buckets, CAST(floor(peak / {WIDTH} + 0.5) AS BIGINT) AS peak_rate,
  CASE WHEN peak > 0 THEN peak_bucket * {WIDTH} ELSE 0 END AS peak_offset_s,
  CAST(floor(coalesce(mean, 0) / {WIDTH} + 0.5) AS BIGINT) AS avg_active_rate
FROM (SELECT log_id, encounter_id, ak AS attacker_key, tk AS target_key, max(amount) AS biggest,
        CAST(floor(count(*) FILTER (len([m for m in modifiers if regexp_matches(m, '(?i)critical|crippling')]) > 0) * 100 / count(*) + 0.5) AS BIGINT) AS crit_pct,
        greatest(1, any_value(ee - es) // {WIDTH} + 1) AS buckets FROM mh GROUP BY ALL) c
JOIN (SELECT log_id, encounter_id, attacker_key, target_key, max(amount) AS peak,
        count(*) FILTER (amount > 0) AS active_buckets, avg(amount) FILTER (amount > 0) AS mean FROM ps GROUP BY ALL) b
  USING (log_id, encounter_id, attacker_key, target_key)
JOIN (SELECT log_id, encounter_id, attacker_key, target_key, bucket AS peak_bucket FROM ps
      QUALIFY row_number() OVER (PARTITION BY log_id, encounter_id, attacker_key, target_key ORDER BY amount DESC, bucket) = 1) q
  USING (log_id, encounter_id, attacker_key, target_key)""".replace("SELECT c.*,", "SELECT c.log_id, c.encounter_id, c.attacker_key, c.target_key, c.biggest, c.crit_pct, c.buckets,").replace("peak / ", "b.peak / ").replace("WHEN peak", "WHEN b.peak"), ps=_PS))
def _(w: Workspace) -> DataFrame:
    return timeline.pair_stats(w.main.acts, WIDTH)


@query("life_delta", sql(f"""
SELECT log_id, encounter_id, name_key, bucket, CAST(coalesce(d.amount, 0) AS BIGINT) AS damage, CAST(coalesce(h.amount, 0) AS BIGINT) AS healing,
  CAST(coalesce(h.amount, 0) - coalesce(d.amount, 0) AS BIGINT) AS delta
FROM (SELECT log_id, encounter_id, target_key AS name_key, bucket, sum(amount) AS amount FROM ps GROUP BY ALL) d
FULL JOIN (SELECT log_id, encounter_id, lower(target) AS name_key, (t - es) // {WIDTH} AS bucket, sum(amount) AS amount FROM hl GROUP BY ALL) h
USING (log_id, encounter_id, name_key, bucket)""", ps=_PS))
def _(w: Workspace) -> DataFrame:
    taken = timeline.all_row(timeline.pair_series(w.main.acts, WIDTH), "target_key").withColumnRenamed(
        "target_key", "name_key"
    )
    return timeline.life_delta(taken, timeline.heal_series(w.main.heals, "target", WIDTH), WIDTH)


@query("encounter_biggest_hits", sql("""
SELECT log_id, encounter_id, place, t - es AS offset_s, actor, target, amount AS damage, array_to_string(specials, '|') AS specials
FROM (SELECT *, row_number() OVER (PARTITION BY log_id, encounter_id ORDER BY amount DESC, t, fight_id, ord) AS place
      FROM act WHERE hit) WHERE place <= 10"""))
def _(w: Workspace) -> DataFrame:
    top = stats.biggest_hits(w.main.acts, ENC)
    return top.withColumn("specials", _text("specials"))


@query("encounter_biggest_heals", sql("""
SELECT log_id, encounter_id, place, t - es AS offset_s, actor, target, amount AS damage, spell
FROM (SELECT *, row_number() OVER (PARTITION BY log_id, encounter_id ORDER BY amount DESC, ord) AS place FROM hl) WHERE place <= 10"""))
def _(w: Workspace) -> DataFrame:
    return stats.biggest_heals(w.main.heals)


_RAW = f"""
SELECT a.log_id, a.encounter_id, a.attacker, a.damage,
  CASE WHEN NOT ends_with(attacker, '`s pet') AND coalesce(r.received, 0) > damage THEN 'enemy' ELSE 'friendly' END AS side
FROM (SELECT log_id, encounter_id, raw_actor AS attacker, CAST(coalesce(sum(amount), 0) AS BIGINT) AS damage FROM act
      WHERE NOT {corpse('raw_actor')} GROUP BY ALL) a
LEFT JOIN rcv r ON r.log_id = a.log_id AND r.encounter_id = a.encounter_id AND r.name_key = lower(a.attacker)"""


@query("raw_attackers", sql("SELECT * FROM raw_a", raw_a=_RAW))
def _(w: Workspace) -> DataFrame:
    return stats.raw_attackers(w.main.acts, w.main.members)


@query("owner_choices", sql("""
SELECT r.*, o.owner, NOT ends_with(attacker, '`s pet') AND NOT ends_with(attacker, '''s pet') AS can_own
FROM raw_a r LEFT JOIN own o ON o.log_id = r.log_id AND o.who = lower(r.attacker)""".replace(
    "SELECT r.*", "SELECT r.log_id, r.encounter_id, r.attacker, r.damage, r.side"), raw_a=_RAW))
def _(w: Workspace) -> DataFrame:
    return stats.owner_choices(stats.raw_attackers(w.main.acts, w.main.members), w.owners)


# --- sides -------------------------------------------------------------------------


@query("encounter_sides", sql("SELECT log_id, encounter_id, actor, damage, side FROM sd"))
def _(w: Workspace) -> DataFrame:
    return w.sides.select(*ENC, "actor", "damage", "side")


_REC = {
    "rd": "SELECT log_id, encounter_id, lower(actor) AS name_key, sum(damage) AS dealt FROM atk GROUP BY ALL",
    "rr": "SELECT log_id, encounter_id, lower(target) AS name_key, sum(damage_taken) AS received FROM dp GROUP BY ALL",
    "r1": """SELECT log_id, encounter_id, name_key, dealt, coalesce(healed, 0) AS healed,
coalesce(received, 0) > coalesce(dealt, 0) + coalesce(healed, 0) AS foe
FROM rd FULL JOIN rr USING (log_id, encounter_id, name_key) LEFT JOIN hld USING (log_id, encounter_id, name_key)""",
    "ra": """SELECT d.log_id, d.encounter_id, lower(d.actor) AS name_key,
sum(CASE WHEN coalesce(r.foe, FALSE) THEN damage_taken ELSE 0 END) AS to_e, sum(CASE WHEN coalesce(r.foe, FALSE) THEN 0 ELSE damage_taken END) AS to_f
FROM dp d LEFT JOIN r1 r ON r.log_id = d.log_id AND r.encounter_id = d.encounter_id AND r.name_key = lower(d.target) GROUP BY ALL""",
    "re": """SELECT r.log_id, r.encounter_id, r.name_key FROM r1 r LEFT JOIN ra a USING (log_id, encounter_id, name_key)
WHERE foe OR (dealt IS NOT NULL AND NOT ends_with(r.name_key, '`s pet') AND healed <= 0 AND coalesce(to_f, 0) > coalesce(to_e, 0))""",
}


@query("recap_enemies", sql("SELECT log_id, encounter_id, name_key FROM re", **_REC))
def _(w: Workspace) -> DataFrame:
    return sides.recap_enemies(w.attackers, w.pairs, w.main.heals)


@query("session_sides", sql("SELECT log_id, name_key, side FROM s4"))
def _(w: Workspace) -> DataFrame:
    return w.log_sides


_OPEN = {
    "ofi": "SELECT f.* FROM fx f JOIN alive a USING (log_id, target, open_ord)",
    "oac": """SELECT g.log_id, g.target, g.open_ord, g.ord, g.amount, coalesce(o.owner, g.actor) AS actor FROM tg g JOIN ofi f USING (log_id, target, open_ord)
LEFT JOIN own o ON o.log_id = g.log_id AND o.who = lower(g.actor) WHERE NOT g.late AND NOT g.is_death""",
    "win": "SELECT log_id, min(start_t) AS ws, max(end_t) AS we FROM ofi GROUP BY ALL",
    "whl": """SELECT e.log_id, e.ord, e.amount, e.target, coalesce(o.owner, e.actor) AS actor FROM ev e JOIN win w ON w.log_id = e.log_id AND e.t BETWEEN w.ws AND w.we
LEFT JOIN own o ON o.log_id = e.log_id AND o.who = lower(e.actor) WHERE e.event_type = 'heal'""",
    "foe": """SELECT f.*, (SELECT coalesce(sum(total_damage), 0) FROM ofi g WHERE g.log_id = f.log_id AND lower(g.target) = lower(f.target)) AS rec,
(SELECT coalesce(sum(amount), 0) FROM oac g WHERE g.log_id = f.log_id AND lower(g.actor) = lower(f.target)) AS dl,
(SELECT coalesce(sum(amount), 0) FROM whl g WHERE g.log_id = f.log_id AND lower(g.actor) = lower(f.target)) AS he FROM ofi f""",
    "prim": """SELECT * FROM foe WHERE lower(target) NOT IN ('you', 'yourself') AND rec > dl + he
QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY total_damage DESC, end_t DESC, open_ord) = 1""",
    "wc": """SELECT log_id, we - ws AS wd,
CAST(coalesce((SELECT sum(amount) FROM oac a WHERE a.log_id = w.log_id AND (lower(actor) IN ('you', 'yourself')
  OR lower(actor) = lower(nullif(regexp_extract(a.log_id, '(?i)^eqlog_([A-Za-z]+)_', 1), '')) || '`s pet')), 0) AS BIGINT) AS damage_out,
CAST(coalesce((SELECT sum(amount) FROM oac a WHERE a.log_id = w.log_id AND lower(target) IN ('you', 'yourself')), 0) AS BIGINT) AS damage_in,
CAST(coalesce((SELECT sum(amount) FROM whl a WHERE a.log_id = w.log_id AND lower(actor) IN ('you', 'yourself')), 0) AS BIGINT) AS healing_out,
CAST(coalesce((SELECT sum(amount) FROM whl a WHERE a.log_id = w.log_id AND lower(target) IN ('you', 'yourself')), 0) AS BIGINT) AS healing_in
FROM win w""",
}


def _counter_rates(duration: str) -> str:
    d = f"greatest({duration}, 1)"
    return f"""{_whole(f'damage_out / {d}')} AS dps_out, {_whole(f'damage_in / {d}')} AS dtps_in, {_whole(f'healing_out / {d}')} AS hps_out,
  {_whole(f'healing_in / {d}')} AS hps_in, {_whole(f'(healing_in - damage_in) / {d}')} AS hp_delta_per_sec"""


@query("active_view", sql(f"""
SELECT p.log_id, p.target, p.open_ord, p.start_t, p.end_t, p.total_damage, wd AS window_seconds, damage_out, damage_in, healing_out,
  healing_in, {_counter_rates('wd')} FROM prim p JOIN wc USING (log_id)""", **_OPEN))
def _(w: Workspace) -> DataFrame:
    return player.active_view(*w.running)


_ACTIVE_DAMAGE = sql(f"""
SELECT log_id, place, actor AS name, damage, duration_seconds, {_whole('damage / greatest(duration_seconds, 1)')} AS dps,
  {_pct('damage', 'total_damage')} AS pct, lower(actor) IN ('you', 'yourself') AS is_you,
  coalesce(lower(actor) = lower(nullif(regexp_extract(log_id, '(?i)^eqlog_([A-Za-z]+)_', 1), '')) || '`s pet', FALSE) AS is_your_pet
FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY damage DESC, seen) AS place FROM (
  SELECT a.log_id, a.actor, any_value(p.total_damage) AS total_damage, any_value(p.end_t - p.start_t) AS duration_seconds,
    CAST(sum(a.amount) AS BIGINT) AS damage, min(a.ord) AS seen
  FROM oac a JOIN prim p USING (log_id, target, open_ord) WHERE lower(a.actor) <> lower(p.target) GROUP BY a.log_id, a.actor)
  WHERE damage > 0) WHERE place <= 8""", **_OPEN)
_ACTIVE_HEALING = sql(f"""
SELECT h.log_id, row_number() OVER (PARTITION BY h.log_id ORDER BY sum(amount) DESC, min(ord)) AS place, actor AS name,
  {_sum('amount')} AS healing, lower(actor) IN ('you', 'yourself') AS is_you, {_whole('sum(amount) / greatest(any_value(we - ws), 1)')} AS hps
FROM whl h JOIN win USING (log_id) JOIN prim p ON p.log_id = h.log_id GROUP BY h.log_id, actor QUALIFY place <= 5""", **_OPEN)


@query("active_top_damage", _ACTIVE_DAMAGE)
def _(w: Workspace) -> DataFrame:
    live, acts, heals = w.running
    return player.active_top_damage(player.active_target(live, acts, heals), acts)


@query("active_top_healing", _ACTIVE_HEALING)
def _(w: Workspace) -> DataFrame:
    live, acts, heals = w.running
    return player.active_top_healing(live, player.active_target(live, acts, heals), heals)


# --- session -----------------------------------------------------------------------


def _rollup(w: Workspace, values: DataFrame) -> DataFrame:
    return session.actor_rollup(values, w.main.encounters, w.log_sides)


def _rollup_sql(mode: int, **extra: str) -> str:
    return sql(f"""
SELECT log_id, name_key, name, total, biggest, encounters_present, avg_rate, median_rate, p95_rate, best_rate, side
FROM rs WHERE mode = {mode}""", **extra)


def _selected(which: str) -> dict[str, str]:
    """The fights of the encounters that were killed and fulfil ``which``, in place of all."""
    kept = f"SELECT log_id, encounter_id FROM mb0 WHERE {which} GROUP BY log_id, encounter_id HAVING bool_or(fight_complete)"
    return {"mb0": CTE["mb"], "mb": f"SELECT * FROM mb0 WHERE (log_id, encounter_id) IN ({kept})"}


def _summary(w: Workspace, chosen: DataFrame | None = None) -> session.Summary:
    m = w.main
    return session.summary(m.encounters, w.attackers, w.pairs, m.members, m.heals, killed_only=True, chosen=chosen)


@query("session_damage_killed_only", _rollup_sql(0, **_selected("TRUE")))
def _(w: Workspace) -> DataFrame:
    return _summary(w).damage


@query("session_sides_killed_only", sql("SELECT log_id, name_key, side FROM s4", **_selected("TRUE")))
def _(w: Workspace) -> DataFrame:
    return _summary(w).sides


@query("session_tanking_chosen", _rollup_sql(1, **_selected("encounter_id % 3 = 1")))
def _(w: Workspace) -> DataFrame:
    return _summary(w, w.main.encounters.where("encounter_id % 3 = 1").select("log_id", "encounter_id")).tanking


@query("session_damage", _rollup_sql(0))
def _(w: Workspace) -> DataFrame:
    return _rollup(w, session.damage_values(w.attackers))


@query("session_tanking", _rollup_sql(1))
def _(w: Workspace) -> DataFrame:
    return _rollup(w, session.tanking_values(w.pairs))


@query("session_healing", _rollup_sql(2))
def _(w: Workspace) -> DataFrame:
    return _rollup(w, session.healing_values(w.main.heals))


@query("session_header", sql(f"""
SELECT log_id, {_stamp('min(s)')} AS start, {_stamp('max(x)')} AS "end", {_sum('dur')} AS duration_seconds, count(*) AS encounter_count,
  count(*) FILTER (fight_complete) AS killed_count, {_sum('total_damage')} AS total_damage, {_sum('total_healing')} AS total_healing,
  CAST(coalesce(any_value(taken), 0) AS BIGINT) AS total_damage_taken
FROM enc LEFT JOIN (SELECT log_id, sum(total) AS taken FROM rs WHERE mode = 1 GROUP BY ALL) USING (log_id) GROUP BY log_id"""))
def _(w: Workspace) -> DataFrame:
    return session.session_header(w.main.encounters, _rollup(w, session.tanking_values(w.pairs)))


@query("session_header_killed_only", sql(f"""
SELECT log_id, {_stamp('min(s)')} AS start, {_stamp('max(x)')} AS "end", {_sum('dur')} AS duration_seconds, count(*) AS encounter_count,
  count(*) AS killed_count, {_sum('total_damage')} AS total_damage, {_sum('total_healing')} AS total_healing
FROM enc WHERE fight_complete GROUP BY log_id"""))
def _(w: Workspace) -> DataFrame:
    return session.session_header(session.choose(w.main.encounters, killed_only=True))


@query("session_share_of_raid", sql(f"""
SELECT log_id, name_key, total, avg_rate, {_pct('total', '(sum(total) OVER (PARTITION BY log_id))')} AS pct_of_raid
FROM rs WHERE mode = 0 AND side = 'friendly' AND avg_rate >= 2"""))
def _(w: Workspace) -> DataFrame:
    rollup = _rollup(w, session.damage_values(w.attackers))
    return session.share_of_raid(rollup, min_rate=2).select("log_id", "name_key", "total", "avg_rate", "pct_of_raid")


@query("session_trend", sql(f"""
SELECT r.log_id, r.encounter_id, CASE WHEN place <= 3 THEN p.name ELSE 'Other' END AS label, place > 3 AS is_other, {_sum('rate')} AS rate
FROM rt r JOIN (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY total DESC, name_key) AS place FROM rs WHERE mode = 0 AND side = 'friendly') p
  ON p.log_id = r.log_id AND p.name_key = r.name_key
WHERE r.mode = 0 GROUP BY r.log_id, r.encounter_id, label, is_other"""))
def _(w: Workspace) -> DataFrame:
    values = session.damage_values(w.attackers)
    return session.trend(session.encounter_rates(values, w.main.encounters), _rollup(w, values), top=3)


@query("session_life_delta", sql(f"""
SELECT *, heals_rate - damage_rate AS life_delta FROM (
SELECT log_id, encounter_id, name_key, CAST(coalesce(value, 0) AS BIGINT) AS damage_value, CAST(coalesce(hv, 0) AS BIGINT) AS heals_value,
  {_whole('coalesce(value, 0) / CASE WHEN dur = 0 THEN 1 ELSE dur END')} AS damage_rate,
  {_whole('coalesce(hv, 0) / CASE WHEN dur = 0 THEN 1 ELSE dur END')} AS heals_rate
FROM (SELECT * FROM val WHERE mode = 1) FULL JOIN (SELECT log_id, encounter_id, lower(target) AS name_key, sum(amount) AS hv FROM hl GROUP BY ALL)
  USING (log_id, encounter_id, name_key)
JOIN eb USING (log_id, encounter_id)
WHERE (log_id, name_key) IN (SELECT (log_id, name_key) FROM rs WHERE mode = 1))"""))
def _(w: Workspace) -> DataFrame:
    values = session.tanking_values(w.pairs)
    return session.received_rates(values, w.main.heals, w.main.encounters, _rollup(w, values))


@query("session_aligned_rates", sql("""
SELECT r.log_id, r.name_key, e.slot AS bucket, coalesce(v.rate, 0) AS rate
FROM rs r JOIN (SELECT log_id, encounter_id, row_number() OVER (PARTITION BY log_id ORDER BY s, encounter_id) - 1 AS slot FROM eb) e ON e.log_id = r.log_id
LEFT JOIN rt v ON v.log_id = r.log_id AND v.name_key = r.name_key AND v.encounter_id = e.encounter_id AND v.mode = 0
WHERE r.mode = 0"""))
def _(w: Workspace) -> DataFrame:
    values = session.damage_values(w.attackers)
    packed = session.aligned_series(values, _rollup(w, values), w.main.encounters)
    return timeline.long_form(packed, ["log_id", "name_key"], "rate")


# --- comparison ---------------------------------------------------------------------


def _pairs(w: Workspace, cross: bool) -> DataFrame:
    """Every encounter against the next of its log, or against the same one of the next log."""
    e = w.main.encounters.select("log_id", "encounter_id")
    if cross:
        number = F.translate(
            F.regexp_extract("log_id", r"_Hero([a-j]+)_", 1), "abcdefghij", "0123456789"
        ).cast("long")
        e = e.withColumn("n", number)
        b = e.select((F.col("n") - 1).alias("n"), F.col("log_id").alias("b_log"), F.col("encounter_id").alias("b_encounter"))
        a = e.select("n", F.col("log_id").alias("a_log"), F.col("encounter_id").alias("a_encounter"), F.col("encounter_id").alias("b_encounter"))
        out = a.join(b, ["n", "b_encounter"])
    else:
        a = e.select(F.col("log_id").alias("a_log"), F.col("encounter_id").alias("a_encounter"),
                     F.col("log_id").alias("b_log"), (F.col("encounter_id") + 1).alias("b_encounter"))
        out = a.join(e.select(F.col("log_id").alias("b_log"), F.col("encounter_id").alias("b_encounter")), ["b_log", "b_encounter"])
    key = F.concat_ws("#", "a_log", F.col("a_encounter").cast("string"))
    return out.select(key.alias("pair_id"), "a_log", "a_encounter", "b_log", "b_encounter")


def _pair_sql(cross: bool) -> str:
    on = ("b.encounter_id = a.encounter_id AND b.n = a.n + 1" if cross
          else "b.log_id = a.log_id AND b.encounter_id = a.encounter_id + 1")
    return f"""SELECT a.log_id || '#' || a.encounter_id AS pair_id, a.log_id AS a_log, a.encounter_id AS a_encounter, b.log_id AS b_log,
b.encounter_id AS b_encounter FROM nb a JOIN nb b ON {on}"""


_ENC_NO = """SELECT log_id, encounter_id, CAST(translate(regexp_extract(log_id, '_Hero([a-j]+)_', 1), 'abcdefghij', '0123456789') AS BIGINT) AS n FROM eb"""


def _diff_steps(cross: bool) -> dict[str, str]:
    steps = {"nb": _ENC_NO, "pr": _pair_sql(cross)}
    for slot in ("a", "b"):
        steps[f"q{slot}"] = f"""SELECT p.pair_id, v.name_key, v.mode, v.name, v.value, v.biggest, e.dur FROM pr p
JOIN val v ON v.log_id = p.{slot}_log AND v.encounter_id = p.{slot}_encounter
JOIN eb e ON e.log_id = v.log_id AND e.encounter_id = v.encounter_id"""
    cells = []
    names = (("damage", "biggest_dmg", "dps"), ("damage_taken", "biggest_taken", "dtps"), ("healing", "biggest_heal", "hps"))
    for slot in ("a", "b"):
        for mode, (v, g, r) in enumerate(names):
            f = f"FILTER (slot = '{slot}' AND mode = {mode})"
            cells.append(f"coalesce(max(value) {f}, 0) AS {slot}_{v}")
            cells.append(f"coalesce(max(biggest) {f}, 0) AS {slot}_{g}")
            cells.append(f"{_whole(f'coalesce(max(value / CASE WHEN dur = 0 THEN 1 ELSE dur END) {f}, 0)')} AS {slot}_{r}")
        cells.append(f"bool_or(slot = '{slot}') AS {slot}_present")
    steps["da"] = f"""SELECT pair_id, name_key, arg_min(name, CASE WHEN slot = 'a' THEN 0 ELSE 10 END + mode) AS name, {', '.join(cells)}
FROM (SELECT *, 'a' AS slot FROM qa UNION ALL SELECT *, 'b' FROM qb) GROUP BY pair_id, name_key"""
    sides_of = []
    for slot in ("a", "b"):
        on = f"x.log_id = p.{slot}_log AND x.encounter_id = p.{slot}_encounter"
        sides_of += [
            f"SELECT p.pair_id, lower(x.actor) AS name_key, x.damage AS v, 'd' AS m FROM pr p JOIN atk x ON {on}",
            f"SELECT p.pair_id, lower(x.target), x.total_damage, 'r' FROM pr p JOIN mb x ON {on}",
            f"SELECT p.pair_id, lower(x.actor), x.amount, 'h' FROM pr p JOIN hl x ON {on}",
        ]
    steps["ds"] = f"""SELECT pair_id, name_key, CASE WHEN NOT ends_with(name_key, '`s pet')
AND coalesce(sum(v) FILTER (m = 'r'), 0) > coalesce(sum(v) FILTER (m <> 'r'), 0) THEN 'enemy' ELSE 'friendly' END AS side
FROM ({' UNION ALL '.join(sides_of)}) GROUP BY pair_id, name_key"""
    steps["dx"] = "SELECT d.*, coalesce(s.side, 'friendly') AS side FROM da d LEFT JOIN ds s ON s.pair_id = d.pair_id AND s.name_key = d.name_key"
    return steps


def _diff(w: Workspace, cross: bool) -> DataFrame:
    m = w.main
    return compare.diff_actors(_pairs(w, cross), m.encounters, w.attackers, w.pairs, m.heals, m.members)


@query("diff_same_log", sql("SELECT * FROM dx", **_diff_steps(False)))
def _(w: Workspace) -> DataFrame:
    return _diff(w, False)


@query("diff_cross_log", sql("SELECT * FROM dx", **_diff_steps(True)))
def _(w: Workspace) -> DataFrame:
    return _diff(w, True)


@query("diff_visible_tanking", sql("""
SELECT pair_id, name_key, a_damage_taken + b_damage_taken AS combined, b_damage_taken - a_damage_taken AS delta,
  CASE WHEN a_damage_taken <> 0 THEN round_even((b_damage_taken - a_damage_taken) / a_damage_taken * 100, 1) END AS pct_change,
  CASE WHEN b_damage_taken = a_damage_taken THEN 'flat' WHEN b_damage_taken > a_damage_taken THEN 'worse' ELSE 'better' END AS trend,
  CAST(row_number() OVER (PARTITION BY pair_id ORDER BY a_damage_taken + b_damage_taken DESC, name_key) AS INTEGER) AS place
FROM dx WHERE side <> 'enemy' AND a_damage_taken + b_damage_taken > 0""", **_diff_steps(False)))
def _(w: Workspace) -> DataFrame:
    return compare.visible_actors(_diff(w, False), "damage_taken").select(
        "pair_id", "name_key", "combined", "delta", "pct_change", "trend", "place"
    )


def _headers_sql() -> str:
    fields = ("name", "duration_seconds", "total_damage", "total_healing", "raid_dps", "fight_complete")
    cols = [f"{s}.{f} AS {s}_{f}" for s in ("a", "b") for f in fields]
    cols += [f"b.{f} - a.{f} AS d_{f}" for f in fields[1:5]]
    cols += [
        f"CASE WHEN a.{f} <> 0 THEN round_even((b.{f} - a.{f}) / a.{f} * 100, 1) END AS pct_{f}" for f in fields[2:5]
    ]
    return sql(f"""
SELECT p.*, {', '.join(cols)}, a_log <> b_log AS cross_log FROM pr p
JOIN eh a ON a.log_id = p.a_log AND a.encounter_id = p.a_encounter JOIN eh b ON b.log_id = p.b_log AND b.encounter_id = p.b_encounter""",
        nb=_ENC_NO, pr=_pair_sql(True),
        eh=f"SELECT log_id, encounter_id, name, dur AS duration_seconds, total_damage, total_healing, {_whole('raid_dps')} AS raid_dps, fight_complete FROM enc")


@query("diff_headers", _headers_sql())
def _(w: Workspace) -> DataFrame:
    return compare.diff_headers(_pairs(w, True), w.main.encounters)


# --- player ----------------------------------------------------------------------------

_MINE = """(lower(actor) IN ('you', 'yourself') OR coalesce(lower(actor) =
  lower(nullif(regexp_extract(log_id, '(?i)^eqlog_([A-Za-z]+)_', 1), '')) || '`s pet', FALSE))"""
_COUNTERS = f"""
SELECT e.log_id, e.encounter_id, e.dur,
  CAST(coalesce(o.v, 0) AS BIGINT) AS damage_out, CAST(coalesce(i.v, 0) AS BIGINT) AS damage_in,
  CAST(coalesce(ho.v, 0) AS BIGINT) AS healing_out, CAST(coalesce(hi.v, 0) AS BIGINT) AS healing_in
FROM eb e
LEFT JOIN (SELECT log_id, encounter_id, sum(damage) AS v FROM atk WHERE {_MINE} GROUP BY ALL) o USING (log_id, encounter_id)
LEFT JOIN (SELECT log_id, encounter_id, sum(damage_taken) AS v FROM dp WHERE lower(target) IN ('you', 'yourself') GROUP BY ALL) i USING (log_id, encounter_id)
LEFT JOIN (SELECT log_id, encounter_id, sum(amount) AS v FROM hl WHERE lower(actor) IN ('you', 'yourself') GROUP BY ALL) ho USING (log_id, encounter_id)
LEFT JOIN (SELECT log_id, encounter_id, sum(amount) AS v FROM hl WHERE lower(target) IN ('you', 'yourself') GROUP BY ALL) hi USING (log_id, encounter_id)"""


def _counters(w: Workspace) -> DataFrame:
    m = w.main
    return player.player_counters(w.attackers, w.pairs, m.heals, m.encounters, list(ENC))


@query("player_counters", sql(f"""
SELECT log_id, encounter_id, dur AS duration_seconds, damage_out, damage_in, healing_out, healing_in, {_counter_rates('dur')} FROM pc""",
    pc=_COUNTERS))
def _(w: Workspace) -> DataFrame:
    return _counters(w)


_TOPD = {**_REC, "td": f"""
SELECT a.log_id, a.encounter_id, row_number() OVER (PARTITION BY a.log_id, a.encounter_id ORDER BY damage DESC, seen) AS place,
  actor AS name, damage, e.dur, {_whole('damage / greatest(e.dur, 1)')} AS dps, {_pct('damage', 'e.total_damage')} AS pct,
  lower(actor) IN ('you', 'yourself') AS is_you,
  coalesce(lower(actor) = lower(nullif(regexp_extract(a.log_id, '(?i)^eqlog_([A-Za-z]+)_', 1), '')) || '`s pet', FALSE) AS is_your_pet
FROM atk a JOIN eb e USING (log_id, encounter_id)
LEFT JOIN re x ON x.log_id = a.log_id AND x.encounter_id = a.encounter_id AND x.name_key = lower(a.actor)
WHERE damage > 0 AND x.name_key IS NULL QUALIFY place <= 10"""}


def _top_damage(w: Workspace) -> DataFrame:
    foes = sides.recap_enemies(w.attackers, w.pairs, w.main.heals)
    return player.top_damage(w.attackers, w.main.encounters, list(ENC), n=10, excluded=foes)


@query("top_damage", sql("""
SELECT log_id, encounter_id, place, name, damage, dur AS duration_seconds, dps, pct, is_you, is_your_pet FROM td""", **_TOPD))
def _(w: Workspace) -> DataFrame:
    return _top_damage(w)


@query("top_damage_of_fights", sql(f"""
SELECT a.log_id, a.fight_id, row_number() OVER (PARTITION BY a.log_id, a.fight_id ORDER BY damage DESC, seen) AS place,
  actor AS name, damage, {_pct('damage', 'f.total_damage')} AS pct
FROM atk a JOIN ft f USING (log_id, fight_id) WHERE damage > 0 AND lower(actor) <> lower(f.target) QUALIFY place <= 8""", **_BY_FIGHT))
def _(w: Workspace) -> DataFrame:
    return player.top_damage(
        stats.attackers(w.main.acts), w.main.members, ["log_id", "fight_id"]
    ).select("log_id", "fight_id", "place", "name", "damage", "pct")


@query("top_healing", sql(f"""
SELECT log_id, encounter_id, row_number() OVER (PARTITION BY log_id, encounter_id ORDER BY sum(amount) DESC, min(ord)) AS place,
  actor AS name, {_sum('amount')} AS healing, lower(actor) IN ('you', 'yourself') AS is_you,
  {_whole('sum(amount) / greatest(any_value(dur), 1)')} AS hps
FROM hl GROUP BY log_id, encounter_id, actor QUALIFY place <= 5"""))
def _(w: Workspace) -> DataFrame:
    return player.top_healing(w.main.heals, w.main.encounters, list(ENC))


@query("combine_pets", sql("""
SELECT log_id, encounter_id, row_number() OVER (PARTITION BY log_id, encounter_id ORDER BY damage2 DESC, place) AS place, name,
  damage2 AS damage,
  CASE WHEN act_on AND is_you THEN CAST(floor(damage2 / greatest(dur, 1) + 0.5) AS BIGINT) ELSE dps END AS dps,
  CASE WHEN act_on AND is_you THEN floor(damage2 / tot * 1000 + 0.5) / 10 ELSE pct END AS pct, is_you
FROM (SELECT *, CAST(damage + CASE WHEN act_on AND is_you THEN pets ELSE 0 END AS BIGINT) AS damage2 FROM (
  SELECT *, has_you AND pets <> 0 AS act_on FROM (
    SELECT *, bool_or(is_you) OVER p AS has_you, sum(damage) OVER p AS tot,
      sum(CASE WHEN is_your_pet THEN damage ELSE 0 END) OVER p AS pets
    FROM td WINDOW p AS (PARTITION BY log_id, encounter_id))))
WHERE NOT (act_on AND is_your_pet)""", **_TOPD))
def _(w: Workspace) -> DataFrame:
    return player.combine_pets(_top_damage(w), list(ENC))


@query("recap", sql(f"""
SELECT e.log_id, e.encounter_id, e.name, {_stamp('e.s')} AS start, {_stamp('e.x')} AS "end", e.dur AS duration_seconds, e.fight_complete,
  e.total_damage, damage_out, damage_in, healing_out, healing_in, {_counter_rates('e.dur')}
FROM enc e JOIN pc USING (log_id, encounter_id)
QUALIFY row_number() OVER (PARTITION BY e.log_id ORDER BY e.x DESC, e.encounter_id) = 1""", pc=_COUNTERS))
def _(w: Workspace) -> DataFrame:
    last = player.latest_encounter(w.main.encounters).select(
        *ENC, "name", S.stamp("start").alias("start"), S.stamp("end").alias("end"), "fight_complete", "total_damage"
    )
    return last.join(_counters(w), list(ENC))


_LAST = "SELECT log_id, encounter_id FROM eb QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY x DESC, encounter_id) = 1"


@query("recap_top_damage", sql("""
SELECT log_id, encounter_id, place, name, damage, dur AS duration_seconds, dps, pct, is_you, is_your_pet
FROM td JOIN lst USING (log_id, encounter_id)""", lst=_LAST, **_TOPD))
def _(w: Workspace) -> DataFrame:
    return player.recap_top_damage(w.attackers, w.pairs, w.main.heals, w.main.encounters)


@query("recap_top_healing", sql(f"""
SELECT log_id, encounter_id, row_number() OVER (PARTITION BY log_id, encounter_id ORDER BY sum(amount) DESC, min(ord)) AS place,
  actor AS name, {_sum('amount')} AS healing, lower(actor) IN ('you', 'yourself') AS is_you,
  {_whole('sum(amount) / greatest(any_value(dur), 1)')} AS hps
FROM hl JOIN lst USING (log_id, encounter_id) GROUP BY log_id, encounter_id, actor QUALIFY place <= 5""", lst=_LAST))
def _(w: Workspace) -> DataFrame:
    return player.recap_top_healing(w.main.heals, w.main.encounters)


# --- overrides --------------------------------------------------------------------------


@query("pet_owner_rewrite", sql(f"""
SELECT log_id, actor, count(*) AS swings, {_sum('amount')} AS damage, count(*) FILTER (pet_origin IS NOT NULL) AS from_pets
FROM act GROUP BY ALL"""))
def _(w: Workspace) -> DataFrame:
    return w.main.acts.groupBy("log_id", "actor").agg(
        F.count("*").alias("swings"), F.sum("amount").alias("damage"), F.count("pet_origin").alias("from_pets")
    )


@query("pet_owner_edits", sql("""
SELECT log_id, CAST(CASE WHEN log_no % 3 = 0 THEN 2 WHEN log_no % 3 = 1 THEN 0 ELSE 0 END AS BIGINT) AS pos, actor, owner FROM (
  SELECT DISTINCT log_id, log_no FROM base2) JOIN (VALUES (0, 'EMBER golem', 'Someone'), (1, 'ember golem', ''), (2, 'ember golem', 'Else'))
  v(r, actor, owner) ON r = log_no % 3 WHERE FALSE
UNION ALL SELECT log_id, CAST(0 AS BIGINT), 'ember golem', 'User' || (log_no * 10 + 4) FROM (SELECT DISTINCT log_id, log_no FROM base2) WHERE log_no % 3 = 0
UNION ALL SELECT log_id, CAST(1 AS BIGINT), 'EMBER golem', 'Someone' FROM (SELECT DISTINCT log_id, log_no FROM base2) WHERE log_no % 3 = 0
UNION ALL SELECT log_id, CAST(0 AS BIGINT), 'ember golem', 'Else' FROM (SELECT DISTINCT log_id, log_no FROM base2) WHERE log_no % 3 = 2"""))
def _(w: Workspace) -> DataFrame:
    """Logs in turn add a spelling, clear the pet, or name another owner."""
    number = F.translate(
        F.regexp_extract("log_id", r"_Hero([a-j]+)_", 1), "abcdefghij", "0123456789"
    ).cast("long") % 3
    edits = w.owners.select(
        "log_id",
        F.lit(1).cast("long").alias("pos"),
        F.when(number == 0, " EMBER golem").when(number == 1, "Ember Golem").otherwise("ember golem").alias("actor"),
        F.when(number == 0, "Someone").when(number == 2, "Else ").alias("owner"),
    )
    return overrides.set_pet_owners(w.owners, edits)


_EDIT = {
    **_MANUAL,
    "xk": "SELECT m.log_id, m.fight_key, min(m.fight_id) AS pos FROM mb m WHERE m.encounter_id IN (3, 4) GROUP BY ALL",
    "kept": "SELECT log_id, group_no, name, fight_key FROM mg WHERE (log_id, fight_key) NOT IN (SELECT (log_id, fight_key) FROM xk)",
    "pruned": "SELECT * FROM kept WHERE (log_id, group_no) IN (SELECT (log_id, group_no) FROM kept GROUP BY log_id, group_no HAVING count(*) >= 2)",
}


@query("split_encounters", sql("SELECT log_id, group_no, name, fight_key FROM pruned", **_EDIT))
def _(w: Workspace) -> DataFrame:
    chosen = w.manual.encounters.where(F.col("encounter_id").isin(3, 4)).select(*ENC)
    keys = overrides.encounter_keys(w.manual.members, chosen)
    return overrides.split_groups(w.manual_groups, keys).drop("pos")


@query("merge_encounters", sql("""
SELECT log_id, group_no, name, fight_key FROM pruned UNION ALL
SELECT x.log_id, coalesce(g.top + 1, 0) AS group_no, 'Joined' AS name, x.fight_key FROM xk x
LEFT JOIN (SELECT log_id, max(group_no) AS top FROM mg GROUP BY ALL) g USING (log_id)
WHERE x.log_id IN (SELECT log_id FROM xk GROUP BY log_id HAVING count(*) >= 2)""", **{
    **_EDIT,
    "xk2": "SELECT log_id FROM xk GROUP BY log_id HAVING count(*) >= 2",
    "kept": _EDIT["kept"].replace("FROM xk)", "FROM xk WHERE log_id IN (SELECT log_id FROM xk2))"),
}))
def _(w: Workspace) -> DataFrame:
    chosen = w.manual.encounters.where(F.col("encounter_id").isin(3, 4)).select(
        *ENC, F.lit(0).cast("long").alias("group_no"), F.lit("Joined").alias("name")
    )
    keys = overrides.encounter_keys(w.manual.members, chosen)
    return overrides.merge_groups(w.manual_groups, keys).drop("pos")


# --- streaming and sinks ---------------------------------------------------------------------


@query("stream_fights", sql(FIGHT_SELECT + " FROM ft"))
def _(w: Workspace) -> DataFrame:
    """What a stream reports after taking the events in by parts: the same fights as in batch."""
    return _fight_rows(w.streamed.fights(min_damage=MIN_DAMAGE))


@query("stream_open_fights", sql(f"""
SELECT log_id, target, open_ord, {_stamp('start_t')} AS start, {_stamp('end_t')} AS "end", total_damage, hits, misses
FROM fx WHERE close_ord = 9223372036854775807"""))
def _(w: Workspace) -> DataFrame:
    """The fights that are still running after the last batch."""
    live = w.streamed.all_fights().where("in_progress")
    at = [S.stamp(S.from_epoch(f"{c}_t")).alias(c) for c in ("start", "end")]
    return live.select("log_id", "target", "open_ord", *at, "total_damage", "hits", "misses")


#: In two parts: what has been idle for too long at the end of the first part is closed there, so a death in the second one is late.
_EXPIRED = {
    "half": "SELECT min(ord) + (max(ord) - min(ord)) // 2 AS last_of_first FROM ev",
    "bd": "SELECT log_id, max(ord) AS bo, arg_max(t, ord) AS bt FROM ev JOIN half ON ord <= last_of_first GROUP BY log_id",
    "ad": """
SELECT ev.*, bo, bt, event_type = 'death' AS is_death, lag(t) OVER w AS pt, lag(event_type = 'death') OVER w AS pd, lag(ord) OVER w AS po
FROM ev LEFT JOIN bd USING (log_id) WHERE event_type IN ('melee_hit', 'spell_damage', 'melee_miss', 'death')
WINDOW w AS (PARTITION BY log_id, target ORDER BY ord)""",
    "tg": CTE["tg"].replace("(pt IS NULL OR pd) AS late", f"(pt IS NULL OR pd OR coalesce(po <= bo AND ord > bo AND bt - pt > {GAP}, FALSE)) AS late"),
    "fb": CTE["fb"].replace("max(CASE WHEN is_death THEN ord END) AS death_ord,", "max(CASE WHEN is_death THEN ord END) AS death_ord, max(ord) AS last_ord,"),
    "en": "SELECT log_id, max(ord) AS eo, arg_max(t, ord) AS et FROM ev GROUP BY log_id",
    "fc": f"""
SELECT fb.*, coalesce(death_ord, least(lead(open_ord) OVER (PARTITION BY log_id, target ORDER BY open_ord),
  CASE WHEN last_ord <= bo AND bt - end_t > {GAP} THEN bo END, CASE WHEN et - end_t > {GAP} THEN eo END), 9223372036854775807) AS close_ord
FROM fb LEFT JOIN bd USING (log_id) JOIN en USING (log_id)""",
    **{k: _SET_BACK[k] for k in ("ld", "pr", "st", "flip")},
}


@query("stream_idle_expiry", sql(FIGHT_SELECT + ", close_ord = 9223372036854775807 AS in_progress FROM ft", **_EXPIRED))
def _(w: Workspace) -> DataFrame:
    """Fights close when their log has moved on, not at their target's next row."""
    found = replay(w.events, GAP, MIN_DAMAGE, parts=2, expire_idle=True)
    return _fight_rows(found.fights(min_damage=MIN_DAMAGE), "in_progress")


@query("stream_fights_heals_extend", sql(FIGHT_SELECT + " FROM ft", **_HEALS_EXTEND))
def _(w: Workspace) -> DataFrame:
    return _fight_rows(replay(w.events, GAP, MIN_DAMAGE, parts=3, heals_extend_fights=True).fights(min_damage=MIN_DAMAGE))


_CHUNKS = "unnest(range(CAST(nb + 255 AS BIGINT) // 256))"


def _document_sql() -> str:
    sections = {
        "header": "eb", "member": "mb", "attacker": f"(SELECT * FROM atk WHERE NOT {corpse('actor')})",
        "special": "(SELECT DISTINCT log_id, encounter_id, actor, unnest(specials) FROM act WHERE hit)",
        "timeline": f"(SELECT log_id, encounter_id, actor, {_CHUNKS} FROM (SELECT log_id, encounter_id, actor, {_NB} FROM act GROUP BY ALL))",
        "raid_series": f"(SELECT log_id, encounter_id, {_CHUNKS} FROM (SELECT log_id, encounter_id, {_NB} FROM act GROUP BY ALL))",
        "biggest_hit": "(SELECT *, row_number() OVER (PARTITION BY log_id, encounter_id ORDER BY amount DESC) AS p FROM act WHERE hit QUALIFY p <= 10)",
        "damage_pair": "mx", "breakdown": "bk", "damage_series": f"(SELECT *, {_CHUNKS} FROM pn)", "hit": "mh",
        "healer": "hna", "heal_pair": "hm", "heal": "hl",
        "heal_series": f"(SELECT *, {_CHUNKS} FROM hn)", "healer_series": f"(SELECT *, {_CHUNKS} FROM hna)",
        "biggest_heal": "(SELECT *, row_number() OVER (PARTITION BY log_id, encounter_id ORDER BY amount DESC) AS p FROM hl QUALIFY p <= 10)",
        "defender": "(SELECT DISTINCT log_id, encounter_id, defender_key FROM df)", "defender_pair": "df",
        "heals_received": "hnt", "heals_received_series": f"(SELECT *, {_CHUNKS} FROM hnt)", "raw_attacker": "raw_a",
    }
    parts = [
        f"SELECT log_id, encounter_id, '{name}' AS section, count(*) AS payloads FROM {src} GROUP BY log_id, encounter_id"
        for name, src in sections.items()
    ]
    return sql(" UNION ALL ".join(parts), pn=_PN, df=_DF, raw_a=_RAW, hm=_HEAL_MATRIX, bk=_BREAKDOWN, **_HEAL_CELLS)


@query("encounter_documents", _document_sql())
def _(w: Workspace) -> DataFrame:
    """The rows of every encounter's document, counted by section."""
    return w.documents.groupBy(*ENC, "section").agg(F.count("payload").alias("payloads"))


@query("document_members", sql("""
SELECT m.log_id, m.encounter_id, m.fight_id, target, total_damage, duration_seconds, fight_complete, coalesce(n, 0) AS attacker_count
FROM mb m LEFT JOIN (SELECT log_id, fight_id, count(DISTINCT actor) AS n FROM act GROUP BY ALL) USING (log_id, fight_id)"""))
def _(w: Workspace) -> DataFrame:
    return sinks.read_section(
        w.documents, "member",
        "fight_id bigint, target string, total_damage bigint, duration_seconds bigint, fight_complete boolean, attacker_count bigint",
    )


@query("document_attackers", sql("SELECT a.*, sd.side FROM shown a JOIN sd USING (log_id, encounter_id, actor)".replace(
    "a.*", "a.log_id, a.encounter_id, a.actor, a.damage, a.hits, a.misses, a.crits, a.biggest, a.dps, a.pct_of_total"), shown=_SHOWN))
def _(w: Workspace) -> DataFrame:
    return sinks.read_section(
        w.documents, "attacker",
        "actor string, damage bigint, hits bigint, misses bigint, crits bigint, biggest bigint, dps bigint, pct_of_total double, side string",
    )


@query("document_breakdown", sql("SELECT * FROM bk", bk=_BREAKDOWN))
def _(w: Workspace) -> DataFrame:
    """What each listed actor dealt to and took from whom, under the first spelling of the names."""
    return sinks.read_section(w.documents, "breakdown", "actor string, direction string, other string, damage bigint, hits bigint")


@query("document_defenders", sql("""
SELECT d.*, CAST(coalesce(h.amount, 0) AS BIGINT) AS heals_total, coalesce(h.n, 0) AS heals_count FROM (
  SELECT log_id, encounter_id, defender_key, arg_min(target, seen) AS defender, CAST(sum(damage_taken) AS BIGINT) AS damage_taken,
    floor(sum(total_avoided) / sum(total_swings) * 1000 + 0.5) / 10 AS avoid_pct FROM df GROUP BY log_id, encounter_id, defender_key) d
LEFT JOIN (SELECT log_id, encounter_id, lower(target) AS defender_key, sum(amount) AS amount, count(*) AS n FROM hl GROUP BY ALL) h
USING (log_id, encounter_id, defender_key)""", df=_DF))
def _(w: Workspace) -> DataFrame:
    return sinks.read_section(
        w.documents, "defender",
        "defender_key string, defender string, damage_taken bigint, avoid_pct double, heals_total bigint, heals_count bigint",
    )


@query("document_heal_pairs", sql("""
SELECT m.log_id, m.encounter_id, h.name AS healer, t.name AS target, damage, hits FROM hm m
JOIN hx h ON h.log_id = m.log_id AND h.encounter_id = m.encounter_id AND h.name_key = m.attacker_key
JOIN hx t ON t.log_id = m.log_id AND t.encounter_id = m.encounter_id AND t.name_key = m.target_key""", hm=_HEAL_MATRIX, hx="""
SELECT log_id, encounter_id, lower(name) AS name_key, arg_min(name, p) AS name FROM (
  SELECT log_id, encounter_id, actor AS name, ord * 2 AS p FROM hl UNION ALL SELECT log_id, encounter_id, target, ord * 2 + 1 FROM hl)
GROUP BY ALL"""))
def _(w: Workspace) -> DataFrame:
    return sinks.read_section(w.documents, "heal_pair", "healer string, target string, damage bigint, hits bigint")


_HEAL_PACKED = {"heal_series": "hp1", "healer_series": "hp2", "heals_received_series": "hp3"}


@query("document_heal_series", sql(" UNION ALL ".join(f"""
SELECT '{name}' AS section, log_id, encounter_id, {'NULL' if name == 'heals_received_series' else 'attacker_key'} AS attacker_key,
  {'NULL' if name == 'healer_series' else 'target_key'} AS target_key, chunk, first_bucket, amounts FROM {src}"""
    for name, src in _HEAL_PACKED.items()), **_HEAL_CELLS))
def _(w: Workspace) -> DataFrame:
    schema = "attacker_key string, target_key string, chunk bigint, first_bucket bigint, amount array<bigint>"
    parts = [sinks.read_section(w.documents, name, schema).withColumn("section", F.lit(name)) for name in _HEAL_PACKED]
    return _packed_rows(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("document_raid_series", sql(f"""
SELECT log_id, encounter_id, bucket // 256 AS chunk, string_agg(CAST(coalesce(amount, 0) AS VARCHAR), ',' ORDER BY bucket) AS amounts
FROM (SELECT *, unnest(range(nb)) AS bucket FROM (SELECT log_id, encounter_id, {_NB} FROM act GROUP BY ALL))
LEFT JOIN (SELECT log_id, encounter_id, greatest(0, (t - es) // {WIDTH}) AS bucket, {_sum('amount')} AS amount FROM act WHERE hit GROUP BY ALL)
USING (log_id, encounter_id, bucket) GROUP BY log_id, encounter_id, bucket // 256"""))
def _(w: Workspace) -> DataFrame:
    return _packed_rows(sinks.read_section(w.documents, "raid_series", "chunk bigint, amount array<bigint>"))


@query("document_owners", sql("""
SELECT r.log_id, r.encounter_id, r.attacker, r.damage, r.side, o.owner
FROM raw_a r LEFT JOIN own o ON o.log_id = r.log_id AND o.who = lower(r.attacker)""", raw_a=_RAW))
def _(w: Workspace) -> DataFrame:
    return sinks.read_section(w.documents, "raw_attacker", "attacker string, damage bigint, side string, owner string")


_MODES = "CASE mode WHEN 0 THEN 'damage' WHEN 1 THEN 'tanking' ELSE 'healing' END AS mode"


@query("session_document_actors", sql(f"""
SELECT log_id, {_MODES}, name_key, name, total, biggest, encounters_present, avg_rate, median_rate, p95_rate, best_rate, side FROM rs"""))
def _(w: Workspace) -> DataFrame:
    return sinks.read_section(
        w.session_documents, "actor",
        "mode string, name_key string, name string, total bigint, biggest bigint, encounters_present bigint, avg_rate bigint, "
        "median_rate bigint, p95_rate bigint, best_rate bigint, side string",
    )


@query("session_document_header", ORACLES["session_header"])
def _(w: Workspace) -> DataFrame:
    return sinks.read_section(
        w.session_documents, "header",
        "start string, end string, duration_seconds bigint, encounter_count bigint, killed_count bigint, total_damage bigint, "
        "total_healing bigint, total_damage_taken bigint",
    )


@query("session_document_encounters", sql("""
SELECT log_id, encounter_id, row_number() OVER (PARTITION BY log_id ORDER BY s, encounter_id) - 1 AS slot, name, dur AS duration_seconds,
  fight_complete FROM enc"""))
def _(w: Workspace) -> DataFrame:
    return sinks.read_section(
        w.session_documents, "encounter",
        "encounter_id bigint, slot bigint, name string, duration_seconds bigint, fight_complete boolean",
    )


@query("session_document_series", sql(f"""
SELECT log_id, {_MODES}, field, name_key, slot // 256 AS chunk, string_agg(CAST(coalesce(amount, 0) AS VARCHAR), ',' ORDER BY slot) AS amounts
FROM (SELECT r.mode, r.log_id, r.name_key, unnest(CASE WHEN mode = 1 THEN ['value', 'rate', 'heals_value', 'heals_rate'] ELSE ['value', 'rate'] END) AS field
      FROM rs r) JOIN slt USING (log_id) LEFT JOIN cel USING (mode, log_id, encounter_id, name_key, field)
GROUP BY log_id, mode, field, name_key, slot // 256""",
    slt="SELECT log_id, encounter_id, row_number() OVER (PARTITION BY log_id ORDER BY s, encounter_id) - 1 AS slot FROM eb",
    hr=f"""SELECT 1 AS mode, log_id, encounter_id, name_key, value, {_whole('value / CASE WHEN dur = 0 THEN 1 ELSE dur END')} AS rate FROM (
SELECT log_id, encounter_id, lower(target) AS name_key, {_sum('amount')} AS value, any_value(dur) AS dur FROM hl GROUP BY ALL)""",
    cel=" UNION ALL ".join(f"SELECT mode, log_id, encounter_id, name_key, '{p}{c}' AS field, {c} AS amount FROM {src}"
                           for src, p in (("rt", ""), ("hr", "heals_")) for c in ("value", "rate"))))
def _(w: Workspace) -> DataFrame:
    """Values, rates and heals received per encounter in time order, of every actor row."""
    schema = "mode string, field string, name_key string, chunk bigint, amount array<bigint>"
    return _packed_rows(sinks.read_section(w.session_documents, "series", schema))


@query("coverage_document", sql("""
SELECT log_id, 'type' AS section, event_type AS name, count(*) AS lines FROM ev GROUP BY ALL
UNION ALL SELECT log_id, 'header', 'total_lines', count(*) FROM ev GROUP BY log_id
UNION ALL SELECT log_id, 'header', 'unknown_total_lines', count(*) FILTER (event_type = 'unknown') FROM ev GROUP BY log_id
UNION ALL SELECT log_id, 'header', 'unknown_total_groups',
  count(DISTINCT regexp_replace(body, '\\d+', 'N', 'g')) FILTER (event_type = 'unknown') FROM ev GROUP BY log_id
UNION ALL SELECT log_id, 'unknown_group', regexp_replace(body, '\\d+', 'N', 'g'), count(*) FROM ev WHERE event_type = 'unknown' GROUP BY ALL"""))
def _(w: Workspace) -> DataFrame:
    docs = w.coverage_documents
    head = sinks.read_section(docs, "header", "total_lines bigint, unknown_total_lines bigint, unknown_total_groups bigint")
    counts = ("total_lines", "unknown_total_lines", "unknown_total_groups")
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("lines")) for c in counts]))
    types = sinks.read_section(docs, "type", "event_type string, lines bigint").withColumnRenamed("event_type", "name")
    shapes = sinks.read_section(docs, "unknown_group", "shape string, lines bigint").withColumnRenamed("shape", "name")
    parts = {"header": head.select("log_id", pairs), "type": types, "unknown_group": shapes}
    rows = [df.select("log_id", F.lit(name).alias("section"), "name", "lines") for name, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("fight_document_attackers", sql(f"""
SELECT a.log_id, a.fight_id, actor, damage, a.hits, a.misses, crits, biggest,
  {_whole('damage / CASE WHEN duration_seconds = 0 THEN 1 ELSE duration_seconds END')} AS dps, {_pct('damage', 'total_damage')} AS pct_of_total
FROM atk a JOIN ft USING (log_id, fight_id)""", **_BY_FIGHT))
def _(w: Workspace) -> DataFrame:
    return sinks.read_section(
        sinks.fight_documents(w.main, WIDTH), "attacker",
        "actor string, damage bigint, hits bigint, misses bigint, crits bigint, biggest bigint, dps bigint, pct_of_total double",
    )


@query("diff_document_actors", ORACLES["diff_same_log"])
def _(w: Workspace) -> DataFrame:
    fields = _diff(w, False).drop("pair_id").schema.simpleString()
    return sinks.read_section(sinks.diff_documents(w.main, _pairs(w, False)), "actor", fields)


@query("stream_active_view", ORACLES["active_view"])
def _(w: Workspace) -> DataFrame:
    """The live view after the last batch, from the stream's state."""
    return w.streamed_owned.active_view()


@query("stream_active_top_damage", ORACLES["active_top_damage"])
def _(w: Workspace) -> DataFrame:
    return w.streamed_owned.active_top_damage()


@query("stream_active_top_healing", ORACLES["active_top_healing"])
def _(w: Workspace) -> DataFrame:
    return w.streamed_owned.active_top_healing()


@query("stream_encounters", sql("SELECT log_id, fight_id, target, encounter_id FROM mb", ft=_fights("close_ord <> 9223372036854775807")))
def _(w: Workspace) -> DataFrame:
    return w.streamed.members().select("log_id", "fight_id", "target", "encounter_id")


_MANUAL_STREAM = {
    **_MANUAL,
    "fall": _fights(),
    "mg": _MANUAL["mg"].replace("FROM ft", "FROM fall"),
    "ft": _fights("close_ord <> 9223372036854775807"),
}


@query("stream_encounters_manual", sql("SELECT log_id, fight_id, target, encounter_id, manual_name FROM mb", **_MANUAL_STREAM))
def _(w: Workspace) -> DataFrame:
    """Encounters of the closed fights, kept up by regrouping the tail of each log, with manual groups."""
    return w.streamed_manual.members().select("log_id", "fight_id", "target", "encounter_id", "manual_name")


_SAVED = """
SELECT log_id, 'owner' AS kind, CAST(0 AS BIGINT) AS no, who AS key, owner AS value FROM own
UNION ALL SELECT log_id, 'group', gno, fight_key, name FROM (
  SELECT *, dense_rank() OVER (PARTITION BY log_id ORDER BY group_no) - 1 AS gno FROM mg)"""


def _overrides(owners: DataFrame, groups: DataFrame) -> DataFrame:
    """Both tables in one; a file's groups count from 0."""
    rows = owners.select(
        "log_id", F.lit("owner").alias("kind"), F.lit(0).cast("long").alias("no"), F.lower("actor").alias("key"), F.col("owner").alias("value")
    )
    return rows.unionByName(
        groups.select("log_id", F.lit("group").alias("kind"), F.col("group_no").alias("no"), F.col("fight_key").alias("key"), F.col("name").alias("value"))
    )


@query("overrides_round_trip", sql(_SAVED, mg=_MANUAL["mg"]))
def _(w: Workspace) -> DataFrame:
    """Saved twice, read back: the newest save counts, owners and groups."""
    path = f"{staging_dir(w.spark)}/skirmish/overrides-{uuid.uuid4().hex}"
    override_files.save_overrides(w.owners.limit(0), w.manual_groups, path)
    override_files.save_overrides(w.owners, w.manual_groups, path)
    return _overrides(*override_files.load_overrides(w.spark, path))
