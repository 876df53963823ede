"""Fights: hits, misses and deaths sessionized per target.

A fight opens with the first hit or miss on its target and ends with the target's death or when the
next hit or miss comes more than ``gap_seconds`` later. Rows are ordered by ``ord``. A fight's key is
``(log_id, target, open_ord)``; numbering happens after admission.

Islands are found in two levels (see ``functions.sliced``): a window inside slices of a target's
rows, and one over slice summaries, so a target holding a large share of all rows is spread over
many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions import scalars as S
from skirmish.functions.sliced import numbered, ord_slice, running, time_slice
from skirmish.sources.staging import cut

OPEN_END = (1 << 63) - 1
OPEN_POLICIES = ("close", "drop", "include")
FIGHT = ("log_id", "target", "open_ord")
#: Event type of a row that stands for a fight carried over from an earlier batch of a stream.
CARRY = "carry"
#: Columns of an event that detection does not look at; ``tag_fights`` hands them on.
DETAILS = ("actor", "amount", "verb", "spell", "damage_type", "outcome", "modifiers")


def _heal_neighbours(rows: DataFrame, heals: DataFrame, gap_seconds: int) -> tuple[DataFrame, DataFrame]:
    """Attach to every combat row the heals of its log right before and after it.

    Heals at most ``gap_seconds`` apart form a heal session. Returns the rows and the sessions.
    """
    h = cut(heals.select("log_id", "ord", S.epoch("ts").alias("t")), "heals")
    h = running(h, ["log_id"], ord_slice("ord"), ["ord"], last={"_pt": F.col("t")})
    starts = F.col("_pt").isNull() | (F.col("t") - F.col("_pt") > gap_seconds)
    h = running(
        h.withColumn("_new", F.when(starts, F.col("ord"))),
        ["log_id"],
        ord_slice("ord"),
        ["ord"],
        last={"_open": F.col("_new")},
    ).select("log_id", "ord", "t", F.coalesce("_new", "_open").alias("heal_session"))
    h = cut(h, "heal_sessions")
    sessions = h.groupBy("log_id", "heal_session").agg(F.max_by("t", "ord").alias("session_last_t"))
    opening = h.where(F.col("ord") == F.col("heal_session")).select("log_id", "heal_session", "t")
    opening = running(
        opening,
        ["log_id"],
        ord_slice("heal_session"),
        ["heal_session"],
        last={"next_session_ord": F.col("heal_session"), "next_session_t": F.col("t")},
        descending=True,
    )
    sessions = sessions.join(opening.drop("t"), ["log_id", "heal_session"])
    both = rows.withColumn("_session", F.lit(None).cast("long")).unionByName(
        h.select("log_id", "ord", "t", F.col("heal_session").alias("_session")), allowMissingColumns=True
    )
    both = cut(both, "combat_and_heals")
    is_heal = F.col("_session").isNotNull()
    for side, falling in (("heal_before", False), ("heal_after", True)):
        values = {f"_{c}": F.when(is_heal, F.col(c)) for c in ("ord", "t", "_session")}
        both = running(both, ["log_id"], ord_slice("ord"), ["ord"], last=values, descending=falling)
        near = F.struct(
            F.col("_ord").alias("ord"), F.col("_t").alias("t"), F.col("__session").alias("heal_session")
        )
        both = both.withColumn(side, F.when(F.col("_ord").isNotNull(), near)).drop(*values)
    rows = both.where(~is_heal).drop("_session")
    return cut(rows, "heal_neighbours"), cut(sessions, "heal_spans")


def _chain_broken(prev: Column, row: Column, gap_seconds: int, heals: bool) -> Column:
    """Did the target's fight run out between two neighbouring combat rows?"""
    idle = ~row["is_death"] & (row["t"] - prev["t"] > gap_seconds)
    if not heals:
        return idle
    after, before = prev["heal_after"], row["heal_before"]
    between = F.coalesce(after["ord"] < row["ord"], F.lit(False))
    held = (
        (after["t"] - prev["t"] <= gap_seconds)
        & (after["heal_session"] == before["heal_session"])
        & (row["is_death"] | (row["t"] - before["t"] <= gap_seconds))
    )
    return F.when(between, ~held).otherwise(idle)


def tag_fights(
    events: DataFrame, gap_seconds: int = 15, heals_extend_fights: bool = False, details: tuple[str, ...] = DETAILS
) -> tuple[DataFrame, DataFrame | None]:
    """Combat rows with the ``open_ord`` of their fight; late deaths carry a null ``open_ord``.

    The second result holds the heal sessions when heals extend fights. ``details`` names the columns handed on; all of
    them go through every shuffle and sort.
    """
    kind = F.col("event_type")
    rows = events.where(kind.isin("melee_hit", "spell_damage", "melee_miss", "death", CARRY))
    keep = list(details)
    rows = rows.select(
        "log_id",
        "target",
        "ord",
        "ts",
        S.epoch("ts").alias("t"),
        (kind == "death").alias("is_death"),
        "event_type",
        *keep,
    )
    sessions = None
    if heals_extend_fights:
        rows, sessions = _heal_neighbours(rows, events.where(kind == "heal"), gap_seconds)
    state_cols = ["t", "is_death"] + (["heal_before", "heal_after"] if heals_extend_fights else [])
    rows = rows.select("*", ord_slice("ord").alias("_slice"), F.struct("ord", *state_cols).alias("_row"))

    keys = ["log_id", "target"]
    in_slice = Window.partitionBy(*keys, "_slice").orderBy("ord")
    rows = rows.withColumn("_prev", F.lag("_row").over(in_slice))

    def opens(prev: Column, row: Column) -> Column:
        fresh = prev.isNull() | prev["is_death"] | _chain_broken(
            prev, row, gap_seconds, heals_extend_fights
        )
        return ~row["is_death"] & fresh

    row, prev = F.col("_row"), F.col("_prev")
    # What a slice tells its successors: its first and last row and its last opening.
    summary = rows.groupBy(*keys, "_slice").agg(
        F.min_by("_row", "ord").alias("_first"),
        F.max_by("_row", "ord").alias("_last"),
        F.max(F.when(prev.isNotNull() & opens(prev, row), F.col("ord"))).alias("_opened"),
    )
    across = Window.partitionBy(*keys).orderBy("_slice")
    summary = summary.withColumn("_carry_prev", F.lag("_last").over(across))
    slice_open = F.coalesce(
        "_opened", F.when(opens(F.col("_carry_prev"), F.col("_first")), F.col("_first.ord"))
    )
    summary = summary.select(
        *keys,
        "_slice",
        "_carry_prev",
        F.last(slice_open, ignorenulls=True)
        .over(across.rowsBetween(Window.unboundedPreceding, -1))
        .alias("_carry_open"),
    )

    rows = rows.join(summary, [*keys, "_slice"])
    rows = rows.withColumn("_prev", F.coalesce("_prev", "_carry_prev"))
    rows = rows.withColumn("_opens", opens(prev, row))
    open_ord = F.coalesce(
        F.last(F.when(F.col("_opens"), F.col("ord")), ignorenulls=True).over(
            in_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
        F.col("_carry_open"),
    )
    late = F.col("is_death") & (
        prev.isNull()
        | prev["is_death"]
        | _chain_broken(prev, row, gap_seconds, heals_extend_fights)
    )
    extra = ["heal_after"] if heals_extend_fights else []
    return (
        rows.withColumn("_open_ord", open_ord).select(
            *keys,
            F.when(~late, F.col("_open_ord")).alias("open_ord"),
            "ord",
            "ts",
            "t",
            "is_death",
            "event_type",
            *keep,
            *extra,
        ),
        sessions,
    )


def fight_bounds(tagged: DataFrame, sessions: DataFrame | None, gap_seconds: int, with_last: bool = False) -> DataFrame:
    """One row per fight: start, end, close position and close time; ``with_last`` also place and time of its last row.

    The sums are written before the next fight is looked up, as the rows would be read and summed once for each branch of that.
    """
    places = [F.max("ord").alias("last_ord"), F.max_by("t", "ord").alias("last_t")] if with_last else []
    act_ord = F.when(~F.col("is_death"), F.col("ord"))
    heard = []
    if sessions is not None:
        heard = [
            F.max_by(F.col(f"heal_after.{c}"), act_ord).alias(f"_after_{c}")
            for c in ("ord", "t", "heal_session")
        ]
    fights = (
        tagged.where(F.col("open_ord").isNotNull())
        .groupBy(*FIGHT)
        .agg(
            F.min_by("t", "ord").alias("start_t"),
            F.max_by("t", act_ord).alias("_last_t"),
            *heard,
            F.max(F.when(F.col("is_death"), F.col("ord"))).alias("_death_ord"),
            F.max(F.when(F.col("is_death"), F.col("t"))).alias("_death_t"),
            F.coalesce(F.sum("amount"), F.lit(0)).alias("total_damage"),
            F.count_if(F.col("event_type").isin("melee_hit", "spell_damage")).alias("hits"),
            F.count_if(F.col("event_type") == "melee_miss").alias("misses"),
            *places,
        )
    )
    fights = running(
        cut(fights, "fight_sums"),
        ["log_id", "target"],
        ord_slice("open_ord"),
        ["open_ord"],
        last={"_next_open": F.col("open_ord"), "_next_t": F.col("start_t")},
        descending=True,
    )
    last_t, next_open = F.col("_last_t"), F.col("_next_open")
    close_ord, close_t, idle_end = next_open, F.col("_next_t"), last_t
    if sessions is not None:
        after_ord, after_t = F.col("_after_ord"), F.col("_after_t")
        fights = fights.withColumnRenamed("_after_heal_session", "heal_session").join(
            sessions, ["log_id", "heal_session"], "left"
        )
        # A heal before the next fight counts; the fight runs on through that heal's session.
        counts = after_ord.isNotNull() & (next_open.isNull() | (after_ord < next_open))
        in_time = counts & (after_t - last_t <= gap_seconds)
        idle_end = F.when(in_time, F.greatest(last_t, F.col("session_last_t"))).otherwise(last_t)
        heal_ord = F.when(in_time, F.col("next_session_ord")).when(counts, after_ord)
        heal_t = F.when(in_time, F.col("next_session_t")).when(counts, after_t)
        heal_first = heal_ord.isNotNull() & (next_open.isNull() | (heal_ord < next_open))
        close_ord = F.when(heal_first, heal_ord).otherwise(close_ord)
        close_t = F.when(heal_first, heal_t).otherwise(close_t)
    killed = F.col("_death_ord").isNotNull()
    return fights.select(
        *FIGHT,
        "start_t",
        F.when(killed, F.col("_death_t")).otherwise(idle_end).alias("end_t"),
        killed.alias("fight_complete"),
        F.when(killed, F.col("_death_ord"))
        .otherwise(F.coalesce(close_ord, F.lit(OPEN_END)))
        .alias("close_ord"),
        F.when(killed, F.col("_death_t")).otherwise(close_t).alias("close_t"),
        "total_damage",
        "hits",
        "misses",
        *(["last_ord", "last_t"] if with_last else []),
    )


#: Closings under one block of the next level of ``_lowest_ends``, as a power of two.
BLOCK_BITS = 5


def late_kills(fights: DataFrame, deaths: DataFrame, gap_seconds: int) -> DataFrame:
    """Fights a late death turns into kills, as ``FIGHT`` keys.

    A death without an open fight completes the newest closed, incomplete fight of its target, unless that
    fight or one closed after it (of any target of the log, before the death) ended more than ``gap + 10`` seconds before
    the death. Everything goes by position, so clocks may run backwards.

    Closings get a running number in their log; a death sees those up to its place. Its candidate is the last waiting fight
    of its target, and whether anything blocks it is one comparison with the lowest end among the closings from the
    candidate on, looked up in a few blocks. A candidate goes to its first death that is not blocked; deaths of the target behind
    that one look for the fight before, in another round, of which there are as many as deaths in a row that
    complete fights of one target.
    """
    grace = gap_seconds + S.LATE_DEATH_SLACK_SECONDS
    none = F.lit(None).cast("bigint")
    closed = fights.where(F.col("close_ord") != OPEN_END).select(
        "log_id", "target", F.col("close_ord").alias("at"), "open_ord", "end_t",
        (~F.col("fight_complete")).alias("waits"), none.alias("death_t"),
    )
    late = deaths.select(
        "log_id", "target", F.col("ord").alias("at"), none.alias("open_ord"), none.alias("end_t"),
        F.lit(False).alias("waits"), F.col("t").alias("death_t"),
    )
    is_closing = F.col("open_ord").isNotNull()
    both = running(
        closed.unionByName(late), ["log_id"], ord_slice("at"), ["at", "open_ord"],
        total={"n": is_closing.cast("bigint")},
    )
    both = cut(both, "closings_and_deaths")
    closings = both.where(is_closing)
    waiting = closings.where("waits").select("log_id", "target", "at", "open_ord", "n", "end_t")
    asking = both.where(~is_closing).select("log_id", "target", "at", F.col("n").alias("upto"), "death_t")
    found = fights.sparkSession.createDataFrame([], "log_id string, target string, open_ord bigint")
    levels = None
    while True:
        pairs = cut(_last_waiting(asking, waiting), "late_deaths")
        if pairs.where(F.col("death_t") - F.col("end_t") <= grace).isEmpty():
            return found
        if levels is None:
            top = closings.agg(F.max("n")).first()[0]
            levels = max(1, -(-int(top + 1).bit_length() // BLOCK_BITS))
        near = pairs.where(F.col("death_t") - F.col("end_t") <= grace)
        free = _lowest_ends(near, closings, levels).where(F.col("lowest") >= F.col("death_t") - grace)
        first = cut(free.groupBy(*FIGHT).agg(F.min("at").alias("first")), "late_kills")
        if first.isEmpty():
            return found
        found = found.unionByName(first.select(*FIGHT))
        asking = pairs.join(first, list(FIGHT)).where(F.col("at") > F.col("first"))
        asking = cut(asking.select("log_id", "target", "at", "upto", "death_t"), "late_deaths")
        if asking.isEmpty():
            return found
        waiting = waiting.join(first.select(*FIGHT), list(FIGHT), "left_anti")
        waiting = waiting.join(asking.select("log_id", "target").distinct(), ["log_id", "target"], "left_semi")


def _last_waiting(asking: DataFrame, waiting: DataFrame) -> DataFrame:
    """Every death with the last waiting fight of its target before it, if there is one."""
    fight = F.struct("open_ord", "n", "end_t")
    seen = asking.unionByName(
        waiting.select("log_id", "target", "at", fight.alias("_fight")), allowMissingColumns=True
    )
    seen = running(seen, ["log_id", "target"], ord_slice("at"), ["at"], last={"_last": F.col("_fight")})
    seen = seen.where(F.col("_fight").isNull() & F.col("_last").isNotNull())
    return seen.select("log_id", "target", "at", "upto", "death_t", "_last.open_ord", "_last.n", "_last.end_t")


def _at_level(level: int) -> Callable[[Column], Column]:
    return lambda block: F.struct(F.lit(level).alias("level"), block.alias("block"))


def _lowest_ends(pairs: DataFrame, closings: DataFrame, levels: int) -> DataFrame:
    """``pairs`` with the lowest end of the closings ``n`` to before ``upto`` of their log.

    The lowest ends of blocks of 2**5, 2**10, ... closings are summed up once; a range is made of whole blocks and less than a
    block's closings on each side, level by level.
    """
    each = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    blocks = closings.select("log_id", "n", "end_t", each.alias("level"))
    block = F.expr(f"shiftright(n, level * {BLOCK_BITS})")
    blocks = blocks.groupBy("log_id", "level", block.alias("block")).agg(F.min("end_t").alias("low"))

    def span(low: Column, high: Column) -> Column:
        empty = F.array().cast("array<bigint>")
        return F.when(low < high, F.sequence(low, F.greatest(low, high - 1))).otherwise(empty)

    low, high, parts = F.col("n"), F.col("upto"), []
    for level in range(levels):
        up, down = F.shiftright(low + ((1 << BLOCK_BITS) - 1), BLOCK_BITS), F.shiftright(high, BLOCK_BITS)
        flat = F.lit(level == levels - 1) | (up >= down)
        sides = F.concat(span(low, F.shiftleft(up, BLOCK_BITS)), span(F.shiftleft(down, BLOCK_BITS), high))
        asked = F.when(flat, span(low, high)).otherwise(sides)
        parts.append(F.transform(asked, _at_level(level)))
        low, high = F.when(flat, F.lit(0)).otherwise(up), F.when(flat, F.lit(0)).otherwise(down)
    keys = [*FIGHT, "at"]
    asked = pairs.select(*keys, F.explode(F.concat(*parts)).alias("_p")).select(*keys, "_p.level", "_p.block")
    lowest = asked.join(blocks, ["log_id", "level", "block"]).groupBy(*keys).agg(F.min("low").alias("lowest"))
    return pairs.join(lowest, keys)


def detect_fights(
    events: DataFrame,
    tagged: DataFrame,
    sessions: DataFrame | None = None,
    *,
    gap_seconds: int = 15,
    min_damage: int = 10_000,
    min_duration_seconds: int = 0,
    open_policy: str = "close",
) -> DataFrame:
    """The admitted fights of every log, numbered by start.

    ``open_policy`` decides about fights still open at the end of a log: ``close`` ends them at
    their last activity, ``drop`` leaves out those that could still go on, ``include`` lists these
    with ``in_progress`` set.
    """
    if open_policy not in OPEN_POLICIES:
        raise ValueError(f"open_policy must be one of {OPEN_POLICIES}")
    fights = cut(fight_bounds(tagged, sessions, gap_seconds), "fight_bounds")
    late = tagged.where(F.col("is_death") & F.col("open_ord").isNull())
    kills = late_kills(fights, late, gap_seconds).withColumn("_late", F.lit(True))
    fights = fights.join(kills, list(FIGHT), "left").withColumn(
        "fight_complete", F.col("fight_complete") | F.coalesce("_late", F.lit(False))
    )
    fights = fights.drop("_late").withColumn("in_progress", F.lit(False))
    if open_policy != "close":
        fights = _with_progress(fights, events, gap_seconds)
        if open_policy == "drop":
            fights = fights.where(~F.col("in_progress"))
    fights = admit(fights, min_damage, min_duration_seconds)
    return number_fights(fights)


def _with_progress(fights: DataFrame, events: DataFrame, gap_seconds: int) -> DataFrame:
    """``in_progress``: not closed, and their last activity no more than the gap before their log's end."""
    ends = events.groupBy("log_id").agg(F.max_by(S.epoch("ts"), "ord").alias("_log_end"))
    alive = (F.col("close_ord") == OPEN_END) & (F.col("_log_end") - F.col("end_t") <= gap_seconds)
    return fights.join(ends, "log_id").withColumn("in_progress", alive).drop("_log_end")


def open_fights(
    events: DataFrame, tagged: DataFrame, sessions: DataFrame | None = None, gap_seconds: int = 15
) -> DataFrame:
    """All fights that could still go on at the end of their log, of any size and target, the player's too.

    Late deaths and numbers concern closed fights only, so neither is worked out.
    """
    fights = fight_bounds(tagged, sessions, gap_seconds).where(F.col("close_ord") == OPEN_END)
    return _with_progress(fights, events, gap_seconds).where("in_progress")


def admit(fights: DataFrame, min_damage: int = 10_000, min_duration_seconds: int = 0) -> DataFrame:
    """Fights worth listing: enough damage, long enough, neither the player nor a pet as target."""
    return fights.where(
        (F.col("total_damage") >= min_damage)
        & (F.col("end_t") - F.col("start_t") >= min_duration_seconds)
        & (F.col("target") != "You")
        & ~S.is_pet("target")
    )


def number_fights(fights: DataFrame) -> DataFrame:
    """``fight_id`` by start; ties in closing order, open fights in opening order."""
    out = numbered(
        fights, ["log_id"], time_slice("start_t"), ["start_t", "close_ord", "open_ord"], "fight_id"
    )
    duration = F.col("end_t") - F.col("start_t")
    return out.select(
        *FIGHT,
        "fight_id",
        S.from_epoch("start_t").alias("start"),
        S.from_epoch("end_t").alias("end"),
        "start_t",
        "end_t",
        duration.alias("duration_seconds"),
        "fight_complete",
        "in_progress",
        "close_ord",
        "total_damage",
        "hits",
        "misses",
        S.raid_rate("total_damage", duration).alias("raid_dps"),
        S.fight_key("target", S.from_epoch("start_t")).alias("fight_key"),
    )


def single_target(events: DataFrame, target: str) -> DataFrame:
    """Combat rows of one named target per log (any casing), up to its first death.

    No gap rule; a log whose first row for the target is its death gives nothing.
    """
    mine = events.where(
        (S.fold("target") == target.lower())
        & F.col("event_type").isin("melee_hit", "spell_damage", "melee_miss", "death")
    )
    first_death = mine.where(F.col("event_type") == "death").groupBy("log_id").agg(
        F.min("ord").alias("_death_ord"), F.min_by("ts", "ord").alias("death_ts")
    )
    rows = mine.where(F.col("event_type") != "death").join(first_death, "log_id", "left")
    return rows.where(F.col("_death_ord").isNull() | (F.col("ord") < F.col("_death_ord"))).drop(
        "_death_ord"
    )


def analyze_fight(events: DataFrame, target: str) -> DataFrame:
    """One row per log: the fight of one named target."""
    rows = single_target(events, target)
    out = rows.groupBy("log_id").agg(
        F.min_by("ts", "ord").alias("start"),
        F.coalesce(F.first("death_ts", ignorenulls=True), F.max_by("ts", "ord")).alias("end"),
        F.first("death_ts", ignorenulls=True).isNotNull().alias("fight_complete"),
        F.coalesce(F.sum("amount"), F.lit(0)).alias("total_damage"),
        F.count_if(F.col("event_type") != "melee_miss").alias("hits"),
        F.count_if(F.col("event_type") == "melee_miss").alias("misses"),
    )
    duration = S.epoch("end") - S.epoch("start")
    return out.withColumn("target", F.lit(target)).withColumn("duration_seconds", duration).withColumn(
        "raid_dps", S.raid_rate("total_damage", duration)
    )
