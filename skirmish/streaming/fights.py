"""Fights over a stream of events.

``FightStream`` is a ``foreachBatch`` sink. A micro-batch runs the same two-level detection as a
batch job; fights still open come in from the state of the batch before as one row each, so
the state is one row per open fight and a busy target is spread over tasks like in batch. The state's tables
are switched by one pointer at the end of a batch and merged by levels (``streaming.state``), so a restart from the
query's checkpoint gives the same result and a batch costs the same after any number of others.

Rows of one log must arrive in ``ord`` order from batch to batch (inside a batch any order will do); a
batch that begins before the end of the one before is an error. Clocks must not fall from batch to batch.

Heals that extend fights need no chains of their own: heals since the start of the oldest open fight of a log are kept
anyway, and come in with the carried fights.

With encounters, a log's fights before its *border* keep their numbers and groups for good; a batch groups the fights behind it
(``tail``) only. A border is the start of a group that no open fight, late kill or manual group can move.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.functions import scalars as S
from skirmish.functions.sliced import SLICE_SECONDS, running, time_slice
from skirmish.operators import encounters as E
from skirmish.operators import fights as D
from skirmish.operators import overrides as V
from skirmish.operators import player
from skirmish.operators.parse import parse_lines
from skirmish.sources.logs import ordered_chunks
from skirmish.sources.staging import cut, owned, staging_dir
from skirmish.streaming.state import Pointer, StateTables

BOUNDS = (
    "log_id string, target string, open_ord bigint, start_t bigint, end_t bigint, fight_complete boolean, "
    "close_ord bigint, close_t bigint, total_damage bigint, hits bigint, misses bigint"
)
OPEN = BOUNDS + ", last_ord bigint, last_t bigint"
ACTORS = "log_id string, target string, open_ord bigint, actor string, amount bigint, ord bigint"
HEALS = "log_id string, ord bigint, t bigint, actor string, target string, amount bigint"
KILLS = "log_id string, target string, open_ord bigint"
ENDS = "log_id string, last_ord bigint, last_t bigint"
MEMBERS = (
    "log_id string, target string, open_ord bigint, fight_id bigint, start timestamp_ntz, end timestamp_ntz, start_t bigint, "
    "end_t bigint, duration_seconds bigint, fight_complete boolean, in_progress boolean, close_ord bigint, total_damage bigint, "
    "hits bigint, misses bigint, raid_dps double, fight_key string, encounter_id bigint, manual_name string"
)
SETTLED = "log_id string, fights bigint, encounters bigint, border_t bigint"
#: The columns of an event that the sink looks at; the others are not read.
TAKEN = ("log_id", "ord", "ts", "event_type", "actor", "target", "amount")
#: Event type of the rows that keep a stream going while no log is written.
HEARTBEAT = "heartbeat"


def gap_sessions(events: DataFrame, gap_seconds: int = 15) -> DataFrame:
    """Activity sessions per target by inactivity only, for a batch or a watermarked stream.

    A batch is cut in one-hour slices: rows are summed by second before the shuffle, and a session that runs over slices is put
    together from the slices' last seconds, so the rows of one target spread over many tasks.
    """
    acts = events.where(F.col("event_type").isin("melee_hit", "spell_damage", "melee_miss"))
    if events.isStreaming:
        return (
            acts.groupBy("log_id", "target", F.session_window("ts", f"{gap_seconds} seconds").alias("_w"))
            .agg(
                F.min("ts").alias("start"),
                F.max("ts").alias("end"),
                F.count("*").alias("events"),
                F.sum("amount").alias("damage"),
            )
            .drop("_w")
        )
    keys, at = ["log_id", "target"], F.floor(F.col("_us") / (SLICE_SECONDS * 1_000_000))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = acts.where(F.col("ts").isNotNull()).groupBy(*keys, micros.alias("_us")).agg(
        F.count("*").alias("_n"), F.sum("amount").alias("_amount")
    )
    rows = running(rows, keys, at, ["_us"], last={"_before": F.col("_us")})
    fresh = F.col("_before").isNull() | (F.col("_us") - F.col("_before") > gap_seconds * 1_000_000)
    rows = rows.withColumn("_new", F.when(fresh, F.col("_us")))
    rows = running(rows, keys, at, ["_us"], last={"_open": F.col("_new")})
    found = rows.groupBy(*keys, F.coalesce("_new", "_open").alias("_first")).agg(
        F.max("_us").alias("_last"), F.sum("_n").alias("events"), F.sum("_amount").alias("damage")
    )
    stamps = [F.timestamp_micros(F.col(c)).cast("timestamp_ntz").alias(name) for c, name in (("_first", "start"), ("_last", "end"))]
    return found.select(*keys, *stamps, "events", "damage")


#: Fights closed longer ago than this before the end of their log are out of reach of a late death.
SETTLING_SECONDS = 2 * S.LATE_DEATH_SLACK_SECONDS


def _completed(fights: DataFrame, kills: DataFrame) -> DataFrame:
    """``fights`` with the late kills applied."""
    late = kills.distinct().withColumn("_late", F.lit(True))
    out = fights.join(late, list(D.FIGHT), "left")
    return out.withColumn("fight_complete", F.col("fight_complete") | F.coalesce("_late", F.lit(False))).drop("_late")


def _group_spans(manual_groups: DataFrame | None) -> DataFrame | None:
    """First and last start of each manual group, from the keys of its fights, and its keys."""
    if manual_groups is None:
        return None
    start = F.try_to_timestamp(F.regexp_extract("fight_key", r"\|([^|]*)$", 1), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    keys = E.valid_groups(manual_groups).withColumn("_t", F.unix_seconds(start.cast("timestamp")))
    return keys.groupBy("log_id", "group_no").agg(
        F.min("_t").alias("first_t"), F.max("_t").alias("last_t"),
        F.sum(F.xxhash64("fight_key", "group_no", "name").cast("decimal(38,0)")).alias("keys"),
    )


def _outside(fit: DataFrame, spans: DataFrame) -> DataFrame:
    """The borders that lie in no span: none that begins before a border of its log ends at it or later.

    One running maximum over borders and spans in time order; pairs of them would grow with the square of a log's length.
    """
    none = F.lit(None).cast("bigint")
    both = fit.select("log_id", F.col("border_t").alias("t"), F.lit(False).alias("is_span"), none.alias("last_t")).unionByName(
        spans.where(F.col("first_t").isNotNull()).select("log_id", F.col("first_t").alias("t"), F.lit(True).alias("is_span"), "last_t")
    )
    both = running(both, ["log_id"], time_slice("t"), ["t", "is_span"], largest={"_upto": F.col("last_t")})
    free = F.col("_upto").isNull() | (F.col("_upto") < F.col("t"))
    return both.where(~F.col("is_span") & free).select("log_id", F.col("t").alias("border_t"))


class FightStream:
    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        gap_seconds: int = 15,
        expire_idle: bool = False,
        pet_owners: DataFrame | None = None,
        encounter_gap_seconds: int | None = None,
        manual_groups: DataFrame | None = None,
        min_damage: int = 10_000,
        min_duration_seconds: int = 0,
        heals_extend_fights: bool = False,
        clock: Callable[[], int] | None = None,
    ):
        """``expire_idle`` closes fights as soon as their log has moved on by more than the gap,
        instead of at the target's next row; ``clock`` (seconds since the epoch, in the logs' time) also when a log stands
        still. With ``encounter_gap_seconds`` the touched logs are
        regrouped after every batch, from the completed fights that ``min_damage`` and
        ``min_duration_seconds`` list, with the manual groups, as a batch job does."""
        self.spark, self.state = spark, StateTables(spark, folder)
        self.gap_seconds, self.expire_idle, self.clock = gap_seconds, expire_idle, clock
        self.pet_owners, self.encounter_gap_seconds = pet_owners, encounter_gap_seconds
        self.manual_groups, self.heals_extend_fights = manual_groups, heals_extend_fights
        self.min_damage, self.min_duration_seconds = min_damage, min_duration_seconds

    # -- sink --------------------------------------------------------------

    def process(self, events: DataFrame, batch_id: int) -> None:
        """Take in one micro-batch of events; its intermediate tables go when its state is written."""
        with owned(self.spark):
            self._take_in(events, batch_id)

    def _take_in(self, events: DataFrame, batch_id: int) -> None:
        state, old_state = self.state, self.state.newest(batch_id)
        new_state = Pointer(batch_id, dict(old_state.tables), old_state.note)
        events = events.where(F.col("event_type").isNull() | (F.col("event_type") != HEARTBEAT))
        events = cut(events.select(*TAKEN), "stream_batch")
        ends = self._log_ends(events, old_state, batch_id)
        state.replace(new_state, "ends", ends)
        ends = state.read(new_state, "ends", ENDS)
        before = state.read(old_state, "open", OPEN)
        kept_heals = state.read(old_state, "open_heals", HEALS)
        carry = before.select(
            "log_id",
            "target",
            F.col("last_ord").alias("ord"),
            S.from_epoch("last_t").alias("ts"),
            F.lit(D.CARRY).alias("event_type"),
        )
        combat = events.unionByName(carry, allowMissingColumns=True)
        if self.heals_extend_fights:
            heals = kept_heals.select("log_id", "ord", S.from_epoch("t").alias("ts"), F.lit("heal").alias("event_type"))
            combat = combat.unionByName(heals, allowMissingColumns=True)
        tagged, sessions = D.tag_fights(combat, self.gap_seconds, self.heals_extend_fights, details=("actor", "amount"))
        tagged = cut(tagged, "stream_tagged")
        bounds = D.fight_bounds(tagged, sessions, self.gap_seconds, with_last=True)
        old = before.select(
            "log_id",
            "target",
            F.col("last_ord").alias("_at"),
            F.col("open_ord").alias("_open"),
            F.col("start_t").alias("_start"),
            *[F.col(c).alias(f"_{c}") for c in ("total_damage", "hits", "misses")],
        )
        # A fight that begins with a carried row goes on under its own key and sums.
        joined = bounds.withColumn("_at", F.col("open_ord"))
        joined = joined.join(old, ["log_id", "target", "_at"], "left")
        now = joined.select(
            "log_id",
            "target",
            F.coalesce("_open", "open_ord").alias("open_ord"),
            F.coalesce("_start", "start_t").alias("start_t"),
            "end_t",
            "fight_complete",
            "close_ord",
            "close_t",
            *[
                (F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
                for c in ("total_damage", "hits", "misses")
            ],
            "last_ord",
            "last_t",
            F.col("open_ord").alias("_tag"),
        )
        if self.expire_idle or self.clock is not None:
            reached = F.col("_end_t")
            if self.clock is not None:
                reached = F.greatest(reached, F.lit(int(self.clock())).cast("long"))
            places = ends.select("log_id", F.col("last_ord").alias("_end_ord"), F.col("last_t").alias("_end_t"))
            idle = (F.col("close_ord") == D.OPEN_END) & (reached - F.col("end_t") > self.gap_seconds)
            now = now.join(places, "log_id", "left")
            now = (
                now.withColumn("close_t", F.when(idle, reached).otherwise(F.col("close_t")))
                .withColumn("close_ord", F.when(idle, F.col("_end_ord")).otherwise(F.col("close_ord")))
                .drop("_end_ord", "_end_t")
            )
        now = cut(now, "stream_fights")
        is_open = F.col("close_ord") == D.OPEN_END
        closed = now.where(~is_open).drop("last_ord", "last_t", "_tag")
        state.add(new_state, "closed", closed)
        state.replace(new_state, "open", now.where(is_open).drop("_tag"))

        late = tagged.where(F.col("is_death") & F.col("open_ord").isNull()).select(
            "log_id", "target", "ord", "t"
        )
        kills = self._settle_late_deaths(closed, late, ends, old_state, new_state)

        live = now.where(is_open).select("log_id", "target", "_tag", "open_ord")
        fresh = (
            tagged.where(~F.col("is_death") & (F.col("event_type") != D.CARRY))
            .select("log_id", "target", F.col("open_ord").alias("_tag"), "actor", "amount", "ord")
            .join(live, ["log_id", "target", "_tag"])
            .select("log_id", "target", "open_ord", "actor", "amount", "ord")
        )
        kept = state.read(old_state, "open_actors", ACTORS).join(
            live.select(*D.FIGHT), list(D.FIGHT), "left_semi"
        )
        actors = fresh.unionByName(kept).groupBy(*D.FIGHT, "actor").agg(
            F.coalesce(F.sum("amount"), F.lit(0)).alias("amount"), F.min("ord").alias("ord")
        )
        state.replace(new_state, "open_actors", actors)
        # Heals are kept as long as a fight that was running at their time is open.
        since = now.where(is_open).groupBy("log_id").agg(F.min("start_t").alias("_since"))
        heals = (
            events.where(F.col("event_type") == "heal")
            .select("log_id", "ord", S.epoch("ts").alias("t"), "actor", "target", "amount")
            .unionByName(kept_heals)
        )
        heals = heals.join(since, "log_id").where(F.col("t") >= F.col("_since")).drop("_since")
        state.replace(new_state, "open_heals", heals)
        if self.encounter_gap_seconds is not None:
            self._regroup(closed, kills, now.where(is_open), ends, old_state, new_state)
        state.commit(new_state)

    def _log_ends(self, events: DataFrame, old_state: Pointer, batch_id: int) -> DataFrame:
        """Each log's last place and time; a log's first row must lie behind the last one of all batches before."""
        before = self.state.read(old_state, "ends", ENDS)
        span = events.groupBy("log_id").agg(
            F.min("ord").alias("_first"),
            F.max("ord").alias("_last"),
            F.max_by(S.epoch("ts"), F.when(F.col("ts").isNotNull(), F.col("ord"))).alias("_t"),
        )
        both = cut(span.join(before, "log_id", "full_outer"), "stream_ends")
        late = both.where(F.col("_first") <= F.col("last_ord")).select("log_id").first()
        if late is not None:
            raise ValueError(f"batch {batch_id} holds rows of {late.log_id} from before the end of an earlier batch")
        return both.select("log_id", F.greatest("_last", "last_ord").alias("last_ord"), F.coalesce("_t", "last_t").alias("last_t"))

    def _settle_late_deaths(
        self, closed: DataFrame, deaths: DataFrame, ends: DataFrame, old_state: Pointer, new_state: Pointer
    ) -> DataFrame:
        """Write and return the fights completed by a death that found no open fight.

        Such a death concerns fights closed less than ten seconds before, so only the fights closed
        at the end of each log are carried from batch to batch (``recent``).
        """
        columns = [c.split()[0] for c in BOUNDS.split(", ")]
        near = closed.select(*columns).unionByName(self.state.read(old_state, "recent", BOUNDS))
        near = cut(near, "stream_recent")
        kills = cut(D.late_kills(near, deaths, self.gap_seconds).select(*D.FIGHT), "stream_kills")
        self.state.add(new_state, "kills", kills, lambda rows: rows.distinct())
        recent = _completed(near, kills).join(ends.select("log_id", F.col("last_t").alias("_end_t")), "log_id", "left")
        recent = recent.where(F.col("_end_t").isNull() | (F.col("close_t") >= F.col("_end_t") - SETTLING_SECONDS))
        self.state.replace(new_state, "recent", recent.select(*columns))
        return kills

    def _regroup(
        self, closed: DataFrame, kills: DataFrame, live: DataFrame, ends: DataFrame, old_state: Pointer, new_state: Pointer
    ) -> None:
        """Group the fights behind each log's border, and move the border on."""
        state, columns = self.state, [c.split()[0] for c in BOUNDS.split(", ")]
        spans = _group_spans(self.manual_groups)
        note = "" if spans is None else str(spans.agg(F.sum(F.xxhash64("log_id", "keys").cast("decimal(38,0)"))).first()[0])
        if note != old_state.note:  # other manual groups: no border holds
            new_state.note = note
            tail = self._all_closed(new_state).select(*columns)
            settled = self.spark.createDataFrame([], SETTLED)
            new_state.tables.pop("members", None)
        else:
            tail = _completed(state.read(old_state, "tail", BOUNDS).unionByName(closed.select(*columns)), kills)
            settled = state.read(old_state, "settled", SETTLED)
        tail = cut(D.admit(tail, self.min_damage, self.min_duration_seconds), "stream_tail")
        rows = cut(D.number_fights(tail.withColumn("in_progress", F.lit(False))), "stream_numbered")
        grouped = cut(E.group_fights(rows, self.encounter_gap_seconds, self.manual_groups), "stream_groups")
        # A group of unclaimed fights starts behind the end of all unclaimed fights before it.
        claimed = F.col("manual_name").isNotNull()
        if self.manual_groups is not None:
            claims = E.valid_groups(self.manual_groups).select("log_id", "fight_key", F.lit(True).alias("_claimed")).distinct()
            starts = grouped.join(claims, ["log_id", "fight_key"], "left")
            claimed = F.coalesce("_claimed", F.lit(False))
        else:
            starts = grouped
        starts = starts.where(~claimed).groupBy("log_id", "encounter_id").agg(F.min("start_t").alias("border_t"))
        bounds = live.groupBy("log_id").agg(F.min("start_t").alias("_live_t"))
        fresh = tail.join(ends.select("log_id", F.col("last_t").alias("_end_t")), "log_id").where(
            F.col("close_t") >= F.col("_end_t") - SETTLING_SECONDS
        )
        fresh = fresh.groupBy("log_id").agg(F.min("start_t").alias("_fresh_t"))
        fit = starts.join(bounds, "log_id", "left").join(fresh, "log_id", "left").where(
            (F.col("_live_t").isNull() | (F.col("border_t") <= F.col("_live_t")))
            & (F.col("_fresh_t").isNull() | (F.col("border_t") <= F.col("_fresh_t")))
        )
        if spans is not None:
            fit = _outside(fit, spans)
        border = cut(fit.groupBy("log_id").agg(F.max("border_t").alias("_border_t")), "stream_borders")
        placed = grouped.join(settled, "log_id", "left").join(border, "log_id", "left")
        placed = placed.withColumn("_done", F.coalesce(F.col("start_t") < F.col("_border_t"), F.lit(False)))
        for c, known in (("fight_id", "fights"), ("encounter_id", "encounters")):
            placed = placed.withColumn(c, F.col(c) + F.coalesce(known, F.lit(0)))
        placed = cut(placed, "stream_members")
        names = [c.split()[0] for c in MEMBERS.split(", ")]
        state.add(new_state, "members", placed.where("_done").select(*names))
        state.replace(new_state, "tail_members", placed.where("NOT _done").select(*names))
        moved = placed.groupBy("log_id").agg(
            F.max(F.when(F.col("_done"), F.col("fight_id"))).alias("_fights"),
            F.max(F.when(F.col("_done"), F.col("encounter_id"))).alias("_encounters"),
            F.max("_border_t").alias("_border_t"),
        )
        after = settled.join(moved, "log_id", "full_outer")
        state.replace(new_state, "settled", after.select(
            "log_id", F.coalesce("_fights", "fights", F.lit(0)).alias("fights"),
            F.coalesce("_encounters", "encounters", F.lit(0)).alias("encounters"),
            F.greatest("_border_t", "border_t").alias("border_t"),
        ))
        left = tail.join(border, "log_id", "left").where(
            F.col("_border_t").isNull() | (F.col("start_t") >= F.col("_border_t"))
        )
        state.replace(new_state, "tail", left.select(*columns))

    def process_lines(self, lines: DataFrame, batch_id: int) -> None:
        """Take in one micro-batch of lines: parse, detect; those of ``stream_lines`` are put in order first."""
        self.process(parse_lines(lines if "ord" in lines.columns else ordered_chunks(lines)), batch_id)

    def start(
        self,
        stream: DataFrame,
        checkpoint: str,
        available_now: bool = False,
        every: str = "250 milliseconds",
        from_lines: bool = False,
    ):
        """Run the sink on a streaming events table, or on lines (``stream_lines``, ``follow_logs``) with ``from_lines``.

        With a ``clock`` a beat a second joins the stream, so that batches run, and idle fights close, while no log is written.
        """
        take = self.process_lines if from_lines else self.process
        if not from_lines:
            stream = stream.select(*TAKEN)  # a sink's rows reach it whole, so the scan is narrowed here
        if self.clock is not None:
            if from_lines:
                raise ValueError("a stream with a clock takes events: parse the lines before")
            beat = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
            beat = beat.select(F.lit(HEARTBEAT).alias("event_type"))
            stream = stream.unionByName(beat, allowMissingColumns=True)
        writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
        return writer.start()

    # -- views -------------------------------------------------------------

    def _all_closed(self, pointer: Pointer) -> DataFrame:
        closed = self.state.read(pointer, "closed", BOUNDS)
        return _completed(closed, self.state.read(pointer, "kills", KILLS)).withColumn("in_progress", F.lit(False))

    def all_fights(self, in_progress: bool = True) -> DataFrame:
        """Closed fights, late kills applied, and the open ones unless left out."""
        pointer = self.state.newest()
        closed = self._all_closed(pointer)
        if not in_progress:
            return closed
        live = self.state.read(pointer, "open", OPEN).drop("last_ord", "last_t").withColumn("in_progress", F.lit(True))
        return closed.unionByName(live)

    def fights(self, min_damage: int = 10_000, min_duration_seconds: int = 0, in_progress: bool = True) -> DataFrame:
        """The listed fights so far, like ``detect_fights``."""
        rows = D.admit(self.all_fights(in_progress), min_damage, min_duration_seconds)
        return D.number_fights(rows)

    def members(self) -> DataFrame:
        """The closed fights with encounter ids."""
        pointer = self.state.newest()
        tail = self.state.read(pointer, "tail_members", MEMBERS)
        return self.state.read(pointer, "members", MEMBERS).unionByName(tail)

    def _running(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Open fights, their damage by actor, and the heals since the first of them began."""
        pointer = self.state.newest()
        live = self.state.read(pointer, "open", OPEN)
        acts = V.apply_pet_owners(self.state.read(pointer, "open_actors", ACTORS), self.pet_owners)
        heals = V.apply_pet_owners(self.state.read(pointer, "open_heals", HEALS), self.pet_owners)
        return live, acts, heals

    def active_view(self) -> DataFrame:
        """Per log: the enemy being fought and the player's counters, after the last batch."""
        return player.active_view(*self._running())

    def active_top_damage(self, n: int = 8) -> DataFrame:
        """Per log: the largest damage dealers of the fight that ``active_view`` shows."""
        live, acts, heals = self._running()
        return player.active_top_damage(player.active_target(live, acts, heals), acts, n)

    def active_top_healing(self, n: int = 5) -> DataFrame:
        """Per log: the largest healers over the window of ``active_view``."""
        live, acts, heals = self._running()
        return player.active_top_healing(live, player.active_target(live, acts, heals), heals, n)


def replay(events: DataFrame, gap_seconds: int, min_damage: int, parts: int = 4, **how) -> FightStream:
    """A stream that has taken in a whole event table in ``parts`` batches by ``ord``.

    The parts arrive one after the other, each in as many files as its partitions, and the query is
    started again for each from its checkpoint.
    """
    spark = events.sparkSession
    folder = f"{staging_dir(spark)}/skirmish/replay-{uuid.uuid4().hex}"
    span = events.agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).first()
    sink = FightStream(spark, f"{folder}/tables", gap_seconds, min_damage=min_damage, **how)
    if span.lo is None:
        return sink
    step = (span.hi - span.lo) // parts + 1
    events = events.select(*TAKEN)
    for i in range(parts):
        part = events.where(
            (F.col("ord") >= span.lo + i * step) & (F.col("ord") < span.lo + (i + 1) * step)
        )
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        sink.start(stream, f"{folder}/checkpoint", available_now=True).awaitTermination()
    return sink
