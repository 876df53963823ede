"""A combat-log view of the ``events`` table, and the log lines such events would be written as.

The provided tables hold no combat log, so activity rows stand in for one: ten users make one log,
the first user of a log is its player, the second the player's pet, the third a pet under its own
name. The event type and fixed residues of the ids choose the kind of combat event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.functions import scalars as S
from skirmish.operators.parse import VERBS_1ST, VERBS_3RD

MOBS = ("a marsh rat", "A marsh rat", "Varn, Last Warden", "Grix Thule-Bane")
TYPED_DAMAGE = ("fire", "cold", "magic")


def _pick(values, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def combat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` projected to the event layout; only the needed columns are scanned.

    The narrow rows are dealt first: a table of few files or row groups would leave the costly expressions here, and the
    parser behind them, to as few tasks.
    """
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").repartition("event_id", "ts", "user_id")
    e = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    base = raw.select(
        e.alias("e"),
        F.col("user_id").alias("u"),
        k.alias("k"),
        F.col("event_type").alias("kind"),
        S.from_epoch(S.epoch("ts")).alias("ts"),
        F.round(F.col("value") * 100).cast("long").alias("amt"),
    )
    u, k, e, kind = F.col("u"), F.col("k"), F.col("e"), F.col("kind")
    log_no = F.floor(u / 10).cast("long")
    base = base.withColumn(
        "char_name",
        F.concat(F.lit("Hero"), F.translate(log_no.cast("string"), "0123456789", "abcdefghij")),
    )
    base = base.withColumn(
        "log_id", F.concat(F.lit("eqlog_"), F.col("char_name"), F.lit("_north.txt"))
    )
    seat = u % 10
    base = base.withColumn(
        "player",
        F.when(seat == 0, "You")
        .when(seat == 1, F.concat(F.col("char_name"), F.lit(S.PET_SUFFIX)))
        .when(seat == 2, "Ember Golem")
        .otherwise(F.concat(F.lit("User"), u.cast("string"))),
    )
    form = (
        F.when(kind == "click", "melee_hit")
        .when((kind == "view") & (k % 20 == 0), "resist")
        .when((kind == "view") & (k % 20 == 1), "zone")
        .when((kind == "view") & (k % 20 == 2), "unknown")
        .when(kind == "view", "melee_miss")
        .when(kind == "signup", "heal")
        .when(kind == "error", "death")
        .when(k % 10 < 5, "typed")
        .when(k % 10 < 7, "dot")
        .when(k % 10 == 7, "shield")
        .when(k % 10 == 8, "nonmelee")
        .when(e % 3 == 0, "bare")
        .when(e % 3 == 1, "falling")
        .otherwise("bleed")
    )
    base = base.withColumn("form", form).withColumn("mob", _pick(MOBS, k % 4))
    form, player, mob = F.col("form"), F.col("player"), F.col("mob")
    # One in four swings is the mob's; ticks and shields are always the players'.
    base = base.withColumn(
        "mob_acts", (e % 4 == 0) & form.isin("melee_hit", "melee_miss", "typed", "death")
    )
    mob_acts = F.col("mob_acts")
    struck_player = F.when(player == "You", F.when(form == "death", "You").otherwise("YOU")).otherwise(
        player
    )
    mob_actor = F.when(e % 89 == 0, F.concat(mob, F.lit(S.CORPSE_SUFFIXES[0]))).otherwise(mob)
    friend = F.concat(F.lit("User"), (log_no * 10 + 3 + e % 7).cast("string"))
    heal_form = _pick(("active", "passive", "proc"), k % 3)
    actor = (
        F.when(form.isin("zone", "unknown"), None)
        .when(form == "resist", "You")
        .when(form.isin("nonmelee", "bare"), S.UNATTRIBUTED)
        .when(form == "falling", S.FALLING)
        .when(form == "bleed", S.UNCONSCIOUS)
        .when(mob_acts, mob_actor)
        .otherwise(player)
    )
    heal_target = (
        F.when((heal_form == "proc") | (e % 5 == 0), player)
        .when((e % 5 == 1) & (heal_form == "active"), "you")
        .when(e % 5 == 1, "You")
        .otherwise(friend)
    )
    target = (
        F.when(form.isin("zone", "unknown"), None)
        .when(form.isin("bare", "falling", "bleed"), "You")
        .when(form == "heal", heal_target)
        .when(mob_acts, struck_player)
        .otherwise(mob)
    )
    melee = form.isin("melee_hit", "melee_miss")
    bare_verb = (form == "melee_miss") | (actor == "You")
    verb = F.when(
        melee, F.when(bare_verb, _pick(VERBS_1ST, k % 21)).otherwise(_pick(VERBS_3RD, k % 21))
    )
    spell = (
        F.when(form.isin("typed", "dot", "resist"), F.concat(F.lit("Spell "), (k % 12).cast("string")))
        .when(form == "shield", "thorns")
        .when(form == "bleed", "Pain and suffering")
        .when(
            (form == "heal") & ((heal_form == "proc") | (k % 4 != 0)),
            F.concat(F.lit("Mending "), (k % 5).cast("string")),
        )
    )
    damage_type = (
        F.when(form == "typed", _pick(TYPED_DAMAGE, k % 3))
        .when(form == "dot", "dot")
        .when(form.isin("shield", "nonmelee", "bare"), "non-melee")
        .when(form == "falling", "falling")
        .when(form == "bleed", "unconscious")
    )
    damage = form.isin("typed", "dot", "shield", "nonmelee", "bare", "falling", "bleed")
    first = F.when(e % 5 == 0, "Critical").when(e % 7 == 0, "Lucky Critical Headshot")
    second = F.when(e % 11 == 0, "Twincast").when(e % 13 == 0, "Crippling Blow Rampage")
    modifiers = F.when(
        melee | damage | (form == "heal"),
        F.when(form.isin("nonmelee", "bleed"), F.array().cast("array<string>")).otherwise(
            F.array_compact(F.array(first, second))
        ),
    )
    shown = base.select(
        "log_id",
        "char_name",
        e.alias("ord"),
        "ts",
        F.when(damage, "spell_damage").otherwise(form).alias("event_type"),
        actor.alias("actor"),
        target.alias("target"),
        F.when(damage | form.isin("melee_hit", "heal"), F.col("amt")).alias("amount"),
        verb.alias("verb"),
        spell.alias("spell"),
        damage_type.alias("damage_type"),
        F.when(form == "melee_miss", _pick(S.OUTCOMES, e % 7)).alias("outcome"),
        modifiers.alias("modifiers"),
        F.when(form == "death", target == "You").alias("you_died"),
        F.when(form == "zone", F.concat(F.lit("Zone "), k.cast("string"))).alias("zone"),
        F.when(
            form == "unknown", F.concat(F.lit("Note "), e.cast("string"), F.lit(" of "), k.cast("string"))
        ).alias("body"),
        "form",
        F.when(form == "heal", heal_form).alias("heal_form"),
        k.alias("k"),
    )
    return shown


EVENT_COLUMNS = (
    "log_id", "ord", "ts", "event_type", "actor", "target", "amount", "verb", "spell",
    "damage_type", "outcome", "modifiers", "you_died", "zone", "body",
)


def log_lines(events: DataFrame) -> DataFrame:
    """The text line each row of ``combat_events`` stands for."""
    form, actor, target = F.col("form"), F.col("actor"), F.col("target")
    amount, spell, verb = F.col("amount").cast("string"), F.col("spell"), F.col("verb")
    k = F.col("k")
    you = actor == "You"

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    tail = (
        F.when(F.col("outcome") == "miss", F.when(you, "miss!").otherwise("misses!"))
        .when(F.col("outcome") == "rune", text(target, "'s magical skin absorbs the blow!"))
        .when(F.col("outcome") == "invulnerable", text(target, " is INVULNERABLE!"))
        .when(F.col("outcome") == "parry", text(target, " parries!"))
        .when(F.col("outcome") == "block", text(target, " blocks with her shield!"))
        .otherwise(text(target, " ", F.col("outcome"), "s!"))
    )
    gross = F.when(k % 2 == 0, text(" (", (F.col("amount") + 50).cast("string"), ")")).otherwise("")
    by_spell = F.when(spell.isNotNull(), text(" by ", spell)).otherwise("")
    over_time = F.when(k % 5 == 0, "over time ").otherwise("")
    shown_self = (
        F.when(actor != target, target)
        .when(you, "yourself")
        .otherwise(_pick(("himself", "herself", "itself"), k % 3))
    )
    has = F.when(target == "You", " have").otherwise(" has")
    heal = (
        F.when(
            F.col("heal_form") == "active",
            text(actor, " healed ", shown_self, " ", over_time, "for ", amount, gross, " hit points", by_spell, "."),
        )
        .when(
            F.col("heal_form") == "passive",
            text(target, has, " been healed ", over_time, "by ", actor, " for ", amount, gross,
                 " hit points", by_spell, "."),
        )
        .otherwise(
            text(target, has, " been healed for ", amount, gross, " hit points", by_spell, ".")
        )
    )
    death = (
        F.when(target == "You", text("You have been slain by ", actor, "!"))
        .when(you, text("You have slain ", target, "!"))
        .when(k % 2 == 0, text(target, " has been slain by ", actor, "!"))
        .otherwise(text(target, " was slain by ", actor, "!"))
    )
    points = text(" for ", amount, " points of ")
    body = (
        F.when(form == "typed", text(actor, " hit ", target, points, F.col("damage_type"), " damage by ", spell, "."))
        .when(form == "dot", text(target, " has taken ", amount, " damage from ", spell, " by ", actor, "."))
        .when(
            form == "shield",
            text(target, " is pierced by ", F.when(you, "YOUR").otherwise(text(actor, "'s")), " ", spell, points,
                 "non-melee damage."),
        )
        .when(form == "nonmelee", text(target, " was chilled to the bone", points, "non-melee damage."))
        .when(form == "bare", text("You were hit by non-melee for ", amount, " damage."))
        .when(form == "falling", text("You take ", amount, " points of falling damage."))
        .when(form == "bleed", text("Pain and suffering strikes you for ", amount, " damage!"))
        .when(form == "melee_hit", text(actor, " ", verb, " ", target, points, "damage."))
        .when(
            form == "melee_miss",
            text(actor, F.when(you, " try to ").otherwise(" tries to "), verb, " ", target, ", but ", tail),
        )
        .when(form == "resist", text(target, " resisted your ", spell, "!"))
        .when(form == "heal", heal)
        .when(form == "death", death)
        .when(form == "zone", text("You have entered ", F.col("zone"), "."))
        .otherwise(F.col("body"))
    )
    marks = F.when(
        F.size("modifiers") > 0,
        F.concat(F.lit(" ("), F.concat_ws(") (", "modifiers"), F.lit(")")),
    ).otherwise("")
    raw = text(
        "[", F.date_format("ts", "EEE MMM dd HH:mm:ss yyyy"), "] ", body, marks, "\r"
    )
    return events.select("log_id", "ord", raw.alias("raw"))


def text_events(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Free text as events no pattern knows: one ``unknown`` event per row of a text table."""
    if table == "documents":
        src = spark.read.parquet(f"{sf_dir}/documents.parquet")
        log, order = F.col("source"), F.col("doc_id")
    else:
        src = spark.read.parquet(f"{sf_dir}/conversations.parquet")
        log, order = F.col("role"), F.col("conv_id") * 1000000 + F.col("turn")
    return src.select(
        log.alias("log_id"),
        order.cast("long").alias("ord"),
        F.lit("unknown").alias("event_type"),
        F.col("text").alias("body"),
    )


def pet_owner_table(events: DataFrame) -> DataFrame:
    """Override rows for every log: the pet with a name of its own belongs to the fifth user."""
    log_no = F.translate(
        F.regexp_extract("log_id", r"_Hero([a-j]+)_", 1), "abcdefghij", "0123456789"
    ).cast("long")
    return (
        events.select("log_id")
        .distinct()
        .select(
            "log_id",
            F.lit(0).cast("long").alias("pos"),
            F.lit("ember golem").alias("actor"),
            F.concat(F.lit("User"), (log_no * 10 + 4).cast("string")).alias("owner"),
        )
    )
