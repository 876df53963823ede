"""Line extraction: raw log lines -> typed events, as one projection of built-in expressions.

Every pattern is tried at most once per line: a match rewrites the body into fixed slots
(``regexp_replace`` with a template), so one regex run yields all fields. A literal that each
pattern needs is tested first, and ``coalesce`` stops at the first match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.functions import scalars as S

#: Slot separator; a code point that Latin-1 text cannot contain.
SEP = "\ue000"
#: Unicode classes and "." stopping at "\n" only.
FLAGS = "(?Ud)"

# --- fixed values: log line formats -----------------------------------------
#: White space of Latin-1, cut off at the end of a line.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
ENVELOPE = (
    r"^\[(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) ([A-Z][a-z]{2}) +([0-9]{1,2}) "
    r"([0-9]{2}):([0-9]{2}):([0-9]{2}) ([0-9]{4})\] (.*)$"
)
VERBS_3RD = (
    "slashes", "crushes", "punches", "pierces", "claws", "kicks", "bites", "hits", "gores",
    "strikes", "mauls", "smashes", "stings", "backstabs", "frenzies on", "maims", "slices",
    "bashes", "shoots", "rends", "stabs",
)
VERBS_1ST = (
    "slash", "crush", "punch", "pierce", "claw", "kick", "bite", "hit", "gore", "strike", "maul",
    "smash", "sting", "backstab", "frenzy on", "maim", "slice", "bash", "shoot", "rend", "stab",
)
# Names: words joined by single separators, written so that no separator can match in two ways.
_WORDS = r"[\w'`-]*(?:(?: |, )[\w'`-]+)*"
NAME = "[A-Z]" + _WORDS
BODY_NAME = "[A-Za-z]" + _WORDS
V3 = "(" + "|".join(VERBS_3RD) + ")"
V1 = "(" + "|".join(VERBS_1ST) + ")"
MISS_TAIL = (
    r"(miss(?:es)?!|fails?!"
    r"|[^!]+? ripostes?!"
    r"|[^!]+? (?:dodges?|parr(?:y|ies)|blocks?(?: with [^!]+)?)!"
    r"|[^!]+? magical skin absorbs the blow!"
    r"|[^!]+? (?:is|are) INVULNERABLE!)"
)

SLOTS = ("form", "actor", "target", "amount", "verb", "spell", "damage_type", "tail", "rest")

#: (literal the body must contain, pattern, slot template), in matching order.
PATTERNS = (
    # spell damage
    (" damage by ",
     rf"^(You|{BODY_NAME}) hit ((?!by )[^.]+?) for (\d+) points? of ([\w-]+) damage by ([^.]+?)\.(.*)$",
     dict(form="spell_damage", actor="$1", target="$2", amount="$3", damage_type="$4", spell="$5", rest="$6")),
    # damage over time tick
    (" damage from ",
     rf"^(You|{BODY_NAME}) (?:has|have) taken (\d+) damage from (.+?) by (You|{NAME})\.(.*)$",
     dict(form="spell_damage", target="$1", amount="$2", spell="$3", actor="$4", damage_type="dot", rest="$5")),
    # damage shield; the owner is empty for YOUR
    (" of non-melee damage.",
     rf"^(.+?) is [\w ]+? by (?:({NAME})'s|YOUR) ([\w ]+?) for (\d+) points? of non-melee damage\.(.*)$",
     dict(form="shield", target="$1", actor="$2", spell="$3", amount="$4", damage_type="non-melee", rest="$5")),
    # non-melee damage without a source; its tail carries no modifiers
    (" of non-melee damage.",
     r"^(.+?) was ([\w \-]+?) for (\d+) points? of non-melee damage\.(.*)$",
     dict(form="spell_damage", target="$1", amount="$3", actor=S.UNATTRIBUTED, damage_type="non-melee")),
    ("You were hit by non-melee for ",
     r"^You were hit by non-melee for (\d+) damage\.(.*)$",
     dict(form="spell_damage", target="You", amount="$1", actor=S.UNATTRIBUTED, damage_type="non-melee", rest="$2")),
    (" of falling damage.",
     r"^You take (\d+) points? of falling damage\.(.*)$",
     dict(form="spell_damage", target="You", amount="$1", actor=S.FALLING, damage_type="falling", rest="$2")),
    ("Pain and suffering strikes you for ",
     r"^Pain and suffering strikes you for (\d+) damage!$",
     dict(form="spell_damage", target="You", amount="$1", actor=S.UNCONSCIOUS, damage_type="unconscious",
          spell="Pain and suffering")),
    # melee hits, first and third person
    (" of damage.",
     rf"^(You)[ ]+{V1}[ ]+(.+?)[ ]+for (\d+) points? of damage\.(.*)$",
     dict(form="melee_hit", actor="$1", verb="$2", target="$3", amount="$4", rest="$5")),
    (" of damage.",
     rf"^({BODY_NAME})[ ]+{V3}[ ]+(.+?)[ ]+for (\d+) points? of damage\.(.*)$",
     dict(form="melee_hit", actor="$1", verb="$2", target="$3", amount="$4", rest="$5")),
    # misses, first and third person
    (", but ",
     rf"^(You)[ ]+try to[ ]+{V1}[ ]+(.+?), but {MISS_TAIL}(.*)$",
     dict(form="melee_miss", actor="$1", verb="$2", target="$3", tail="$4", rest="$5")),
    (", but ",
     rf"^({BODY_NAME})[ ]+tries to[ ]+{V1}[ ]+(.+?), but {MISS_TAIL}(.*)$",
     dict(form="melee_miss", actor="$1", verb="$2", target="$3", tail="$4", rest="$5")),
    (" resisted your ",
     rf"^({BODY_NAME}) resisted your (.+?)!$",
     dict(form="resist", actor="You", target="$1", spell="$2")),
    # heals: passive with healer, active, passive without healer
    (" been healed ",
     rf"^(You|{BODY_NAME}) (?:has been|have been) healed (?:over time )?by (You|{NAME}) "
     r"for (\d+)(?:\s+\(\d+\))? hit points?(?: by ([^.]+?))?\.(.*)$",
     dict(form="heal", target="$1", actor="$2", amount="$3", spell="$4", rest="$5")),
    ("healed ",
     rf"^(You|{BODY_NAME}) (?:has |have )?healed (.+?) (?:over time )?"
     r"for (\d+)(?:\s+\(\d+\))? hit points?(?: by ([^.]+?))?\.(.*)$",
     dict(form="heal_active", actor="$1", target="$2", amount="$3", spell="$4", rest="$5")),
    (" been healed ",
     rf"^(You|{BODY_NAME}) (?:has been|have been) healed (?:over time )?"
     r"for (\d+)(?:\s+\(\d+\))? hit points? by ([^.]+?)\.(.*)$",
     dict(form="heal", actor="$1", target="$1", amount="$2", spell="$3", rest="$4")),
    # deaths
    ("You have been slain by ",
     r"^You have been slain by (.+?)!$",
     dict(form="you_died", actor="$1", target="You")),
    ("You have slain ",
     r"^You have slain (.+?)!$",
     dict(form="death", actor="You", target="$1")),
    (" slain by ",
     r"^(.+?) (?:has been slain|was slain) by (.+?)!$",
     dict(form="death", actor="$2", target="$1")),
    # zone change
    ("You have entered ",
     r"^You have entered (?!an area )(.+?)\.$",
     dict(form="zone", target="$1")),
)
# --- end of fixed values ----------------------------------------------------


def _template(slots: dict[str, str]) -> str:
    return SEP + SEP.join(slots.get(name, "") for name in SLOTS)


def _rewritten(text: Column, pattern: str, template: str) -> Column:
    """``text`` rewritten by the template, null when the pattern does not match."""
    once = F.regexp_replace(text, F.lit(FLAGS + pattern), F.lit(template))
    return F.get(F.filter(F.array(once), lambda x: F.startswith(x, F.lit(SEP))), F.lit(0))


def stamped(lines: DataFrame, keep_unstamped: bool = False) -> DataFrame:
    """Split lines into ``ts`` and ``body``.

    A line without a valid time stamp is left out, or kept with both null. The generator drops the
    unmatched lines itself, so no filter repeats the envelope regex below the projection.
    """
    raw = F.rtrim("raw", F.lit(BLANKS))
    slots = "".join(f"{SEP}${i}" for i in range(1, 8))
    parts = F.split(F.regexp_replace(raw, F.lit(FLAGS + ENVELOPE), F.lit(slots)), SEP)
    found = F.filter(F.array(parts), lambda p: F.size(p) == 8)
    generate = F.explode_outer if keep_unstamped else F.explode
    out = lines.select("log_id", "ord", raw.alias("raw"), generate(found).alias("_p"))

    def part(i: int) -> Column:
        return F.get("_p", F.lit(i))

    month = F.instr(F.lit(MONTHS), part(1))
    ts = F.try_make_timestamp_ntz(
        part(6).cast("int"),
        F.floor((month + 2) / 3).cast("int"),
        part(2).cast("int"),
        part(3).cast("int"),
        part(4).cast("int"),
        part(5).cast("decimal(16,6)"),
    )
    out = out.select("log_id", "ord", "raw", ts.alias("ts"), part(7).alias("body"))
    if keep_unstamped:
        return out.withColumn("body", F.when(F.col("ts").isNotNull(), F.col("body")))
    return out.where(F.col("ts").isNotNull())


def parse_lines(lines: DataFrame, keep_unstamped: bool = False) -> DataFrame:
    """Typed events of ``lines(log_id, ord, raw)``; lines without a time stamp give no event.

    ``keep_unstamped`` keeps those lines with a null ``event_type`` (for coverage counts).
    """
    body = F.col("body")
    matched = F.coalesce(
        *[
            F.when(body.contains(literal), _rewritten(body, pattern, _template(slots)))
            for literal, pattern, slots in PATTERNS
        ]
    )
    src = stamped(lines, keep_unstamped)
    src = src.withColumn("_m", F.split(matched, SEP))
    slot = {
        name: F.nullif(F.get("_m", F.lit(i + 1)), F.lit("")) for i, name in enumerate(SLOTS)
    }
    form = F.when(F.col("ts").isNotNull(), F.coalesce(slot["form"], F.lit("unknown")))
    actor = F.when(form == "shield", F.coalesce(slot["actor"], F.lit("You"))).otherwise(
        slot["actor"]
    )
    event_type = (
        F.when(form == "shield", "spell_damage")
        .when(form == "heal_active", "heal")
        .when(form == "you_died", "death")
        .otherwise(form)
    )
    target = (
        F.when(form == "zone", F.lit(None).cast("string"))
        .when(
            (form == "heal_active") & F.lower(slot["target"]).isin(*S.SELF_PRONOUNS),
            slot["actor"],
        )
        .otherwise(slot["target"])
    )
    takes_modifiers = event_type.isin("melee_hit", "melee_miss", "spell_damage", "heal")
    return src.select(
        "log_id",
        "ord",
        "ts",
        event_type.alias("event_type"),
        actor.alias("actor"),
        target.alias("target"),
        slot["amount"].try_cast("long").alias("amount"),
        slot["verb"].alias("verb"),
        slot["spell"].alias("spell"),
        slot["damage_type"].alias("damage_type"),
        F.when(form == "melee_miss", S.miss_outcome(slot["tail"])).alias("outcome"),
        F.when(takes_modifiers, S.line_modifiers(F.coalesce(slot["rest"], F.lit("")))).alias(
            "modifiers"
        ),
        F.when(event_type == "death", form == "you_died").alias("you_died"),
        F.when(form == "zone", slot["target"]).alias("zone"),
        F.when(form == "unknown", body).alias("body"),
        "raw",
    )
