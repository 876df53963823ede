"""Scalar column functions, built-in expressions without lambdas, which would leave whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
DEFAULT_SPECIALS = (
    "Headshot",
    "Assassinate",
    "Slay Undead",
    "Decapitate",
    "Double Bow Shot",
    "Twincast",
    "Rampage",
)
CRIT_MARKS = ("Critical", "Crippling Blow")
OUTCOMES = ("miss", "riposte", "parry", "block", "dodge", "rune", "invulnerable")
MISS_MARKS = (
    ("magical skin", "rune"),
    ("INVULNERABLE", "invulnerable"),
    ("riposte", "riposte"),
    ("parr", "parry"),
    ("block", "block"),
    ("dodge", "dodge"),
)
UNATTRIBUTED = "(unattributed)"
FALLING = "(falling)"
UNCONSCIOUS = "(unconscious)"
SELF_PRONOUNS = ("yourself", "himself", "herself", "itself")
YOU_ALIASES = ("you", "yourself")
PET_SUFFIX = "`s pet"
CORPSE_SUFFIXES = ("`s corpse", "'s corpse")
LATE_DEATH_SLACK_SECONDS = 10
# --- end of fixed values ----------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def epoch(ts) -> Column:
    """Whole seconds of a naive timestamp; the session time zone is UTC."""
    return F.unix_seconds(_c(ts).cast("timestamp"))


def from_epoch(seconds) -> Column:
    return F.timestamp_seconds(_c(seconds)).cast("timestamp_ntz")


def stamp(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss")


def iso(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss")


def fold(name) -> Column:
    return F.lower(_c(name))


def line_modifiers(rest) -> Column:
    """All parenthesized groups of a line tail, each kept as one string."""
    return F.regexp_extract_all(_c(rest), F.lit(r"\(([^)]+)\)"), F.lit(1))


def miss_outcome(tail) -> Column:
    tail = _c(tail)
    chain = None
    for mark, label in MISS_MARKS:
        hit = tail.contains(mark)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain.otherwise("miss")


def _joined(modifiers) -> Column:
    """All modifiers of a line in one string, empty without any; no mark holds a line end."""
    return F.concat_ws("\n", _c(modifiers))


def is_crit(modifiers) -> Column:
    joined = _joined(modifiers)
    return F.contains(joined, F.lit(CRIT_MARKS[0])) | F.contains(joined, F.lit(CRIT_MARKS[1]))


def is_heal_crit(modifiers) -> Column:
    return F.contains(F.lower(_joined(modifiers)), F.lit("critical"))


def is_pair_crit(modifiers) -> Column:
    return F.rlike(_joined(modifiers), F.lit("(?i)critical|crippling"))


def specials(modifiers, names: Sequence[str] = DEFAULT_SPECIALS) -> Column:
    """Names from ``names`` (in that order) contained in any modifier."""
    joined = _joined(modifiers)
    return F.array_compact(F.array(*[F.when(F.contains(joined, F.lit(n)), F.lit(n)) for n in names]))


def hit_source(pet_origin="pet_origin", spell="spell", special_list="specials", verb="verb") -> Column:
    return F.coalesce(
        F.nullif(_c(pet_origin), F.lit("")),
        F.nullif(_c(spell), F.lit("")),
        F.get(_c(special_list), F.lit(0)),
        F.initcap(F.nullif(_c(verb), F.lit(""))),
        F.lit("Melee"),
    )


def heal_source(pet_origin="pet_origin", spell="spell") -> Column:
    return F.coalesce(
        F.nullif(_c(pet_origin), F.lit("")), F.nullif(_c(spell), F.lit("")), F.lit("Heal")
    )


def is_you(name) -> Column:
    return fold(name).isin(*YOU_ALIASES)


def is_pet(name) -> Column:
    return _c(name).endswith(PET_SUFFIX)


def is_your_pet(name, char_name) -> Column:
    return F.coalesce(
        fold(name) == F.concat(fold(char_name), F.lit(PET_SUFFIX)), F.lit(False)
    )


def is_corpse(name) -> Column:
    name = _c(name)
    return name.endswith(CORPSE_SUFFIXES[0]) | name.endswith(CORPSE_SUFFIXES[1])


def fight_key(target, start) -> Column:
    """Stable key of a fight; null when the fight has no start."""
    return F.concat(fold(target), F.lit("|"), iso(start))


def body_shape(body) -> Column:
    return F.regexp_replace(_c(body), r"\d+", "N")


def char_name(log_id) -> Column:
    return F.nullif(F.regexp_extract(_c(log_id), r"(?i)^eqlog_([A-Za-z]+)_", 1), F.lit(""))


def whole(x) -> Column:
    """Half-even rounding to a LONG."""
    return F.bround(_c(x).cast("double"), 0).cast("long")


def one_decimal(x) -> Column:
    return F.bround(_c(x).cast("double"), 1)


def raid_rate(amount, seconds) -> Column:
    """Amount per second, 0 for a fight without duration."""
    return F.when(_c(seconds) > 0, _c(amount) / _c(seconds)).otherwise(F.lit(0.0))


def actor_rate(amount, seconds) -> Column:
    """Amount per second where a missing duration counts as one second."""
    return _c(amount) / F.when(_c(seconds) == 0, 1).otherwise(_c(seconds))


def live_rate(amount, seconds) -> Column:
    """Amount per second with a floor of one second."""
    return _c(amount) / F.greatest(_c(seconds), F.lit(1))


def pct_of(part, total) -> Column:
    total = _c(total)
    return one_decimal(100.0 * _c(part) / F.when(total == 0, 1).otherwise(total))


def avoid_pct(avoided, hits) -> Column:
    swings = _c(hits) + _c(avoided)
    return F.when(
        swings > 0, F.floor(F.try_divide(_c(avoided), swings) * 1000 + 0.5) / 10
    ).otherwise(F.lit(0.0))


def pct_change(a, b) -> Column:
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return F.try_divide(b - a, a) * 100


def trend_class(delta, higher_is_better: bool) -> Column:
    delta = _c(delta)
    up, down = ("better", "worse") if higher_is_better else ("worse", "better")
    return F.when(delta == 0, "flat").when(delta > 0, up).otherwise(down)


def bucket_count(duration, width: int) -> Column:
    return F.greatest(F.lit(1), F.floor(_c(duration) / width) + 1).cast("long")


def bucket_index(offset, width: int, n_buckets) -> Column:
    """Bucket of an offset, clamped into [0, n)."""
    return F.greatest(
        F.lit(0), F.least(F.floor(_c(offset) / width), _c(n_buckets) - 1)
    ).cast("long")
