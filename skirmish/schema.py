"""Column layouts shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

#: Typed events; ``event_type`` tells which of the nullable columns are filled.
EVENTS = T.StructType(
    [
        T.StructField("log_id", T.StringType()),
        T.StructField("ord", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("actor", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("amount", T.LongType()),
        T.StructField("verb", T.StringType()),
        T.StructField("spell", T.StringType()),
        T.StructField("damage_type", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("modifiers", T.ArrayType(T.StringType())),
        T.StructField("you_died", T.BooleanType()),
        T.StructField("zone", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("raw", T.StringType()),
    ]
)

#: User overrides: pet actor -> owner.
PET_OWNERS = T.StructType(
    [
        T.StructField("log_id", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("actor", T.StringType()),
        T.StructField("owner", T.StringType()),
    ]
)

#: User overrides: one row per fight key of a manual encounter.
MANUAL_GROUPS = T.StructType(
    [
        T.StructField("log_id", T.StringType()),
        T.StructField("group_no", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("fight_key", T.StringType()),
    ]
)
