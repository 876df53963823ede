"""Parser coverage: line counts by event type and the shapes of lines no pattern knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions import scalars as S


def line_counts(parsed: DataFrame) -> DataFrame:
    """Per log: lines, lines without time stamp, unknown lines (``parsed`` keeps unstamped rows)."""
    return parsed.groupBy("log_id").agg(
        F.count("*").alias("total_lines"),
        F.count_if(F.col("event_type").isNull()).alias("no_timestamp"),
        F.count_if(F.col("event_type") == "unknown").alias("unknown_lines"),
    )


def type_counts(parsed: DataFrame) -> DataFrame:
    return (
        parsed.where(F.col("event_type").isNotNull())
        .groupBy("log_id", "event_type")
        .agg(F.count("*").alias("lines"))
    )


def unknown_shapes(events: DataFrame) -> DataFrame:
    """Per log and digit-free shape of the unknown lines: how often, and where first.

    A shape may be a long text, so rows are grouped by its SHA-256 digest.
    """
    return (
        events.where(F.col("event_type") == "unknown")
        .groupBy("log_id", F.unhex(F.sha2(S.body_shape("body").cast("binary"), 256)).alias("digest"))
        .agg(F.count("*").alias("lines"), F.min("ord").alias("first_ord"))
    )


def top_shapes(events: DataFrame, limit: int = 200) -> DataFrame:
    """The most frequent shapes of each log with their first line as the example.

    Counting carries digests and numbers only; shape and example of the listed rows are looked up
    afterwards.
    """
    order = Window.partitionBy("log_id").orderBy(F.col("lines").desc(), "first_ord")
    top = unknown_shapes(events).withColumn("place", F.row_number().over(order)).where(
        F.col("place") <= limit
    )
    lines = events.where(F.col("event_type") == "unknown").select(
        "log_id", F.col("ord").alias("first_ord"), F.col("body").alias("example")
    )
    listed = top.withColumn("place", F.col("place").cast("long")).drop("digest").join(lines, ["log_id", "first_ord"])
    return listed.withColumn("shape", S.body_shape("example"))


def shape_totals(shapes: DataFrame) -> DataFrame:
    return shapes.groupBy("log_id").agg(
        F.count("*").alias("unknown_total_groups"), F.sum("lines").alias("unknown_total_lines")
    )
