"""Log files as DataFrames: scan, stream, time windows, character names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.functions import scalars as S

#: A scan task starts at a block offset; blocks of one file lie at least this far apart.
BLOCK_BITS = 20
#: Spark's row ids count the rows of a task in their lower 33 bits.
ROW_BITS = 33
#: Of a chunk's ``ord``: chunk number, block in MiB, row in its task.
CHUNK_ORD, BLOCK_ORD, CHUNK_ROW_ORD = 20, 17, 26


def _checked(value, bits: int, what: str):
    """``value``, or an error where it does not fit: a key that wraps would put lines out of order."""
    fits = value.between(0, (1 << bits) - 1)
    return F.when(fits, value).otherwise(F.raise_error(F.lit(f"{what} needs more than {bits} bits")).cast("long"))


def _as_lines(text: DataFrame) -> DataFrame:
    """Latin-1 text, and ``ord`` = (block offset in MiB, row in task), which rises through a file."""
    block = F.shiftright(F.col("_metadata.file_block_start"), BLOCK_BITS)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return text.select(
        F.col("_metadata.file_name").alias("log_id"),
        (F.shiftleft(block, ROW_BITS) + row).alias("ord"),
        F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("raw"),
    )


def _bytes(spark: SparkSession, key: str) -> int:
    value = spark._jsparkSession.sessionState().conf().getConfString(key)
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(value))


def read_lines(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """Every line of the logs, also a last one without line end; lines end at ``\\n`` only."""
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        if _bytes(spark, key) < (1 << BLOCK_BITS):
            raise ValueError(f"{key} must be at least 1 MiB to keep line order")
    reader = spark.read.option("lineSep", "\n")
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return _as_lines(reader.text(paths))


def stream_lines(
    spark: SparkSession, path: str, glob: str | None = None, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Lines of log chunks as they arrive in a directory, not yet ordered (see ``ordered_chunks``).

    The file source takes in whole new files, so a growing log has to be rotated into chunks named
    ``<log name>.<chunk number>``.
    """
    reader = spark.readStream.option("lineSep", "\n")
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(path).select(
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("raw"),
    )


def ordered_chunks(batch: DataFrame) -> DataFrame:
    """``lines`` of one micro-batch: ``ord`` is (chunk number, block offset in MiB, row in task).

    Room for 2**20 chunks per log of up to 128 GiB each, and 2**26 lines per task; anything larger is an error.
    """
    chunk = F.coalesce(F.regexp_extract("file_name", r"\.(\d+)$", 1).try_cast("long"), F.lit(0).cast("long"))
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    rows = batch.select("*", chunk.alias("_chunk"), F.shiftright("block_start", BLOCK_BITS).alias("_block"), row.alias("_row"))
    high = F.shiftleft(_checked(F.col("_chunk"), CHUNK_ORD, "a chunk number"), BLOCK_ORD + CHUNK_ROW_ORD)
    middle = F.shiftleft(_checked(F.col("_block"), BLOCK_ORD, "a block's place in its chunk"), CHUNK_ROW_ORD)
    return rows.select(
        F.regexp_replace("file_name", r"\.\d+$", "").alias("log_id"),
        (high + middle + _checked(F.col("_row"), CHUNK_ROW_ORD, "a row of a task")).alias("ord"),
        "raw",
    )


def last_stamp(events: DataFrame) -> DataFrame:
    """Per log: time stamp of the last stamped line, by position."""
    return events.groupBy("log_id").agg(
        F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("ord"))).alias("last_ts")
    )


def since_hours(events: DataFrame, hours: float) -> DataFrame:
    """Events of the last ``hours`` before each log's own end; 0 keeps the whole log."""
    if hours <= 0:
        return events
    cutoff = last_stamp(events).select(
        "log_id", (S.epoch("last_ts") - F.lit(int(hours * 3600))).alias("_cutoff")
    )
    return (
        events.join(cutoff, "log_id").where(S.epoch("ts") >= F.col("_cutoff")).drop("_cutoff")
    )


def with_character(df: DataFrame) -> DataFrame:
    return df.withColumn("char_name", S.char_name("log_id"))
