"""Places of texts that share a doc_id, so that an operator that goes by (doc_id, place) keeps them apart.

The different texts under one doc_id lie behind each other in the order of their hashes, each ``base`` units (words, lines)
after the start of the first one, with one unit between them. Rows with one doc_id and equal texts have one place. All
other texts have base 0. A place beyond 2**31 is an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.functions.sliced import running
from skirmish.sources.staging import cut


def bases(docs: DataFrame, units: Callable[[Column], Column]) -> DataFrame | None:
    """(id, hash, base) of the texts of every doc_id that has several; None if there is no such doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text")).where("id IS NOT NULL")
    rows = rows.withColumn("hash", F.xxhash64("text"))
    span = rows.groupBy("id").agg(F.min("hash").alias("low"), F.max("hash").alias("high"))
    several = cut(span.where("low <> high").select("id"), "shared_ids")
    if several.isEmpty():
        return None
    sizes = rows.join(several, "id", "left_semi").select("id", "hash", F.coalesce(units(F.col("text")), F.lit(0)).cast("long").alias("size")).distinct()
    found = running(sizes, ["id"], F.shiftright("hash", 44), ["hash"], total={"base": F.col("size") + 1})
    fits = F.col("base") + F.col("size") < (1 << 31) - 1
    checked = F.when(fits, F.col("base")).otherwise(F.raise_error(F.lit("the texts of one doc_id have over 2**31 words or lines")).cast("long"))
    return cut(found.select("id", "hash", checked.cast("int").alias("base")), "bases")


def with_base(rows: DataFrame, found: DataFrame | None, doc_id: str, text: str, name: str = "base") -> DataFrame:
    """``rows`` with the base of each text as a last column."""
    if found is None:
        return rows.withColumn(name, F.lit(0))
    side = found.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), F.col("base").alias("_found"))
    met = rows.join(side, (F.col(doc_id).cast("long") == F.col("_id")) & (F.xxhash64(text) == F.col("_hash")), "left")
    return met.withColumn(name, F.coalesce("_found", F.lit(0))).drop("_id", "_hash", "_found")


def words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))


def lines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
