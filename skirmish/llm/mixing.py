"""Operator 9: mix sources to target weights by repeating documents.

Sizes are words. The sources, by code point with null last, weigh ``weights`` in turn and share
``share`` times all words. A target stops at ``ceiling`` times its source's size and the excess is
shared anew by weight: with the level L at which the targets min(weight * L, cap) add up, that is one
pass over the sources in the order of cap / weight. A document is emitted floor(rate) times, and once
more with the fraction as probability, decided by a hash of seed and doc_id, so reruns agree.

Only the table of sources is sorted and summed (one row per source); documents meet it by an
equi-join, which Spark broadcasts when the table is small. A null text has size 0 and is repeated
like any other; rows with the same doc_id share their draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.sources.staging import cut

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the first eight hex digits of md5(seed:doc_id)."""
    hexes = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8)
    return F.conv(hexes, 16, 10).cast("double") / F.lit(float(1 << 32))


def rates(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, target, rate."""
    if not share <= ceiling:
        raise ValueError("share is above what ceiling allows")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("nth", nth).withColumn("cap", F.col("source_size") * F.lit(ceiling))
    per = per.withColumn("weight", F.array(*map(F.lit, weights))[(F.col("nth") - 1) % len(weights)].cast("double"))
    per = per.withColumn("full", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    by_full = Window.orderBy("full", "nth")
    before = by_full.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    per = per.withColumn("step", F.row_number().over(by_full)).withColumn("level", level)
    found = F.min(F.when(F.col("level") <= F.col("full"), F.struct("step", "level"))).over(every)["level"]
    level = F.coalesce(found, F.max("full").over(every))
    target = F.least(F.col("weight") * level, F.col("cap"))
    per = per.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.select("source", "source_size", "target", rate.alias("rate"))


def _with_copies(rows: DataFrame, per: DataFrame, seed: str) -> DataFrame:
    """``rows`` with their source's columns and the number of copies."""
    per = per.select(F.col("source").alias("_source"), "source_size", "target", "rate")
    joined = rows.join(per, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.floor("rate")
    return joined.withColumn("copies", (whole + (draw(F.col("doc_id"), seed) < F.col("rate") - whole).cast("int")).cast("int"))


def plan_mix(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """(doc_id, size, source_size, target, copies) of every document."""
    sizes = cut(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "sizes")
    out = _with_copies(sizes, rates(sizes, **how), seed)
    return out.select("doc_id", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """The documents, each as often as the mix takes it; all columns stay, ``copy`` counts from 0 (in place of a column of that name)."""
    per = cut(rates(docs.select("source", size_of(F.col("text")).alias("size")), **how), "rates")
    named = docs.withColumnsRenamed({c: f"_doc_{c}" for c in docs.columns})
    keyed = named.withColumns({"source": F.col("_doc_source"), "doc_id": F.col("_doc_doc_id")})
    out = _with_copies(keyed, per, seed).where("copies > 0")
    own = [F.col(f"_doc_{c}").alias(c) for c in docs.columns if c != "copy"]
    return out.select(*own, F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    out = plan_mix(docs)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


_HEX = " + ".join(f"(strpos('0123456789abcdef', substr(h, {i + 1}, 1)) - 1) * {16 ** (7 - i)}.0" for i in range(8))
SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS h FROM documents),
per AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS nth FROM sized GROUP BY source),
weighed AS (SELECT *, source_size * 2.0::DOUBLE AS cap, CASE nth % 3 WHEN 1 THEN 5.0::DOUBLE WHEN 2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM per),
leveled AS (
  SELECT *, cap / weight AS full_at,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed),
found AS (SELECT level FROM leveled WHERE level <= full_at ORDER BY full_at, nth LIMIT 1),
targets AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, least(weight * (SELECT level FROM found), cap) AS target FROM leveled),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN ({_HEX}) / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source
"""
