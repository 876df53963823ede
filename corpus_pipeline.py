"""Documents to a training mix: stages in order, each written as Parquet and read again by the next.

Every stage keeps the columns of ``documents`` (the last adds ``copy``) and works on all rows that the stage
before it kept. ``run`` applies them to ``documents``. The stages that learn read ``labels``, the
decontamination reads ``benchmark``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.llm import decontam, jaccard, lines, mixing, toxicity
from skirmish.sources.staging import owned, staging_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model is learnt from the labelled documents; those that it rejects go."""
    model = toxicity.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return toxicity.reject(docs.select(*COLUMNS), model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redundant lines go; documents stay, with the length of what is left."""
    out = lines.dedup(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast("long"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    return jaccard.dedup(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminate(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for."""
    return mixing.mix(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", dedup_documents),
    ("decontamination", drop_contaminated),
    ("mix_sources", mix_sources),
]

#: The toxicity model is not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the stages before it are written to the shared checkpoint folder."""
    docs = _table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{staging_dir(spark)}/skirmish/pipeline-{uuid.uuid4().hex}/{i}-{name}"
        with owned(spark):  # a stage's own intermediate tables go once its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
