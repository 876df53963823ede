"""Override files: read into tables and written back as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.schema import MANUAL_GROUPS, PET_OWNERS

VERSION = 1
FILE_SCHEMA = (
    "version INT, pet_owners MAP<STRING, STRING>, "
    "manual_encounters ARRAY<STRUCT<fight_keys: ARRAY<STRING>, name: STRING>>, _bad STRING"
)


def _log_of(path_col: str):
    """``<log name>.<anything>.json`` belongs to ``<log name>``."""
    name = F.regexp_extract(path_col, r"([^/]+)$", 1)
    return F.url_decode(F.regexp_replace(name, r"(\.[^.]+)?\.json$", ""))


def _found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, in order."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    statuses = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(str(s.getPath().toString()) for s in statuses or [])


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of complete saves, oldest first: only a finished write leaves its success marker."""
    return [x.rsplit("/", 1)[0] for x in _found(spark, f"{path.rstrip('/')}/v=*/_SUCCESS")]


def load_overrides(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(pet_owners, manual_groups)`` of the override files under ``path`` (one per log), or of the
    newest save where ``path`` is a folder written by ``save_overrides``.

    A missing folder, a broken file and a file that holds no object count as empty.
    """
    saved = _versions(spark, path) if not path.endswith(".json") else []
    if not saved and not _found(spark, path):
        return spark.createDataFrame([], PET_OWNERS), spark.createDataFrame([], MANUAL_GROUPS)
    if saved:
        reader, path, log_id = spark.read.schema("log_id STRING, " + FILE_SCHEMA), saved[-1], F.col("log_id")
    else:
        reader, log_id = spark.read.schema(FILE_SCHEMA).option("multiLine", True), _log_of("_metadata.file_path")
    files = (
        reader.option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .json(path)
        .withColumn("log_id", log_id)
        .where(F.col("_bad").isNull())
    )
    owners = files.select(
        "log_id", F.posexplode(F.map_entries("pet_owners")).alias("pos", "o")
    ).select("log_id", F.col("pos").cast("long").alias("pos"), F.col("o.key").alias("actor"), F.col("o.value").alias("owner"))
    groups = files.select("log_id", F.posexplode("manual_encounters").alias("group_no", "g"))
    groups = groups.select(
        "log_id",
        F.col("group_no").cast("long").alias("group_no"),
        F.nullif("g.name", F.lit("")).alias("name"),
        F.posexplode("g.fight_keys").alias("pos", "fight_key"),
    ).select("log_id", "group_no", "name", F.col("pos").cast("long").alias("pos"), "fight_key")
    return owners, groups


def override_documents(pet_owners: DataFrame, manual_groups: DataFrame) -> DataFrame:
    """One document per log. Overrides are typed in by a user, so a log's are few."""
    owners = pet_owners.groupBy("log_id").agg(
        F.map_from_entries(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "actor", "owner"))),
                        lambda x: F.struct(x["actor"], x["owner"]))
        ).alias("pet_owners")
    )
    keys = manual_groups.groupBy("log_id", "group_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "fight_key"))), lambda x: x["fight_key"]).alias("fight_keys"),
        F.first("name").alias("name"),
    )
    groups = keys.groupBy("log_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("group_no", "fight_keys", "name"))),
            lambda x: F.struct(x["fight_keys"].alias("fight_keys"), x["name"].alias("name")),
        ).alias("manual_encounters")
    )
    return owners.join(groups, "log_id", "full_outer").select(
        "log_id",
        F.lit(VERSION).alias("version"),
        F.coalesce("pet_owners", F.create_map().cast("map<string,string>")).alias("pet_owners"),
        F.coalesce(
            "manual_encounters", F.array().cast("array<struct<fight_keys:array<string>,name:string>>")
        ).alias("manual_encounters"),
    )


def save_overrides(pet_owners: DataFrame, manual_groups: DataFrame, path: str) -> None:
    """Write the documents as JSON lines with their ``log_id`` to a new version folder under ``path``.

    Readers take the newest version with a success marker, so a save that breaks off changes nothing.
    """
    spark = pet_owners.sparkSession
    taken = [int(x.rsplit("=", 1)[1]) for x in _found(spark, f"{path.rstrip('/')}/v=*")]
    folder = f"{path.rstrip('/')}/v={max(taken, default=0) + 1:08d}"
    override_documents(pet_owners, manual_groups).write.option("ignoreNullFields", False).json(folder)
