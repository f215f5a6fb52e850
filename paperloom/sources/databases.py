"""Reference databases as small tables: retractions and miscitations. Each is a Parquet table in a folder that may be set."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import email
from .http import Client

#: Where the databases are kept: a folder that all executors can read.
FOLDER = "spark.paperloom.databases"
RETRACTIONS = "doi string, retractionwatch string, date date"
MISCITATIONS = "doi string, reftext string, warning string"


def _folder(spark: SparkSession) -> str | None:
    return spark.conf.get(FOLDER, None)


def _table(spark: SparkSession, name: str, schema: str) -> DataFrame:
    folder = _folder(spark)
    return spark.read.schema(schema).parquet(f"{folder}/{name}") if folder else spark.createDataFrame([], schema)


def retractions(spark: SparkSession) -> DataFrame:
    """(doi, retractionwatch) of the newest copy."""
    rows = _table(spark, "retractionwatch", RETRACTIONS)
    newest = rows.agg(F.max("date").alias("newest"))
    return rows.join(F.broadcast(newest), F.col("date") == F.col("newest")).select("doi", "retractionwatch")


def retraction_date(spark: SparkSession) -> date | None:
    return _table(spark, "retractionwatch", RETRACTIONS).agg(F.max("date")).first()[0]


def compact_retractions(raw: DataFrame) -> DataFrame:
    """(doi, retractionwatch) of the published list: one row for each paper, its distinct kinds of notices joined."""
    rows = raw.select(F.col("OriginalPaperDOI").alias("doi"), F.col("RetractionNature").alias("nature")).where("doi IS NOT NULL AND doi <> 'unavailable'")
    return rows.groupBy("doi").agg(F.array_join(F.array_sort(F.collect_set("nature")), ";").alias("retractionwatch"))


def latest(snapshots: DataFrame, key: str = "doi", date: str = "date") -> DataFrame:
    """One row for each key of dated snapshots together: that of the newest snapshot that has it; of several in one snapshot the least."""
    others = [c for c in snapshots.columns if c not in (key, date)]
    newest = F.min(F.struct((-F.unix_date(date)).alias("_age"), *others))
    return snapshots.where(F.col(key).isNotNull()).groupBy(key).agg(newest.alias("_x")).select(key, *(F.col(f"_x.{c}").alias(c) for c in others), F.date_from_unix_date(-F.col("_x._age")).alias(date))


def difference(old: DataFrame, new: DataFrame, key: str = "doi") -> DataFrame:
    """(key, change, before, after) of what is added, removed or changed from one snapshot to another; keys are unique in each. before, after: rows of the other columns."""
    others = [c for c in old.columns if c != key]
    side = lambda df, name: df.select(key, F.struct(*others).alias(name))
    rows = side(old, "before").join(side(new, "after"), key, "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return rows.withColumn("change", change).where("change IS NOT NULL").select(key, "change", "before", "after")


def retraction_changes(spark: SparkSession, since: date) -> DataFrame:
    """What the newest copy has otherwise than the one that was newest on a day; all is new if there was none."""
    rows = _table(spark, "retractionwatch", RETRACTIONS)
    before = rows.where(F.col("date") <= F.lit(since)).agg(F.max("date")).first()[0]
    old = rows.where(F.col("date") == F.lit(before)) if before else rows.limit(0)
    return difference(old.select("doi", "retractionwatch"), retractions(spark))


def update_retractions(spark: SparkSession, csv: str | None = None, client: Client | None = None) -> str:
    """Stores a newer copy, from a CSV file or else the service, and returns its path."""
    folder = _folder(spark)
    if not folder:
        raise ValueError(f"set {FOLDER} to a folder for the databases")
    if csv is None:
        got = (client or Client(timeout=300)).get(f"https://api.labs.crossref.org/data/retractionwatch?{email() or ''}")
        # Kept as it came, and read like a file: quoted fields have line ends.
        csv = f"{folder}/retractionwatch-download"
        spark.createDataFrame([(got.text(),)], "value string").write.mode("overwrite").text(csv)
    raw = spark.read.csv(csv, header=True, multiLine=True, escape='"')
    path = f"{folder}/retractionwatch"
    # A folder for each day: an update that is repeated takes its place, and readers of the newest copy read no other.
    compact_retractions(raw).withColumn("date", F.current_date()).write.partitionBy("date").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return path


def miscitations(spark: SparkSession) -> DataFrame:
    """(doi, reftext, warning)."""
    return _table(spark, "miscite", MISCITATIONS)
