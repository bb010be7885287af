"""Reading the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.session import counted


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of ``<name>.parquet`` files or directories."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [table(spark, folder, n) for n in names]


#: At most so many repeated keys are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def table_once(spark: SparkSession, folder: str, name: str, key: str, *columns: str) -> DataFrame:
    """The columns of one row for each key of a table, the first as it is stored; rows with a null key stay as they are.

    Keys and the places of rows alone are aggregated, so the other columns never
    move, and are read once.
    """
    rows = table(spark, folder, name)
    place = F.struct("_metadata.file_path", "_metadata.row_index")
    again = rows.select(key, place.alias("at")).filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("at").alias("__first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again, n = counted(again, "repeated")
    rows = rows.select(key, *[c for c in columns if c != key], place.alias("__at"))
    if n:
        rows = rows.join(F.broadcast(again) if n <= BROADCAST_KEYS else again, key, "left").filter("__first is null or __at = __first")
    return rows.select(key, *[c for c in columns if c != key])


def spread_out(df: DataFrame) -> DataFrame:
    """Rows for work that is heavy for each: over all cores where the input came in fewer parts than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
