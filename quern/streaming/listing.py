"""The listing store and ledgers as streams.

The store is a folder of versions; a batch reads the last version that an
earlier batch completed, merges into it, and writes the version of its own
number, so a batch that runs again after a loss does the same work again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.dedupe import first_wins, last_wins
from quern.operators.listing import merge_runs


def _versions(spark: SparkSession, folder: str, mark: str = "v=") -> list[int]:
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = jvm.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith(mark)]
    return sorted(int(p.getName()[len(mark) :]) for p in done if fs.exists(jvm.Path(p, "_SUCCESS")))


def read_versioned(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The latest complete version, or the latest before ``before``; None without one."""
    found = [v for v in _versions(spark, folder) if before is None or v < before]
    return spark.read.parquet(f"{folder}/v={found[-1]}") if found else None


def stream_store(rows: DataFrame, folder: str, checkpoint: str, key: str, at: str, day: str) -> StreamingQuery:
    """Keeps a store of the latest row of each ``key``, with its first and last ``day``.

    Rows of a batch are ordered by ``at``.  Runs until the input that is there
    has been taken.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = last_wins(batch.filter(F.col(key).isNotNull()), [key], [F.col(at), F.xxhash64(*batch.columns)])
        span = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(day).alias("__first"), F.max(day).alias("__last"))
        held = read_versioned(spark, folder, number)
        if held is None:
            held = latest.limit(0).select("*", F.col(day).alias("first_seen"), F.col(day).alias("last_seen"), F.col(day).alias("closed_at"))
        merged = merge_runs(held, latest, key, F.col(day)).join(span, key, "left")
        merged = merged.withColumn("first_seen", F.least("first_seen", "__first")).withColumn("last_seen", F.greatest("last_seen", "__last")).drop("__first", "__last")
        merged.write.mode("overwrite").parquet(f"{folder}/v={number}")
        # the one before serves a batch that runs again; older ones serve nobody
        for v in _versions(spark, folder)[:-2]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/v={v}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    return rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_ledger(rows: DataFrame, folder: str, checkpoint: str, keys: list[str], at: str) -> StreamingQuery:
    """Appends the first row of each key that the ledger doesn't have, however long ago it came.

    The ledger itself is the state: a batch is joined with the keys that earlier
    batches wrote, so nothing is forgotten and nothing kept in memory.  A batch that runs
    again after a loss replaces its own part.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = first_wins(batch, keys, [F.col(at), F.xxhash64(*batch.columns)])
        earlier = [f"{folder}/batch={v}" for v in _versions(spark, folder, "batch=") if v < number]
        if earlier:
            known = spark.read.schema(batch.schema).parquet(*earlier).select(*keys).distinct()
            fresh = fresh.join(known, keys, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
