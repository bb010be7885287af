"""Session factory and the few settings the operators rely on."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Observation, SparkSession, functions as F

#: Settings that change results or plan quality, never resources of a cluster.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "8", name: str = "quern", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benches."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    conf = ENGINE_CONF | {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("QUERN_DRIVER_MEMORY", "8g"),
        "spark.driver.host": "127.0.0.1",
    }
    return builder.config(map=conf).getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; one of our own only on a single machine where none is named.

    A cluster names it in ``spark.checkpoint.dir``.  Without that setting a
    folder of this machine will do if all of the session runs here; else an
    error is raised, as executors would each write to a disk of their own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if spark.sparkContext.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quern-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession) -> str:
    """This application's own part of the shared folder, which goes when the application ends."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/quern-{spark.sparkContext.applicationId}"
    fs, at = _hadoop(spark, folder)
    if not fs.exists(at):
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return folder


def cut(df):
    """Write ``df`` to the shared checkpoint folder and read it from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df, name: str):
    """Write ``df`` as a table in the shared folder and read that: lineage is cut and columns are pruned.

    The table lives until ``forget`` or the end of the application.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def counted(df, name: str):
    """``written`` and the number of its rows, which the write itself counts."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def forget(*tables) -> None:
    """Remove tables of ``written`` that nothing reads any more."""
    for t in tables:
        fs, at = _hadoop(t.sparkSession, t._quern_path)
        fs.delete(at, True)
