"""The store of records as lines of JSON, and tables as CSV."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.operators.dedupe import last_wins


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_store(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """The records of a store; a missing one is empty, a line that is no record fails, the last line of a key holds.

    Lines are ordered by file name and then by their place in it.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    placed = lines.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__line"))
    columns = lines.columns
    return last_wins(placed, [key], [F.col("__file"), F.col("__block"), F.col("__line")]).select(*columns)


def write_store(df: DataFrame, path: str, key: str = "id") -> None:
    """Writes records sorted by key with their fields sorted, beside the old store, which steps aside before the new one takes its name and goes after that."""
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.select(*sorted(df.columns)).orderBy(key).write.option("ignoreNullFields", "false").json(staged)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    new, old = jvm.Path(staged), jvm.Path(path)
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = jvm.Path(f"{staged}.old")
    held = fs.exists(old)
    if held and not fs.rename(old, aside):
        raise OSError(f"{path} could not be put aside")
    if not fs.rename(new, old):
        if held:
            fs.rename(aside, old)
        raise OSError(f"{staged} could not be renamed to {path}")
    fs.delete(aside, True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table by the names in its header; quotes double inside quotes and may hold line ends.

    Columns that the file lacks come out null; others are left aside.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    empty = spark.createDataFrame([], schema)
    have = {c.strip().lower(): c for c in raw.columns}
    return raw.select(*[(F.col(f"`{have[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in empty.schema])


def write_csv(df: DataFrame, path: str, compressed: bool = True, all_quoted: bool = False) -> None:
    out = df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", all_quoted)
    (out.option("compression", "gzip") if compressed else out).csv(path)


def write_top(df: DataFrame, path: str, by: str, key: str, most: int = 100_000) -> None:
    """A compressed CSV of the rows with most of a number, ties by key: a heap per task, never a full sort."""
    write_csv(df.orderBy(F.desc(by), key).limit(most), path)


def publish(cards: DataFrame, folder: str, status: str = "status", source: str = "source", slim: tuple[str, ...] = ()) -> None:
    """Three tables of JSON lines: ``open``, ``filtered`` - the rest, without the ``slim`` columns - and ``meta``, a row of counts with the sources in order."""
    is_open = F.coalesce(F.col(status) == "open", F.lit(False))
    cards.filter(is_open).write.mode("overwrite").json(f"{folder}/open")
    cards.filter(~is_open).drop(*slim).write.mode("overwrite").json(f"{folder}/filtered")
    counts = [F.count("*").alias("total"), *[F.count_if(F.col(status) == s).alias(s) for s in ("open", "dropped", "closed")]]
    cards.agg(*counts, F.array_sort(F.collect_set(source)).alias("sources")).write.mode("overwrite").json(f"{folder}/meta")  # there are few sources


def read_contacts(spark: SparkSession, paths: list[str], schema: str, ident: str, person: str, org: str) -> DataFrame:
    """Contacts of several CSV files, the row of the newest file first; a missing id is ``person|org``, rows without a person go, and files that can't be read are left out."""
    rows = None
    for path in paths:
        try:
            one = read_csv(spark, path, schema).withColumn("__at", F.coalesce(F.lit(_modified(spark, path)), F.lit(0)))
        except Exception:  # an unreadable file is no reason to lose the others
            continue
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.trim(person) != "").withColumn(ident, F.coalesce(F.nullif(F.trim(ident), F.lit("")), F.concat(F.trim(person), F.lit("|"), F.trim(F.coalesce(F.col(org), F.lit(""))))))
    columns = [c for c in rows.columns if c != "__at"]
    return last_wins(rows, [ident], [F.col("__at"), F.xxhash64(*columns)]).select(*columns)


def _modified(spark: SparkSession, path: str) -> int:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).getModificationTime()
