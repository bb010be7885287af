"""Small tables that people and earlier runs keep: aliases, ledgers, backups, sheets, batches and probes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.functions.text import employer_norm
from quern.operators.dedupe import last_wins
from quern.operators.people import COLUMNS, DONE, HEADINGS, person_key
from quern.sources.store import _exists, _modified, read_csv


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """``norm, alias`` of a CSV of names and the employers they stand for, both brought to keys; a missing file is empty."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "norm string, alias string")
    rows = read_csv(spark, path, "company string, employer string")
    return rows.select(employer_norm(F.col("company")).alias("norm"), employer_norm(F.col("employer")).alias("alias")).filter("norm <> '' and alias <> ''").distinct()


LEDGER = "key string, name string, company string, email string, sent string, note string"


def append_ledger(people: DataFrame, folder: str, sent: str) -> None:
    """Adds people to a ledger, under their keys and with the day on which they were written to."""
    key = person_key(F.col("email"), F.col("name"), F.col("company"))
    text = lambda c: F.col(c) if c in people.columns else F.lit(None).cast("string")
    people.select(key.alias("key"), "name", "company", "email", F.lit(sent).alias("sent"), text("note").alias("note")).write.mode("append").option("header", True).option("escape", '"').csv(folder)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The last entry of each key by its day; a missing ledger is empty."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], LEDGER)
    rows = read_csv(spark, folder, LEDGER).filter("key <> ''")
    return last_wins(rows, ["key"], [F.coalesce("sent", F.lit("")), F.xxhash64(*rows.columns)])


def read_backup(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``key`` of every person in the newest of several backups - one JSON object of lists of people -; none without a file."""
    there = [p for p in paths if _exists(spark, p)]
    if not there:
        return spark.createDataFrame([], "key string")
    newest = max(there, key=lambda p: (_modified(spark, p), p))
    whole = spark.read.text(newest, wholetext=True).select(F.from_json("value", "map<string, array<struct<name:string,company:string,email:string>>>").alias("m"))
    people = whole.select(F.explode(F.flatten(F.map_values(F.map_filter("m", lambda k, v: v.isNotNull())))).alias("p"))
    return people.select(person_key(F.col("p.email"), F.col("p.name"), F.col("p.company")).alias("key")).filter("key <> '|'").distinct()


def read_sheet(spark: SparkSession, path: str, within: int = 8) -> DataFrame:
    """The rows of a people's sheet in CSV by the columns its headings mean, with ``row`` as the sheet counts it, from 1 and blank rows too.

    The headings are the first of ``within`` rows that has two of the columns;
    an error without one.  Rows without a name and company go; ``skip`` says why
    a row that has been dealt with is passed over.
    """
    lines = spark.read.option("multiLine", True).option("escape", '"').option("keepEmptyRows", True).csv(path)
    known = {c.replace("_", ""): c for c in COLUMNS} | HEADINGS
    head = lines.limit(within).collect()
    meant = [[known.get(re.sub("[^a-z0-9]", "", (c or "").lower()), "") for c in row] for row in head]
    at = next((i for i, m in enumerate(meant) if len({c for c in m if c}) >= 2), None)
    if at is None:
        raise ValueError("no row of headings")
    # a sheet is one file written by people: its rows keep their order in one part
    rows = lines.coalesce(1).withColumn("row", (F.monotonically_increasing_id() + 1).cast("int")).filter(F.col("row") > at + 1)
    where = {c: lines.columns[i] for i, c in reversed(list(enumerate(meant[at]))) if c}
    out = rows.select("row", *[(F.trim(F.coalesce(F.col(where[c]), F.lit(""))) if c in where else F.lit("")).alias(c) for c in COLUMNS])
    out = out.filter((F.col("first_name") != "") | (F.col("last_name") != "") | (F.col("company") != ""))
    return out.withColumn("skip", F.when(F.lower("status").isin(*DONE), F.concat(F.lit("status is "), F.lower("status"))).otherwise(""))


def write_template(spark: SparkSession, path: str) -> None:
    """A sheet of headings alone."""
    spark.createDataFrame([tuple(COLUMNS)], ", ".join(f"c{i} string" for i in range(len(COLUMNS)))).coalesce(1).write.mode("overwrite").csv(path)


def batch_text(people: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``text``: a part of a batch to be written by hand for each person: a heading, a line for each field, and room for the draft."""
    lines = [F.concat(F.lit(f"- {f}: "), F.regexp_replace(F.coalesce(F.col(f).cast("string"), F.lit("")), r"\s+", " ")) for f in fields]
    return people.select(F.concat_ws("\n", F.concat(F.lit("## "), F.regexp_replace("name", r"\s+", " ")), *lines, F.lit(""), F.lit("### draft"), F.lit("")).alias("text"))


def read_batch(texts: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``name, fields..., draft`` of every part of ``text``; parts without a draft have an empty one."""
    parts = texts.select(F.explode(F.split("text", r"(?m)^## ")).alias("p")).filter(F.trim("p") != "")
    value = lambda f: F.trim(F.regexp_extract("p", rf"(?m)^- {re.escape(f)}:[ \t]*(.*)$", 1)).alias(f)
    return parts.select(F.trim(F.regexp_extract("p", r"^(.*)", 1)).alias("name"), *map(value, fields), F.trim(F.regexp_extract("p", r"(?s)\n### draft\s*\n(.*)$", 1)).alias("draft"))


PROBES = "company string, source string, slug string, verdict string, job_count int, reported_name string, probed_at string"


def split_probes(wanted: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ``wanted(company, source, slug)`` with what an earlier probe said, a miss too, and those to be probed."""
    known = held.select("source", "slug", "verdict", "job_count", "reported_name").dropDuplicates(["source", "slug"])
    return wanted.join(known, ["source", "slug"]), wanted.join(known, ["source", "slug"], "left_anti")


def named_probes(probes: DataFrame, least: int = 85) -> DataFrame:
    """Probes of boards whose reported name is another's as 'name-mismatch'; a board that reports none stays confirmed."""
    from quern.functions.udf import name_similarity

    like = name_similarity(employer_norm(F.col("reported_name")), employer_norm(F.col("company")))
    wrong = (F.col("verdict") == "confirmed") & (F.trim(F.coalesce("reported_name", F.lit(""))) != "") & (like < least)
    return probes.withColumn("verdict", F.when(wrong, "name-mismatch").otherwise(F.col("verdict")))


def first_confirmed(probes: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """``company, source, slug`` of each company's first confirmed board, by the order of sources and then of slugs (``slug_no``)."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    found = probes.filter("verdict = 'confirmed'").filter(place > 0)
    return found.groupBy("company").agg(F.min_by(F.struct("source", "slug"), F.struct(place, F.col("slug_no"))).alias("x")).select("company", "x.*")
