"""The state of listings over runs, and their cards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def merge_runs(held: DataFrame, fresh: DataFrame, key: str, today: Column) -> DataFrame:
    """The store after a run: fetched rows replace held ones and keep their first day; a closed one that returns is open.

    ``held`` has the columns of ``fresh`` besides ``first_seen, last_seen, closed_at``.
    """
    body = [c for c in fresh.columns if c != key]
    old = held.select(key, *[F.col(c).alias(f"__{c}") for c in held.columns if c != key], F.lit(True).alias("__held"))
    both = fresh.withColumn("__new", F.lit(True)).join(old, key, "full_outer")
    new = F.col("__new").isNotNull()
    return both.select(
        key,
        *[F.when(new, F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in body],
        F.coalesce("__first_seen", today).alias("first_seen"),
        F.when(new, F.greatest("__last_seen", today)).otherwise(F.col("__last_seen")).alias("last_seen"),
        F.when(~new, F.col("__closed_at")).alias("closed_at"),
    )


def close_missing(store: DataFrame, fetched: DataFrame, healthy: DataFrame, key: str, group: str, listed: Column, today: Column, stale_before: Column) -> DataFrame:
    """Closes open rows that a run did not bring.

    Where ``listed`` says that the source lists all it has, absence closes a row
    if its group is among the ``healthy``; else a row closes once it was last
    seen before ``stale_before``.
    """
    here = fetched.select(key).distinct().withColumn("__here", F.lit(True))
    well = healthy.select(group).distinct().withColumn("__well", F.lit(True))
    gone = F.col("__here").isNull() & F.col("closed_at").isNull()
    close = gone & F.when(listed, F.col("__well").isNotNull()).otherwise(F.coalesce(F.col("last_seen") < stale_before, F.lit(False)))
    out = store.join(here, key, "left").join(well, group, "left")
    return out.withColumn("closed_at", F.when(close, today).otherwise(F.col("closed_at"))).select(*store.columns)


def run_history(rows: DataFrame, delivered: DataFrame, group: str, key: str, run: str) -> DataFrame:
    """``group, key, first_run, last_run, runs, gaps``: when a key was listed, and how often it came back.

    A gap is a stretch of the group's delivered snapshots without the key between two with it.
    """
    runs = delivered.select(group, run).distinct().withColumn("d", F.row_number().over(Window.partitionBy(group).orderBy(run)))
    seen = rows.select(group, key, run).dropna().distinct().join(runs, [group, run])
    before = F.lag("d").over(Window.partitionBy(group, key).orderBy("d"))
    seen = seen.withColumn("gap", (F.col("d") - before > 1).cast("int"))
    return seen.groupBy(group, key).agg(F.min(run).alias("first_run"), F.max(run).alias("last_run"), F.count("*").alias("runs"), F.coalesce(F.sum("gap"), F.lit(0)).alias("gaps"))


def store_over_runs(rows: DataFrame, delivered: DataFrame, runs: DataFrame, group: str, key: str, run: str, day: str, listed: Column, stale_days: int) -> DataFrame:
    """``group, key, first_seen, last_seen, closed_at, reopened``: the store after all ``runs`` (``run, day``), as merging and closing run by run leave it.

    Rows count in runs that their group ``delivered`` (``group, run``).  Where
    ``listed`` says that the source lists all it has, a row closes at its
    group's next delivered run without it; else at the first run of any group
    more than ``stale_days`` after it was last seen.  A closed row that comes
    back is open again; ``reopened`` counts how often.
    """
    days = runs.select(run, day).dropna().groupBy(run).agg(F.max(day).alias("d"))
    later = days.select(F.col("d").alias("later"))
    # one row a run: a short table
    aged = days.join(F.broadcast(later), F.col("later") > F.date_add("d", stale_days), "left").groupBy(run, "d").agg(F.min("later").alias("aged"))
    well = delivered.select(group, run).dropna().distinct().join(F.broadcast(aged), run)
    well = well.withColumn("next", F.lead("d").over(Window.partitionBy(group).orderBy(run)))
    seen = rows.select(group, key, run).dropna().distinct().join(well, [group, run])
    seen = seen.withColumn("closes", F.when(listed, F.col("next")).otherwise(F.col("aged")))
    seen = seen.withColumn("again", F.lead("d").over(Window.partitionBy(group, key).orderBy(run)))
    return seen.groupBy(group, key).agg(
        F.min("d").alias("first_seen"), F.max("d").alias("last_seen"), F.max_by("closes", run).alias("closed_at"), F.count_if(F.coalesce(F.col("closes") < F.col("again"), F.lit(False))).alias("reopened")
    )


def cards(rows: DataFrame, key: str, ident: str, order: Sequence[Column], seen: Column, also: Column) -> DataFrame:
    """A card per key: the least ``ident`` in ``order`` is its face; first and last time, count, and the others' ``also`` in order.

    The face is an aggregate; only the distinct ``also`` values of a key are collected.
    """
    base = rows.select(F.col(key).alias("k"), F.struct(*order, F.col(ident)).alias("o"), F.col(ident).alias("i"), seen.alias("s"), also.alias("a"))
    face = base.groupBy("k").agg(F.min("o").alias("face"), F.min("s").alias("first_seen"), F.max("s").alias("last_seen"), F.count_distinct("i").alias("members"))
    others = base.select("k", "a").distinct().groupBy("k").agg(F.array_sort(F.collect_set("a")).alias("also_at"))
    return face.join(others, "k").select(F.col("k").alias(key), F.col(f"face.{ident}").alias(ident), "first_seen", "last_seen", "members", "also_at")


def histogram(rows: DataFrame, value: str, width: int) -> DataFrame:
    """``bucket, rows, share_of_peak`` of a number by buckets of ``width``; nulls are left out."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / width) * width).cast("long").alias("bucket")).agg(F.count("*").alias("rows"))
    # a row per bucket is left
    return counts.select("bucket", "rows", F.round(F.col("rows") / F.max("rows").over(Window.partitionBy()), 4).alias("share_of_peak"))


def upper_median(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """The element in the middle, the upper of two, of each group.

    Values are counted first, so it is the distinct values of a group that are ordered.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("median")).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by)
    upto = F.sum("__n").over(w.orderBy("median").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = counts.withColumn("__upto", upto).withColumn("rows", F.sum("__n").over(w).cast("long"))
    return counts.filter("__upto > floor(rows / 2) and __upto - __n <= floor(rows / 2)").select(*by, "median", "rows")
