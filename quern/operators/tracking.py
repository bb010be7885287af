"""What people keep of their own beside the data: trackers, queues, follow-ups, and tables that several keys may join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def age_days(at: Column, now: Column) -> Column:
    """Whole days between an instant and ``now``, none below 0; null without an instant."""
    return F.when(at.isNotNull(), F.greatest(F.lit(0), F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400))).cast("long")


def pending(rows: DataFrame, status: str, updated: str, now: Column, waiting: Sequence[str], working: str, minutes: int) -> DataFrame:
    """The rows that wait, or are worked on for more than ``minutes`` without an update; ``stalled`` tells which."""
    late = (F.col(status) == working) & (F.unix_timestamp(now) - F.unix_timestamp(F.col(updated)) > 60 * minutes)
    return rows.withColumn("stalled", F.coalesce(late, F.lit(False))).filter(F.col(status).isin(*waiting) | F.col("stalled"))


def followups(rows: DataFrame, sent: str, answered: Column, days: int, today: Column) -> DataFrame:
    """Adds ``followup``, so many days after a row was sent, and ``due``, once that has come without an answer."""
    at = F.date_add(F.col(sent), days)
    return rows.withColumn("followup", at).withColumn("due", F.coalesce((at <= today) & ~answered, F.lit(False)))


def reply_rates(rows: DataFrame, pool: str, sent: Column, replied: Column, least: int = 3) -> DataFrame:
    """``pool, sent, replied, rate, best``: answers in percent of what was sent, halves up; best are those of the highest rate above 0 among pools with ``least`` sent."""
    out = rows.groupBy(F.col(pool).alias("pool")).agg(F.count_if(sent).alias("sent"), F.count_if(sent & replied).alias("replied"))
    out = out.withColumn("rate", F.when(F.col("sent") > 0, F.floor(F.col("replied") * 100 / F.col("sent") + 0.5)).otherwise(0).cast("long"))
    able = F.when((F.col("sent") >= least) & (F.col("rate") > 0), F.col("rate"))
    # a row per pool
    return out.withColumn("best", F.coalesce(able == F.max(able).over(Window.partitionBy()), F.lit(False)))


def hit_ratio(rows: DataFrame, group: Sequence[str], hit: Column, name: Column) -> DataFrame:
    """``group..., hits, total, reported``: rows that hit, of those of a group that has any, and the least of the names."""
    out = rows.groupBy(*group).agg(F.count_if(hit).alias("hits"), F.count("*").alias("total"), F.min(name).alias("reported"))
    return out.filter("hits > 0")


def targets(openings: DataFrame, company: str, score: str, title: str, least: int, top: int = 2, salts: int = 32) -> DataFrame:
    """``company, open_roles, best_score, titles``: openings of at least a score per company, with the titles of the best."""
    rows = openings.filter(F.col(score) >= least).select(F.col(company).alias("company"), F.col(score).alias("s"), F.col(title).alias("t"))
    totals = rows.groupBy("company").agg(F.count("*").alias("open_roles"), F.max("s").alias("best_score"))
    order = [F.desc("s"), F.col("t")]
    inside = Window.partitionBy("company", F.pmod(F.xxhash64("t"), F.lit(salts))).orderBy(*order)
    # ranked within salts first, so a company with most openings is no single task
    kept = rows.distinct().withColumn("n", F.row_number().over(inside)).filter(F.col("n") <= top)
    kept = kept.withColumn("n", F.row_number().over(Window.partitionBy("company").orderBy(*order))).filter(F.col("n") <= top)
    titles = kept.groupBy("company").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), "; ").alias("titles"))
    return totals.join(titles, "company")


def merge_backup(held: DataFrame, brought: DataFrame, key: str) -> DataFrame:
    """All rows of both; of a key that both have the held row stays.  Keys are unique on each side."""
    return held.unionByName(brought.join(held.select(key), key, "left_anti").select(*held.columns))


def patch(rows: DataFrame, changes: DataFrame, key: str, kept: Sequence[str]) -> DataFrame:
    """``rows`` with the columns that ``changes`` gives not null; rows in which all of ``kept`` are null or empty go."""
    body = [c for c in rows.columns if c != key]
    new = changes.select(key, *[(F.col(c) if c in changes.columns else F.lit(None)).alias(f"__{c}") for c in body])
    out = rows.join(new, key, "full_outer").select(key, *[F.coalesce(f"__{c}", c).alias(c) for c in body])
    some = F.lit(False)
    for c in kept:
        some = some | (F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    return out.filter(some)


def fallback_key(*keys: tuple[str, Column]) -> Column:
    """The first of the keys that isn't empty, marked with its name, so that keys of different sorts never meet."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.concat(F.lit(f"{n}:"), F.trim(c))) for n, c in keys])


def joined_by_any(left: DataFrame, right: DataFrame, ident: str, keys: Sequence[tuple[str, Column, Column]], value: str) -> DataFrame:
    """``left`` with ``value`` of ``right`` by the first of several keys that finds any; of several finds the least value.

    ``keys`` are ``(name, key of left, key of right)``.  Each is an equality
    join of its own, as a join on one or another of several keys would compare
    all rows with all.
    """
    found = None
    for i, (_, a, b) in enumerate(keys):
        one = right.select(b.alias("__k"), F.col(value).alias("__v")).filter("__k <> ''").groupBy("__k").agg(F.min("__v").alias("__v"))
        hits = left.select(ident, a.alias("__k")).filter("__k <> ''").join(one, "__k").select(ident, F.struct(F.lit(i).alias("i"), F.col("__v")).alias("__f"))
        found = hits if found is None else found.unionByName(hits)
    best = found.groupBy(ident).agg(F.min("__f").alias("__f"))
    return left.join(best, ident, "left").withColumn(value, F.col("__f.__v")).drop("__f")


def without(rows: DataFrame, *others: DataFrame, key: str) -> DataFrame:
    """The rows whose key none of the others has."""
    for o in others:
        rows = rows.join(o.select(key).distinct(), key, "left_anti")
    return rows


def newest_load(loads: DataFrame, key: Sequence[Column], order: Sequence[Column], name: str = "key") -> DataFrame:
    """One row of each key, the latest by ``order``; the key is the first that isn't empty of ``key``."""
    whole = loads.withColumn(name, F.coalesce(*[F.nullif(F.trim(k), F.lit("")) for k in key])).filter(F.col(name).isNotNull())
    return whole.groupBy(name).agg(F.max_by(F.struct(*loads.columns), F.struct(*order)).alias("__r")).select(name, *[F.col(f"__r.{c}").alias(c) for c in loads.columns if c != name])


def search_score(low: Column, words: Column) -> Column:
    """The share of the words of a query that a text has, in percent."""
    words = F.filter(F.split(F.lower(words), r"\s+"), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: F.contains(low, w)))
    return F.when(F.size(words) > 0, 100 * hits / F.size(words)).otherwise(0.0)
