"""Keeping one row of many."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``; nulls are a key like any other.

    The choice is an aggregate, not a window: rows are combined before the
    shuffle, so a key that most rows have is no large group.  ``order`` must
    end in something unique for the result to be determined.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key in ``order``."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def upsert_absent(known: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``known`` and what ``found`` adds to it; what is known stays as it is."""
    return known.unionByName(found.join(known.select(*keys).distinct(), list(keys), "left_anti").select(*known.columns))


def spread(df: DataFrame, group: Column, order: Sequence[Column], per_group: int, salts: int = 64) -> DataFrame:
    """Adds ``place``: at most ``per_group`` of each group in order come first, then the rest in order.

    Rows are ranked within salts of a group, and what these put first among each
    other, so a group that holds most rows is no single task.  ``order`` must end
    in something unique.  Null groups are one group.
    """
    sort = [c.column.desc_nulls_last() if _down(c) else c.asc_nulls_last() for c in order]
    rows = df.withColumns({"__g": group, "__salt": F.pmod(F.xxhash64(*_plain(order)), F.lit(salts))})
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__g", "__salt").orderBy(*sort)))
    rows = rows.withColumn("__first", F.col("__n") <= per_group)
    # at most salts * per_group rows of a group are ranked together; the others each stand alone
    box = [F.col("__g"), F.col("__first"), F.when(~F.col("__first"), F.xxhash64(*_plain(order)))]
    rows = rows.withColumn("__late", (~F.col("__first") | (F.row_number().over(Window.partitionBy(*box).orderBy(*sort)) > per_group)).cast("int"))
    ranked = rows.drop("__g", "__salt", "__n", "__first")
    return number_rows(ranked, [F.col("__late"), *order], "place").drop("__late")


def number_rows(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Adds the place of each row in a total order, from 1, without bringing all rows into one task.

    Rows are sorted into ranges; the sizes of the ranges, one row for each
    partition, give every range its start.
    """
    from quern.session import written

    ranged = df.select("*", *[c.alias(f"__o{i}") for i, c in enumerate(_plain(order))])
    sort = [F.col(f"__o{i}").desc_nulls_last() if _down(c) else F.col(f"__o{i}").asc_nulls_last() for i, c in enumerate(order)]
    ranged = ranged.repartitionByRange(*sort).withColumn("__part", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    start = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("__part", start.alias("__start")))  # a row per partition
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*sort))
    out = ranged.join(starts, "__part").withColumn(name, (F.col("__start") + inside).cast("long"))
    return out.select(*[c for c in df.columns if c != name], name)


class desc:
    """Marks a column of an order as descending."""

    def __init__(self, column: Column):
        self.column = column


def _down(c: Column | desc) -> bool:
    return isinstance(c, desc)


def _plain(order: Sequence) -> list[Column]:
    return [c.column if isinstance(c, desc) else c for c in order]
