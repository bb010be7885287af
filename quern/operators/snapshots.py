"""What changed between full snapshots.

A dictionary gives every key an ordinal inside its shard of the key space; it
only grows, so a key keeps its ordinal when later runs, or late rows, come.  A
snapshot is a bitmap over ordinals: 64-bit words, of which only those with a
bit are stored, and beside a word the vectors of its keys, packed in the order of
their bits, with a fingerprint of every compared column.  AND-NOT of a word with
the one before gives additions and removals; for the keys common to both, the
place of a bit among those set leads to its vectors, which show what changed.  A
shard mixes the keys of all partitions of the data, so a partition that holds a
third of all rows is spread over every shard.  Keys' texts stay with the
dictionary until the changed ordinals are known.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quern.session import written

WORD = 64


#: Blanks beyond the one space between words.
_BLANKS = "[\\s  -​ 　]{2,}|[\\t\\n\\x0B\\f\\r  -​ 　]"


def text_key(*texts: Column) -> Column:
    """Texts as compared: case, amount of blank space and null against blank aside.

    Several texts give one key, with a separator that has a blank on both sides,
    so that one pass over the whole does.
    """
    joined = texts[0] if len(texts) == 1 else F.concat_ws(" \u0001 ", *[F.coalesce(x, F.lit("")) for x in texts])
    return F.trim(F.regexp_replace(F.lower(F.coalesce(joined, F.lit(""))), _BLANKS, " "))


def instant_key(text: Column) -> Column:
    """The instant an ISO text names, in microseconds; other text as compared."""
    clean = F.upper(F.trim(text))
    at = F.when((F.substring(clean, 5, 1) == "-") & (F.length(clean) >= 10), F.unix_micros(clean.try_cast("timestamp")))
    return F.coalesce(at.cast("string"), text_key(text))


def _held(spark: SparkSession, store: str | None) -> tuple[int, list[DataFrame] | None]:
    """The number of complete versions of a store, and the last one's dictionary, vectors and groups."""
    if store is None:
        return 0, None
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = jvm.Path(store).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    n = 0
    while fs.exists(jvm.Path(f"{store}/groups/v={n + 1}/_SUCCESS")):
        n += 1
    if not n:
        return 0, None
    return n, [spark.read.parquet(*[f"{store}/dictionary/v={i}" for i in range(1, n + 1)]), spark.read.parquet(f"{store}/last/v={n}"), spark.read.parquet(f"{store}/groups/v={n}")]


def snapshot_changes(
    rows: DataFrame,
    delivered: DataFrame,
    group: str,
    key: str,
    run: str,
    compare: Sequence[Column],
    latest: Column,
    shards: int = 1024,
    store: str | None = None,
    with_columns: bool = False,
) -> DataFrame:
    """``run, group, key, change_kind`` of every difference between consecutive snapshots.

    ``delivered`` lists the (group, run) pairs whose snapshots count; rows of
    others are ignored, and a pair without rows is an empty snapshot.  Within a
    snapshot the row with the largest ``latest`` holds for a key; of rows that
    tie there the one with the largest fingerprint, so that the result doesn't
    depend on order.  Each snapshot is compared with the group's previous
    delivered one by ``compare``; the first of a group gives nothing.  Rows and
    pairs with a null group, key or run are no part of any snapshot.

    ``with_columns`` adds ``changed_columns``, the places in ``compare``, from 1,
    of what changed; null unless the row says 'changed'.

    ``store`` is a folder that keeps the dictionary and each group's last
    snapshot, so that a later call with the same folder, shards and compared
    columns needs the new runs' rows alone: pairs up to a group's last run
    in the store are passed over.  Without a folder they live for one call.
    """
    spark = rows.sparkSession
    version, held = _held(spark, store)
    runs = delivered.select(F.col(group).alias("g"), F.col(run).alias("r")).dropna().distinct()
    began = F.lit(0)
    if held:
        runs = runs.join(held[2], "g", "left").filter("last is null or r > last")
        began = F.col("last").isNotNull().cast("int")
    # the group's snapshots are numbered, so that one pair of bitmaps serves all groups of a word; the one in the store is the first
    by = Window.partitionBy("g")
    runs = runs.select("g", "r", (F.row_number().over(by.orderBy("r")) + began).alias("d"), (F.count("*").over(by) + began).cast("int").alias("n"))
    vector = F.array(*[F.hash(F.lit(i), c) for i, c in enumerate(compare)])
    base = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(run).alias("r"), latest.alias("t"), F.struct(F.xxhash64(*compare).alias("h"), vector.alias("v")).alias("x")).dropna(subset=["g", "k", "r"])
    base = base.join(runs, ["g", "r"]).withColumn("s", F.pmod(F.xxhash64("g", "k"), F.lit(shards)).cast("int"))
    # the one exchange of rows; what follows groups by s and more
    base = base.repartition("s")
    per_run = base.groupBy("s", "g", "k", "d").agg(F.max_by("x", F.struct(F.col("t"), F.col("x"))).alias("x"), F.max("n").alias("n"))
    if held:
        going_on = runs.groupBy("g").agg(F.max("n").alias("n"))
        per_run = per_run.unionByName(held[0].join(held[1], ["s", "o"]).join(going_on, "g").select("s", "g", "k", F.lit(1).alias("d"), "x", "n"))
    keys = per_run.groupBy("s", "g", "k").agg(F.min("d").alias("first"), F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("d", "x"))).alias("seen"))
    order = Window.partitionBy("s")
    if held:
        known = held[0].withColumnRenamed("o", "had")
        keys = keys.join(known, ["s", "g", "k"], "left").join(known.groupBy("s").agg(F.max("had").alias("most")), "s", "left")
        new = F.row_number().over(order.orderBy(F.col("had").isNotNull(), "first", "g", "k"))
        keys = keys.withColumn("o", F.coalesce("had", F.coalesce("most", F.lit(-1)) + new))
    else:
        keys = keys.withColumn("had", F.lit(None).cast("int")).withColumn("o", F.row_number().over(order.orderBy("first", "g", "k")) - 1)
    keys = written(keys.select("s", "g", "k", "n", "seen", "had", F.col("o").cast("int").alias("o")), "keys")
    cells = keys.select("s", (F.col("o") / WORD).cast("int").alias("w"), (F.col("o") % WORD).cast("int").alias("b"), "n", F.explode("seen").alias("d", "x"))
    bit = F.expr("shiftleft(1L, b)")
    words = cells.groupBy("s", "w", "d").agg(
        F.bit_or(bit).alias("new"),
        F.bit_or(F.when(F.col("n") > F.col("d"), bit).otherwise(F.lit(0).cast("long"))).alias("goes_on"),
        F.array_sort(F.collect_list(F.struct("b", "x"))).alias("cells"),  # 64 at most
    )
    # words without a bit aren't stored: a neighbour counts only if it is the next snapshot's
    ordered = Window.partitionBy("s", "w").orderBy("d")
    follows = F.lag("d").over(ordered) == F.col("d") - 1
    none = F.lit(0).cast("long")
    words = words.select(
        "s", "w", "d", "new", "goes_on", "cells",
        F.coalesce(F.when(follows, F.lag("new").over(ordered)), none).alias("old"),
        F.when(follows, F.lag("cells").over(ordered)).alias("was"),
        F.coalesce(F.when(F.lead("d").over(ordered) == F.col("d") + 1, F.lead("new").over(ordered)), none).alias("next"),
    )
    new, old = F.col("new"), F.col("old")
    added = F.when(F.col("d") > 1, new.bitwiseAND(F.bitwise_not(old))).otherwise(none)
    removed = new.bitwiseAND(F.col("goes_on")).bitwiseAND(F.bitwise_not(F.col("next")))
    words = words.select("s", "w", "d", "cells", "was", "old", added.alias("added"), removed.alias("removed"), new.bitwiseAND(old).alias("common"))

    def at(x: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), x["b"])

    below = lambda x: F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), x["b"]))
    on = lambda bits, x: F.col(bits).bitwiseAND(at(x)) != 0
    before = lambda x: F.get("was", F.bit_count(F.col("old").bitwiseAND(below(x))))["x"]
    differ = lambda x: F.filter(F.transform(F.arrays_zip(x["x"]["v"].alias("p"), before(x)["v"].alias("q")), lambda y, i: F.when(y["p"] != y["q"], i + 1)), lambda i: i.isNotNull())
    none_changed = F.lit(None).cast("array<int>")
    entry = lambda x, kind, d, c: F.struct(x["b"].alias("b"), F.lit(kind).alias("change_kind"), d.alias("d"), c.alias("changed_columns"))
    here = F.transform("cells", lambda x: F.when(on("added", x), entry(x, "added", F.col("d"), none_changed)).when(on("common", x) & (x["x"]["h"] != before(x)["h"]), entry(x, "changed", F.col("d"), differ(x) if with_columns else none_changed)))
    gone = F.transform("cells", lambda x: F.when(on("removed", x), entry(x, "removed", F.col("d") + 1, none_changed)))
    found = words.select("s", "w", F.explode(F.array_compact(F.concat(here, gone))).alias("e")).select("s", (F.col("w") * WORD + F.col("e.b")).alias("o"), "e.d", "e.change_kind", "e.changed_columns")
    out = found.join(keys.select("s", "o", "g", "k"), ["s", "o"]).join(runs.select("g", "d", "r"), ["g", "d"])
    if store is not None:
        out = written(out, "changes")  # before the store moves on
        n = version + 1
        # a group's last snapshot, with those of groups that had no new one
        last = keys.filter(F.map_contains_key("seen", F.col("n"))).select("s", "o", F.element_at("seen", F.col("n")).alias("x"))
        ends = runs.groupBy("g").agg(F.max("r").alias("last"))
        if held:
            stay = held[1].join(held[0], ["s", "o"]).join(ends, "g", "left_anti").select("s", "o", "x")
            last, ends = last.unionByName(stay), ends.unionByName(held[2].join(ends, "g", "left_anti"))
        keys.filter("had is null").select("s", "g", "k", "o").write.mode("overwrite").parquet(f"{store}/dictionary/v={n}")
        last.write.mode("overwrite").parquet(f"{store}/last/v={n}")
        ends.write.mode("overwrite").parquet(f"{store}/groups/v={n}")  # its completion makes the version count
    columns = [F.col("r").alias(run), F.col("g").alias(group), F.col("k").alias(key), F.col("change_kind")]
    return out.select(*columns, *(["changed_columns"] if with_columns else []))


def board_key(source: Column, token: Column, site: Column) -> Column:
    """``source:token[:site]`` without the case in which parts were written."""
    part = [F.lower(F.trim(c)) for c in (source, token)]
    site = F.lower(F.trim(site))
    return F.concat(part[0], F.lit(":"), part[1], F.when(F.coalesce(site, F.lit("")) == "", "").otherwise(F.concat(F.lit(":"), site)))


def found_changes(snapshots: DataFrame, reports: DataFrame, boards: DataFrame, shards: int = 1024, store: str | None = None) -> DataFrame:
    """``run_no, board_key, external_id, change_kind`` between a board's delivered snapshots; a board that ``boards`` doesn't list keeps the key of its rows."""
    names = boards.select("board_key", F.lower(F.trim("board_key")).alias("board")).dropna().groupBy("board").agg(F.min("board_key").alias("board_key"))
    ok = reports.filter(F.lower(F.trim("status")) == "ok").select(F.lower(F.trim("board_key")).alias("board"), "run_no")
    key = F.regexp_replace("external_id", r"^[\s ]+|[\s ]+$", "")
    rows = snapshots.select(
        board_key(F.col("source"), F.col("token"), F.col("site")).alias("board"),
        "run_no",
        key.alias("external_id"),
        "fetched_at",
        # one pass over the texts of a row, then each on its own
        F.split(text_key(*[F.col(c) for c in ("title", "location_raw", "department", "employment_type")]), " ?\u0001 ?").alias("text"),
        instant_key(F.col("posted_at")).alias("posted_at"),
    )
    compare = [F.get("text", F.lit(i)) for i in range(4)] + [F.col("posted_at")]
    found = snapshot_changes(rows, ok, "board", "external_id", "run_no", compare, F.col("fetched_at"), shards, store)
    return found.join(names, "board", "left").select("run_no", F.coalesce("board_key", "board").alias("board_key"), "external_id", "change_kind")
