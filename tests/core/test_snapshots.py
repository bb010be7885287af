import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quern.operators.snapshots import found_changes, instant_key, snapshot_changes, text_key


def _brute(rows, delivered):
    out, by = set(), {}
    for g, k, r, t, v in rows:
        if None in (g, k, r) or (g, r) not in delivered:
            continue
        cell = by.setdefault((g, r), {})
        cell[k] = max(cell.get(k, (t, v)), (t, v), key=lambda x: x[0])
    for g in {g for g, _ in delivered}:
        runs = sorted(r for h, r in delivered if h == g)
        for p, r in zip(runs, runs[1:]):
            old, new = by.get((g, p), {}), by.get((g, r), {})
            out |= {(r, g, k, "added") for k in new.keys() - old.keys()} | {(r, g, k, "removed") for k in old.keys() - new.keys()}
            out |= {(r, g, k, "changed") for k in new.keys() & old.keys() if new[k][1] != old[k][1]}
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), f"k{rng.randrange(150)}", rng.randrange(1, 7), i, rng.randrange(3)) for i in range(2500)]
    rows += [(None, "k", 1, 0, 0), ("a", None, 1, 0, 0), ("a", "k1", None, 0, 0)]
    delivered = {(g, r) for g in "abc" for r in range(1, 7) if (g, r) not in {("a", 3), ("b", 1)}}
    df = spark.createDataFrame(rows, "g string, k string, r int, t int, v int")
    ok = spark.createDataFrame(sorted(delivered), "g string, r int")
    for shards in (1, 3, 64):
        got = [tuple(x) for x in snapshot_changes(df, ok, "g", "k", "r", [F.col("v")], F.col("t"), shards).collect()]
        assert len(got) == len(set(got)) and set(got) == _brute(rows, delivered)


def test_ordinals_survive_new_runs_and_empties(spark):
    df = spark.createDataFrame([("a", "k", 1, 0, 0)], "g string, k string, r int, t int, v int")
    ok = spark.createDataFrame([("a", 1), ("a", 2)], "g string, r int")
    got = [tuple(x) for x in snapshot_changes(df, ok, "g", "k", "r", [F.col("v")], F.col("t")).collect()]
    assert got == [(2, "a", "k", "removed")]
    assert snapshot_changes(df.limit(0), ok, "g", "k", "r", [F.col("v")], F.col("t")).count() == 0
    assert snapshot_changes(df, ok.limit(0), "g", "k", "r", [F.col("v")], F.col("t")).count() == 0


def test_a_store_needs_new_runs_alone(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice("aab"), f"k{rng.randrange(200)}", rng.randrange(1, 9), i, rng.randrange(3)) for i in range(3000)]
    rows += [("late", f"k{i}", r, 0, r // 5) for i in range(70) for r in range(4, 9)]
    delivered = sorted({(g, r) for g in ("a", "b", "late") for r in range(1, 9) if (g, r) not in {("a", 5), ("a", 6), ("b", 1), ("late", 1), ("late", 2)}})
    df = lambda part: spark.createDataFrame(part, "g string, k string, r int, t int, v int")
    ok = lambda part: spark.createDataFrame(part, "g string, r int")
    store, got, ordinals = str(tmp_path / "store"), [], {}
    for lo, hi in ((1, 3), (4, 4), (5, 8)):
        part = [x for x in rows if lo <= x[2] <= hi]
        again = [x for x in delivered if x[1] <= hi]  # pairs that the store has are passed over
        got += [tuple(x) for x in snapshot_changes(df(part), ok(again), "g", "k", "r", [F.col("v")], F.col("t"), 3, store=store).collect()]
        said = spark.read.parquet(f"{store}/dictionary/*").collect()
        now = {(x.g, x.k): (x.s, x.o) for x in said}
        assert len(said) == len(now) == len(set(now.values())) and ordinals.items() <= now.items()
        ordinals = now
    assert len(got) == len(set(got)) and set(got) == _brute(rows, set(delivered))


def test_changed_columns_are_named(spark):
    rows = [("a", f"k{i}", r, "x" if r == 1 or i % 2 else "y", str(i) if r == 1 or i % 3 else "z") for i in range(130) for r in (1, 2)]
    df = spark.createDataFrame(rows, "g string, k string, r int, p string, q string")
    ok = spark.createDataFrame([("a", 1), ("a", 2)], "g string, r int")
    got = {x.k: x.changed_columns for x in snapshot_changes(df, ok, "g", "k", "r", [F.col("p"), F.col("q")], F.lit(0), 1, with_columns=True).collect()}
    want = {f"k{i}": [c for c, on in ((1, i % 2 == 0), (2, i % 3 == 0)) if on] for i in range(130)}
    assert got == {k: v for k, v in want.items() if v}


def test_what_is_no_difference(spark):
    df = spark.createDataFrame([("Data  Analyst ", None), ("data analyst", "")], "t string, d string")
    assert len({r[0] for r in df.select(text_key(F.col("t"), F.col("d"))).collect()}) == 1
    df = spark.createDataFrame([("2026-03-16T10:31:14-07:00",), ("2026-03-16T17:31:14Z",), ("2026-03-16T17:31:14+00:00",)], "t string")
    assert len({r[0] for r in df.select(instant_key(F.col("t"))).collect()}) == 1
    df = spark.createDataFrame([("soon",), (None,), ("2026",)], "t string")
    assert [r[0] for r in df.select(instant_key(F.col("t"))).collect()] == ["soon", "", "2026"]


def test_found_changes(spark):
    at = datetime(2026, 3, 2)
    rows = [
        (1, "lever", "Tok", None, " 7 ", "A", "x", None, None, None, at),
        (2, "lever", "tok", None, "7", "a", "X ", "", None, None, at),
        (2, "lever", "tok", None, "7", "stale", "x", "", None, None, at - timedelta(hours=1)),
        (2, "lever", "tok", None, "8", "b", "x", "", None, None, at),
        (3, "lever", "tok", None, "9", "undelivered", "x", "", None, None, at),
    ]
    snaps = spark.createDataFrame(rows, "run_no int, source string, token string, site string, external_id string, title string, location_raw string, department string, employment_type string, posted_at string, fetched_at timestamp")
    reports = spark.createDataFrame([(1, "lever:tok", "ok"), (2, "lever:tok", "failed"), (2, "lever:tok", "ok"), (3, "lever:tok", "failed")], "run_no int, board_key string, status string")
    boards = spark.createDataFrame([("lever:tok",), ("lever:tok",)], "board_key string")
    assert [tuple(r) for r in found_changes(snaps, reports, boards).collect()] == [(2, "lever:tok", "8", "added")]
