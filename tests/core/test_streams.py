from pyspark.sql import functions as F

from quern.streaming.listing import read_versioned, stream_ledger, stream_store


def test_store_stream_equals_batch(spark, tmp_path):
    schema = "id string, v int, at timestamp, day string"
    source = str(tmp_path / "in")
    rows = [("a", 1, 1, "d1"), ("b", 1, 1, "d1"), ("a", 2, 2, "d2"), ("c", 1, 3, "d3")]
    frame = lambda part: spark.createDataFrame(part, "id string, v int, t long, day string").select("id", "v", F.timestamp_seconds("t").alias("at"), "day")
    store, mark = str(tmp_path / "store"), str(tmp_path / "mark")
    for part in (rows[:2], rows[2:]):
        frame(part).coalesce(1).write.mode("append").parquet(source)
        stream_store(spark.readStream.schema(schema).parquet(source), store, mark, "id", "at", "day").awaitTermination()
    got = {r.id: (r.v, r.first_seen, r.last_seen) for r in read_versioned(spark, store).collect()}
    assert got == {"a": (2, "d1", "d2"), "b": (1, "d1", "d1"), "c": (1, "d3", "d3")}


def test_ledger_stream_drops_repeats(spark, tmp_path):
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    # a repeat that comes days later is a repeat too
    for part in ([("a", 1), ("a", 2), ("b", 3)], [("a", 900_000), ("c", 900_001)], [("b", 4), ("c", 5), ("d", 6)]):
        spark.createDataFrame(part, "k string, t long").select("k", F.timestamp_seconds("t").alias("at")).coalesce(1).write.mode("append").parquet(source)
        stream_ledger(spark.readStream.schema("k string, at timestamp").parquet(source), out, mark, ["k"], "at").awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "d"]
