from datetime import datetime

from loamstack.sinks.tables import append_once
from loamstack.streaming import nightly
from pyspark.sql import functions as F

COLUMNS = "file_id string, eid string, seen_at timestamp"


def drain(q):
    q.awaitTermination(120)
    assert q.exception() is None


def test_seen_entries(spark, tmp_path):
    src = f"{tmp_path}/in"
    night = lambda d: datetime(2025, 1, d)
    out: dict = {}
    batches = [[("f", "a", night(1)), ("f", "a", night(1)), (None, "x", night(1))], [("f", "a", night(2)), ("f", "b", night(2))], [("f", "a", night(2))]]
    for b in batches:
        spark.createDataFrame(b, COLUMNS).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(COLUMNS).parquet(src)
        q = (nightly.seen_entries(stream).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c")
             .foreachBatch(lambda df, k: out.update({r.eid: (r.first_seen, r.last_seen, r.runs_seen) for r in df.collect()})).start())
        drain(q)
    assert out == {"a": (night(1), night(2), 2), "b": (night(2), night(2), 1)}


def test_each_night_is_idempotent(spark, tmp_path):
    src, dst = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([("f", "a", None), ("g", "b", None)], COLUMNS).write.parquet(src)

    def run(df, name):
        for _ in range(2):  # as after a failure
            append_once(df.select("file_id", F.col("eid").alias("tx")), dst, name)

    drain(nightly.each_night(spark.readStream.schema(COLUMNS).parquet(src), run, f"{tmp_path}/c"))
    assert spark.read.parquet(dst).count() == 2


def test_upsert_nights(spark):
    state = spark.createDataFrame([("f", "a", datetime(2024, 1, 1), datetime(2025, 1, 1), 5), ("f", "old", None, None, None)],
                                  "file_id string, eid string, first_seen timestamp_ntz, last_seen timestamp_ntz, runs_seen int")
    batch = spark.createDataFrame([("f", "a", "x", None), ("f", "n", "y", datetime(2025, 1, 30)), ("f", "n", "y", None)], "file_id string, eid string, text string, first_seen timestamp_ntz")
    now = datetime(2025, 2, 1)
    once = nightly.upsert_nights(state, batch, now)
    twice = nightly.upsert_nights(once, batch, now)
    got = {r.eid: tuple(r)[2:] for r in twice.collect()}
    assert got == {"a": (datetime(2024, 1, 1), now, 6), "n": (datetime(2025, 1, 30), now, 1), "old": (None, None, 0)}


def test_daily_arrivals(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.createDataFrame([("f", datetime(2025, 1, 1, 3)), ("f", datetime(2025, 1, 1, 9)), ("f", None), ("f", datetime(2025, 1, 9))],
                          "file_id string, first_seen timestamp_ntz").write.parquet(src)
    stream = spark.readStream.schema("file_id string, first_seen timestamp_ntz").parquet(src)
    q = nightly.daily_arrivals(stream).writeStream.format("memory").queryName("days").outputMode("append").trigger(availableNow=True).start()
    drain(q)
    assert [(r.file_id, r.day.day, r.entries) for r in spark.table("days").collect()] == [("f", 1, 2)]
