"""Streams give what batches give, delivered once."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skyloom.operators import kalman, sessions
from skyloom.streaming import readings as R

SCHEMA = "drone_id long, reading_id long, ts timestamp_ntz, us long, altitude double, battery double, latitude double, longitude double"
BASE = datetime(2024, 1, 1)


def rows(first: int, last: int):
    out = []
    for i in range(first, last):
        for drone in (1, 2):
            second = i * 10 + (200 if i >= 20 else 0)
            out.append((drone, i * 2 + drone, BASE + timedelta(seconds=second), int(BASE.timestamp() + second) * 1_000_000, 10.0 + i * 0.5
                + (i * drone) % 3 * 0.2, 90.0 - i * 0.1, None, None))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "readings")
    for first, last in ((0, 12), (12, 25), (25, 40)):
        spark.createDataFrame(rows(first, last), SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, folder):
    return R.readings_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1)


def finished(spark, frame, tmp_path, mode="append"):
    R.to_table(frame, str(tmp_path / "out"), str(tmp_path / "checkpoint"), mode).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_live_filter_is_the_batch_filter(spark, folder, tmp_path):
    live = finished(spark, R.live_filter(stream(spark, folder)), tmp_path)
    batch = kalman.smooth(spark.read.parquet(folder))
    key = lambda f: {(r.drone_id, r.reading_id): (round(r.filtered, 9), None if r.nis is None else round(r.nis, 9)) for r in f.collect()}
    assert key(live) == key(batch)


def test_closed_sessions_are_the_batch_sessions(spark, folder, tmp_path):
    live = {(r.drone_id, r.readings, r.length_us) for r in finished(spark, R.live_sessions(stream(spark, folder), delay="10 seconds"), tmp_path).collect()}
    batch = {(r.drone_id, r.readings, int(r.seconds * 1e6)) for r in sessions.sessions(spark.read.parquet(folder)).collect()}
    assert live and live <= batch


def test_windows_count_what_the_watermark_closed(spark, folder, tmp_path):
    live = {(r.drone_id, r.start): r.n for r in finished(spark, R.counts(stream(spark, folder), "1 minute", "5 seconds"), tmp_path).collect()}
    batch = spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).groupBy("drone_id", F.window("ts", "1 minute").alias("w")).count()
    whole = {(r.drone_id, r.w.start): r["count"] for r in batch.collect()}
    assert live and all(whole[k] == n for k, n in live.items())


def test_duplicates_and_strangers_are_left_out(spark, folder, tmp_path):
    owners = spark.createDataFrame([(1, 7), (2, 8)], "drone_id long, owner_id long")
    twice = stream(spark, folder).union(stream(spark, folder))
    out = finished(spark, R.deduplicated(R.owned_stream(twice, owners, 7)), tmp_path)
    assert {r.drone_id for r in out.collect()} == {1} and out.count() == 40


def test_watchers_get_each_batch_once(spark, folder, tmp_path):
    got = []
    watched = lambda: spark.createDataFrame([(2,), (2,)], "drone_id long")
    for _ in range(2):  # a restart from the checkpoint delivers nothing again
        R.deliver(stream(spark, folder), watched, lambda batch, n: got.extend(r.reading_id for r in batch.collect()), str(tmp_path / "c")).awaitTermination()
    assert sorted(got) == [i * 2 + 2 for i in range(40)]


def test_newest_connection_replaces_older(spark, tmp_path):
    path = str(tmp_path / "connections")
    spark.createDataFrame([(1, 5, "a", BASE), (1, 5, "b", BASE + timedelta(seconds=5)), (1, 6, "c", BASE)],
        "drone_id long, user_id long, connection string, ts timestamp").write.parquet(path)
    q = R.newest_connection(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)).writeStream.format("memory").queryName("newest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.user_id, r.connection) for r in spark.table("newest").collect()} == {(5, "b"), (6, "c")}
