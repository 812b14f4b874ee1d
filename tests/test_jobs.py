"""Jobs of uploads, as their events tell; lost work fails, repeated uploads are one job, restarts repeat nothing."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skyloom.streaming import jobs
from skyloom.streaming import readings as R

BASE = datetime(2024, 1, 1)


def at(s):
    return BASE + timedelta(seconds=s)


def followed(spark, folder, tmp_path, **how):
    events = spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    R.to_table(jobs.job_states(events, **how), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    out = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("upload_id", "sequence").collect():
        out.setdefault(r.upload_id, []).append((r.status, r.attempt, (r.ts - BASE).total_seconds(), r.error))
    return out


def test_states_and_a_lost_job(spark, tmp_path):
    folder = str(tmp_path / "events")
    write = lambda rows: spark.createDataFrame(rows, jobs.EVENTS).coalesce(1).write.mode("append").parquet(folder)
    write([("a", "queued", at(0), None), ("a", "processing", at(1), None), ("b", "queued", at(0), None), ("b", "queued", at(3), None), (None, "queued", at(0), None),
        ("b", "processing", at(4), None), ("b", "failed", at(5), "no such format"), ("c", "done", at(9), None), ("c", "processing", at(8), None), ("c", "queued",
        at(7), None), ("d", "what", at(1), None)])
    first = followed(spark, folder, tmp_path, limit_s=60, delay="1 second")
    assert first == {
        "a": [("queued", 0, 0, None), ("processing", 1, 1, None)],
        "b": [("queued", 0, 0, None), ("processing", 1, 4, None), ("failed", 1, 5, "no such format")],
        "c": [("queued", 0, 7, None), ("processing", 1, 8, None), ("done", 1, 9, None)],
    }
    write([("c", "queued", at(300), None), ("b", "processing", at(300), None), ("b", "done", at(301), None), ("e", "queued", at(400), None)])
    again = followed(spark, folder, tmp_path, limit_s=60, delay="1 second")  # from the checkpoint; time has gone on
    assert again["a"] == [*first["a"], ("failed", 1, 61, jobs.LOST)]
    assert again["b"] == [*first["b"], ("processing", 2, 300, None), ("done", 2, 301, None)]
    assert again["c"] == first["c"] and again["e"] == [("queued", 0, 400, None)] and set(again) == {*"abce"}
    write([("a", "processing", at(500), None), ("a", "done", at(502), None)])
    assert followed(spark, folder, tmp_path, limit_s=60, delay="1 second")["a"][-2:] == [("processing", 2, 500, None), ("done", 2, 502, None)]


@pytest.fixture
def uploads(spark, tmp_path):
    folder = str(tmp_path / "uploads")

    def add(*rows):
        spark.createDataFrame(rows, "upload_id string, size int").coalesce(1).write.mode("append").parquet(folder)

    return add, lambda: spark.readStream.schema("upload_id string, size int").option("maxFilesPerTrigger", 1).parquet(folder)


def test_work_is_done_once_and_failures_are_seen(spark, tmp_path, uploads):
    add, stream = uploads
    events, results, checkpoint = (str(tmp_path / x) for x in ("events", "results", "checkpoint"))
    calls = []

    def analyse(rows):
        calls.append(sorted(r.upload_id for r in rows.collect()))
        if "crash" in calls[-1]:
            raise RuntimeError("boom")
        return rows.select("upload_id", (F.col("size") * 2).alias("twice"), F.when(F.col("size") < 0, "negative size").alias("error"))

    add(("x", 1), ("y", -1), ("x", 1))
    jobs.run_jobs(stream(), analyse, events, results, checkpoint).awaitTermination()
    add(("x", 1), ("z", 5))
    jobs.run_jobs(stream(), analyse, events, results, checkpoint).awaitTermination()
    add(("crash", 1))
    jobs.run_jobs(stream(), analyse, events, results, checkpoint).awaitTermination()
    assert calls == [["x", "y"], ["z"], ["crash"]]
    assert sorted((r.upload_id, r.twice) for r in spark.read.parquet(results).filter("error IS NULL").collect()) == [("x", 2), ("z", 10)]
    states = spark.read.parquet(events)
    last = {r.upload_id: (r.event, r.error) for r in states.filter("event IN ('done', 'failed')").collect()}
    assert last == {"x": ("done", None), "y": ("failed", "negative size"), "z": ("done", None), "crash": ("failed", "internal error: RuntimeError")}


def test_a_killed_batch_ends_as_failed_and_runs_again_from_its_checkpoint(spark, tmp_path, uploads, monkeypatch):
    add, stream = uploads
    events, results, checkpoint = (str(tmp_path / x) for x in ("events", "results", "checkpoint"))

    def analyse(rows):
        return rows.select("upload_id", "size")

    log_event = jobs.log_event

    def dies_afterwards(rows, event, *rest):
        log_event(rows, event, *rest)
        if event == "processing":
            raise RuntimeError("the process is gone")

    add(("k", 1))
    monkeypatch.setattr(jobs, "log_event", dies_afterwards)
    with pytest.raises(Exception, match="the process is gone"):
        jobs.run_jobs(stream(), analyse, events, results, checkpoint).awaitTermination()
    monkeypatch.setattr(jobs, "log_event", log_event)
    begun = {r.event for r in spark.read.parquet(events).collect()}
    assert begun == {"queued", "processing"}
    # an event of another upload an hour later moves time on: the job is told as lost
    spark.createDataFrame([("other", "queued", datetime.now() + timedelta(hours=1), None)], jobs.EVENTS).coalesce(1).write.mode("append").parquet(events)
    assert [s for s, *_ in followed(spark, events, tmp_path / "follow", limit_s=60, delay="1 second")["k"]] == ["queued", "processing", "failed"]
    jobs.run_jobs(stream(), analyse, events, results, checkpoint).awaitTermination()
    jobs.run_jobs(stream(), analyse, events, results, checkpoint).awaitTermination()
    assert spark.read.parquet(results).count() == 1
    assert spark.read.parquet(events).filter("upload_id = 'k' AND event = 'done'").count() == 1


def test_the_current_state_of_each_job(spark):
    rows = [("a", 0, "queued", 0, BASE, None), ("a", 1, "done", 1, BASE, None), ("b", 0, "queued", 0, BASE, None)]
    out = jobs.current(spark.createDataFrame(rows, jobs.TRANSITIONS)).collect()
    assert {(r.upload_id, r.status) for r in out} == {("a", "done"), ("b", "queued")}
