"""Folds on streams end with the batch's results, whatever the order of rows and the cut of micro-batches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skyloom.operators import baselines, kalman
from skyloom.streaming import refold
from skyloom.streaming import readings as R

READING = "drone_id long, us long, reading_id long, altitude double"


def readings():
    rng = random.Random(1)
    out = []
    for drone in (1, 2):
        us = 0
        for i in range(60):
            us += rng.choice([1, 1, 2, 5, 40 if i % 20 == 0 else 1]) * 1_000_000 * (0 if i % 13 == 5 else 1)
            out.append((drone, us, 1000 * drone + i, None if i % 17 == 3 else 10 + i * 0.3 + rng.random()))
    return out


def written(spark, rows, schema, folder, parts):
    for part in parts(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def finished(spark, stream, tmp_path):
    R.to_table(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def cut(n):
    return lambda rows: [rows[i::n] for i in range(n)]  # each part jumps over the whole time


def test_a_shuffled_stream_ends_with_the_filter_of_the_batch(spark, tmp_path):
    rows = readings()
    batch = kalman.smooth(spark.createDataFrame(rows, READING)).collect()
    random.Random(2).shuffle(rows)
    out = finished(spark, refold.corrected_filter(written(spark, rows, READING, str(tmp_path / "in"), cut(5)), horizon_s=10_000), tmp_path)
    true = {(r.drone_id, r.reading_id): (round(r.filtered, 9), None if r.nis is None else round(r.nis, 9)) for r in batch}
    last = refold.latest(out, ["drone_id"], ["us", "reading_id"]).collect()
    assert {(r.drone_id, r.reading_id): (round(r.filtered, 9), None if r.nis is None else round(r.nis, 9)) for r in last} == true
    sequences = out.groupBy("drone_id").agg(F.count_distinct("sequence").alias("n"), F.max("sequence").alias("last")).collect()
    assert all(r.n == r.last + 1 for r in sequences) and out.agg(F.max("revision")).first()[0] >= 2
    # in order nothing is corrected
    ordered = finished(spark, refold.corrected_filter(written(spark, sorted(rows), READING, str(tmp_path / "in2"), lambda x: [x[:50], x[50:80], x[80:]])), tmp_path / "b")
    assert ordered.filter("revision > 0").isEmpty() and ordered.count() == len(true)


def test_rows_beyond_the_horizon_are_told_apart(spark, tmp_path):
    rows = [(1, i * 1_000_000, i, float(i)) for i in range(100)]
    late, timely = rows[3], rows[95]
    parts = lambda _: [[r for r in rows if r not in (late, timely)], [late, timely, rows[50]]]
    out = finished(spark, refold.corrected_filter(written(spark, rows, READING, str(tmp_path / "in"), parts), horizon_s=20), tmp_path)
    told = {r.reading_id for r in out.filter("kept IS NULL").collect()}
    assert told == {3, 50} and out.filter("reading_id = 95 AND kept").count() == 1
    assert {r.reading_id for r in out.filter("revision > 0").collect()} == {96, 97, 98, 99}


OBSERVATION = "drone_id long, baseline_group string, feature_key string, flight_index long, value double, qualified boolean, valid boolean, absolute_bad boolean, floor double, relative_floor double, baselined boolean"


def observations():
    rng = random.Random(3)
    out = []
    for drone in (1, 2):
        for feature in ("a", "b"):
            for i in range(40):
                value = None if i % 11 == 7 else 10 + rng.gauss(0, 1) + (15 if i % 9 == 8 else 0)
                out.append((drone, "epoch:initial", feature, i, value, i % 7 != 3, i % 10 != 9, i % 13 == 12, 0.1, 0.0, feature == "a"))
    return out


def decisions(rows):
    return {(r.drone_id, r.feature_key, r.flight_index): (r.admitted, r.quarantine_reason, r.n_before, r.base_median, r.base_spread, r.base_n, r.ref_median)
        for r in rows.collect()}


@pytest.mark.parametrize("parts", [lambda rows: [sorted(rows, key=lambda r: r[3])], cut(4), lambda rows: [[r for r in rows if lo <= r[3] < lo + 13] for lo in (0,
    13, 26, 39)]], ids=["at once", "shuffled", "in order"])
def test_admission_on_a_stream_is_that_of_the_batch(spark, tmp_path, parts):
    rows = observations()
    random.Random(4).shuffle(rows)
    true = decisions(baselines.admit(spark.createDataFrame(rows, OBSERVATION)))
    out = finished(spark, refold.live_admission(written(spark, rows, OBSERVATION, str(tmp_path / "in"), parts)), tmp_path)
    assert decisions(refold.latest(out, baselines.KEYS, ["flight_index"])) == true


def test_a_stream_goes_on_where_the_batch_ended_and_after_a_restart(spark, tmp_path):
    rows = observations()
    table = spark.createDataFrame(rows, OBSERVATION)
    true = decisions(baselines.admit(table))
    before = refold.gate_states(baselines.admit(table.filter("flight_index < 20")))
    folder = str(tmp_path / "in")
    later = [r for r in rows if r[3] >= 20]
    stream = lambda: refold.live_admission(written(spark, [], OBSERVATION, folder, lambda _: []), before)
    for lo in (20, 30):  # each turn is a query of its own, from the same checkpoint
        spark.createDataFrame([r for r in later if lo <= r[3] < lo + 10], OBSERVATION).coalesce(1).write.mode("append").parquet(folder)
        out = finished(spark, stream(), tmp_path)
    assert decisions(refold.latest(out, baselines.KEYS, ["flight_index"])) == {k: v for k, v in true.items() if k[2] >= 20}
    assert out.filter("revision > 0").isEmpty()
