"""Alignment of two recordings against a plain numpy search over all lags."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom import plans
from skyloom.operators import alignment, windows
from skyloom.plans import flights


@pytest.fixture(scope="module")
def recordings(spark):
    """Three pairs at 50 Hz over 60 s: a copy that begins 0.6 s late, one that does not resemble, and one too short to use."""
    rng = np.random.default_rng(4)
    t = np.arange(3000) / 50
    wave = sum(np.sin(2 * np.pi * f * t + p) * a for f, p, a in zip(rng.uniform(0.05, 0.8, 12), rng.uniform(0, 6, 12), rng.uniform(0.5, 2, 12), strict=True))
    late = np.interp(t - 0.6, t, wave)
    rows = []
    for log, values in (("r1", wave), ("s1", late), ("r2", wave), ("s2", rng.standard_normal(3000)), ("r3", wave[:200]), ("s3", late[:200])):
        rows += [(log, "att.roll", int(i * 20_000), float(v)) for i, v in enumerate(values)] + [(log, "alt.rel", int(i * 20_000), float(i))
            for i in range(0, len(values), 25)]
    signals = spark.createDataFrame(rows, "log string, key string, us long, value double")
    return spark.createDataFrame([(1, "r1", "s1"), (2, "r2", "s2"), (3, "r3", "s3")], "pair int, real_log string, sim_log string"), signals, wave, late


def test_shift_is_that_of_a_plain_search(recordings):
    pairs, signals, wave, late = recordings
    out = {r.pair: r for r in alignment.align(pairs, signals).collect()}
    best = max(range(-100, 101), key=lambda k: np.corrcoef(wave[200:2800], late[200 + k : 2800 + k])[0, 1])
    assert best == 30 and out[1].shift_s == pytest.approx(-best / 50,
        abs=0.02)  # the lag of the real series against the other and out[1].quality == "fine" and out[1].correlation > 0.95
    assert out[2].quality == "coarse_only" and out[2].shift_s == 0 and out[2].correlation < 0.6
    assert out[3].reason == "insufficient_overlap" and {r.axis for r in out.values()} == {"att.roll"}


def test_resampled_signals_are_read_at_the_shifted_times(recordings):
    pairs, signals, wave, late = recordings
    aligned = alignment.align(pairs, signals).filter("pair = 1")
    shift = round(aligned.first().shift_s * 50)
    out = alignment.resample(aligned, signals).filter("key = 'att.roll' AND real IS NOT NULL AND sim IS NOT NULL").toPandas()
    at = out["i"].to_numpy()
    assert len(out) > 2500 and np.allclose(out["real"], wave[at]) and np.allclose(out["sim"], late[at + shift])
    flags = {(r.key, r.low_rate, r.upsampled) for r in alignment.resample(aligned, signals).select("key", "low_rate", "upsampled").distinct().collect()}
    assert flags == {("att.roll", False, False), ("alt.rel", True, True)}


def test_windows_of_a_flight_with_and_without_steady_stretches(spark):
    rows = []
    for flight, noisy in ((1, 40), (2, 100)):
        for i in range(0, 1300):  # 130 s at 10 Hz, airborne from 10 to 120 s
            us, up = i * 100_000, 100 <= i < 1200
            rows.append((flight, "land.landed", us, 0.0 if up else 1.0))
            rows += [(flight, k, us, 0.9 if 100 <= i < 100 + noisy * 10 else 0.1) for k in ("vel.z", "rate_sp.roll", "rate_sp.pitch", "rate_sp.yaw")]
    frame, segments = windows.flight_windows(spark.createDataFrame(rows, "flight int, key string, us long, value double"))
    out = {r.flight: r for r in windows.assessment(frame).collect()}
    assert out[1].status == "full" and out[1].steady_s == pytest.approx(70, abs=0.2) and out[1].airborne_s == pytest.approx(110, abs=0.2)
    assert out[2].status == "partial" and out[2].steady_reason == "insufficient_steady_flight"
    assert segments.filter("flight = 1").select(F.sum("length_us")).first()[0] == pytest.approx(70e6, abs=2e5)


def test_samples_of_recordings_are_not_shuffled(spark, sf_dir):
    pairs = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    for name in ("aligned_recordings", "resampled_recordings"):
        assert _shuffled(spark, name, lambda name=name: plans.QUERIES[name](spark, sf_dir).collect()) < 6000 * pairs  # 5,000 samples each


def _shuffled(spark, group, run):
    """Bytes that the stages of a run write for others."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    run()
    sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}
    assert len(stages) > 3
    return sum(sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteBytes() for s in stages)


def test_recordings_that_are_made_in_place_are_those_that_are_gathered(spark, sf_dir):
    pairs, signals, gather = flights._recordings(spark, sf_dir)
    asked = pairs.filter("pair < 3").select("pair", F.lit("att.roll").alias("key"), F.lit(9).alias("n"), "real_log", "sim_log", F.lit(5).cast("long").alias("real_us"),
        F.lit(7).cast("long").alias("sim_us"))
    order = lambda side: F.array_sort(F.arrays_zip(f"{side}.us", f"{side}.value")).alias(side)
    made, told = (rows.select("pair", "key", "n", "real_us", "sim_us", order("real"), order("sim")).orderBy("pair").collect() for rows in (gather(asked),
        alignment.gathered(asked, signals)))
    assert made == told and len(made) == 3 and len(made[0].sim) == 2500 and made[0].sim[1].us == 31 * 20_000


def test_gaps_held_states_and_long_flights_are_resampled_like_samples_read_one_by_one(spark):
    rng, rows, by = np.random.default_rng(5), [], {}
    for log, late in (("r", 0), ("s", 13_000)):
        for key in ("gps.nsats", "alt.rel", f"only.{log}"):
            us = np.sort(rng.choice(2_400_000, 300, replace=False)) * 1000 + late
            us[0] = late
            values = [None if x < 0.1 else float("nan") if x < 0.15 else float(x) for x in rng.random(300)]
            by[log, key] = list(zip(us.tolist(), values, strict=True))
            rows += [(log, key, t, v) for t, v in by[log, key]]
    signals = spark.createDataFrame(rows, "log string, key string, us long, value double").repartition(7)
    aligned = spark.createDataFrame([(1, "r", "s", 0, 13_000, 0.02, 2390.0, None), (2, "r", "s", 0, 0, 0.0, 1.0, "insufficient_overlap")],
        "pair int, real_log string, sim_log string, real_us long, sim_us long, shift_s double, overlap_s double, reason string")
    out = alignment.resample(aligned, signals).toPandas()
    assert set(zip(out["pair"], out["key"], strict=True)) == {(1, "gps.nsats"), (1, "alt.rel")} and out["low_rate"].all() and out["upsampled"].all()

    def one(samples, t, hold):
        before, after = [s for s in samples if s[0] <= t], [s for s in samples if s[0] > t]
        if not before or not after:
            return samples[-1][1] if samples[-1][0] == t else None
        (a, v), (b, w) = before[-1], after[0]
        return v if hold else None if v is None or w is None else v + (t - a) / (b - a) * (w - v)

    for key, own in out.groupby("key"):
        own = own.sort_values("i")
        assert own["i"].tolist() == list(range(119_501)) and own["t_s"].iloc[-1] == 2390.0
    listed = alignment.resample(aligned, signals).filter("i % 997 = 0 OR i = 0").collect()
    for r in listed:
        for log, begin, found in (("r", 0, r.real), ("s", 33_000, r.sim)):
            want = one([(t - begin, v) for t, v in by[log, r.key]], r.i * 20_000, r.key == "gps.nsats")
            assert (found is None) == (want is None) and (want is None or found == pytest.approx(want, nan_ok=True)), (r, want)
    assert len(listed) > 200 and any(r.real is None for r in listed) and any(r.real is not None and np.isnan(r.real) for r in listed)


def test_filter_and_lags_are_those_of_sample_by_sample_sums():
    rng = np.random.default_rng(6)
    for n in (16, 63, 64, 65, 700):
        x = rng.standard_normal(n).cumsum()
        sections = alignment.butterworth_sections(50.0)
        assert sections is alignment.butterworth_sections(50.0)  # designed once, not for every pair

        def run(x, sections=sections):
            for b0, b1, b2, a1, a2 in sections.tolist():
                gain = (b0 + b1 + b2) / (1 + a1 + a2)
                s2 = (b2 - a2 * gain) * x[0]
                s1, out = (b1 - a1 * gain) * x[0] + s2, []
                for v in x:
                    y = b0 * v + s1
                    s1, s2 = b1 * v - a1 * y + s2, b2 * v - a2 * y
                    out.append(y)
                x = np.array(out)
            return x

        pad = min(15, n - 1)
        whole = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
        assert np.allclose(alignment.band_pass(x), run(run(whole)[::-1])[::-1][pad : pad + n], atol=1e-9)
    for n, late in ((40, 3), (700, -120), (900, 480)):  # lags up to nine tenths and more of the series
        a = rng.standard_normal(n)
        b = np.roll(a, late) + rng.standard_normal(n) * 0.1
        p, q = (alignment.band_pass(v) for v in (a, b))
        p, q = p - p.mean(), q - q.mean()
        most = min(500, n - 1)
        scores = [sum(p[i] * q[i - k] for i in range(max(0, k), min(n, n + k))) / np.sqrt((p @ p) * (q @ q)) for k in range(-most, most + 1)]
        lag, score = alignment.best_shift(a, b)
        assert lag == int(np.argmax(np.round(scores, 12))) - most and score == pytest.approx(max(scores))
