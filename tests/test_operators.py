"""Operators against hand-computed cases and independent numpy versions."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import catalogue, draws
from skyloom.functions import engineering as N
from skyloom.operators import baselines, calibration, distributions, epochs, features, kalman, latest, paths, scoring, series, sessions, spectral, status, store, trends, uncertainty

BASE = datetime(2024, 1, 1)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def readings(spark, rows):
    """rows: (second, battery, altitude) of one vehicle."""
    data = [(1, i, BASE + timedelta(seconds=s), int(s * 1e6), b, a, 50.0, 5.0, 10.0, 20.0, "flying") for i, (s, b, a) in enumerate(rows)]
    return spark.createDataFrame(data,
        "drone_id long, reading_id long, ts timestamp_ntz, us long, battery double, altitude double, temperature double, speed double, latitude double, longitude double, flight_state string")


# --- status and sessions


def test_linear_drain_is_recovered(spark):
    rows = readings(spark, [(60 * i, 100.0 - i, 1.0) for i in range(10)])
    r = status.battery_estimate(latest.newest(rows, 51)).first()
    assert r.drain_per_min == pytest.approx(-1.0) and r.minutes_remaining == pytest.approx(91.0) and r.confidence > 0.99
    assert status.battery_estimate(rows.limit(3)).count() == 0
    flat = status.battery_estimate(readings(spark, [(60 * i, 80.0, 1.0) for i in range(8)])).first()
    assert flat.minutes_remaining is None and flat.drain_per_min == 0


def test_same_time_stamps_have_no_slope(spark):
    r = status.battery_estimate(readings(spark, [(5, 50.0 + i, 1.0) for i in range(6)])).first()
    assert r.drain_per_min == 0 and r.minutes_remaining is None


def test_sessions_split_above_the_gap_only(spark):
    rows = readings(spark, [(0, 100.0, 1.0), (10, 95.0, 1.0), (20, 90.0, 1.0), (30, 80.0, 1.0), (7230, 100.0, 1.0), (7240, 95.0, 1.0), (7250, 85.0, 1.0)])
    r = sessions.lifetime(rows).first()
    assert (r.sessions, r.charges, r.readings) == (2, 1, 7) and r.flight_hours == pytest.approx(50 / 3600)
    even = sessions.lifetime(readings(spark, [(45 * i, None, 1.0) for i in range(24_401)])).first()
    assert even.sessions == 1 and even.maintenance and even.wear_percent >= 80
    assert sessions.sessions(readings(spark, [(0, 1.0, 1.0), (46, 1.0, 1.0)])).count() == 2
    assert sessions.lifetime(rows.limit(0)).count() == 0


def test_alerts_and_bands(spark):
    assert value(spark, status.alerts(F.lit(19.0), F.lit(81.0))) == ["LOW BATTERY", "OVERHEATING"]
    assert value(spark, status.alerts(F.lit(None).cast("double"), F.lit(80.0))) == []
    assert [value(spark, status.health_band(F.lit(r))) for r in (70, 69, 40, 39)] == ["critical", "warning", "warning", "healthy"]


# --- filters


def numpy_filter(times, values):
    out, x, p = [], None, None
    for i, (t, z) in enumerate(zip(times, values, strict=True)):
        dt = t - times[i - 1] if i else None
        if i and dt <= 0:
            continue
        if not i or dt > 30:
            x, p = np.array([z, 0.0]), np.eye(2) * 10
        else:
            f = np.array([[1, dt], [0, 1]])
            x, p = f @ x, f @ p @ f.T + 0.25 * np.array([[dt**4 / 4, dt**3 / 2], [dt**3 / 2, dt**2]])
            k = p[:, 0] / (p[0, 0] + 0.09)
            x, p = x + k * (z - x[0]), p - np.outer(k, p[0])
        out.append((x[0], x[1]))
    return out


def test_altitude_filter_against_matrices(spark):
    rng = np.random.default_rng(0)
    times = [0, 1, 2, 2, 3, 5, 40, 41, 42, 43]
    values = (np.array(times) * 1.5 + rng.normal(0, 0.3, len(times))).tolist()
    got = kalman.smooth(readings(spark, [(t, None, v) for t, v in zip(times, values, strict=True)])).orderBy("us", "reading_id").collect()
    true = numpy_filter(times, values)
    assert len(got) == len(true) == 9
    assert np.allclose([(r.filtered, r.velocity) for r in got], true)
    assert [r.nis is None for r in got] == [True] + [False] * 4 + [True] + [False] * 3


def test_fault_is_found_and_healthy_noise_is_not(spark):
    rng = np.random.default_rng(3)
    height = 20 + rng.normal(0, 0.3, 300)
    assert kalman.fault_runs(kalman.smooth(readings(spark, [(i, None, float(h)) for i, h in enumerate(height)]))).count() == 0
    height[150:] += np.linspace(20, 200, 150)
    found = kalman.fault_runs(kalman.smooth(readings(spark, [(i, None, float(h)) for i, h in enumerate(height)]))).orderBy("start_us").first()
    assert found.severity == "CRITICAL" and 150e6 <= found.start_us <= 160e6


def test_fused_state_stays_finite_with_gaps(spark):
    rows = readings(spark, [(i, None, float(i)) for i in range(20)] + [(200 + i, None, 5.0) for i in range(3)])
    blank = F.when(F.col("reading_id") % 3 != 0, F.col("latitude"))
    rows = rows.withColumns({"latitude": blank, "roll": F.lit(1.0), "pitch": F.lit(None).cast("double"), "yaw": F.lit(2.0)})
    out = kalman.fuse(rows).orderBy("us").collect()
    assert len(out) == 23 and all(math.isfinite(r.x) and math.isfinite(r.position_std) for r in out)
    assert out[20].z == 5.0 and out[20].vz == 0.0


def test_fused_state_is_that_of_a_matrix_filter(spark):
    """Joint updates with matrix inverses, and blocks moved by their own transition matrices, give the same states."""
    rng = np.random.default_rng(8)
    rows = [(1, i, int(i * 1e6), 10 + i * 1e-5 + rng.normal(0, 1e-6), 20 + i * 2e-5, 30.0 + i * 0.4, float(rng.normal(2.5, 0.3)), *map(float, rng.normal(0, 3, 3))) for i in range(30)]
    rows[7] = (*rows[7][:3], None, None, *rows[7][5:])
    rows[11] = (*rows[11][:6], None, *rows[11][7:9], None)
    frame = spark.createDataFrame(rows, "drone_id int, reading_id int, us long, latitude double, longitude double, altitude double, speed double, roll double, pitch double, yaw double")
    out = kalman.fuse(frame).orderBy("us").collect()
    x, p = None, None
    for n, (_, _, us, lat, lon, alt, speed, *angles) in enumerate(rows):
        east = None if lon is None else math.radians(lon - rows[0][4]) * 6_371_000 * math.cos(math.radians(rows[0][3]))
        north = None if lat is None else math.radians(lat - rows[0][3]) * 6_371_000
        if x is None:
            x, p = np.array([east, north, alt, 0, 0, 0, *angles], float), np.eye(9) * 10
        else:
            moved = p.copy()
            for i in range(3):
                at, f = np.ix_([i, i + 3], [i, i + 3]), np.array([[1.0, 1.0], [0.0, 1.0]])
                moved[at] = f @ p[at] @ f.T + 0.25 * np.array([[0.25, 0.5], [0.5, 1.0]])
                moved[6 + i, 6 + i] += 4.0
            x, p = x + np.r_[x[3:6], np.zeros(6)], moved
        for at, values, r in (([0, 1, 2], [east, north, alt], 0.09), ([6, 7, 8], angles, 4.0)):
            if None not in values:
                h = np.eye(9)[at]
                gain = p @ h.T @ np.linalg.inv(h @ p @ h.T + r * np.eye(3))
                x, p = x + gain @ (np.array(values) - h @ x), (np.eye(9) - gain @ h) @ p
        pace = np.linalg.norm(x[3:6])
        if speed is not None and pace >= 1e-6:
            h = np.r_[np.zeros(3), x[3:6] / pace, np.zeros(3)][None]
            gain = p @ h.T / (h @ p @ h.T + 0.25)
            x, p = x + gain[:, 0] * (speed - pace), (np.eye(9) - gain @ h) @ p
        r = out[n]
        assert np.allclose([r.x, r.y, r.z, r.vx, r.vy, r.vz, r.roll_est, r.pitch_est, r.yaw_est], x, atol=1e-6)
        assert r.position_std == pytest.approx(math.sqrt(p[0, 0] + p[1, 1] + p[2, 2]))


# --- series


def signal(spark, rows):
    return spark.createDataFrame([(1, i, int(t * 1e6), float(v)) for i, (t, v) in enumerate(rows)], "key long, seq long, us long, value double")


def test_cleaning_and_clock_jump(spark):
    rows = signal(spark, [(0, 1), (1, math.nan), (2, 3), (2, 4), (3, math.inf)])
    out = series.clean(rows).orderBy("us").collect()
    assert [(r.us, r.value, r.noisy) for r in out] == [(0, 1.0, True), (2_000_000, 3.0, True)]
    turned = signal(spark, [(10, 1), (11, 1), (0, 1), (1, 1), (2, 1)])
    assert series.cut_clock_jump(turned).count() == 3
    assert series.cut_clock_jump(signal(spark, [(10, 1), (11, 1), (0, 1), (1, 1)])).agg(F.min("us")).first()[0] == 10_000_000


def test_grid_and_interpolation_against_numpy(spark):
    rng = np.random.default_rng(1)
    t, v = np.sort(rng.uniform(0, 20, 50)), rng.normal(size=50)
    t[0] = 0.0
    rows = signal(spark, zip(t, v, strict=True))
    out = series.on_grid(rows, 500_000).orderBy("i").collect()
    us = np.array((t * 1e6).astype(int), float)
    at = np.arange(len(out)) * 500_000.0
    true = np.interp(at, us, v)
    assert len(out) == max(2, round((us[-1] - us[0]) / 500_000) + 1)
    for r, x, where in zip(out, true, at, strict=True):
        assert (r.value is None) == (where > us[-1]) and (r.value is None or r.value == pytest.approx(x))
    held = series.on_grid(rows, 500_000, hold=True).orderBy("i").collect()
    assert held[3].value == pytest.approx(v[np.searchsorted(us, at[3], side="right") - 1])


def test_runs_phases_and_anchor(spark):
    rows = signal(spark, enumerate([0, 1, 1, 0, 1, 1, 1, 0]))
    best = series.longest_run(rows, F.col("value") > 0.5).first()
    assert (best.start_us, best.next_us, best.n) == (4_000_000, 7_000_000, 3)
    assert series.first_lasting(rows, F.col("value") > 0.5, 3).first().us == 4_000_000
    angles = signal(spark, enumerate([350, 10, 20, 340]))
    assert [r.unwrapped for r in series.unwrapped(angles).orderBy("us").collect()] == [350, 370, 380, 340]
    spans = spark.createDataFrame([(1, 1_000_000, 3_000_000)], "key long, start_us long, end_us long")
    assert series.counter_rate(signal(spark, [(0, 5), (2, 9), (3, 4)]), spans).first().reason == "counter_reset"
    assert series.counter_rate(signal(spark, [(0, 5), (2, 9)]), spans).first().per_minute == pytest.approx(4 * 30)


# --- distributions and spectra


def pairs(spark, real, sim):
    return spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(real, sim, strict=True))],
        "pair long, i long, real double, sim double")


def test_comparison_identities(spark):
    x = np.random.default_rng(4).normal(size=400)
    same = distributions.compare(pairs(spark, x, x)).first()
    assert same.rmse == same.bias == same.wasserstein == same.ks == 0 and same.kl_bits == pytest.approx(0) and same.pearson_r == pytest.approx(1)
    moved = distributions.compare(pairs(spark, x, x + 2)).first()
    assert moved.bias == pytest.approx(2) and moved.wasserstein == pytest.approx(2) and moved.variance_ratio == pytest.approx(1)
    stuck = distributions.compare(pairs(spark, x, np.ones(400))).first()
    assert stuck.degenerate and stuck.wasserstein is None and stuck.variance_ratio_reason == "sim_variance_degenerate"


def test_distances_against_numpy(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(0, 1, 300).round(1), rng.normal(0.3, 1.4, 300).round(1)
    r = distributions.distances(distributions.both_sides(pairs(spark, a, b))).first()
    grid = np.unique(np.r_[a, b])
    fa, fb = (np.searchsorted(np.sort(s), grid, side="right") / 300 for s in (a, b))
    assert r.ks == pytest.approx(np.abs(fa - fb).max())
    assert r.wasserstein == pytest.approx(np.abs(np.sort(a) - np.sort(b)).mean())


def test_effective_samples(spark):
    x = np.random.default_rng(6).normal(size=500)
    c = x - x.mean()
    phi = (c[:-1] @ c[1:]) / (c @ c)
    assert distributions.effective_samples(pairs(spark, x, x)).first().n_eff == pytest.approx(500 * (1 - phi) / (1 + phi))
    assert distributions.effective_samples(pairs(spark, [1, 1, 1, 1], [1, 1, 1, 1])).first().n_eff is None


def test_welch_against_numpy(spark):
    x = np.random.default_rng(7).normal(size=1000) + np.sin(np.arange(1000) * 2 * np.pi * 10 / 50)
    out = spectral.welch(signal(spark, enumerate(x)), 50.0).orderBy("bin").collect()
    n = 64
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    parts = [np.abs(np.fft.rfft((x[s : s + n] - x[s : s + n].mean()) * w)) ** 2 / (50 * (w**2).sum()) for s in range(0, 1000 - n + 1, n // 2)]
    true = np.mean(parts, axis=0)
    true[1:-1] *= 2
    assert np.allclose([r.power for r in out], true) and max(out, key=lambda r: r.power).hz == pytest.approx(10, abs=0.5)


def test_lag_is_recovered(spark):
    x = np.random.default_rng(8).normal(size=200)
    frame = spark.createDataFrame([(x[:-3].tolist(), x[3:].tolist())], "a array<double>, b array<double>")
    scores = spectral.correlation_lags(F.col("a"), F.col("b"), 5)
    lag, score, _ = spectral.best_lag(F.col("s"), 5)
    r = frame.select(scores.alias("s")).select(lag.alias("lag"), score.alias("score")).first()
    assert r.lag == 3 and r.score > 0.9


# --- health


def observed(spark, values, feature="act.hover", **more):
    table = {k: (sub, tier) for k, sub, tier in catalogue.FEATURES}
    rows = [(1, "epoch:initial", feature, i, v, more.get("qualified", {}).get(i, True), v is not None, False) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows,
        "drone_id long, baseline_group string, feature_key string, flight_index int, value double, qualified boolean, valid boolean, absolute_bad boolean")
    assert feature in table
    return frame.join(F.broadcast(catalogue.features(spark)), "feature_key").withColumns({"autopilot": F.lit("px4"), "reason": F.lit(None).cast("string")})


def test_outliers_are_quarantined_and_never_learned(spark):
    frame = baselines.admit(observed(spark, [0.5, 0.51, 0.49, 0.5, 0.5, 0.5, 0.9, 0.91, 0.9]))
    out = frame.orderBy("flight_index").collect()
    assert [r.admitted for r in out] == [True] * 6 + [False] * 3 and {r.quarantine_reason for r in out[6:]} == {"outlier"}
    assert out[8].n_before == 6 and out[8].base_median == pytest.approx(0.5)
    change = baselines.inferred_changes(frame).first()
    assert change.direction == "up" and change.max_pairwise_z <= 2
    assert [r.quarantine_reason for r in baselines.admit(observed(spark, [0.5, None],
        qualified={0: False})).orderBy("flight_index").collect()] == ["flight_not_qualified", "feature_invalid"]


def test_scores_follow_baseline_and_norms(spark):
    rows = scoring.with_absolute(observed(spark, [0.5] * 6 + [0.56]), catalogue.norms(spark)).drop("absolute_bad").withColumn("absolute_bad", F.lit(False))
    out = scoring.score_features(baselines.admit(rows)).orderBy("flight_index").collect()
    assert [r.status for r in out[:3]] == ["learning", "learning", "scored"] and out[2].score == 100 and out[6].z == pytest.approx(3.0) and out[6].score == 70
    assert value(spark, scoring.graded(F.lit(15.0), F.lit(10.0), F.lit(20.0))) == pytest.approx(67.5)
    assert [value(spark, scoring.band(F.lit(s))) for s in (85.0, 70.0, 50.0, 49.9)] == ["fine", "watch", "off", "bad"]


def test_drift_and_step_callouts(spark):
    drift = trends.callouts(baselines.admit(observed(spark, [0.5] * 5 + [0.5 + 0.006 * k for k in range(1, 11)]))).first()
    assert drift.drift and not drift.step and drift.delta == pytest.approx(0.06)
    step = trends.callouts(baselines.admit(observed(spark, [0.5] * 6 + [0.75, 0.75, 0.75]))).first()
    assert step.step and not step.drift
    calm = trends.callouts(baselines.admit(observed(spark, [0.5, 0.51] * 4))).first()
    assert not calm.step and not calm.drift


def test_epochs_take_the_later_event_of_a_flight(spark):
    events = spark.createDataFrame([(1, 2, 0, "a", "props"), (1, 2, 1, "b", "props"), (1, 4, 2, "c", "gps")],
        "drone_id long, flight_index int, seq long, epoch string, change_type string")
    flights = spark.createDataFrame([(1, i, "act.hover") for i in range(6)], "drone_id long, flight_index int, feature_key string")
    out = epochs.feature_epoch(flights, events, catalogue.reset_features(spark)).orderBy("flight_index").collect()
    assert [r.epoch for r in out] == [None, None, "b", "b", "b", "b"]
    assert [r.epoch for r in epochs.latest_epoch(flights.drop("feature_key"), events).orderBy("flight_index").collect()] == [None, None, "b", "b", "c", "c"]


def test_absent_parameters_are_no_change(spark):
    rows = [(1, 0, "MC_ROLL_P", "6.5"), (1, 1, "MC_ROLL_P", "6.5000001"), (1, 2, "MC_ROLL_P", "7.0"), (1, 4, "MC_ROLL_P", "8.0"), (1, 0,
        "CA_ROTOR7_PX", "1"), (1, 1, "CA_ROTOR7_PX", "2"), (1, 0, "CA_ROTOR_COUNT", "4"), (1, 1, "CA_ROTOR_COUNT", "4"),
        (1, 0, "OTHER", "1"), (1, 1, "OTHER", "2")]
    out = epochs.parameter_changes(spark.createDataFrame(rows, "drone_id long, flight_index int, name string, value string")).collect()
    assert [(r.flight_index, r.name, r.new) for r in out] == [(2, "MC_ROLL_P", "7.0")]


def test_forbidden_claims(spark):
    texts = {"Motor spread 12%, usual 4%": [], "about 20 flights left on this pack": ["remaining life"],
        "The pack is at 80 % health": ["battery capacity"], "Safe to fly, better than most drones": ["safe to fly", "other drones"]}
    for text, kinds in texts.items():
        assert value(spark, catalogue.forbidden_claims(F.lit(text))) == kinds


# --- features and calibration


def test_resistance_is_recovered(spark):
    rng = np.random.default_rng(9)
    amps, mah = rng.uniform(5, 30, 400), np.linspace(0, 2000, 400)
    volts = 25.2 - 0.0006 * mah - 0.03 * amps + rng.normal(0, 0.002, 400)
    rows = spark.createDataFrame([(1, *map(float, r)) for r in zip(volts, amps, mah, strict=True)], "flight long, volts double, amps double, mah double")
    r = features.pack_resistance(rows, F.lit(6.0)).first()
    assert r.r_cell_mohm == pytest.approx(5.0, rel=0.05) and r.reason is None and r.r2 > 0.99
    assert features.pack_resistance(rows.withColumn("amps", F.lit(10.0))).first().reason == "insufficient_current_range"


@pytest.mark.parametrize(("means", "pattern", "detail"), [([0.5, 0.5, 0.5, 0.5], "balanced", None), ([0.6, 0.5, 0.5, 0.5],
    "single_motor_high", "1"), ([0.55, 0.5, 0.55, 0.5], "one_side_high", "front"), ([0.55, 0.55, 0.5, 0.5], "same_spin_set_high", "+")])
def test_motor_patterns(spark, means, pattern, detail):
    shape = [(0.2, 0.2, 0.05), (-0.2, -0.2, 0.05), (0.2, -0.2, -0.05), (-0.2, 0.2, -0.05)]
    geometry = spark.createDataFrame([(1, i, *g) for i, g in enumerate(shape)], "flight long, motor int, px double, py double, km double")
    r = features.motor_pattern(spark.createDataFrame([(1, i, m) for i, m in enumerate(means)], "flight long, motor int, mean double"), geometry).first()
    assert (r.pattern, r.detail) == (pattern, detail)


def test_attitude_angle(spark):
    half = math.radians(10) / 2
    angle = features.quaternion_angle([F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)], [F.lit(-2 * math.cos(half)), F.lit(-2
        * math.sin(half)), F.lit(0.0), F.lit(0.0)])
    assert value(spark, angle) == pytest.approx(10)


def test_calibration_of_idle_samples(spark):
    rng = np.random.default_rng(10)
    rows = [(1, *map(float, rng.normal([0, 0, 9.81, 0, 0, 0], 0.05))) for _ in range(50)]
    schema = "drone_id long, accel_x double, accel_y double, accel_z double, gyro_x double, gyro_y double, gyro_z double"
    assert calibration.imu_check(spark.createDataFrame(rows, schema)).first().overall
    assert calibration.imu_check(spark.createDataFrame(rows[:5], schema)).first().reason == "insufficient_samples"


# --- engineering


def test_atmosphere_battery_and_rotor(spark):
    assert value(spark, N.air_density(F.lit(0.0), F.lit(15.0))) == pytest.approx(1.225, abs=1e-3)
    assert value(spark, N.air_density(F.lit(3000.0), F.lit(-4.5))) == pytest.approx(0.909, abs=0.01)
    assert [value(spark, N.battery_capacity(F.lit(float(t)))) for t in (-30, -15, 7.5, 20, 50)] == pytest.approx([0.5, 0.6, 0.875, 1.0, 1.0])
    ct = value(spark, N.standard_blade()["ct"])
    assert ct == pytest.approx(0.0104, abs=0.0005)
    lam = value(spark, N.glauert_inflow(F.lit(ct), F.lit(0.1)))
    assert lam == pytest.approx(ct / (2 * math.hypot(0.1, lam)), rel=1e-6)


def test_max_altitude_is_where_rpm_runs_out(spark):
    altitude, capped = N.max_altitude(F.lit(4.0), F.lit(0.254), F.lit(7600.0))
    h = value(spark, altitude)
    need = value(spark, N.required_rpm(F.lit(4.0), N.air_density(F.lit(h), F.lit(15 - 0.0065 * h)), F.lit(0.254)))
    assert 0 < h < 9000 and need == pytest.approx(7600, rel=1e-6) and not value(spark, capped)
    assert value(spark, N.tilt_limit(F.lit(2.0))) == pytest.approx(60.0)


def test_step_response_against_closed_form(spark):
    frame = spark.range(1).select(N.step_response(F.lit(15.0), F.lit(0.15), F.lit(8.0), 4.0, 50.0).alias("r")).first().r
    actual = np.array([x["actual"] for x in frame])
    t = np.array([x["t"] for x in frame]) - 0.5
    wd = 8 * math.sqrt(1 - 0.15**2)
    true = np.where(t > 0, 15 * (1 - np.exp(-1.2 * t) * (np.cos(wd * t) + 0.15 / math.sqrt(1 - 0.15**2) * np.sin(wd * t))), 0)
    assert np.abs(actual - true).max() < 0.15
    assert actual.max() / 15 - 1 == pytest.approx(value(spark, N.step_metrics(F.lit(0.15), F.lit(8.0))["overshoot_percent"]) / 100, abs=0.02)


def test_draws_are_uniform_and_summaries_contain_the_point(spark):
    u = np.array([r.u for r in spark.range(5000).select(draws.uniform(F.col("id"), 3).alias("u")).collect()])
    assert 0 < u.min() and u.max() < 1 and u.mean() == pytest.approx(0.5, abs=0.02) and u.std() == pytest.approx(math.sqrt(1 / 12), abs=0.01)
    s = uncertainty.summary(uncertainty.blade_draws(spark, 300), "ct").first()
    assert s.p05 < value(spark, N.standard_blade()["ct"]) < s.p95


# --- paths and store


def test_search_goes_around_and_is_cheapest(spark):
    asked = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 0.0), (2, 0.0, 0.0, 5.0, 0.0)],
        "request long, start_x double, start_y double, goal_x double, goal_y double")
    scene = spark.createDataFrame([(1, 2.5, y / 2) for y in range(-2, 3)], "request long, x double, y double")
    ways = paths.plan(asked, scene)
    length = {r.path: r.metres for r in paths.path_length(ways.withColumnRenamed("request", "path"), axes=("x", "y")).collect()}
    assert length[2] == pytest.approx(5.0) and 5.5 < length[1] < 9
    near = ways.filter("request = 1 AND i > 0").crossJoin(scene.select(F.col("x").alias("ox"),
        F.col("y").alias("oy"))).select(F.min(F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")))).first()[0]
    assert near > paths.RADIUS


def test_plane_and_space_searches_agree(spark):
    flat = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 3.0)], "request long, start_x double, start_y double, goal_x double, goal_y double")
    none = spark.createDataFrame([], "request long, x double, y double, z double")
    solid = flat.withColumns({"start_z": F.lit(0.0), "goal_z": F.lit(0.0)})
    one = paths.path_length(paths.plan(flat, none.drop("z")).withColumnRenamed("request", "path"), axes=("x", "y")).first().metres
    two = paths.path_length(paths.plan(solid, none, axes=("x", "y", "z")).withColumnRenamed("request", "path")).first().metres
    assert one == pytest.approx(two)


def test_risk_is_that_of_all_draws_of_all_obstacles():
    import inspect

    assert inspect.signature(paths.plan).parameters["draws"].default == uncertainty.DRAWS == 2000
    rng = np.random.default_rng(3)
    fixed = rng.normal(0, 3, (11, 2))
    places = fixed[:, None, :] + rng.normal(0, 0.3, (11, 2000, 2))
    risk = paths.risk_of(fixed, places, 0.6)
    for point in rng.normal(0, 3, (300, 2)):
        assert risk(point) == pytest.approx(1 - np.prod(1 - (np.sqrt(((places - point) ** 2).sum(axis=2)) <= 0.6).mean(axis=1)), abs=1e-12)


def test_trajectory_keeps_limits_and_ends():
    way = np.array([[0.0, 0, 0], [2, 1, 0], [4, 0, 1], [6, 0, 0]])
    rows, fine = paths.trajectory(way, np.empty((0, 3)), 5.0, 2.5, 0.2, 0.6)
    v = np.sqrt((np.diff(rows[:, 1:], axis=0) ** 2).sum(axis=1)) * 20
    assert fine and v.max() <= 5.0 * 1.01 and np.allclose(rows[0, 1:], way[0]) and np.abs(rows[-1, 1:] - way[-1]).max() < 0.2


def test_store_operations(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a", False), (2, 1, "a", True), (3, 1, "a", False), (4, 2, "a", False), (5, 1, None, False)],
        "id long, drone_id long, text string, failed boolean")
    kept = store.first_by_content(rows, ["drone_id"], F.coalesce("text", F.lit("")), ["id"], F.col("failed"))
    assert sorted(r.id for r in kept.collect()) == [1, 4, 5]
    left, gone = store.without(rows, rows.filter("drone_id = 2"), "drone_id")
    assert left.count() == 4 and gone.first().deleted == 1
    path = str(tmp_path / "t")
    store.replace_partitions(rows, path, ["drone_id"])
    store.replace_partitions(rows.filter("drone_id = 2").withColumn("text", F.lit("b")), path, ["drone_id"])
    assert sorted((r.id, r.text) for r in spark.read.parquet(path).collect() if r.id in (1, 4)) == [(1, "a"), (4, "b")]
