"""What must hold on large tables: work spread over tasks, done once, and results at the edges that only many rows meet."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skyloom import plans
from skyloom.functions import catalogue
from skyloom.functions import engineering as N
from skyloom.operators import alignment, baselines, distributions, paths, scans, series, windows


def test_a_step_a_rounding_error_beyond_half_a_turn_goes_the_short_way(spark):
    beyond = 180 + 2.842170943040401e-14
    rows = spark.createDataFrame([(1, 0, beyond), (1, 1, 0.0), (1, 2, 10.0)], "key long, us long, value double")
    out = [r.unwrapped for r in series.unwrapped(rows).orderBy("us").collect()]
    assert np.allclose(out, [180, 360, 370])


def test_step_responses_are_those_of_single_steps_and_run_in_many_tasks(spark, sf_dir):
    def stepped(d: float, zeta: float, omega: float) -> list[float]:
        x, v, out, h = 0.0, 0.0, [0.0], N.DT_S
        for i in range(4000):
            slope = lambda t, x, v: omega * omega * ((d if t >= N.STEP_AT_S else 0.0) - x) - 2 * zeta * omega * v
            t = i * h
            a1 = slope(t, x, v)
            v2 = v + a1 * h / 2
            a2 = slope(t + h / 2, x + v * h / 2, v2)
            v3 = v + a2 * h / 2
            a3 = slope(t + h / 2, x + v2 * h / 2, v3)
            v4 = v + a3 * h
            a4 = slope(t + h, x + v3 * h, v4)
            x, v = x + h / 6 * (v + 2 * v2 + 2 * v3 + v4), v + h / 6 * (a1 + 2 * a2 + 2 * a3 + a4)
            if i % 20 == 19:
                out.append(x)
        return out

    for tuning in ((15.0, 0.15, 8.0), (30.0, 1.0, 8.0), (10.0, 1.7, 12.0)):
        found = spark.range(1).select(N.step_response(*map(F.lit, tuning), 4.0, 50.0).alias("r")).first().r
        assert len(found) == 201 and np.allclose([x["actual"] for x in found], stepped(*tuning), rtol=0, atol=1e-9)
        assert [x["desired"] for x in found[24:26]] == [0.0, tuning[0]]
    for duration in (0.4, 0.5):  # over before the command, or as it begins
        short = spark.range(1).select(N.step_response(F.lit(15.0), F.lit(0.5), F.lit(8.0), duration, 50.0).alias("r")).first().r
        assert len(short) == round(duration * 50) + 1 and max(abs(x["actual"]) for x in short) < 1e-2
    assert plans.QUERIES["step_response"](spark, sf_dir).rdd.getNumPartitions() >= 4


def test_the_standard_blade_is_solved_once_and_the_inflow_once_for_each_row(spark, sf_dir):
    solved = spark.range(1).select(N.blade_coefficients(*map(F.lit, (N.LIFT_SLOPE, N.CD0, N.CHORD_RATIO, N.ROOT_DEG, N.TIP_DEG))).alias("b")).first().b
    assert spark.range(1).select(N.standard_blade().alias("b")).first().b == solved
    for name, folds in (("blade_element_hover", 0), ("wind_power", 1)):
        plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("aggregate(") == folds


def test_pairs_are_aligned_from_two_passes_over_their_samples(spark):
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passes.add(len(batch))
            yield batch

    us = np.arange(3000) * 20_000
    wave = np.sin(us / 2e6) + np.sin(us / 7e5)
    rows = [(log, "att.roll", int(t), float(v)) for log, values in (("r", wave), ("s", np.roll(wave, 25))) for t, v in zip(us, values, strict=True)]
    signals = spark.createDataFrame(rows, "log string, key string, us long, value double").mapInPandas(counted, "log string, key string, us long, value double")
    pairs = spark.createDataFrame([(1, "r", "s")], "pair long, real_log string, sim_log string")
    found = alignment.align(pairs, signals).first()
    assert abs(found.shift_s + 0.5) < 0.03 and found.quality == "fine"
    assert passes.value <= 5 * len(rows)  # samples, and those that only name the flight's beginning
    asked = np.array([-1, 0, 5, 10, 25, 40], float)
    assert np.allclose(alignment.on_grid(np.array([20, 0, 10]), np.array([4.0, 0, 1]), asked), [np.nan, 0, 0.5, 1, np.nan, np.nan], equal_nan=True)


def test_searches_are_spread_and_ask_for_the_risk_of_cells_together(spark, sf_dir):
    asked = []

    def risk(points):
        asked.append(len(points))
        return np.zeros(len(points))

    way = paths.search(np.zeros(2), np.array([4.0, 0.2]), np.empty((0, 2)), 0.6, 0.5, 3.0, risk)
    assert len(way) == 9 and sum(asked) > 2 * len(asked)
    assert paths.search(np.zeros(2), np.array([4.0, 0.0]), np.array([[0.0, 0.0], [4.0, 0.0]]), 0.6, 0.5, 3.0) != []  # ends are free
    around = np.array([[x, y] for x in np.arange(-1, 1.1, 0.5) for y in np.arange(-1, 1.1, 0.5) if max(abs(x), abs(y)) == 1])
    assert paths.search(np.zeros(2), np.array([4.0, 0.0]), around, 0.3, 0.5, 3.0) == []
    for name in ("grid_path_2d", "risk_aware_path", "smooth_trajectory"):
        assert plans.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= 4


def test_parameters_are_sorted_in_parts_that_do_not_grow(spark, sf_dir, monkeypatch):
    rows = spark.range(1000).withColumnRenamed("id", "key")
    monkeypatch.setattr(scans, "TASK_ROWS", 100)
    assert scans.dealt(rows, 1000, "key").rdd.getNumPartitions() == 10
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    for name in ("parameter_changes", "parameter_events"):
        assert plans.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= orders // 100


def test_a_name_is_watched_where_it_tells_a_change(spark):
    names = ["MC_ROLLRATE_P", "firmware_version", "BAT1_CAPACITY", "CA_ROTOR5_PX", "CA_ROTOR_COUNT", "COM_OTHER", "XBAT1_CAPACITY", ""]
    out = spark.createDataFrame([(n,) for n in names], "name string").select(catalogue.is_watched(F.col("name")).alias("w"), catalogue.change_type(F.col("name")).alias("c")).collect()
    assert all(r.w == (r.c is not None) for r in out) and sum(r.w for r in out) >= 5


def test_a_gate_takes_medians_anew_only_after_an_admission(monkeypatch):
    taken = []
    monkeypatch.setattr(baselines, "median", lambda values: taken.append(1) or sorted(values)[len(values) // 2])
    step = baselines.gate()
    for i in range(6):
        step(10.0 + i, True, True, False, 0.5, 0.0, True)
    before = len(taken)
    last = [step(1e6, True, True, False, 0.5, 0.0, True) for _ in range(5)]
    assert len(taken) <= before + 4 and {r[1] for r in last} == {"outlier"}
    assert step(10.0, True, True, False, 50.0, 0.0, True)[5] == 50.0  # other floors


def test_features_sort_the_lines_of_a_flight_a_few_times(spark, sf_dir):
    plan = plans.QUERIES["feature_extraction"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("windowspecdefinition(flight") > 0
    assert sum("l_linenumber" in line and "Window" in line for line in plan.splitlines()) <= 2  # 25 before


def test_quantiles_of_keys_that_a_task_holds_and_of_larger_ones(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(k), None if i % 50 == 7 else float(x)) for k, n in ((1, 900), (2, 40), (3, 1), (4, 700)) for i, x in enumerate(rng.normal(0, 9, n).round(1))]
    frame, shares = spark.createDataFrame([*rows, (5, None)], "k int, v double"), [0.0, 0.25, 0.5, 0.95, 1.0]
    plain = scans.quantiles(frame, ["k"], "v", shares)
    assert "MapInPandas" not in plain._jdf.queryExecution().toString()
    monkeypatch.setattr(scans, "TASK_ROWS", 500)
    split = scans.quantiles(frame, ["k"], "v", shares)
    assert "MapInPandas" in split._jdf.queryExecution().toString()
    for found in (plain, split):
        out = {r.k: r for r in found.collect()}
        assert set(out) == {1, 2, 3, 4}
        for k in out:
            own = [v for key, v in rows if key == k and v is not None]
            assert out[k].n == len(own) and np.allclose(out[k].q, np.quantile(own, shares), rtol=0, atol=1e-9)


def test_steady_stretches_are_those_of_every_grid_point_without_making_them(spark):
    rng = np.random.default_rng(5)
    rows, values = [], {}
    for flight in range(6):
        rows += [(flight, "land.landed", us, landed) for us, landed in ((0, 1.0), (1_000_000 + flight, 0.0), (90_000_000, 1.0), (99_000_000, 1.0))]
        for key in windows.STEADY_SIGNALS[: 4 if flight else 3]:
            us = np.unique(np.concatenate([rng.integers(0, 95_000_000, 60), [1_000_000 + flight + 40_000, 80_000_000]]))
            v = rng.choice([0.05, 0.1, -0.2, 0.31, 0.3, 0.5, -0.9], len(us), p=[0.4, 0.3, 0.2, 0.025, 0.025, 0.025, 0.025])
            rows += [(flight, key, int(a), float(b)) for a, b in zip(us, v, strict=True)]
            values[flight, key] = us, v
    frame, segments = windows.flight_windows(spark.createDataFrame(rows, "flight int, key string, us long, value double"), scale=0.2)
    assert "Sequence(0" not in frame._jdf.queryExecution().toString() and "sequence(0" not in frame._jdf.queryExecution().toString()
    found = {}
    for r in segments.collect():
        found.setdefault(r.flight, []).append((r.start_us, r.end_us, r.n))
    for flight in range(6):
        start, end = 1_000_000 + flight, 90_000_000
        grid = start + 20_000 * np.arange(round((end - start) / 20_000) + 1)
        small = np.full(len(grid), flight > 0)
        for key in windows.STEADY_SIGNALS[: 4 if flight else 3]:
            us, v = values[flight, key]
            at = np.abs(np.interp(grid, us, v, left=np.nan, right=np.nan))
            small &= at < (0.5 if key == "vel.z" else 0.3)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], small.astype(int), [0]])))
        own = [(int(grid[a]), int(grid[b - 1]), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True) if grid[b - 1] - grid[a] >= 980_000]
        assert sorted(found.get(flight, [])) == own and (own or not flight)


def test_distances_of_pairs_that_a_task_holds_and_of_larger_ones(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(p, s, None if i % 40 == 3 else float(x)) for p, n, m in ((1, 500, 300), (2, 20, 31), (3, 4, 0)) for s, k in ((1, n), (0, m))
        for i, x in enumerate(rng.normal(s, 2, k).round(1))]
    sides = spark.createDataFrame(rows, "pair int, side int, value double")
    plain = distributions.distances(sides)
    assert "MapInPandas" not in plain._jdf.queryExecution().toString()
    monkeypatch.setattr(scans, "TASK_ROWS", 200)
    both = distributions.distances(sides)
    assert "MapInPandas" in both._jdf.queryExecution().toString()
    for found in (plain, both):
        out = {r.pair: r for r in found.collect()}
        assert set(out) == {1, 2, 3} and out[3].wasserstein is None and out[3].ks is None
        for p in (1, 2):
            a, b = (np.sort([v for q, s, v in rows if q == p and s == side and v is not None]) for side in (1, 0))
            every = np.unique(np.concatenate([a, b]))
            gap = np.abs(np.searchsorted(a, every, side="right") / len(a) - np.searchsorted(b, every, side="right") / len(b))
            assert np.isclose(out[p].ks, gap.max()) and np.isclose(out[p].wasserstein, (gap[:-1] * np.diff(every)).sum())


def test_bins_of_pairs_that_a_task_holds_need_no_second_pass(spark, sf_dir):
    plan = plans.QUERIES["histogram_bins"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan and "ExistingRDD" not in plan
