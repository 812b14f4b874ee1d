"""Scans over ranges: what one task would say, for keys of any size, and no key in one task."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import baselines, distributions, kalman, scans


def skewed(spark, n=20_000):
    """A third of all rows, and more, in one key; ties, nulls and a null key."""
    rng = np.random.default_rng(0)
    keys = np.where(rng.random(n) < 0.6, 7, rng.integers(0, 40, n))
    values = np.where(rng.random(n) < 0.2, 5.0, rng.normal(0, 10, n)).round(2)
    rows = [(None if k == 39 else int(k), None if i % 50 == 0 else float(v), i) for i, (k, v) in enumerate(zip(keys, values, strict=True))]
    return spark.createDataFrame(rows, "k int, v double, i int").repartition(7), rows


def test_pieces_get_what_lies_before_and_after(spark):
    frame, rows = skewed(spark, 5000)

    def run(piece, before, after):
        return piece.assign(before=before or 0, after=after or 0, n=len(piece))[["k", "i", "before", "after", "n"]]

    out = scans.scanned(frame.select("k", "i"), ["k"], ["i"], len, lambda a, b: a + b, run, "k int, i int, before long, after long, n long", parts=16)
    own = out.toPandas()
    own["k"] = own["k"].fillna(-1)
    totals = {k: sum((-1 if r[0] is None else r[0]) == k for r in rows) for k in own["k"].unique()}
    for (k, before), piece in own.groupby(["k", "before"]):
        assert len(piece) == piece["n"].iloc[0] and before + len(piece) + piece["after"].iloc[0] == totals[k]
        earlier = own[(own["k"] == k) & (own["before"] < before)]
        assert len(earlier) == before and (earlier.empty or earlier["i"].max() < piece["i"].min())
    assert own[own["k"] == 7]["before"].nunique() >= 8  # the hot key is in many ranges
    assert scans.scanned(frame.limit(0).select("k", "i"), ["k"], ["i"], len, lambda a, b: a + b, run, "k int, i int, before long, after long, n long").count() == 0


def test_scans_are_the_same_within_a_union(spark):
    frame, _ = skewed(spark, 3000)
    run = lambda piece, before, after: piece.assign(n=np.arange(len(piece)) + (before or 0))[["k", "i", "n"]]
    out = scans.scanned(frame.select("k", "i"), ["k"], ["i"], len, lambda a, b: a + b, run, "k int, i int, n long", parts=8)
    both = spark.range(5).selectExpr("-1 AS k", "0 AS i", "0 AS n").repartition(3).union(out).filter("k IS NULL OR k >= 0")
    own = both.toPandas().fillna({"k": -1}).sort_values(["k", "i"])
    assert len(own) == 3000 and (own.groupby("k").cumcount() == own["n"]).all()


def test_quantiles_are_exact(spark):
    frame, rows = skewed(spark)
    shares = [0.0, 0.05, 0.5, 0.731, 1.0]
    out = {r.k: r for r in scans.quantiles(frame, ["k"], "v", shares).collect()}
    values = {}
    for k, v, _ in rows:
        if v is not None:
            values.setdefault(k, []).append(v)
    assert set(out) == set(values)
    for k, own in values.items():
        assert out[k].n == len(own) and np.allclose(out[k].q, np.quantile(own, shares), atol=1e-9)


def test_medians_hold_no_key(spark):
    frame, rows = skewed(spark)
    found = baselines.median_mad(frame.filter("k IS NOT NULL"), ["k"], "v")
    plan = found._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "percentile" not in plan
    for r in found.collect():
        own = np.array([v for k, v, _ in rows if k == r.k and v is not None])
        assert r.n == len(own) and r.median == pytest.approx(np.median(own)) and r.mad == pytest.approx(np.median(np.abs(own - np.median(own))))


def test_distances_of_one_large_pair(spark):
    rng = np.random.default_rng(1)
    real, sim = rng.normal(0, 1, 8000).round(2), rng.normal(0.3, 1.2, 5000).round(2)
    rows = [("big", 1, float(v)) for v in real] + [("big", 0, float(v)) for v in sim] + [("one-sided", 1, 1.0), ("small", 1, 1.0), ("small", 0, 3.0), ("big", 1, None)]
    out = {r.pair: r for r in distributions.distances(spark.createDataFrame(rows, "pair string, side int, value double")).collect()}
    points = np.unique(np.concatenate([real, sim]))
    a, b = (np.searchsorted(np.sort(x), points, side="right") / len(x) for x in (real, sim))
    assert out["big"].ks == pytest.approx(np.abs(a - b).max()) and out["big"].wasserstein == pytest.approx((np.abs(a - b)[:-1] * np.diff(points)).sum())
    assert out["small"].wasserstein == 2.0 and out["small"].ks == 1.0 and out["one-sided"].ks is None and out["one-sided"].wasserstein is None


def plain_filter(rows, gap=30.0):
    """The filter over one vehicle, row after row."""
    step, last, out, track = kalman.altitude_filter(kalman.ACCELERATION_STD**2, kalman.MEASUREMENT_STD**2)(), None, {}, 0
    for us, i, y in sorted(rows):
        dt = None if last is None else (us - last) / 1e6
        if dt is not None and dt <= 0:
            continue
        last, dt = us, None if dt is None or dt > gap else dt
        track += dt is None
        out[i] = (track, *step(y, dt))
    return out


def test_one_vehicle_is_many_tasks(spark):
    rng = np.random.default_rng(2)
    us = np.cumsum(rng.choice([0, 500_000, 1_000_000, 3_000_000], 6000)) + np.cumsum(rng.random(6000) < 0.002) * 60_000_000
    rows = [(1, int(t), i, float(np.sin(t / 5e7) * 20 + rng.normal(0, 0.3))) for i, t in enumerate(us)]
    rows += [(2, int(t), 10_000 + i, float(i)) for i, t in enumerate(us[:50])] + [(1, 5, 99_999, None)]
    frame = spark.createDataFrame(rows, "drone_id long, us long, reading_id long, altitude double").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        found = kalman.smooth(frame)
        tasks = found.select("drone_id", F.spark_partition_id().alias("p")).groupBy("drone_id").agg(F.count_distinct("p").alias("n")).collect()
        got = {r.reading_id: r for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert max(r.n for r in tasks if r.drone_id == 1) >= 10
    for drone in (1, 2):
        true = plain_filter([(t, i, y) for d, t, i, y in rows if d == drone and y is not None])
        assert {i for i, r in got.items() if r.drone_id == drone} == set(true)
        for i, (track, *numbers) in true.items():
            r = got[i]
            assert r.track == track and (r.nis is None) == (numbers[4] is None)
            for x, y in zip((r.filtered, r.velocity, r.deviation, r.innovation, r.nis), numbers, strict=True):
                assert x is y or math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-8)


def test_elements_compose_in_any_bracketing():
    rng = np.random.default_rng(3)
    dt, y = rng.uniform(0.1, 3, 37), rng.normal(0, 5, 37)
    dt[11] = np.nan
    for cut in ((0, 37), (11, 37), (12, 37), (0, 11)):
        own = kalman.Element.of(dt[slice(*cut)], y[slice(*cut)], 0.25, 0.09)
        step = kalman.altitude_filter(0.25, 0.09)([1.0, 0.5, 2.0, 0.1, 3.0])
        for t, v in zip(dt[slice(*cut)], y[slice(*cut)], strict=True):
            step(v, None if math.isnan(t) else t)
        assert np.allclose(own.composed().after([1.0, 0.5, 2.0, 0.1, 3.0]), step.state())
        one = own[:1]
        for i in range(1, len(own.b)):
            one = one.then(own[i : i + 1])
        assert np.allclose(one.A, own.composed().A) and np.allclose(one.J, own.composed().J)


def test_first_fixes_are_an_aggregate(spark):
    rows = [(1, 5, 1, None, 8.0), (1, 6, 2, 47.0, 8.0), (1, 7, 3, 47.001, 8.001), (None, 1, 4, 1.0, 1.0), (2, 1, 5, None, None)]
    out = {r.reading_id: r for r in kalman.to_local_metres(spark.createDataFrame(rows, "drone_id long, us long, reading_id long, latitude double, longitude double")).collect()}
    assert out[1].north is None and (out[2].east, out[2].north) == (0, 0) and out[3].north == pytest.approx(111.19, abs=0.1) and out[4].north == 0 and out[5].east is None
