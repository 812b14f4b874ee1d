"""After flights are deleted, admissions and baselines are those of a full recompute, and only touched series were read and folded."""

from __future__ import annotations

import random
from pathlib import Path
from statistics import median

import pytest
from pyspark.sql import functions as F

from skyloom.operators import baselines as B
from skyloom.operators import rebuild as R

SCHEMA = "drone_id long, baseline_group string, feature_key string, flight_index long, value double, qualified boolean, valid boolean, absolute_bad boolean, floor double, relative_floor double, baselined boolean"


@pytest.fixture(scope="module")
def observed(spark):
    rng = random.Random(5)
    rows = [(drone, "epoch:initial", feature, i, None if i % 9 == 5 else 10 + rng.gauss(0, 1) + (12 if i in (7, 8, 9) else 0), i % 8 != 1, True, i % 12 == 11, 0.2, 0.01,
        feature != "c") for drone in range(6) for feature in "abc" for i in range(1 if drone == 5 else 24)]
    return spark.createDataFrame(rows, SCHEMA).cache()


DECIDED = ["admitted", "quarantine_reason", "n_before", "base_median", "base_mad", "base_spread", "base_n", "ref_median", "ref_spread"]


def decisions(frame):
    return {tuple(r[k] for k in (*B.KEYS, "flight_index")): tuple(r[c] for c in DECIDED) for r in frame.collect()}


def doomed_of(spark):
    return spark.createDataFrame([(1, 7), (1, 7), (1, 20), (2, 0), (5, 0), (3, 99)], "drone_id long, flight_index long")


def test_recorded_admissions_are_the_plain_ones(observed):
    assert decisions(R.admit_recorded(observed)) == decisions(B.admit(observed))


def test_rebuilt_admissions_are_those_of_a_full_recompute(spark, observed):
    recorded, doomed = R.admit_recorded(observed).cache(), doomed_of(spark)
    left = observed.join(doomed, ["drone_id", "flight_index"], "left_anti")
    out = R.rebuilt(recorded, doomed)
    assert out.columns == recorded.columns and decisions(out) == decisions(B.admit(left)) != decisions(recorded)
    assert {tuple(r): None for r in out.select(*B.KEYS, "flight_index", "gate_state").collect()} == {tuple(r): None for r in R.admit_recorded(left).select(*B.KEYS,
        "flight_index", "gate_state").collect()}
    changed, gone = R.without_flights(recorded, doomed)
    assert changed.filter("drone_id NOT IN (1, 2)").isEmpty() and changed.filter("drone_id = 1").agg(F.min("flight_index")).first()[0] == 8
    assert {r.table: r.deleted for r in gone.collect()} == {"flights": 4, "flight_features": 12}


def test_baselines_of_the_next_flight(observed):
    admitted = B.admit(observed).cache()
    own = {}
    for r in sorted(admitted.filter("admitted").collect(), key=lambda r: r.flight_index):
        own.setdefault((r.drone_id, r.feature_key), []).append((r.flight_index, r.value))
    out = R.final_baselines(admitted).collect()
    assert len(out) == sum(1 + (len(v) >= 5) for v in own.values())
    for r in out:
        mine = own[r.drone_id, r.feature_key]
        mine = mine[-10:] if r.kind == "rolling" else mine[:5]
        centre = median(v for _, v in mine)
        mad = median(abs(v - centre) for _, v in mine)
        assert r.flights == [i for i, _ in mine] and r.n == len(mine) and r.median == pytest.approx(centre) and r.mad == pytest.approx(mad)
        assert r.spread == pytest.approx(max(1.4826 * mad, 0.2, 0.01 * abs(centre)))


def test_deletion_in_stored_tables_touches_the_vehicles_concerned(spark, observed, tmp_path):
    path, baselines = str(tmp_path / "admissions"), str(tmp_path / "baselines")
    recorded = R.admit_recorded(observed)
    recorded.write.partitionBy("drone_id").parquet(path)
    R.final_baselines(recorded).write.partitionBy("drone_id").parquet(baselines)
    files = lambda: {f: f.stat().st_mtime_ns for f in Path(path).glob("drone_id=*/*.parquet")}
    before = files()
    doomed = doomed_of(spark)
    gone = R.delete_flights(spark, path, baselines, doomed)
    assert {r.table: r.deleted for r in gone.collect()} == {"flights": 4, "flight_features": 12}
    left = B.admit(observed.join(doomed, ["drone_id", "flight_index"], "left_anti"))
    assert decisions(spark.read.parquet(path)) == decisions(left)
    key = lambda f: {(r.drone_id, r.feature_key, r.kind, r.median, tuple(r.flights)) for r in f.collect()}
    assert key(spark.read.parquet(baselines)) == key(R.final_baselines(left))
    after = files()
    untouched = {f for f in before if f.parent.name in ("drone_id=0", "drone_id=4")}
    assert untouched and all(after.get(f) == before[f] for f in untouched)
    assert not any(f.parent.name == "drone_id=5" for f in after)
