"""Every plan that has SQL against it, and plans against shapes that don't scale."""

from __future__ import annotations

import math
import re
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from skyloom import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[str]:
    def one(x):
        if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return None
        if isinstance(x, bool) or not hasattr(x, "__float__"):
            return str(x)
        return round(float(x), 4) + 0.0

    return sorted(repr(tuple(map(one, r))) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_plan_agrees_with_its_sql(spark, sf_dir, con, name):
    out, true = plans.QUERIES[name](spark, sf_dir).toPandas(), con.execute(plans.SQL[name]).fetchdf()
    assert sorted(out.columns) == sorted(true.columns) and len(out) == len(true)
    assert canonical(out) == canonical(true)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_plan_without_sql_has_rows(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0


PYTHON_PLANS = {"features_with_admissions", "report_admissions", "report_scores", "report_rollup", "report_findings", "report_trends", "flight_deletion", "stored_baselines", "median_mad", "ks_wasserstein", "compare_series", "flight_features", "worst_test_ratio", "histogram_divergence", "histogram_bins", "trend_points", "trend_pills", "guide_callouts", "vehicle_risk", "finding_causes", "feature_extraction", "spread_details", "admission_gate", "inferred_changes", "feature_scores", "subsystem_scores", "flight_rollup", "findings", "worst_findings", "trend_callouts", "kalman_smooth", "sensor_fault_runs", "welch_density"}


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_physical_plan(spark, sf_dir, name):
    plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert name in PYTHON_PLANS or not re.search("Pandas|ArrowEval|PythonUDF|MapInArrow", plan)


def test_every_query_of_the_contract_is_callable():
    import __spark_entry__ as contract

    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(plans.QUERIES) <= set(queries) and set(sql) <= set(queries)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = plans.QUERIES["owner_scoped_scan"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,O)" in plan and "o_orderdate" not in plan


def test_the_core_does_not_import_the_corpus_operators():
    root = Path(plans.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path


def test_lines_of_findings(spark):
    from pyspark.sql import functions as F

    from skyloom.functions import catalogue, phrases

    rows = spark.createDataFrame(
        [
            ("act.sat_frac", 0.023, "single_motor_high", "2", [0.4, 0.6, 0.4, 0.4]),
            ("gps.eph_p50", 6.125, "one_side_high", "front", [0.5, 0.5, 0.4, 0.4]),
            ("pwr.r_cell", 6.55, "mixed", None, [0.5, 0.4]),
        ],
        "feature_key string, value double, pattern string, place string, means array<double>",
    ).join(phrases.display(spark), "feature_key")
    value = F.col("value")
    out = rows.select(
        "feature_key",
        phrases.figure(value).alias("figure"),
        phrases.pattern_line(F.col("pattern"), F.col("place"), F.col("means")).alias("pattern"),
        phrases.consistent_line(value, F.lit(True)).alias("consistent"),
        phrases.guide_line(value, F.lit(5.0), F.lit("PX4")).alias("guide"),
        phrases.definitional_line(F.lit("motor_saturation"), value).alias("fact"),
        phrases.change_prompt(F.lit("up")).alias("prompt"),
    )
    found = {r.feature_key: r for r in out.collect()}
    assert [found[k].figure for k in ("act.sat_frac", "gps.eph_p50", "pwr.r_cell")] == ["2.3%", "6.12 m", "6.5 mΩ/cell"]  # as Python's format has it
    assert [found[k].pattern for k in ("act.sat_frac", "gps.eph_p50", "pwr.r_cell")] == ["Motor 2 gives 50% more than the others", "Front motors give 25% more than the others", None]
    assert found["gps.eph_p50"].consistent == "GPS error 6.12 m, too low each flight yet" and found["act.sat_frac"].fact == "Motors at their limit 2.3% of the time"
    assert all(len(r[c].split()) <= phrases.MOST_WORDS for r in found.values() for c in ("consistent", "guide", "fact"))
    texts = [(r[c],) for r in found.values() for c in ("pattern", "consistent", "guide", "fact", "prompt") if r[c]] + [(t,) for most, also in phrases.CAUSES.values() for t in (*most, *also)]
    assert spark.createDataFrame(texts, "text string").filter(F.size(catalogue.forbidden_claims(F.col("text"))) > 0).count() == 0


def test_assessments_tell_what_was_missing(spark):
    from pyspark.sql import functions as F

    from skyloom.functions import phrases

    rows = spark.createDataFrame([("full", None, 90.0, 40.0), ("not_assessed", "airborne_too_short", 41.6, 0.0), ("not_assessed", "no_airborne_detected", None, 0.0), ("partial", "insufficient_steady_flight", 90.0, 12.0), ("partial", "signal_absent:vel.z", 90.0, 0.0)], "status string, reason string, air double, steady double")
    head, advice = phrases.assessment_text(F.col("status"), F.coalesce("reason", F.lit("")), F.col("air"), F.col("steady"))
    out = [tuple(r) for r in rows.select(head, advice).collect()]
    assert out[0] == (None, None) and "42 s" in out[1][0] and "60 s" in out[1][1] and out[2][0].startswith("No takeoff") and "12 s" in out[3][0] and all(x for r in out[1:] for x in r)
