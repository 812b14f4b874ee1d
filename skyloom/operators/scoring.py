"""Scores of features, subsystems and flights, the first-flight checklist, and findings by probable cause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .baselines import mode, robust_z

# Bands, scores of failed norms, caps and minimum counts.
BANDS = ((85.0, "fine"), (70.0, "watch"), (50.0, "off"))
GATE_FAIL, BAD_ONLY, ABSOLUTE_BAD_CAP = 70.0, 40.0, 49.0
SCORED_FROM, HIGH_FROM, OVERALL_SUBSYSTEMS = 3, 10, 4
CAP_BY_WORST = {"bad": 69.0, "off": 84.0}
EMIT_BELOW, DEFINITIONAL_RANK = 85.0, 70.0
REJECTION_RATIO, IMBALANCE_TRIGGER = 1.0, 30.0
TOP_FINDINGS = 3
#: Reasons for missing values that a change of logging or hardware would mend.
LOGGING_GAPS = {"requires_fifo_accel": "raw high-rate accelerometer logging", "no_per_cell_sensing": "sensing of every battery cell"}


def band(score: Column) -> Column:
    out = F.lit("bad")
    for edge, name in reversed(BANDS):
        out = F.when(score >= edge, name).otherwise(out)
    return F.when(score.isNotNull(), out)


def graded(value: Column, healthy: Column, bad: Column) -> Column:
    """100 at 0, 85 at the healthy edge, 50 at the bad one, 0 at twice that, linear between."""
    inside = F.when(healthy == 0, 100.0).otherwise(100 - 15 * F.try_divide(value, healthy))
    between = 85 - 35 * F.try_divide(value - healthy, bad - healthy)
    beyond = F.greatest(F.lit(0.0), 50 - 50 * F.try_divide(value - bad, bad))
    return F.when(value <= healthy, inside).when(value <= bad, between).otherwise(beyond)


def with_absolute(rows: DataFrame, norms: DataFrame) -> DataFrame:
    """Adds absolute_score, absolute_status and absolute_bad from the norm of each feature and autopilot.

    Norms are a table that callers may replace; Spark broadcasts it if it is small. Without a norm there is no score.
    """
    value = F.col("value")
    rows = rows.join(norms, ["feature_key", "autopilot"], "left")
    worse = lambda edge: F.when(F.col("norm_lower"), value < F.col(edge)).otherwise(value > F.col(edge))
    kind = lambda name: F.col("norm_kind") == name
    hit = worse("bad_edge") | (value == F.col("bad_edge"))
    score = (
        F.when(value.isNull(), None)
        .when(kind("gate"), F.when(worse("healthy_edge"), GATE_FAIL).otherwise(100.0))
        .when(kind("bad_only"), F.when(hit, BAD_ONLY))
        .when(kind("graded"), graded(value, F.col("healthy_edge"), F.col("bad_edge")))
    )
    rows = rows.withColumn("absolute_score", score)
    status = (
        F.when(F.col("norm_kind").isNull(), "no_norm")
        .when(value.isNull(), "not_computed")
        .when(kind("context"), "context")
        .when(kind("usage"), F.when(worse("healthy_edge"), "usage_flown_to_empty").otherwise("usage_ok"))
        .otherwise(F.coalesce(band(F.col("absolute_score")), F.lit("no_norm")))
    )
    return rows.withColumn("absolute_status", status).withColumn("absolute_bad", F.coalesce(F.col("absolute_score") < 50, F.lit(False)))


def blend_weight(n: Column) -> Column:
    return F.when(n <= 2, 0.0).when(n >= 5, 1.0).otherwise((n - 2) / 3)


def baseline_score(z: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - 15 * (z - 1)))


def definitional(feature: Column, value: Column, clip_events: Column) -> Column:
    """Facts that need no baseline: saturation, estimator rejection, clipping, an imbalance trigger."""
    return (
        F.when((feature == "act.sat_frac") & (value > 0), "motor_saturation")
        .when((feature == "est.test_ratio_p95") & (value >= REJECTION_RATIO), "estimator_rejection")
        .when((feature == "vib.clip_rate") & (clip_events > 0), "accel_clipping")
        .when((feature == "vib.imbalance") & (value >= IMBALANCE_TRIGGER), "imbalance_detector")
    )


def score_features(admitted: DataFrame) -> DataFrame:
    """Adds n, status, mode, weight, z, score, capped, confidence, consistently_bad and unscored_reason to gated rows.

    n counts admitted flights before this one and itself. A baseline counts from n = SCORED_FROM, beside the absolute
    score until n = 5. Features that are never scored have a reason and no mode.
    """
    z = robust_z(F.col("value"), F.col("base_median"), F.col("base_spread"), F.col("lower_is_worse"))
    rows = admitted.withColumn("n", F.col("n_before") + 1).withColumn("z", F.when(F.col("baselined") & F.col("valid"), z))
    seen = Window.partitionBy("drone_id", "baseline_group", "feature_key").orderBy("flight_index").rowsBetween(Window.unboundedPreceding, -1)
    counted = F.col("qualified") & F.col("valid") & F.col("value").isNotNull()
    rows = rows.withColumn("valid_before", F.count_if(counted).over(seen)).withColumn("bad_before", F.count_if(counted & F.col("absolute_bad")).over(seen))
    skip = F.when(~F.col("valid") | F.col("value").isNull(), F.coalesce("reason", F.lit("feature_invalid"))).when(F.col("tier") == "R3",
        "tier_r3_never_scored").when(F.col("absolute_status").startswith("usage"), "usage_note_only").when(~F.col("baselined"), "detail_only")
    rows = rows.withColumn("unscored_reason", skip)
    scored = F.col("unscored_reason").isNull()
    own, s_abs, weight = baseline_score(F.col("z")), F.col("absolute_score"), blend_weight(F.col("n"))
    use = F.coalesce(F.col("z").isNotNull() & (F.col("n") >= SCORED_FROM), F.lit(False))
    raw = F.when(s_abs.isNull(), F.when(use, own)).when(use, weight * own + (1 - weight) * s_abs).otherwise(s_abs)
    rows = rows.withColumn("weight", F.when(scored, F.when(use, F.when(s_abs.isNull(), 1.0).otherwise(weight)).otherwise(0.0)))
    capped = F.coalesce(F.col("absolute_bad") & (raw > ABSOLUTE_BAD_CAP), F.lit(False))
    rows = rows.withColumn("capped", scored & capped).withColumn("score", F.when(scored, one_digit(F.when(capped, ABSOLUTE_BAD_CAP).otherwise(raw))))
    rows = rows.withColumn("mode", F.when(scored, F.when(use, mode(F.col("n"))).otherwise("absolute")))
    rows = rows.withColumn("status", F.when(F.col("unscored_reason") == "usage_note_only", "usage").when(~scored,
        "unscored").when(F.col("score").isNull(), "learning").otherwise("scored"))
    confidence = (
        F.when((F.col("tier") == "R2") & (F.col("n") < 5), "low")
        .when(F.col("mode") == "personal", F.when((F.col("n") >= HIGH_FROM) & (F.col("tier") == "R1"), "high").otherwise("medium"))
        .when(F.col("mode") == "blended", "medium")
        .when(s_abs.isNotNull(), F.col("norm_confidence"))
        .when(definitional(F.col("feature_key"), F.col("value"), F.col("value")).isNotNull(), "high")
        .otherwise("low")
    )
    rows = rows.withColumn("confidence", F.when(scored, confidence).when(F.col("status") == "usage", F.col("norm_confidence")))
    return rows.withColumn("consistently_bad", scored & F.col("absolute_bad") & (F.col("valid_before") >= 1) & (F.col("valid_before") == F.col("bad_before")))


def one_digit(score: Column) -> Column:
    """Rounded to one digit; a tie goes up, whatever the last bits of a double say."""
    return F.round(score + 1e-9, 1)


def combined(score: Column) -> Column:
    """Half the worst and half the mean of a group's scores."""
    return 0.5 * F.min(score) + 0.5 * F.avg(score)


def rollup(scores: DataFrame, flight: tuple[str, ...] = ("drone_id", "flight_index")) -> DataFrame:
    """Per flight: overall score and band, whether a bad feature caps it, scored subsystems and features.

    A subsystem counts if it has a scored feature; an overall score needs four of them.
    """
    scored = F.when(F.col("status") == "scored", F.col("score"))
    subsystems = scores.groupBy(*flight, "subsystem").agg(one_digit(combined(scored)).alias("own"), F.min(scored).alias("worst"),
        F.count_if(F.col("status") == "scored").alias("scored"), F.count_if("valid").alias("valid"), F.count(F.lit(1)).alias("total"))
    out = subsystems.groupBy(*flight).agg(
        F.count("own").alias("scored_subsystems"), one_digit(combined(F.col("own"))).alias("raw"), F.min("worst").alias("worst_score"), F.sum("scored").alias("features_scored"), F.sum("valid").alias("features_valid"), F.sum("total").alias("features_total")
    )
    enough = F.col("scored_subsystems") >= OVERALL_SUBSYSTEMS
    worst = band(F.col("worst_score"))
    ceiling = F.lit(None).cast("double")
    for name, most in CAP_BY_WORST.items():
        ceiling = F.when(worst == name, most).otherwise(ceiling)
    applied = F.coalesce(enough & (F.col("raw") > ceiling), F.lit(False))
    overall = F.when(enough, F.when(applied, ceiling).otherwise(F.col("raw")))
    return out.select(*flight, "scored_subsystems", overall.alias("overall"), band(overall).alias("score_band"), applied.alias("capped"),
        "worst_score", "features_scored", "features_valid", "features_total")


def subsystem_scores(scores: DataFrame, flight: tuple[str, ...] = ("drone_id", "flight_index")) -> DataFrame:
    """(flight, subsystem, score, worst_feature) of subsystems that have a scored feature."""
    rows = scores.filter("status = 'scored'")
    return rows.groupBy(*flight, "subsystem").agg(one_digit(combined(F.col("score"))).alias("score"), F.min_by("feature_key",
        F.struct("score", "place")).alias("worst_feature"))


# Checks of a first flight: name, feature, passing rule, status of a failure, confidence, for one autopilot only.
CHECKS = (
    ("accel_clipping", "vib.clip_rate", "value = 0", "watch", "low", None),
    ("prop_imbalance", "vib.imbalance", "value < 30", "off", "medium", "px4"),
    ("gps_accuracy", "gps.eph_p50", "value <= 3.0", "watch", "medium", "px4"),
    ("gps_satellites", "gps.nsats_p10", "value >= 6", "watch", "medium", "px4"),
    ("gps_speed_accuracy", "gps.sacc_p50", "value <= 0.5", "watch", "medium", "px4"),
    ("estimator_agreement", "est.test_ratio_p95", "value < 1", "off", "high", None),
    ("motor_headroom", "act.sat_frac", "value = 0", "watch", "high", None),
    ("pack_not_empty", "pwr.v_cell_min", "value > 3.6", "usage_note", "high", None),
)


def checklist(features: DataFrame, flight: tuple[str, ...] = ("drone_id", "flight_index")) -> DataFrame:
    """(flight, autopilot, check, feature_key, status, confidence): one row for each check that the autopilot has.

    A check without a value is unavailable.
    """
    rows = F.array(*[F.struct(F.lit(c).alias("check"), F.lit(f).alias("feature_key"), F.lit(fail).alias("fail"),
        F.lit(conf).alias("confidence"), F.lit(only).cast("string").alias("only")) for c, f, _, fail, conf, only in CHECKS])
    flights = features.select(*flight, "autopilot").distinct().withColumn("c", F.explode(rows)).select(*flight, "autopilot",
        "c.*").filter("only IS NULL OR only = autopilot")
    ok = F.lit(False)
    for _, feature, rule, _, _, _ in CHECKS:
        ok = F.when(F.col("feature_key") == feature, F.expr(rule)).otherwise(ok)
    values = features.filter("valid").select(*flight, "feature_key", "value")
    out = flights.join(values, [*flight, "feature_key"], "left")
    status = F.when(F.col("value").isNull(), "unavailable").when(ok, "ok").otherwise(F.col("fail"))
    return out.select(*flight, "autopilot", "check", "feature_key", status.alias("status"), "confidence")


def logging_gaps(features: DataFrame) -> DataFrame:
    """Rows whose missing value has a remedy, with it."""
    remedy = F.lit(None).cast("string")
    for reason, what in LOGGING_GAPS.items():
        remedy = F.when(F.col("reason") == reason, what).otherwise(remedy)
    return features.withColumn("needs", remedy).filter("needs IS NOT NULL")


def cause_group(feature: Column, pattern: Column) -> Column:
    """Findings of one group point to one physical cause."""
    known = pattern.isin("single_motor_high", "one_side_high", "same_spin_set_high")
    return (
        F.when(feature.startswith("vib.metric"), "vib.metric")
        .when(feature == "act.spread", F.concat(F.lit("pattern."), F.when(known, pattern).otherwise("other")))
        .when(feature.startswith("trk."), "trk")
        .when(feature.isin("gps.eph_p50", "gps.nsats_p10", "gps.sacc_p50"), "gps.position")
        .when(feature.isin("gps.noise", "gps.jamming"), "gps.rf")
        .when(feature.startswith("est."), "est")
        .otherwise(feature)
    )


def findings(scores: DataFrame, flight: tuple[str, ...] = ("drone_id", "flight_index")) -> DataFrame:
    """One row for each flight and cause: the leading feature, its kind, and the other features of the cause.

    Expects score_features() rows with definitional and pattern columns. A feature is found if its score is under
    EMIT_BELOW or absolutely bad, or by definition. The lead has the worst score, then tier R1, then catalogue order.
    """
    emits = F.coalesce((F.col("status") == "scored") & (F.col("score") < EMIT_BELOW), F.lit(False)) | F.col("absolute_bad")
    has_base = F.col("base_median").isNotNull()
    personal = (has_base & (F.coalesce("weight", F.lit(0.0)) > 0.5)) | (F.col("absolute_score").isNull() & has_base)
    kind = (
        F.when(~emits, F.when(F.col("definitional").isNotNull(), "definitional"))
        .when(F.col("consistently_bad"), "consistently_bad")
        .when((F.col("feature_key") == "act.spread") & personal & F.col("pattern").isNotNull(), "pattern")
        .when(personal, "personal")
        .otherwise("absolute")
    )
    rows = scores.filter(F.col("value").isNotNull()).withColumn("kind", kind).filter("kind IS NOT NULL")
    rows = rows.withColumn("cause", cause_group(F.col("feature_key"), F.col("pattern"))).withColumn("rank_score",
        F.coalesce(F.when(F.col("kind") == "definitional", DEFINITIONAL_RANK), F.col("score"), F.lit(DEFINITIONAL_RANK)))
    order = Window.partitionBy(*flight, "cause").orderBy("rank_score", F.col("tier") != "R1", "place")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    related = F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "feature_key"))))
    lead = lambda c: F.min_by(c, "rank").alias(c)
    out = ranked.groupBy(*flight, "cause").agg(lead("feature_key"), lead("kind"), lead("rank_score"), F.transform(related,
        lambda x: x["feature_key"]).alias("related"))
    return out


def worst_findings(found: DataFrame, most: int = TOP_FINDINGS, flight: tuple[str, ...] = ("drone_id", "flight_index")) -> DataFrame:
    """The first findings of each flight, worst first."""
    order = Window.partitionBy(*flight).orderBy("rank_score", "cause")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
