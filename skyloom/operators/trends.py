"""Trend callouts of a feature against its reference baseline: steps, drifts and crossed guides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Flights for a step, a drift and a guide; half-width of the band in spreads; least span of a scale in floors.
STEP, DRIFT, GUIDE = 3, 5, 3
BAND_SPREADS, MIN_SPAN_FLOORS = 2.0, 4.0


def callouts(admitted: DataFrame) -> DataFrame:
    """One row for each vehicle, group and feature: latest value, reference band, step, drift, delta and scale span.

    Expects admit() rows of one group per feature, with lower_is_worse. A step has its last three values beyond the
    harmful edge of the band, a drift the median of the last five. Where both hold, the way over the edge decides: a
    jump of at least the band's half-width from the last value inside is a step, less is a drift. Without any value
    inside it is a step.
    """
    keys = ["drone_id", "baseline_group", "feature_key"]
    rows = admitted.filter(F.col("qualified") & F.col("value").isNotNull())
    whole = Window.partitionBy(*keys)
    order = whole.orderBy("flight_index")
    first = F.max(F.when(F.col("admitted"), F.col("rank_admitted"))).over(whole)
    rows = rows.withColumn("rank_admitted", F.sum(F.col("admitted").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("have", first)
    reference = F.sort_array(F.collect_list(F.when(F.col("admitted") & (F.col("rank_admitted") <= 5), F.col("value"))).over(whole))
    rows = rows.withColumn("reference", F.when(F.col("have") >= 5, reference))
    middle = F.get("reference", F.lit(2))
    deviations = F.sort_array(F.transform("reference", lambda x: F.abs(x - middle)))
    rows = rows.withColumn("ref", middle).withColumn("half", BAND_SPREADS * F.greatest(1.4826 * F.get(deviations, F.lit(2)), F.col("floor"),
        F.col("relative_floor") * F.abs(middle)))
    edge = F.when(F.col("lower_is_worse"), F.col("ref") - F.col("half")).otherwise(F.col("ref") + F.col("half"))
    rows = rows.withColumn("edge", edge)
    beyond = F.when(F.col("lower_is_worse"), F.col("value") < F.col("edge")).otherwise(F.col("value") > F.col("edge"))
    rows = rows.withColumn("beyond", beyond).withColumn("back",
        F.row_number().over(whole.orderBy(F.desc("flight_index")))).withColumn("next", F.lead("value").over(order))
    inside = ~F.col("beyond")
    last = lambda c: F.max_by(c, "flight_index")
    out = rows.groupBy(*keys).agg(
        last("flight_index").alias("flight_index"),
        last("value").alias("value"),
        F.first("ref").alias("ref"),
        F.first("half").alias("half"),
        F.first("have").alias("have"),
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("back") <= STEP) & F.col("beyond")).alias("recent"),
        F.percentile(F.when(F.col("back") <= DRIFT, F.col("value")), F.lit(0.5)).alias("median"),
        F.first("edge").alias("edge"),
        F.first("lower_is_worse").alias("lower"),
        F.first("floor").alias("floor"),
        F.first("relative_floor").alias("relative_floor"),
        F.max_by(F.struct("value", "next"), F.when(inside, F.col("flight_index"))).alias("cross"),
    )
    step = F.coalesce((F.col("n") >= STEP) & (F.col("recent") == STEP), F.lit(False))
    past = F.when(F.col("lower"), F.col("median") < F.col("edge")).otherwise(F.col("median") > F.col("edge"))
    drift = F.coalesce((F.col("n") >= DRIFT) & past, F.lit(False))
    abrupt = F.coalesce(F.abs(F.col("cross.next") - F.col("cross.value")) >= F.col("half"), F.lit(True))
    span = MIN_SPAN_FLOORS * F.greatest(F.col("floor"), F.col("relative_floor") * F.abs(F.coalesce("ref", "value")))
    return out.select(
        *keys,
        "flight_index",
        "value",
        F.col("ref").alias("reference_median"),
        (F.col("ref") - F.col("half")).alias("band_low"),
        (F.col("ref") + F.col("half")).alias("band_high"),
        (F.col("value") - F.col("ref")).alias("delta"),
        (step & (~drift | abrupt)).alias("step"),
        (drift & (~step | ~abrupt)).alias("drift"),
        F.when(F.col("ref").isNull(), F.col("have")).cast("int").alias("reference_progress"),
        span.alias("min_span"),
    )


KEYS = ["drone_id", "pack", "feature_key"]


def points(scored: DataFrame) -> DataFrame:
    """What is drawn: (drone_id, pack, feature_key, flight_index, value, baseline_group, admitted, score, current).

    One point for each qualified flight with a value; power features are drawn by pack, pack being null for others.
    current holds for the points in the group of the last one: earlier ones belong to the time before a change.
    """
    pack = F.when(F.col("feature_key").startswith("pwr."), F.col("pack_id").cast("string"))
    rows = scored.filter(F.col("qualified") & F.col("value").isNotNull()).withColumn("pack", pack)
    last = F.last("baseline_group").over(Window.partitionBy(*KEYS).orderBy("flight_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select(*KEYS, "flight_index", "value", "baseline_group", "admitted", "score", (F.col("baseline_group") == last).alias("current"))


def boundaries(drawn: DataFrame, events: DataFrame, resets: DataFrame) -> DataFrame:
    """(drone_id, pack, feature_key, flight_index, source, change_type): changes that reset a feature inside its drawn range."""
    range_ = drawn.groupBy(*KEYS).agg(F.min("flight_index").alias("first"), F.max("flight_index").alias("last"))
    marks = events.join(resets, "change_type")
    rows = range_.join(marks, ["drone_id", "feature_key"])
    return rows.filter((F.col("flight_index") > F.col("first")) & (F.col("flight_index") <= F.col("last"))).select(*KEYS, "flight_index",
        "source", "change_type")


def guide_crossed(admitted: DataFrame, norms: DataFrame) -> DataFrame:
    """(keys, guide): series whose last three values are all past the nearest edge of a graded or bad-only norm."""
    keys = ["drone_id", "baseline_group", "feature_key"]
    edges = norms.filter("norm_kind IN ('graded', 'bad_only')").select("feature_key", "autopilot",
        F.coalesce(F.when(F.col("norm_kind") == "graded", F.col("healthy_edge")), F.col("bad_edge")).alias("guide"))
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("flight_index")))
    rows = admitted.filter(F.col("qualified") & F.col("value").isNotNull()).withColumn("back",
        back).filter(F.col("back") <= GUIDE).drop("guide").join(edges, ["feature_key", "autopilot"])
    past = F.when(F.col("lower_is_worse"), F.col("value") < F.col("guide")).otherwise(F.col("value") > F.col("guide"))
    return rows.groupBy(*keys, "guide").agg(F.count_if(past).alias("n")).filter(F.col("n") == GUIDE).drop("n")


def pill(score_band, called):
    """The colour beside a value: its score's band, but at least watch where something was called out."""
    return F.when(called & (score_band.isNull() | (score_band == "fine")), "watch").otherwise(score_band)
