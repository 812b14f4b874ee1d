"""Robust baselines per vehicle, group and feature, with an admission gate that decides what they learn from."""

from __future__ import annotations

from functools import reduce
from statistics import median

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold_sorted
from .scans import quantiles

# Scale of the MAD, sizes of rolling and reference baseline, flights for each mode, gate and inference cuts.
MAD_SCALE = 1.4826
ROLLING, REFERENCE = 10, 5
PERSONAL_FROM, BLENDED_FROM = 5, 3
GATE_Z = 3.5
INFER_FLIGHTS, INFER_SPREADS = 3, 2.0

KEYS = ["drone_id", "baseline_group", "feature_key"]
GATE_INPUTS = ["value", "qualified", "valid", "absolute_bad", "floor", "relative_floor", "baselined"]
GATE_OUTPUTS = "admitted boolean, quarantine_reason string, n_before int, base_median double, base_mad double, base_spread double, base_n int, ref_median double, ref_spread double"


def group_key(feature: Column, epoch: Column, pack: Column) -> Column:
    """Name of a baseline: by epoch, and for power features by battery pack."""
    name = F.coalesce(epoch.cast("string"), F.lit("initial"))
    of_pack = F.concat(F.lit("pack:"), F.coalesce(pack.cast("string"), F.lit("unknown")), F.when(epoch.isNull(),
        "").otherwise(F.concat(F.lit("/epoch:"), name)))
    return F.when(feature.startswith("pwr."), of_pack).otherwise(F.concat(F.lit("epoch:"), name))


def mode(n: Column) -> Column:
    return F.when(n >= PERSONAL_FROM, "personal").when(n >= BLENDED_FROM, "blended").otherwise("absolute")


def robust_z(value: Column, centre: Column, spread: Column, lower_is_worse: Column) -> Column:
    """Deviation in spreads towards the harmful side; the harmless side is 0."""
    z = F.try_divide(value - centre, spread)
    return F.greatest(F.lit(0.0), F.when(lower_is_worse, -z).otherwise(z))


def median_mad(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, median, mad, n): exact, from ranks among sorted values (scans.quantiles), so a key may have any number of rows."""
    middle = quantiles(rows, keys, value, [0.5]).select(*keys, F.get("q", F.lit(0)).alias("median"), "n")
    same = reduce(Column.__and__, [rows[k].eqNullSafe(middle[k]) for k in keys])
    apart = rows.filter(F.col(value).isNotNull()).join(middle, same).select(*(rows[k] for k in keys), F.abs(rows[value] - middle["median"]).alias("apart"))
    mad = quantiles(apart, keys, "apart", [0.5]).select(*keys, F.get("q", F.lit(0)).alias("mad"))
    same = reduce(Column.__and__, [middle[k].eqNullSafe(mad[k]) for k in keys])
    return middle.join(mad, same).select(*(middle[k] for k in keys), "median", "mad", F.col("n").cast("int").alias("n"))


def gate(kept: list | None = None):
    """A step of the admission fold; holds the ten last and five first admitted values of a series.

    step.state() tells how many were admitted, and both lists; a gate may take up such a state.
    """
    count, rolling, reference = (0, [], []) if kept is None else (kept[0], list(kept[1]), list(kept[2]))

    def baseline(values, floor, relative):
        middle = median(values)
        mad = median([abs(v - middle) for v in values])
        return middle, mad, max(MAD_SCALE * mad, floor, relative * abs(middle))

    known = {}  # both baselines, until a value is admitted or the floors are others

    def step(value, qualified, valid, bad, floor, relative, baselined):
        nonlocal count
        before = count
        if known.get("floors") != (floor, relative):
            known.clear()
            known["floors"] = (floor, relative)
        if "rolling" not in known:
            known["rolling"] = baseline(rolling, floor, relative) if rolling else (None, None, None)
        if "reference" not in known:
            known["reference"] = baseline(reference, floor, relative) if len(reference) == REFERENCE else (None, None, None)
        (centre, mad, spread), (first, _, first_spread) = known["rolling"], known["reference"]
        reason = None
        if not qualified:
            reason = "flight_not_qualified"
        elif not valid or value is None:
            reason = "feature_invalid"
        elif bad:
            reason = "absolute_bad"
        elif baselined and before >= PERSONAL_FROM and abs(value - centre) > GATE_Z * spread:
            reason = "outlier"
        out = (reason is None, reason, before, centre, mad, spread, len(rolling), first, first_spread)
        if reason is None:
            count += 1
            rolling[:] = [*rolling, value][-ROLLING:]
            known.pop("rolling")
            if len(reference) < REFERENCE:
                reference.append(value)
                known.pop("reference")
        return out

    step.state = lambda: [count, list(rolling), list(reference)]
    return step


def admit(observations: DataFrame) -> DataFrame:
    """Runs every series of observations through the gate, oldest first, in one pass over sorted rows.

    Needs drone_id, baseline_group, feature_key, flight_index, value, qualified, valid, absolute_bad and the feature's
    floor, relative_floor and baselined. Adds whether the value was admitted and why not, how many were before it, and
    the rolling and reference baselines that it was judged against (null while they have too few values). A value is
    judged against admitted values only, so each decision depends on the earlier ones.
    """
    return fold_sorted(observations, KEYS, ["flight_index"], gate, GATE_INPUTS, GATE_OUTPUTS)


def inferred_changes(admitted: DataFrame) -> DataFrame:
    """(keys, direction, baseline_median, max_pairwise_z): series whose last three qualified flights agree on a new level.

    All three were outliers on one side of the baseline they were judged against, and lie within two spreads.
    """
    last = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("flight_index")))
    rows = admitted.filter("qualified").withColumn("place", last).filter(F.col("place") <= INFER_FLIGHTS)
    out = rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.coalesce(F.col("quarantine_reason") == "outlier", F.lit(False))).alias("outliers"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.max_by("base_median", "place").alias("median"),
        F.max_by("base_spread", "place").alias("spread"),
    )
    pairwise = F.try_divide(F.col("hi") - F.col("lo"), F.col("spread"))
    one_side = (F.col("lo") > F.col("median")) | (F.col("hi") <= F.col("median"))
    out = out.filter((F.col("n") == INFER_FLIGHTS) & F.col("outliers") & one_side & (pairwise <= INFER_SPREADS))
    return out.select(*KEYS, F.when(F.col("lo") > F.col("median"), "up").otherwise("down").alias("direction"),
        F.col("median").alias("baseline_median"), pairwise.alias("max_pairwise_z"))
