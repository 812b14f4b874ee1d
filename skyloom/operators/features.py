"""Per-flight features from long signals: (flight, key, us, value), a window per flight and steady segments.

Each feature is one grouped aggregate over the flight; values come with a reason where there is none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalogue import features as catalogue
from .scans import quantiles
from .series import at_times

# Least samples, saturation, current range, manoeuvre rate, pattern cuts, sag window.
MIN_SAMPLES, SATURATION, CURRENT_RANGE, MIN_FIT = 10, 0.98, 0.30, 20
MANOEUVRE_RATE, MANOEUVRE_S = 0.3, 10.0
BALANCED_SPREAD, SINGLE_SHARE, MODEL_R2 = 0.02, 0.5, 0.6
#: (feature, signal, percentile) of features that are one percentile of one signal.
PERCENTILES = (
    ("vib.metric_p50", "imu.vibration", 0.5),
    ("vib.metric_p95", "imu.vibration", 0.95),
    ("gps.eph_p50", "gps.eph", 0.5),
    ("gps.nsats_p10", "gps.nsats", 0.1),
    ("gps.sacc_p50", "gps.sacc", 0.5),
    ("gps.noise", "gps.noise", 0.5),
    ("gps.jamming", "gps.jamming", 0.5),
)


def inside(signals: DataFrame, windows: DataFrame, flight: str = "flight") -> DataFrame:
    """Samples within each flight's windows (flight, start_us, end_us), ends included; windows must not overlap."""
    spans = windows.select(flight, "start_us", "end_us")
    return signals.join(spans, flight).filter(F.col("us").between(F.col("start_us"), F.col("end_us"))).drop("start_us", "end_us")


def magnitude(*axes: Column) -> Column:
    """Length of a vector, for autopilots that log vibration by axis."""
    return F.sqrt(reduce(lambda a, b: a + b, [a * a for a in axes]))


def percentile_features(signals: DataFrame, table: tuple = PERCENTILES, flight: str = "flight") -> DataFrame:
    """(flight, feature_key, value, reason) of every percentile feature whose signal the flight has; few samples give a reason.

    Only wanted signals take part, once for all percentiles; ranks are looked for among sorted values (scans.quantiles),
    so no task holds a signal of more than scans.TASK_ROWS samples.
    """
    shares = sorted({p for _, _, p in table})
    wanted = F.array(*[F.struct(F.lit(f).alias("feature_key"), F.lit(k).alias("key"), F.lit(shares.index(p)).alias("at")) for f, k, p in table])
    own = signals.filter(F.col("key").isin(sorted({k for _, k, _ in table})))
    there = own.select(flight, "key").distinct()
    found = quantiles(own.select(flight, "key", "value"), [flight, "key"], "value", shares)
    own = there.join(found, [flight, "key"], "left").select(flight, "key", F.col("q").alias("p"), F.coalesce("n", F.lit(0)).alias("n"))
    named = own.select("*", F.explode(wanted).alias("w")).filter(F.col("w.key") == F.col("key"))
    enough = F.col("n") >= MIN_SAMPLES
    return named.select(flight, "w.feature_key", F.when(enough, F.get("p", F.col("w.at"))).alias("value"), F.when(~enough,
        "insufficient_samples").alias("reason"))


def worst_ratio(signals: DataFrame, flight: str = "flight", least: int = 1) -> DataFrame:
    """(flight, value, worst): the largest p95 of the estimator's test ratios with enough samples, and which one it is."""
    found = quantiles(signals.select(flight, "key", "value"), [flight, "key"], "value", [0.95])
    own = found.select(flight, "key", F.get("q", F.lit(0)).alias("p95"), "n").filter(F.col("n") >= least)
    return own.groupBy(flight).agg(F.max("p95").alias("value"), F.max_by("key", F.struct("p95", "key")).alias("worst"))


def saturation(motors: DataFrame, flight: str = "flight") -> DataFrame:
    """(flight, sat_frac, n): share of samples in which any motor is at full output; motors: (flight, i, motor, value)."""
    samples = motors.groupBy(flight, "i").agg(F.bool_or(F.col("value") >= SATURATION).alias("any"))
    return samples.groupBy(flight).agg(F.avg(F.col("any").cast("int")).alias("sat_frac"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_SAMPLES)


def motor_means(motors: DataFrame, flight: str = "flight") -> DataFrame:
    return motors.groupBy(flight, "motor").agg(F.avg("value").alias("mean"))


def motor_spread(means: DataFrame, flight: str = "flight") -> DataFrame:
    """(flight, mean, spread, highest, reason): spread is (max - min) / mean over the motors' means; highest counts from 1."""
    out = means.groupBy(flight).agg(F.avg("mean").alias("mean"), F.max("mean").alias("hi"), F.min("mean").alias("lo"),
        F.count("mean").alias("n"), F.max_by("motor", F.struct("mean", -F.col("motor"))).alias("at"))
    few = (F.col("n") < 2) | (F.col("mean") <= 0)
    return out.select(flight, "mean", F.when(~few, (F.col("hi") - F.col("lo")) / F.col("mean")).alias("spread"), F.when(~few, F.col("at")
        + 1).alias("highest"), F.when(few, "too_few_motors").alias("reason"))


def motor_pattern(means: DataFrame, geometry: DataFrame, flight: str = "flight") -> DataFrame:
    """(flight, pattern, detail): what the motors' deviations from their mean look like.

    geometry: (flight, motor, px, py, km). Deviations are fitted by position (two variables, a shifted centre of
    gravity) and by spin direction (one variable), without intercept; where the position matrix is singular the
    minimum-norm fit has one variable's worth. A flight without whole geometry has no pattern.
    """
    d = F.col("mean") - F.col("centre")
    rows = means.join(geometry, [flight, "motor"], "left").join(means.groupBy(flight).agg(F.avg("mean").alias("centre")), flight).withColumn("d", d)
    s = F.signum("km")
    x, y, v = F.col("px"), F.col("py"), F.col("d")
    total = lambda c: F.sum(c)
    out = rows.groupBy(flight).agg(
        F.count(F.when(x.isNull() | y.isNull() | F.col("km").isNull(), 1)).alias("missing"),
        F.first("centre").alias("centre"),
        ((F.max("mean") - F.min("mean")) / F.first("centre")).alias("spread"),
        total(v * v).alias("vv"),
        total(x * x).alias("xx"),
        total(y * y).alias("yy"),
        total(x * y).alias("xy"),
        total(x * v).alias("xv"),
        total(y * v).alias("yv"),
        total(s * v).alias("sv"),
        total(s * s).alias("ss"),
        F.sort_array(F.collect_list(F.struct(v.alias("d"), (-F.col("motor")).alias("m"))), asc=False).alias("order"),
        total(F.when(v > 0, s)).alias("high_spin"),
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    trace = F.col("xx") + F.col("yy")
    regular = F.abs(det) > 1e-12 * trace * trace
    bx = F.when(regular, (F.col("xv") * F.col("yy") - F.col("yv") * F.col("xy")) / det).otherwise(F.try_divide(F.col("xv"), trace))
    by = F.when(regular, (F.col("yv") * F.col("xx") - F.col("xv") * F.col("xy")) / det).otherwise(F.try_divide(F.col("yv"), trace))
    out = out.withColumns({"bx": bx, "by": by})
    side = F.try_divide(F.col("bx") * F.col("xv") + F.col("by") * F.col("yv"), F.col("vv"))
    spin = F.try_divide(F.col("sv") * F.col("sv"), F.col("ss") * F.col("vv"))
    top, second = F.get("order", F.lit(0))["d"], F.get("order", F.lit(1))["d"]
    out = out.withColumns({"side": F.coalesce(side, F.lit(0.0)), "spin": F.coalesce(spin, F.lit(0.0)), "share": F.try_divide(top * top, F.col("vv"))})
    single = (F.col("share") >= SINGLE_SHARE) & (top > 0) & (top >= 2 * F.greatest(second, F.lit(0.0)))
    modelled = F.greatest("side", "spin") >= MODEL_R2
    pattern = (
        F.when(F.col("missing") > 0, None)
        .when((F.col("spread") < BALANCED_SPREAD) | (F.col("vv") <= 1e-18), "balanced")
        .when(single, "single_motor_high")
        .when(modelled & (F.col("side") >= F.col("spin")), "one_side_high")
        .when(modelled, "same_spin_set_high")
        .otherwise("mixed")
    )
    toward = F.when(F.abs("bx") >= F.abs("by"), F.when(F.col("bx") > 0, "front").otherwise("rear")).otherwise(F.when(F.col("by") > 0,
        "right").otherwise("left"))
    detail = F.when(pattern == "single_motor_high", (1 - F.get("order", F.lit(0))["m"]).cast("string")).when(pattern == "one_side_high",
        toward).when(pattern == "same_spin_set_high", F.when(F.col("high_spin") > 0, "+").otherwise("-"))
    return out.select(flight, pattern.alias("pattern"), detail.alias("detail"), F.round("side", 3).alias("r2_one_side"), F.round("spin",
        3).alias("r2_same_spin"), F.when(F.col("missing") > 0, "geometry_unavailable").alias("reason"))


def pack_resistance(battery: DataFrame, cells: Column | None = None, flight: str = "flight") -> DataFrame:
    """(flight, r_cell_mohm, se_ohm, r2, n, reason): V = a + b mAh - R I by least squares over the flight's samples.

    battery: (flight, volts, amps, mah). Sums are of centred values, so the normal equations have two unknowns. Needs
    MIN_FIT samples and a spread of currents; a fit that gives no positive resistance is not physical.
    """
    cells = F.lit(1.0) if cells is None else cells
    rows = battery.dropna(subset=["volts", "amps", "mah"])
    cov = lambda a, b: F.covar_pop(a, b) * F.count(F.lit(1))
    p = F.percentile("amps", F.array(F.lit(0.05), F.lit(0.95)))
    s = rows.groupBy(flight).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("amps").alias("mean_i"),
        p.alias("p"),
        *(cov(a, b).alias(n) for a, b, n in (("mah", "mah", "cc"), ("amps", "amps", "ii"), ("mah", "amps", "ci"), ("mah", "volts", "cv"),
            ("amps", "volts", "iv"), ("volts", "volts", "vv"))),
    )
    det = F.col("cc") * F.col("ii") - F.col("ci") * F.col("ci")
    slope = F.try_divide(F.col("iv") * F.col("cc") - F.col("cv") * F.col("ci"), det)
    drift = F.try_divide(F.col("cv") * F.col("ii") - F.col("iv") * F.col("ci"), det)
    s = s.withColumns({"r": -slope, "b": drift})
    rest = F.greatest(F.col("vv") - F.col("b") * F.col("cv") + F.col("r") * F.col("iv"), F.lit(0.0))
    s = s.withColumn("rest", rest)
    se = F.sqrt(F.col("rest") / F.greatest(F.lit(1), F.col("n") - 3) * F.try_divide(F.col("cc"), det))
    reason = (
        F.when(F.col("n") < MIN_FIT, "insufficient_samples")
        .when((F.col("mean_i") <= 0) | (F.col("p")[1] - F.col("p")[0] < CURRENT_RANGE * F.col("mean_i")), "insufficient_current_range")
        .when(F.col("r").isNull() | (F.col("r") <= 0), "non_physical_fit")
    )
    fine = reason.isNull()
    return s.select(flight, F.when(fine, F.col("r") / cells * 1000).alias("r_cell_mohm"), F.when(fine, se).alias("se_ohm"), F.when(fine, 1
        - F.try_divide(F.col("rest"), F.col("vv"))).alias("r2"), "n", reason.alias("reason"))


def hover_sag(volts: DataFrame, before: DataFrame, steady: DataFrame, cells: float = 1.0, flight: str = "flight") -> DataFrame:
    """(flight, sag): median voltage before takeoff less that of the first steady stretch, per cell."""
    median = lambda spans, name: inside(volts, spans, flight).groupBy(flight).agg(F.percentile("value", F.lit(0.5)).alias(name))
    return median(before, "rest").join(median(steady, "hover"), flight).select(flight, ((F.col("rest") - F.col("hover")) / cells).alias("sag"))


def lowest_cell(volts: DataFrame, cells: float, flight: str = "flight") -> DataFrame:
    return volts.groupBy(flight).agg((F.min("value") / cells).alias("v_cell_min"))


def cell_delta(deltas: DataFrame, flight: str = "flight") -> DataFrame:
    """(flight, value, reason): p95 of the spread between cells; all zeros mean that no cell is sensed."""
    out = deltas.groupBy(flight).agg(F.percentile("value", F.lit(0.95)).alias("p"), F.bool_or(F.col("value") != 0).alias("any"))
    return out.select(flight, F.when(F.col("any"), F.col("p")).alias("value"), F.when(~F.col("any"), "no_per_cell_sensing").alias("reason"))


def cell_count(parameter: Column, signal_median: Column) -> Column:
    """Cells by parameter, else by the logged count."""
    return F.coalesce(F.nullif(parameter, F.lit(0)), F.round(signal_median).cast("int"))


def rate_tracking(setpoints: DataFrame, gyro: DataFrame, rate_hz: float, threshold: float = MANOEUVRE_RATE, key: str = "key",
    need_s: float = MANOEUVRE_S) -> DataFrame:
    """(key, ratio, active, reason): RMS of gyro less setpoint over RMS of setpoint, on commanded motion.

    The gyro is interpolated at the setpoints' times. Needs need_s seconds of setpoints beyond the threshold.
    """
    rows = at_times(gyro, setpoints.select(key, "us", F.col("value").alias("sp")), key, clamp=True)
    error = F.col("value") - F.col("sp")
    active = F.abs("sp") > threshold
    out = rows.groupBy(key).agg(F.count_if(active).alias("active"), F.sqrt(F.avg(F.when(active, error * error))).alias("e"),
        F.sqrt(F.avg(F.when(active, F.col("sp") * F.col("sp")))).alias("s"))
    few = F.col("active") < int(need_s * rate_hz)
    return out.select(key, F.when(~few, F.try_divide("e", "s")).alias("ratio"), "active", F.when(few, "insufficient_manoeuvring").alias("reason"))


def quaternion_angle(a: list[Column], b: list[Column]) -> Column:
    """Degrees between two attitudes; either sign of a quaternion is the same attitude."""
    length = lambda q: F.sqrt(reduce(lambda x, y: x + y, [c * c for c in q]))
    dot = reduce(lambda x, y: x + y, [p * q for p, q in zip(a, b, strict=True)]) / (length(a) * length(b))
    return F.degrees(2 * F.acos(F.least(F.lit(1.0), F.abs(dot))))


def attitude_error(rows: DataFrame, flight: str = "flight") -> DataFrame:
    """(flight, value, n): p95 of the angle between attitude (qw..qz) and setpoint (dw..dz)."""
    angle = quaternion_angle([F.col(f"q{c}") for c in "wxyz"], [F.col(f"d{c}") for c in "wxyz"])
    return rows.groupBy(flight).agg(F.percentile(angle, F.lit(0.95)).alias("value"), F.count(F.lit(1)).alias("n"))


def normalised_actuator(value: Column, lowest: Column, highest: Column, least: Column, most: Column) -> Column:
    """Output as a share of its range; signals that lie in it already pass through."""
    return F.when((lowest >= -0.01) & (highest <= 1.01), value).otherwise(F.try_divide(value - least, most - least))


def all_features(flights: DataFrame, values: DataFrame, flight: str = "flight", extra: tuple[str, ...] = ()) -> DataFrame:
    """Every catalogue feature of every flight: value or reason. flights: (flight, qualified, window_reason).

    An unqualified flight has no value, with its window's reason; a feature without any row has no signal. Columns
    `extra` of values are kept; a row with a first one of these, a label, needs no value.
    """
    names = catalogue(flights.sparkSession).select("feature_key", "subsystem", "tier")
    every = flights.crossJoin(F.broadcast(names))  # 26 rows
    rows = every.join(values.select(flight, "feature_key", "value", "reason", *extra), [flight, "feature_key"], "left")
    own = [F.when(F.col("qualified"), F.col(c)).alias(c) for c in ("value", *extra)]
    nothing = F.col("value").isNull() & (F.col(extra[0]).isNull() if extra else F.lit(True))
    reason = F.when(~F.col("qualified"), F.coalesce("window_reason", F.lit("flight_not_qualified"))).when(nothing, F.coalesce("reason", F.lit("signal_absent")))
    return rows.select(flight, "feature_key", "subsystem", "tier", *own, reason.alias("reason"))
