"""All catalogue features of many flights at once, from long signals (flight, key, us, value).

flights has a row for each flight: flight, qualified, window_reason, start_us, end_us (airborne), steady_qualified,
steady_reason, cells, motor_count, accel_cutoff. steady has the steady segments (flight, segment, start_us, end_us),
which don't overlap. Every function gives rows (flight, feature_key, value, label, detail, reason): a value or a label
where the feature could be measured, else the reason. A flight without a feature's signal has no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import features as X
from .scans import stored
from .series import at_times, clipped
from .spectral import averaged_density

# Bands of the vibration spectrum in Hz (None: up to the Nyquist frequency) and seconds of a segment.
BANDS = (("vib.band_lo", 0.0, 5.0), ("vib.band_struct", 5.0, 20.0), ("vib.band_hi", 20.0, None))
SEGMENT_S, LEAST_SEGMENT, MOST_SEGMENT = 2.5, 16, 4096
# Seconds before takeoff and of hovering that voltages are taken from, samples these need, longest lag.
BEFORE_S, HOVER_S, MIN_VOLTS, LAG_S = 5.0, 30.0, 3, 0.3
FEW, UNSTEADY = "insufficient_samples", "insufficient_steady_flight"
RATIOS = ("vel", "pos", "hgt", "mag")
AXES = (("roll", "gyro.x"), ("pitch", "gyro.y"), ("yaw", "gyro.z"))


def rows_of(frame: DataFrame, feature: str | Column, value=None, reason=None, label=None, detail=None) -> DataFrame:
    """frame's flights as feature rows."""

    def column(x, kind: str, name: str) -> Column:
        return (F.lit(None) if x is None else x).cast(kind).alias(name)

    key = F.lit(feature) if isinstance(feature, str) else feature
    return frame.select("flight", key.alias("feature_key"), column(value, "double", "value"), column(label, "string", "label"),
        column(detail, "string", "detail"), column(reason, "string", "reason"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


#: Signals whose rate a feature needs.
RATED = ("accel_fifo.x", "accel.x", *(f"rate_sp.{a}" for a, _ in AXES))


def counts(signals: DataFrame, rated: tuple[str, ...] = RATED) -> DataFrame:
    """(flight, key, n, rate_hz): samples of every signal, and of rated ones a million over the median positive interval."""
    step = F.col("us") - F.lag("us").over(Window.partitionBy("flight", "key").orderBy("us"))
    rows = signals.filter(F.col("key").isin(*rated)).select("flight", "key", step.alias("step"))
    median = F.percentile(F.when(F.col("step") > 0, F.col("step")), F.lit(0.5))
    rates = rows.groupBy("flight", "key").agg((1e6 / median).alias("rate_hz"))
    return signals.groupBy("flight", "key").agg(F.count(F.lit(1)).alias("n")).join(rates, ["flight", "key"], "left")


def airborne(signals: DataFrame, flights: DataFrame) -> DataFrame:
    return X.inside(signals, flights.select("flight", "start_us", "end_us"), "flight")


def vector_length(signals: DataFrame, axes: list[str], alone: bool = False) -> DataFrame:
    """(flight, us, value): length of a vector logged by axis, of flights that have as many samples of each axis.

    Axes that are logged together align by their samples' places. With `alone`, flights without that have the first axis
    as it is. A flight's samples are sorted as arrays, one for each axis.
    """
    names = [f"a{i}" for i in range(len(axes))]
    own = signals.filter(F.col("key").isin(axes)).groupBy("flight").agg(*(F.sort_array(F.collect_list(F.when(F.col("key") == a,
        F.struct("us", "value")))).alias(n) for n, a in zip(names, axes, strict=True)))
    whole = reduce(lambda x, y: x & y, [F.size(n) == F.size(names[0]) for n in names[1:]])

    def length(first: Column, i: Column) -> Column:
        values = [F.get(n, i)["value"] for n in names]
        square = reduce(lambda x, y: x + y, [F.coalesce(v * v, F.lit(0.0)) for v in values])
        return F.struct(first["us"].alias("us"), F.when(F.coalesce(*values).isNotNull(), F.sqrt(square)).alias("value"))

    rows = own.select("flight", F.inline(F.when(whole, F.transform(names[0], length)).otherwise(F.col(names[0]) if alone else None)))
    return rows.select("flight", "us", "value")


def percentiles(signals: DataFrame, present: DataFrame, flights: DataFrame) -> DataFrame:
    """Features that are a percentile of one signal over the airborne window, and the largest of the test ratios."""
    vibration = vector_length(signals, ["vibe.x", "vibe.y", "vibe.z"], alone=True)
    names = {key for _, key, _ in X.PERCENTILES}
    own = signals.filter(F.col("key").isin(*names - {"imu.vibration"}))
    both = own.select("flight", "key", "us", "value").unionByName(vibration.withColumn("key", F.lit("imu.vibration")).select("flight", "key", "us", "value"))
    spans = flights.select("flight", "start_us", "end_us")
    inside = F.when(F.col("us").between(F.col("start_us"), F.col("end_us")), F.col("value"))  # an absent sample keeps the signal present
    found = X.percentile_features(both.join(spans, "flight").select("flight", "key", inside.alias("value")))
    ratios = airborne(signals.filter(F.col("key").isin([f"est.{r}_tr" for r in RATIOS])), flights)
    worst = X.worst_ratio(ratios, least=X.MIN_SAMPLES)
    return union([rows_of(found, F.col("feature_key"), F.col("value"), F.col("reason")), rows_of(worst, "est.test_ratio_p95",
        F.col("value"), detail=F.col("worst"))])


def clip_rate(signals: DataFrame, flights: DataFrame) -> DataFrame:
    """Clippings a minute: growth of the three counters between the last values at takeoff and at landing."""
    rows = signals.filter(F.col("key").isin([f"imu.clip{i}" for i in range(3)])).join(flights.select("flight", "start_us", "end_us"), "flight")
    at = lambda bound: F.max_by("value", F.when(F.col("us") <= F.col(bound), F.col("us")))
    each = rows.groupBy("flight", "key").agg(at("start_us").alias("before"), at("end_us").alias("after"), F.min_by("value",
        "us").alias("first"), F.first(F.col("end_us") - F.col("start_us")).alias("span"))
    grown = F.col("after") - F.coalesce("before", "first")
    out = each.groupBy("flight").agg(F.count(F.lit(1)).alias("n"), F.count("after").alias("known"), F.min(grown).alias("least"),
        F.sum(grown).alias("total"), F.first("span").alias("span"))
    out = out.filter("n = 3")
    reason = F.when(F.col("known") < 3, FEW).when(F.col("least") < 0, "counter_reset")
    return rows_of(out, "vib.clip_rate", F.when(reason.isNull(), F.col("total") / (F.col("span") / 6e7)), reason)


def vibration_bands(signals: DataFrame, present: DataFrame, flights: DataFrame, steady: DataFrame) -> DataFrame:
    """Power of the acceleration's length in three bands, in dB, over the steady segments that hold a Welch segment.

    Unfiltered accelerations are taken where all their axes are there, else filtered ones, which have no highest band
    and none above their filter's cutoff; a band that holds the cutoff says so.
    """
    keys = [f"{source}.{a}" for source in ("accel_fifo", "accel") for a in "xyz"]
    fifo = F.col("source") == "accel_fifo"
    sources = present.filter(F.col("key").isin(keys)).groupBy("flight", F.substring_index("key", ".", 1).alias("source")).agg(F.count_distinct("key").alias("axes"),
        F.count_distinct("n").alias("sizes"), F.max(F.when(F.col("key").endswith(".x"), F.col("rate_hz"))).alias("rate")).filter("axes = 3")
    mine = sources.groupBy("flight").agg(F.max(F.struct("source", "sizes", "rate")).alias("m")).select("flight", "m.*")  # of both, accel_fifo
    mine = mine.join(flights.select("flight", "steady_qualified", "steady_reason", "accel_cutoff"), "flight")
    length = F.least(F.lit(MOST_SEGMENT), F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.lit(float(LEAST_SEGMENT)), F.col("rate")
        * SEGMENT_S)) + 1e-12)).cast("int"))
    measured = mine.filter("steady_qualified").select("flight", "source", "rate", length.alias("length"))
    own = signals.filter(F.col("key").isin(keys)).join(measured.select("flight", "source"), "flight").filter(F.col("key").startswith("accel_fifo.") == fifo)
    lengths = vector_length(own.select("flight", F.substring_index("key", ".", -1).alias("key"), "us", "value"), ["x", "y", "z"]).join(measured, "flight")
    inside = lengths.join(steady.select("flight", "segment", F.col("start_us").alias("from_us"), F.col("end_us").alias("to_us")),
        "flight").filter("us BETWEEN from_us AND to_us")
    spectrum = stored(averaged_density(inside, ["flight", "segment"], ["flight"]))  # the bins of one segment for each flight
    bands = F.array(*[F.struct(F.lit(k).alias("feature_key"), F.lit(lo).alias("lo"), F.lit(hi).cast("double").alias("hi")) for k, lo, hi in BANDS])
    asked = mine.select("*", F.explode(bands).alias("b")).select("flight", "source", "sizes", "rate", "steady_qualified", "steady_reason",
        F.when(~fifo & (F.col("accel_cutoff") > 0), F.col("accel_cutoff")).alias("cutoff"), "b.*")
    asked = asked.withColumn("nyquist", F.col("rate") / 2).withColumn("hi", F.coalesce("hi", "nyquist"))
    bins = spectrum.join(asked.select("flight", "feature_key", "lo", "hi"), "flight").filter("hz > lo AND hz < hi")
    by = Window.partitionBy("flight", "feature_key").orderBy("hz")
    area = (F.col("hz") - F.lag("hz").over(by)) * (F.col("power") + F.lag("power").over(by)) / 2
    power = bins.select("flight", "feature_key", area.alias("area")).groupBy("flight", "feature_key").agg(F.sum("area").alias("power"),
        F.count(F.lit(1)).alias("bins"))
    out = asked.join(power, ["flight", "feature_key"], "left").join(spectrum.select("flight").distinct().withColumn("seen", F.lit(True)), "flight", "left")
    reason = (
        F.when(~F.col("steady_qualified"), F.coalesce("steady_reason", F.lit(UNSTEADY)))
        .when(F.col("rate").isNull() | (F.col("sizes") > 1), "accel_axes_misaligned")
        .when(F.col("seen").isNull(), "steady_segments_shorter_than_welch_window")
        .when((F.col("feature_key") == "vib.band_hi") & ~fifo, "requires_fifo_accel")
        .when(F.col("lo") >= F.col("nyquist"), "band_above_nyquist")
        .when(F.col("lo") >= F.col("cutoff"), "band_above_filter_cutoff")
        .when(F.coalesce("bins", F.lit(0)) < 2, "too_few_frequency_bins")
        .when(F.col("power") <= 0, "no_power_in_band")
    )
    partial = F.when(reason.isNull() & (F.col("hi") > F.col("cutoff")), "band_partially_filtered")
    return rows_of(out, F.col("feature_key"), F.when(reason.isNull(), 10 * F.log10("power")), reason, detail=partial)


def _steady_samples(signals: DataFrame, flights: DataFrame, steady: DataFrame) -> DataFrame:
    own = steady.join(flights.filter("steady_qualified").select("flight"), "flight")
    return X.inside(signals, own, "flight")


def _unsteady(flights: DataFrame) -> Column:
    return F.when(~F.col("steady_qualified"), F.coalesce("steady_reason", F.lit(UNSTEADY)))


def steady_medians(signals: DataFrame, present: DataFrame, flights: DataFrame, steady: DataFrame) -> DataFrame:
    """Medians over steady flight: the imbalance metric and the thrust of hovering."""
    names = {"fd.imbalance": "vib.imbalance", "thrust.sp": "act.hover"}
    own = _steady_samples(signals.filter(F.col("key").isin(list(names))), flights, steady)
    own = own.groupBy("flight", "key").agg(F.percentile("value", F.lit(0.5)).alias("median"), F.count(F.lit(1)).alias("n"))
    out = present.filter(F.col("key").isin(list(names))).select("flight", "key").join(flights.select("flight", "steady_qualified",
        "steady_reason"), "flight").join(own, ["flight", "key"], "left")
    reason = F.coalesce(_unsteady(flights), F.when(F.coalesce("n", F.lit(0)) < X.MIN_SAMPLES, FEW))
    feature = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("key")]
    return rows_of(out, feature, F.when(reason.isNull(), F.col("median")), reason)


def motor_signals(signals: DataFrame, present: DataFrame, flights: DataFrame) -> DataFrame:
    """(flight, motor, us, value) of flights that log all their motors, else of those that log all their outputs."""
    number = F.regexp_extract("key", r"^act\.(motor|out)(\d+)$", 2)
    kind = F.regexp_extract("key", r"^act\.(motor|out)(\d+)$", 1)
    rows = present.select("flight", kind.alias("kind"), F.try_to_number(F.nullif(number, F.lit("")),
        F.lit("999")).cast("int").alias("motor")).filter("motor IS NOT NULL")
    rows = rows.join(flights.select("flight", "motor_count"), "flight").filter("motor < motor_count")
    whole = rows.groupBy("flight", "kind",
        "motor_count").agg(F.count(F.lit(1)).alias("n")).filter("n = motor_count").groupBy("flight").agg(F.min("kind").alias("kind"), F.first("motor_count").alias("motor_count"))
    motors = signals.filter(F.col("key").rlike(r"^act\.(motor|out)\d+$")).withColumn("motor", number.cast("int")).withColumn("own", kind)
    return motors.join(whole, "flight").filter("own = kind AND motor < motor_count").select("flight", "motor", "us", "value")


def motor_features(signals: DataFrame, present: DataFrame, flights: DataFrame, steady: DataFrame, geometry: DataFrame) -> DataFrame:
    """Saturation over the airborne window; mean, spread and pattern of the motors over steady flight."""
    motors = motor_signals(signals, present, flights)
    have = motors.select("flight").distinct().join(flights.select("flight", "steady_qualified", "steady_reason"), "flight")
    each = Window.partitionBy("flight", "motor")
    air = airborne(motors, flights).withColumn("i", F.row_number().over(each.orderBy("us"))).withColumn("n", F.count(F.lit(1)).over(each))
    air = air.withColumn("least", F.min("n").over(Window.partitionBy("flight"))).filter("i <= least")  # the shortest motor ends all
    full = have.join(X.saturation(air), "flight", "left")
    means = X.motor_means(_steady_samples(motors, flights, steady))
    spread, pattern = X.motor_spread(means), X.motor_pattern(means, geometry)
    still = have.filter("steady_qualified").select("flight")
    unsteady = have.filter("NOT steady_qualified")
    return union(
        [
            rows_of(full, "act.sat_frac", F.col("sat_frac"), F.when(F.col("sat_frac").isNull(), FEW)),
            rows_of(still.join(spread, "flight"), "act.mean", F.col("mean")),
            rows_of(still.join(spread, "flight"), "act.spread", F.col("spread"), F.col("reason"), detail=F.col("highest")),
            rows_of(still.join(pattern, "flight"), "act.pattern", None, F.col("reason"), F.col("pattern"), F.col("detail")),
            *(rows_of(unsteady, f"act.{x}", None, _unsteady(flights)) for x in ("mean", "spread", "pattern")),
        ]
    )


def power_features(signals: DataFrame, present: DataFrame, flights: DataFrame, steady: DataFrame) -> DataFrame:
    """Resistance of a cell, its lowest voltage and its sag in hovering, and the spread between cells.

    Without a known number of cells, only the last. The battery's fields must have the same times.
    """
    fields = {"batt.voltage_raw": "volts", "batt.current_raw": "amps", "batt.discharged_mah": "mah"}
    volts = signals.filter("key = 'batt.voltage_raw'")
    have = present.filter("key = 'batt.voltage_raw'").select("flight").join(flights, "flight")
    known = have.filter("cells IS NOT NULL")
    unknown = have.filter("cells IS NULL")
    own = signals.filter(F.col("key").isin(list(fields)))
    wide = own.groupBy("flight", "us").agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(n) for k, n in fields.items()),
        F.count(F.lit(1)).alias("n"))
    aligned = wide.groupBy("flight").agg(F.bool_and(F.col("n") == 3).alias("aligned"), F.count("amps").alias("amps"), F.count("mah").alias("mah"))
    air = airborne(wide.select("flight", "us", *fields.values()), flights)
    fit = X.pack_resistance(air)
    r = known.join(aligned, "flight").join(fit.select("flight", "r_cell_mohm", F.col("reason").alias("unfit")), "flight", "left").filter("amps > 0 AND mah > 0")
    reason = F.when(~F.col("aligned"), "battery_fields_misaligned").otherwise(F.when(F.col("r_cell_mohm").isNull(), F.coalesce("unfit", F.lit(FEW))))
    lowest = airborne(volts, flights).groupBy("flight").agg(F.min("value").alias("low"), F.count(F.lit(1)).alias("n"))
    low = known.join(lowest, "flight", "left")
    few = F.when(F.coalesce("n", F.lit(0)) < X.MIN_SAMPLES, FEW)
    before = flights.select("flight", (F.col("start_us") - int(BEFORE_S * 1e6)).alias("start_us"), (F.col("start_us") - 1).alias("end_us"))
    total = Window.partitionBy("flight").orderBy("start_us").rowsBetween(Window.unboundedPreceding, -1)
    spans = steady.withColumn("length_us", F.col("end_us") - F.col("start_us")).withColumn("before_us", F.coalesce(F.sum(F.col("end_us")
        - F.col("start_us")).over(total), F.lit(0)))
    hover = clipped(spans, int(HOVER_S * 1e6)).join(flights.filter("steady_qualified").select("flight"), "flight")

    def median(windows: DataFrame, name: str) -> DataFrame:
        return X.inside(volts, windows, "flight").groupBy("flight").agg(F.percentile("value", F.lit(0.5)).alias(name), F.count(F.lit(1)).alias(f"n_{name}"))

    sag = known.join(median(before, "rest"), "flight", "left").join(median(hover, "hover"), "flight", "left")
    no_sag = F.coalesce(
        F.when(F.coalesce("n_rest", F.lit(0)) < MIN_VOLTS, "no_pre_takeoff_data"), _unsteady(flights), F.when(F.coalesce("n_hover", F.lit(0)) < MIN_VOLTS, FEW)
    )
    delta = X.cell_delta(signals.filter("key = 'batt.cell_delta'"))
    return union(
        [
            *(rows_of(unknown, k, None, F.lit("cell_count_unknown")) for k in ("pwr.r_cell", "pwr.v_cell_min", "pwr.sag_hover")),
            rows_of(r, "pwr.r_cell", F.when(reason.isNull(), F.col("r_cell_mohm") / F.col("cells")), reason),
            rows_of(low, "pwr.v_cell_min", F.when(few.isNull(), F.col("low") / F.col("cells")), few),
            rows_of(sag, "pwr.sag_hover", F.when(no_sag.isNull(), (F.col("rest") - F.col("hover")) / F.col("cells")), no_sag),
            rows_of(delta, "pwr.cell_delta", F.col("value"), F.col("reason")),
        ]
    )


def tracking(signals: DataFrame, present: DataFrame, flights: DataFrame) -> DataFrame:
    """(flight, axis, n, active, need, ratio, best_lag_ms, ratio_at_best_lag, reason) of rates on commanded motion.

    The gyro is interpolated at the setpoints' times. The lag is the shift, up to LAG_S, by which the gyro comes nearest
    to the setpoints; shifted samples go round from the end to the start of the window.
    """
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(f"rate_sp.{a}").alias("sp_key"), F.lit(g).alias("gyro_key")) for a,
        g in AXES])).alias("a")
    asked = flights.select("flight", "start_us", "end_us", axes).select("flight", "start_us", "end_us", "a.*")
    rate = present.select("flight", F.col("key").alias("sp_key"), "rate_hz")
    asked = asked.join(rate, ["flight", "sp_key"]).join(present.select("flight", F.col("key").alias("gyro_key")), ["flight", "gyro_key"])
    axis_of = F.create_map(*[F.lit(x) for a, g in AXES for x in (f"rate_sp.{a}", a, g, a)])[F.col("key")]
    track = ["flight", "axis"]
    sp = airborne(signals.filter(F.col("key").isin([f"rate_sp.{a}" for a, _ in AXES])), flights).select("flight", axis_of.alias("axis"), "us",
        F.col("value").alias("sp"))
    gyro = signals.filter(F.col("key").isin([g for _, g in AXES])).select("flight", axis_of.alias("axis"), "us", "value")
    on = F.abs("sp") > X.MANOEUVRE_RATE
    own = asked.select(*track, "rate_hz", F.floor(F.col("rate_hz") * X.MANOEUVRE_S).alias("need"), F.greatest(F.lit(1),
        F.floor(F.col("rate_hz") * LAG_S)).cast("int").alias("lags"))
    level = at_times(gyro, sp, track, clamp=True).groupBy(*track).agg(F.count(F.lit(1)).alias("n"), F.count_if(on).alias("active"),
        F.sqrt(F.avg(F.when(on, F.col("sp") * F.col("sp")))).alias("rms"), F.sort_array(F.collect_list(F.struct("us", "sp", "value"))).alias("s"))
    moving = F.filter(F.transform("s", lambda x, i: F.struct(x["sp"].alias("sp"), i.alias("i"))), lambda x: F.abs(x["sp"]) > X.MANOEUVRE_RATE)

    def error(k: Column) -> Column:
        apart = F.filter(F.transform("moving", lambda x: F.get("s", F.pmod(x["i"] - k, F.size("s")))["value"] - x["sp"]), lambda d: d.isNotNull())
        return F.sqrt(F.try_divide(F.aggregate(apart, F.lit(0.0), lambda t, d: t + d * d), F.size(apart)))

    found = own.join(level, track, "left").withColumn("moving", moving)
    found = found.withColumn("errors", F.transform(F.sequence(F.lit(0), F.coalesce("lags", F.lit(1)) - 1), lambda k: F.struct(error(k).alias("error"), k.alias("k"))))
    nearest = F.array_min(F.transform("errors", lambda e: F.struct(F.round(e["error"], 12).alias("error"), e["k"].alias("k"))))
    out = found.select(*track, "rate_hz", "need", "n", "active", "rms", nearest.alias("best"), F.get("errors", F.lit(0))["error"].alias("plain"))
    reason = F.when((F.coalesce("n", F.lit(0)) < X.MIN_SAMPLES) | F.col("rate_hz").isNull(), FEW).when(F.col("active") < F.col("need"),
        "insufficient_manoeuvring")
    fine = reason.isNull()
    return out.select(
        *track, "n", "active", "need",
        F.when(fine, F.col("plain") / F.col("rms")).alias("ratio"),
        F.when(fine, F.col("best.k") / F.col("rate_hz") * 1000).alias("best_lag_ms"),
        F.when(fine, F.col("best.error") / F.col("rms")).alias("ratio_at_best_lag"),
        reason.alias("reason"),
    )


def attitude(signals: DataFrame, present: DataFrame, flights: DataFrame) -> DataFrame:
    """p95 of the angle between attitude, interpolated at the setpoints' times, and setpoint."""
    parts = [f"{kind}.q{c}" for kind in ("att", "att_sp") for c in "wxyz"]
    have = present.filter(F.col("key").isin(parts)).groupBy("flight").agg(F.count(F.lit(1)).alias("n")).filter("n = 8").select("flight")
    own = signals.filter(F.col("key").isin(parts)).join(have, "flight").select("flight", F.split("key", r"\.")[0].alias("kind"),
        F.split("key", r"\.")[1].alias("part"), "us", "value")
    track = ["flight", "part"]
    targets = airborne(own.filter("kind = 'att_sp'"), flights)
    rows = at_times(own.filter("kind = 'att'").select(*track, "us", "value"), targets.select(*track, "us", F.col("value").alias("d")), track, clamp=True)
    pick = lambda c, v: F.max(F.when(F.col("part") == f"q{c}", F.col(v)))
    wide = rows.groupBy("flight", "us").agg(*(pick(c, "value").alias(f"q{c}") for c in "wxyz"), *(pick(c,
        "d").alias(f"d{c}") for c in "wxyz"))
    out = have.join(X.attitude_error(wide), "flight", "left")
    few = F.when(F.coalesce("n", F.lit(0)) < X.MIN_SAMPLES, FEW)
    return rows_of(out, "trk.att_err_p95", F.when(few.isNull(), F.col("value")), few)


def extracted(signals: DataFrame, flights: DataFrame, steady: DataFrame, geometry: DataFrame) -> DataFrame:
    """Every feature row of the qualified flights; X.all_features adds what is absent and the flights that don't qualify.

    The number of samples and the rate of every signal, a few dozen narrow rows a flight, are kept for all features.
    """
    fine = flights.filter("qualified")
    own = signals.join(fine.select("flight"), "flight", "left_semi")
    present = stored(counts(own))
    tracked = tracking(own, present, fine)
    lag = F.format_string("lag %.1f ms, ratio %.3f", "best_lag_ms", "ratio_at_best_lag")
    return union(
        [
            percentiles(own, present, fine),
            clip_rate(own, fine),
            vibration_bands(own, present, fine, steady),
            steady_medians(own, present, fine, steady),
            motor_features(own, present, fine, steady, geometry),
            power_features(own, present, fine, steady),
            rows_of(tracked, F.concat(F.lit("trk.rate_rms."), "axis"), F.col("ratio"), F.col("reason"), detail=F.when(F.col("reason").isNull(), lag)),
            attitude(own, present, fine),
        ]
    )


def spread_details(found: DataFrame) -> DataFrame:
    """(flight, spread, highest_motor, mean, pattern, pattern_detail): a spread with what its finding names.

    found: rows (flight, feature_key, value, label, detail); a flight without a spread has no row.
    """
    of = lambda key, field: F.max(F.when(F.col("feature_key") == key, F.col(field)))
    out = found.groupBy("flight").agg(
        of("act.spread", "value").alias("spread"), of("act.spread", "detail").cast("int").alias("highest_motor"), of("act.mean", "value").alias("mean"),
        of("act.pattern", "label").alias("pattern"), of("act.pattern", "detail").alias("pattern_detail"),
    )
    return out.filter("spread IS NOT NULL")
