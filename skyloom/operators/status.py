"""Status of vehicles from their recent readings: drain regression, outliers, alerts and an additive risk score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sample sizes, cuts and points of the status rules.
MIN_REGRESSION, MIN_HISTORY = 5, 8
FLAT_SLOPE = -0.01
Z_CUT = 2.5
BATTERY_POINTS = ((15, 40), (30, 25), (50, 10))
MINUTES_POINTS = ((2, 25), (5, 15), (10, 5))
TEMPERATURE_POINTS = ((80, 20), (60, 10))
ANOMALY_POINTS, ANOMALY_CAP, FAULT_CAP = 8, 15, 20
HEALTH_BANDS = ((70, "critical"), (40, "warning"))
LOW_BATTERY, OVERHEATING = 20, 80


def fleet_averages(readings: DataFrame) -> DataFrame:
    """Per vehicle: mean speed, temperature and battery, highest altitude, number of readings. Nulls are skipped."""
    return readings.groupBy("drone_id").agg(
        F.avg("speed").alias("avg_speed"), F.avg("temperature").alias("avg_temperature"), F.max("altitude").alias("max_altitude"), F.avg("battery").alias("avg_battery"), F.count(F.lit(1)).alias("readings")
    )


def line_fit(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """Least-squares slope, intercept and R2 clamped to [0, 1]; without variance in x the slope is 0.

    A constant y has R2 1 where the line fits it, which it always does.
    """
    slope = F.coalesce(F.regr_slope(y, x), F.lit(0.0))
    flat = F.var_pop(y) == 0
    fit = F.when(flat, 1.0).when(F.regr_slope(y, x).isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.regr_r2(y, x))))
    return slope, F.coalesce(F.regr_intercept(y, x), F.avg(y)), fit


def battery_estimate(recent: DataFrame) -> DataFrame:
    """Drain per minute of each vehicle's recent readings, and minutes until empty where it drains.

    At least MIN_REGRESSION readings with a battery value; otherwise the vehicle has no row. A slope of FLAT_SLOPE or
    more gives the rate only. minutes = max(0, -last battery / slope); confidence is R2.
    """
    rows = recent.filter("battery IS NOT NULL")
    first = F.min("us").over(Window.partitionBy("drone_id"))
    rows = rows.withColumn("minute", (F.col("us") - first) / 6e7)
    slope, _, fit = line_fit(F.col("minute"), F.col("battery"))
    last = F.max_by("battery", F.struct("us", "reading_id"))
    out = rows.groupBy("drone_id").agg(slope.alias("slope"), fit.alias("fit"), last.alias("last"),
        F.count(F.lit(1)).alias("sample_size")).filter(F.col("sample_size") >= MIN_REGRESSION)
    drains = F.col("slope") < FLAT_SLOPE
    minutes = F.greatest(F.lit(0.0), -F.col("last") / F.col("slope"))
    return out.select("drone_id", F.col("slope").alias("drain_per_min"), F.when(drains, minutes).alias("minutes_remaining"), F.when(drains,
        F.col("fit")).alias("confidence"), "sample_size")


def outliers(recent: DataFrame, fields: tuple[str, ...] = ("temperature", "speed")) -> DataFrame:
    """Per vehicle and field: mean, deviation and z of the current value (place 1) against the readings before it.

    Only vehicles with MIN_HISTORY values before it and a deviation above 0; anomalous says that abs(z) > Z_CUT.
    """
    stats = recent.groupBy("drone_id").agg(F.array(*map(_field_stats, fields)).alias("stats"))
    return _judged(stats.select("drone_id", F.explode("stats").alias("s")).select("drone_id", "s.*"))


def _field_stats(field: str) -> Column:
    """A struct of the field's current value and the statistics of those before it, for one aggregation of all fields."""
    before = F.when(F.col("place") > 1, F.col(field))
    current = F.max(F.when(F.col("place") == 1, F.col(field))).alias("value")
    return F.struct(F.lit(field).alias("field"), current, F.avg(before).alias("mean"), F.stddev_pop(before).alias("deviation"), F.count(before).alias("n"))


def _judged(stats: DataFrame) -> DataFrame:
    rows = stats.filter((F.col("n") >= MIN_HISTORY) & (F.col("deviation") > 1e-12) & F.col("value").isNotNull())
    z = (F.col("value") - F.col("mean")) / F.col("deviation")
    return rows.withColumn("z", z).withColumn("anomalous", F.abs(z) > Z_CUT)


def points(value: Column, table: tuple[tuple[float, int], ...], above: bool = False) -> Column:
    """Points of the first cut that the value is under (or above); 0 for none or a null."""
    out = F.lit(0)
    for cut, n in reversed(table):
        out = F.when(value > cut if above else value < cut, n).otherwise(out)
    return out


def health_band(risk: Column) -> Column:
    out = F.lit("healthy")
    for cut, name in reversed(HEALTH_BANDS):
        out = F.when(risk >= cut, name).otherwise(out)
    return out


def risk(recent: DataFrame, fault_points: DataFrame) -> DataFrame:
    """Additive 0-100 risk of every vehicle's current reading, from recent rows (place from 1) and (drone_id, fault_points).

    The recent rows are read once: one aggregation gives the current reading, the drain and the statistics of all fields.
    """
    first = F.min(F.when(F.col("battery").isNotNull(), F.col("us"))).over(Window.partitionBy("drone_id"))
    known = F.when(F.col("battery").isNotNull(), (F.col("us") - first) / 6e7)
    slope, _, _ = line_fit(F.col("minute"), F.col("battery"))
    now = lambda c: F.max(F.when(F.col("place") == 1, F.col(c))).alias(c)
    last = F.max_by("battery", F.when(F.col("battery").isNotNull(), F.struct("us", "reading_id")))
    rows = recent.withColumn("minute", known).groupBy("drone_id").agg(
        now("battery"),
        now("temperature"),
        F.when((F.count("battery") >= MIN_REGRESSION) & (slope < FLAT_SLOPE), F.greatest(F.lit(0.0), -last / slope)).alias("minutes_remaining"),
        F.array(_field_stats("temperature"), _field_stats("speed")).alias("stats"),
    )
    odd = F.filter("stats", lambda s: (s["n"] >= MIN_HISTORY) & (s["deviation"] > 1e-12) & (F.abs((s["value"] - s["mean"]) / s["deviation"]) > Z_CUT))
    rows = rows.withColumn("anomalies", F.size(odd)).join(fault_points, "drone_id", "left")
    n = F.col("anomalies")
    score = (
        points(F.col("battery"), BATTERY_POINTS)
        + points(F.col("minutes_remaining"), MINUTES_POINTS)
        + points(F.col("temperature"), TEMPERATURE_POINTS, above=True)
        + F.least(F.lit(ANOMALY_CAP), n * ANOMALY_POINTS)
        + F.least(F.lit(FAULT_CAP), F.coalesce("fault_points", F.lit(0)))
    )
    score = F.least(F.lit(100), score).cast("int")
    return rows.select("drone_id", n.cast("long").alias("anomalies"), score.alias("risk"), health_band(score).alias("health"))


def alerts(battery: Column, temperature: Column) -> Column:
    """Threshold alerts as an array; a null value is not evaluated."""
    found = F.array(F.when(battery < LOW_BATTERY, "LOW BATTERY"), F.when(temperature > OVERHEATING, "OVERHEATING"))
    return F.filter(found, lambda x: x.isNotNull())


def simple_risk(battery: Column, temperature: Column, speed: Column) -> Column:
    """The flat threshold score: 30 under 40 %, 30 more under 20 %, 20 above 70 C, 20 more above 80 C, 20 above 25 m/s."""
    rules = ((battery < 40, 30), (battery < 20, 30), (temperature > 70, 20), (temperature > 80, 20), (speed > 25, 20))
    return F.least(F.lit(100), reduce(lambda a, b: a + b, [F.when(rule, n).otherwise(0) for rule, n in rules]))


def simple_health(battery: Column, temperature: Column) -> Column:
    return F.when(battery < LOW_BATTERY, "CRITICAL").when(temperature > OVERHEATING, "OVERHEATING").when(battery < 40, "WARNING").otherwise("GOOD")
