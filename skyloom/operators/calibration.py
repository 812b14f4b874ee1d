"""Sensor checks per device and tracking of setpoints, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bias and noise limits of accelerometer and gyroscope, limit of variation, least samples.
ACCELEROMETER, GYROSCOPE, VARIATION = (0.5, 0.3), (1.0, 0.5), 0.05
MIN_SAMPLES, MIN_TRACKING = 10, 5
EXPECTED = {"accel_x": 0.0, "accel_y": 0.0, "accel_z": 9.81, "gyro_x": 0.0, "gyro_y": 0.0, "gyro_z": 0.0}


def bias_noise(axis: str, expected: float, bias_limit: float, noise_limit: float) -> tuple[Column, Column, Column]:
    """(bias, noise, pass): mean less what it should be, population deviation, and whether both are within limits."""
    bias, noise = F.avg(axis) - expected, F.stddev_pop(axis)
    return bias, noise, (F.abs(bias) <= bias_limit) & (noise <= noise_limit)


def variation(value: Column, limit: float = VARIATION) -> tuple[Column, Column]:
    """(coefficient of variation, pass) of a field strength or a response."""
    cv = F.try_divide(F.stddev_pop(value), F.avg(value))
    return cv, cv <= limit


def overall(*steps: str) -> Column:
    """Whether all supplied steps passed; null if none was supplied."""
    given = F.array(*map(F.col, steps))
    known = F.filter(given, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.forall(known, lambda x: x))


def imu_check(samples: DataFrame, device: str = "drone_id") -> DataFrame:
    """(device, n, axes passed, overall, reason) from idle samples; too few, or axes of unequal length, are unavailable."""
    parts = []
    for axis, expected in EXPECTED.items():
        bias, noise, fine = bias_noise(axis, expected, *(ACCELEROMETER if axis.startswith("accel") else GYROSCOPE))
        parts += [bias.alias(f"{axis}_bias"), noise.alias(f"{axis}_noise"), fine.alias(f"{axis}_pass"), F.count(axis).alias(f"{axis}_n")]
    out = samples.groupBy(device).agg(*parts)
    counts = [F.col(f"{a}_n") for a in EXPECTED]
    short = F.least(*counts) < MIN_SAMPLES
    reason = F.when(short, "insufficient_samples").when(F.least(*counts) != F.greatest(*counts), "unequal_axes")
    return out.withColumn("reason", reason).withColumn("overall", F.when(F.col("reason").isNull(), overall(*[f"{a}_pass" for a in EXPECTED])))


def tracking_error(rows: DataFrame, keys: tuple[str, ...] = ("drone_id", "axis"), least: int = MIN_TRACKING) -> DataFrame:
    """(keys, rms, max_error, n): actual against desired values; keys with fewer samples are left out."""
    e = F.col("actual") - F.col("desired")
    return rows.groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rms"), F.max(F.abs(e)).alias("max_error"), F.count(e).alias("n")).filter(F.col("n") >= least)
