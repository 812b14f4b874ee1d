"""Monte Carlo over rotor parameters and gusts: draws are made once and joined to specifications as summary rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import engineering as N
from ..functions.draws import normal, triangular, uniform

DRAWS, TURBULENCE = 2000, 0.15
# Lowest, likeliest and highest value of each uncertain blade parameter.
RANGES = {"lift_slope": (5.5, 5.75, 5.8), "cd0": (0.015, 0.02, 0.03), "chord": (0.06, 0.10, 0.12), "root_deg": (32.0, 36.0, 40.0), "tip_deg": (6.0, 10.0, 14.0)}
LEVELS = (0.05, 0.5, 0.95)


def blade_draws(spark: SparkSession, draws: int = DRAWS) -> DataFrame:
    """(draw, ct): thrust coefficients of randomly drawn blades."""
    rows = spark.range(draws).withColumnRenamed("id", "draw")
    parts = [triangular(uniform(F.col("draw"), i), *RANGES[name]) for i, name in enumerate(RANGES)]
    return rows.withColumn("ct", N.blade_coefficients(*parts)["ct"])


def summary(values: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """Mean, deviation and percentiles of a column, per key or overall."""
    p = F.percentile(name, F.array(*map(F.lit, LEVELS)))
    return values.groupBy(*(keys or [])).agg(F.avg(name).alias("mean"), F.stddev_pop(name).alias("sd"), p[0].alias("p05"), p[1].alias("p50"), p[2].alias("p95"))


def rpm_uncertainty(specs: DataFrame, draws: int = DRAWS) -> DataFrame:
    """specs (spec, thrust_n, diameter_m) with mean, sd and percentiles of the hover rpm under uncertain blades.

    rpm goes with the thrust coefficient's inverse root, so one summary row of that root serves every specification.
    """
    root = summary(blade_draws(specs.sparkSession, draws).withColumn("root", 1 / F.sqrt("ct")), "root")
    unit = N.blade_rpm(F.col("thrust_n"), F.lit(N.STANDARD_DENSITY), F.col("diameter_m"), F.lit(1.0))
    return specs.crossJoin(F.broadcast(root)).select("spec", *((unit * F.col(c)).alias(c) for c in ("mean", "sd", "p05", "p50", "p95")))  # one row


def gust_uncertainty(specs: DataFrame, draws: int = DRAWS) -> DataFrame:
    """specs (spec, thrust_n, diameter_m, wind, energy_wh, motors) with percentiles of power per motor and minutes in gusty wind."""
    blade = N.standard_blade()
    rows = specs.withColumn("blade", blade).withColumn("rpm", N.blade_rpm(F.col("thrust_n"), F.lit(N.STANDARD_DENSITY), F.col("diameter_m"), F.col("blade.ct")))
    rows = rows.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    gust = F.greatest(F.lit(0.0), F.col("wind") * (1 + TURBULENCE * normal(uniform(F.col("draw"), 11), uniform(F.col("draw"), 12))))
    tip = N.tip_speed(F.col("rpm"), F.col("diameter_m"))
    power = N.blade_power(N.wind_power_coefficient(F.col("blade"), gust / tip), F.lit(N.STANDARD_DENSITY), F.col("diameter_m"), tip)
    rows = rows.withColumn("power", power).withColumn("minutes", F.col("energy_wh") / (F.col("power") * F.col("motors")) * 60)
    p = lambda c: F.percentile(c, F.array(*map(F.lit, LEVELS)))
    out = rows.groupBy("spec").agg(F.avg("power").alias("power_mean"), p("power").alias("pw"), p("minutes").alias("mn"))
    return out.select("spec", "power_mean", *(F.col("pw")[i].alias(f"power_{n}") for i, n in enumerate(("p05", "p50", "p95"))),
        *(F.col("mn")[i].alias(f"minutes_{n}") for i, n in enumerate(("p05", "p50", "p95"))))
