"""Sessions of vehicles and the lifetime figures that come from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Session gap, wear model and charge step; metres per degree of the flat-earth distance.
SESSION_GAP_S = 45.0
MOTOR_LIFE_HOURS, MAINTENANCE_PERCENT = 300.0, 80.0
CHARGE_STEP = 5.0
METRES_PER_DEGREE_LAT, METRES_PER_DEGREE_LON = 110540.0, 111320.0


def flat_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on a flat earth, with the length of a degree of longitude at the first point."""
    north = (lat2 - lat1) * METRES_PER_DEGREE_LAT
    east = (lon2 - lon1) * METRES_PER_DEGREE_LON * F.cos(F.radians(lat1))
    return F.sqrt(east * east + north * north)


def with_steps(readings: DataFrame, gap_s: float = SESSION_GAP_S) -> DataFrame:
    """Adds what each reading is to the one before it of its vehicle: begins (a session), metres, charged.

    A gap of exactly gap_s does not split. Metres count inside a session where both latitudes are known; charges count
    across sessions, where both battery values are known. One shuffle on drone_id; the later steps reuse it.
    """
    order = Window.partitionBy("drone_id").orderBy("us", "reading_id")
    before = {c: F.lag(c).over(order) for c in ("us", "latitude", "longitude", "battery")}
    begins = before["us"].isNull() | (F.col("us") - before["us"] > gap_s * 1e6)
    metres = F.when(~begins & before["latitude"].isNotNull() & F.col("latitude").isNotNull(), flat_metres(before["latitude"],
        before["longitude"], F.col("latitude"), F.col("longitude")))
    charged = F.coalesce(F.col("battery") - before["battery"] >= CHARGE_STEP, F.lit(False))
    return readings.select("*", begins.alias("begins"), metres.alias("metres"), charged.alias("charged"))


def with_sessions(readings: DataFrame, gap_s: float = SESSION_GAP_S) -> DataFrame:
    """with_steps, and the session number from 1."""
    order = Window.partitionBy("drone_id").orderBy("us", "reading_id").rowsBetween(Window.unboundedPreceding, 0)
    return with_steps(readings, gap_s).withColumn("session", F.sum(F.col("begins").cast("int")).over(order).cast("int"))


def sessions(readings: DataFrame, gap_s: float = SESSION_GAP_S) -> DataFrame:
    """Per vehicle and session: first and last microsecond, readings, seconds, metres."""
    return (
        with_sessions(readings, gap_s)
        .groupBy("drone_id", "session")
        .agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("readings"), F.coalesce(F.sum("metres"),
            F.lit(0.0)).alias("metres"))
        .withColumn("seconds", (F.col("end_us") - F.col("start_us")) / 1e6)
    )


def lifetime(readings: DataFrame, gap_s: float = SESSION_GAP_S) -> DataFrame:
    """Per vehicle: hours flown, kilometres, charges, motor wear in percent, whether it needs maintenance, sessions, readings.

    Seconds of a session are the gaps inside it, so no second grouping is needed.
    """
    order = Window.partitionBy("drone_id").orderBy("us", "reading_id")
    seconds = F.when(~F.col("begins"), (F.col("us") - F.lag("us").over(order)) / 1e6)
    out = (
        with_steps(readings, gap_s)
        .withColumn("seconds", seconds)
        .groupBy("drone_id")
        .agg(
            F.coalesce(F.sum("seconds") / 3600, F.lit(0.0)).alias("flight_hours"),
            F.coalesce(F.sum("metres") / 1000, F.lit(0.0)).alias("distance_km"),
            F.count_if("charged").alias("charges"),
            F.count_if("begins").alias("sessions"),
            F.count(F.lit(1)).alias("readings"),
        )
    )
    wear = F.least(F.lit(100.0), F.col("flight_hours") / MOTOR_LIFE_HOURS * 100)
    return out.withColumn("wear_percent", wear).withColumn("maintenance", wear >= MAINTENANCE_PERCENT)
