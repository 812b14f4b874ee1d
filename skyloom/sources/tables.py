"""Tables of a data folder, and the telemetry view that the plans read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of the folder; only the columns that a plan uses are read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time stamp without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def telemetry(spark: SparkSession, folder: str) -> DataFrame:
    """Readings of all vehicles: events in the role of telemetry.

    One row per event: reading_id, drone_id, ts, us (microseconds), flight_state, altitude, battery, temperature,
    speed, latitude, longitude. As in real telemetry, optional fields have gaps: battery, temperature and position
    are null in a fixed part of the rows.
    """
    events = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    gap = lambda every, value: F.when(F.col("event_id") % every != 0, value)
    return events.select(
        F.col("event_id").alias("reading_id"),
        F.col("user_id").alias("drone_id"),
        "ts",
        micros(F.col("ts")).alias("us"),
        F.col("event_type").alias("flight_state"),
        F.col("value").alias("altitude"),
        gap(11, F.least("value", F.lit(100.0))).alias("battery"),
        gap(13, k).alias("temperature"),
        (k / 4).alias("speed"),
        gap(7, k / 100).alias("latitude"),
        gap(7, F.col("value") / 100).alias("longitude"),
    )


#: The same view for a reader of SQL.
TELEMETRY_SQL = r"""telemetry AS (
    SELECT event_id AS reading_id, user_id AS drone_id, ts, epoch_us(ts) AS us, event_type AS flight_state, value AS altitude,
        CASE WHEN event_id % 11 <> 0 THEN least(value, 100.0) END AS battery,
        CASE WHEN event_id % 13 <> 0 THEN k END AS temperature, k / 4 AS speed,
        CASE WHEN event_id % 7 <> 0 THEN k / 100 END AS latitude,
        CASE WHEN event_id % 7 <> 0 THEN value / 100 END AS longitude
    FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9.]+)', 1) AS DOUBLE) AS k FROM events))"""
