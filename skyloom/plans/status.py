"""Scans and vehicle status over the telemetry view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kalman, latest, status
from ..sources.tables import TELEMETRY_SQL, table, telemetry
from .common import Plans, rounded
from .filters import FAULTS_SQL, kalman_steps

PLANS = Plans()
#: Readings that a status looks at, and the gap and time unit that fit this telemetry: half a day, in hours.
RECENT, GAP_UNITS, UNIT_US = 51, 12.0, 3.6e9

RECENT_SQL = f"""WITH {TELEMETRY_SQL}, recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY drone_id ORDER BY us DESC,
    reading_id DESC) AS place FROM telemetry) WHERE place <= 51)"""


@PLANS.add(f"""WITH {TELEMETRY_SQL} SELECT drone_id, reading_id, us, CAST(place AS INTEGER) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY drone_id ORDER BY us DESC, reading_id DESC) AS place FROM telemetry WHERE ts BETWEEN TIMESTAMP
        '2024-01-05' AND TIMESTAMP '2024-01-25') WHERE place BETWEEN 6 AND 15""")
def telemetry_page(spark: SparkSession, folder: str) -> DataFrame:
    rows = latest.time_range(telemetry(spark, folder), "2024-01-05", "2024-01-25")
    return latest.newest(rows, limit=10, offset=5).select("drone_id", "reading_id", "us", "place")


@PLANS.add(f"""WITH {TELEMETRY_SQL} SELECT drone_id, reading_id, latitude, battery FROM telemetry WHERE latitude IS NOT NULL AND longitude
    IS NOT NULL AND battery IS NOT NULL""")
def complete_fields_scan(spark: SparkSession, folder: str) -> DataFrame:
    return latest.complete(telemetry(spark, folder), ["latitude", "longitude", "battery"]).select("drone_id", "reading_id", "latitude", "battery")


@PLANS.add(f"""WITH {TELEMETRY_SQL} SELECT drone_id, reading_id, place FROM (
    SELECT drone_id, reading_id, CAST(row_number() OVER (PARTITION BY drone_id ORDER BY us DESC, reading_id DESC) AS INTEGER) AS place FROM telemetry
    WHERE flight_state = 'view' AND (latitude IS NOT NULL OR temperature IS NOT NULL)) WHERE place <= 20""")
def idle_any_field_scan(spark: SparkSession, folder: str) -> DataFrame:
    rows = latest.any_of(telemetry(spark, folder).filter("flight_state = 'view'"), ["latitude", "temperature"])
    return latest.newest(rows, 20).select("drone_id", "reading_id", "place")


@PLANS.add("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders SEMI JOIN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) c ON
    o_custkey = c_custkey WHERE o_orderstatus = 'O'""")
def owner_scoped_scan(spark: SparkSession, folder: str) -> DataFrame:
    owners = table(spark, folder, "customer").withColumnRenamed("c_custkey", "o_custkey")
    rows = table(spark, folder, "orders").filter("o_orderstatus = 'O'")
    return latest.owned_by(rows, owners, "o_custkey", F.col("c_nationkey") == 7).select("o_orderkey", "o_custkey", "o_totalprice")


@PLANS.add("""SELECT s_nationkey, s_suppkey, CAST(place AS INTEGER) AS place FROM (SELECT s_nationkey, s_suppkey, row_number() OVER
    (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place FROM supplier) WHERE place BETWEEN 2 AND 3""")
def paged_listing(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "supplier").withColumn("rank_key", -F.col("s_suppkey"))
    return latest.newest(rows, limit=2, offset=1, key="s_nationkey", order=("rank_key",)).select("s_nationkey", "s_suppkey", "place")


@PLANS.add("""SELECT p_partkey, (p_size <> 0 AND p_retailprice <> 0 AND p_size % 7 <> 0) AS complete FROM part""")
def complete_specs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").withColumn("cells", F.col("p_size") % 7)
    return rows.select("p_partkey", latest.truthy("p_size", "p_retailprice", "cells").alias("complete"))


@PLANS.add(f"""WITH {TELEMETRY_SQL} SELECT drone_id, round(avg(speed), 6) AS avg_speed, round(avg(temperature), 6) AS avg_temperature,
    round(max(altitude), 6) AS max_altitude,
    round(avg(battery), 6) AS avg_battery, count(*) AS readings FROM telemetry GROUP BY drone_id""")
def fleet_averages(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(status.fleet_averages(telemetry(spark, folder)))


ESTIMATE_SQL = """est AS (SELECT drone_id, coalesce(regr_slope(battery, minute), 0) AS slope, count(*) AS sample_size, arg_max(battery, (us,
    reading_id)) AS last,
        CASE WHEN var_pop(battery) = 0 THEN 1.0 WHEN regr_slope(battery, minute) IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0,
            regr_r2(battery, minute))) END AS fit
    FROM (SELECT *, (us - min(us) OVER (PARTITION BY drone_id)) / 6e7 AS minute FROM recent WHERE battery IS NOT NULL) GROUP BY drone_id
        HAVING count(*) >= 5)"""


@PLANS.add(f"""{RECENT_SQL}, {ESTIMATE_SQL} SELECT drone_id, round(slope, 9) AS drain_per_min, sample_size,
    CASE WHEN slope < -0.01 THEN round(greatest(0.0, -last / slope), 4) END AS minutes_remaining, CASE WHEN slope < -0.01 THEN round(fit, 6)
        END AS confidence FROM est""")
def battery_estimate(spark: SparkSession, folder: str) -> DataFrame:
    out = status.battery_estimate(latest.newest(telemetry(spark, folder), RECENT))
    return out.select("drone_id", F.round("drain_per_min", 9).alias("drain_per_min"), "sample_size", F.round("minutes_remaining",
        4).alias("minutes_remaining"), F.round("confidence", 6).alias("confidence"))


@PLANS.add(f"""WITH {TELEMETRY_SQL}, t AS (SELECT *, (us - min(us) OVER (PARTITION BY drone_id)) / 8.64e10 AS day FROM telemetry WHERE temperature IS NOT NULL)
    SELECT drone_id, round(coalesce(regr_slope(temperature, day), 0), 6) AS slope, round(coalesce(regr_intercept(temperature, day),
        avg(temperature)), 6) AS intercept,
        round(CASE WHEN var_pop(temperature) = 0 THEN 1.0 WHEN regr_slope(temperature, day) IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0,
            regr_r2(temperature, day))) END, 6) AS r2 FROM t GROUP BY drone_id""")
def trend_regression(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    rows = telemetry(spark, folder).filter("temperature IS NOT NULL")
    rows = rows.withColumn("day", (F.col("us") - F.min("us").over(Window.partitionBy("drone_id"))) / 8.64e10)
    slope, intercept, fit = status.line_fit(F.col("day"), F.col("temperature"))
    return rounded(rows.groupBy("drone_id").agg(slope.alias("slope"), intercept.alias("intercept"), fit.alias("r2")))


ANOMALY_SQL = """stat AS (SELECT drone_id, field, max(CASE WHEN place = 1 THEN v END) AS value, avg(CASE WHEN place > 1 THEN v END) AS mean,
    stddev_pop(CASE WHEN place > 1 THEN v END) AS deviation, count(CASE WHEN place > 1 THEN v END) AS n
    FROM (SELECT drone_id, place, 'temperature' AS field, temperature AS v FROM recent UNION ALL SELECT drone_id, place, 'speed', speed FROM
        recent) GROUP BY drone_id, field),
    z AS (SELECT *, (value - mean) / deviation AS z FROM stat WHERE n >= 8 AND deviation > 1e-12 AND value IS NOT NULL)"""


@PLANS.add(f"""{RECENT_SQL}, {ANOMALY_SQL} SELECT drone_id, field, round(value, 6) AS value, round(mean, 6) AS mean, round(deviation, 6) AS
    deviation, n, round(z, 6) AS z, abs(z) > 2.5 AS anomalous FROM z""")
def zscore_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(status.outliers(latest.newest(telemetry(spark, folder), RECENT)))


@PLANS.add(f"""WITH RECURSIVE {RECENT_SQL.removeprefix("WITH ")}, {kalman_steps("recent")}, {FAULTS_SQL}, fp AS (SELECT drone_id, sum(CASE
    severity WHEN 'CRITICAL' THEN 20 ELSE 10 END) AS points FROM fr GROUP BY drone_id),
    {ESTIMATE_SQL}, {ANOMALY_SQL}, m AS (SELECT drone_id, CASE WHEN slope < -0.01 THEN greatest(0.0, -last / slope) END AS minutes FROM est),
    n AS (SELECT drone_id, count(*) FILTER (WHERE abs(z) > 2.5) AS anomalies FROM z GROUP BY drone_id),
    sc AS (SELECT r.drone_id, coalesce(anomalies, 0) AS anomalies, CAST(least(100,
        CASE WHEN battery < 15 THEN 40 WHEN battery < 30 THEN 25 WHEN battery < 50 THEN 10 ELSE 0 END + CASE WHEN minutes < 2 THEN 25 WHEN
            minutes < 5 THEN 15 WHEN minutes < 10 THEN 5 ELSE 0 END
        + CASE WHEN temperature > 80 THEN 20 WHEN temperature > 60 THEN 10 ELSE 0 END + least(15, coalesce(anomalies, 0) * 8) + least(20,
            coalesce(points, 0))) AS INTEGER) AS risk
        FROM recent r LEFT JOIN m USING (drone_id) LEFT JOIN n USING (drone_id) LEFT JOIN fp USING (drone_id) WHERE r.place = 1)
    SELECT drone_id, anomalies, risk, CASE WHEN risk >= 70 THEN 'critical' WHEN risk >= 40 THEN 'warning' ELSE 'healthy' END AS health FROM sc""")
def vehicle_risk(spark: SparkSession, folder: str) -> DataFrame:
    """Risk with the fault runs of the filtered altitude, all from one set of recent rows."""
    recent = latest.newest(telemetry(spark, folder), RECENT)
    faults = kalman.fault_points(kalman.fault_runs(kalman.smooth(recent, reset_gap_s=GAP_UNITS, second_us=UNIT_US)))
    return status.risk(recent, faults)


@PLANS.add(f"""{RECENT_SQL}, {ESTIMATE_SQL}, {ANOMALY_SQL}, m AS (SELECT drone_id, CASE WHEN slope < -0.01 THEN greatest(0.0, -last / slope)
    END AS minutes FROM est),
    n AS (SELECT drone_id, count(*) FILTER (WHERE abs(z) > 2.5) AS anomalies FROM z GROUP BY drone_id),
    s AS (SELECT r.drone_id, coalesce(anomalies, 0) AS anomalies, CAST(least(100,
        CASE WHEN battery < 15 THEN 40 WHEN battery < 30 THEN 25 WHEN battery < 50 THEN 10 ELSE 0 END + CASE WHEN minutes < 2 THEN 25 WHEN
            minutes < 5 THEN 15 WHEN minutes < 10 THEN 5 ELSE 0 END
        + CASE WHEN temperature > 80 THEN 20 WHEN temperature > 60 THEN 10 ELSE 0 END + least(15, coalesce(anomalies, 0) * 8)) AS INTEGER) AS risk
        FROM recent r LEFT JOIN m USING (drone_id) LEFT JOIN n USING (drone_id) WHERE place = 1)
    SELECT drone_id, anomalies, risk, CASE WHEN risk >= 70 THEN 'critical' WHEN risk >= 40 THEN 'warning' ELSE 'healthy' END AS health FROM s""")
def risk_without_faults(spark: SparkSession, folder: str) -> DataFrame:
    none = spark.createDataFrame([], "drone_id long, fault_points long")
    return status.risk(latest.newest(telemetry(spark, folder), RECENT), none)


@PLANS.add(f"""WITH {TELEMETRY_SQL} SELECT reading_id, coalesce(battery < 20, false) AS low, coalesce(temperature > 80, false) AS hot,
    CAST(least(100, CASE WHEN altitude < 40 THEN 30 ELSE 0 END + CASE WHEN altitude < 20 THEN 30 ELSE 0 END + CASE WHEN speed > 17.5 THEN 20
        ELSE 0 END + CASE WHEN speed > 20 THEN 20 ELSE 0 END + CASE WHEN altitude > 25 THEN 20 ELSE 0 END) AS INTEGER) AS simple_risk,
    CASE WHEN altitude < 20 THEN 'CRITICAL' WHEN speed > 20 THEN 'OVERHEATING' WHEN altitude < 40 THEN 'WARNING' ELSE 'GOOD' END AS
        simple_health FROM telemetry""")
def alerts(spark: SparkSession, folder: str) -> DataFrame:
    rows = telemetry(spark, folder)
    found = status.alerts(F.col("battery"), F.col("temperature"))
    heat = F.col("speed") * 4
    return rows.select(
        "reading_id",
        F.array_contains(found, "LOW BATTERY").alias("low"),
        F.array_contains(found, "OVERHEATING").alias("hot"),
        status.simple_risk(F.col("altitude"), heat, F.col("altitude")).alias("simple_risk"),
        status.simple_health(F.col("altitude"), heat).alias("simple_health"),
    )
