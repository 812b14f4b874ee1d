"""Sessions, lifetime figures and filtered series of the telemetry view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kalman, sessions
from ..sources.tables import TELEMETRY_SQL, telemetry
from .common import Plans, rounded
from .filters import FAULTS_SQL, kalman_steps
from .status import GAP_UNITS, UNIT_US

PLANS = Plans()
#: A session gap that fits this telemetry: six hours.
GAP_S = 21_600.0

STEPS_SQL = f"""WITH {TELEMETRY_SQL}, l AS (SELECT *, lag(us) OVER w AS us0, lag(latitude) OVER w AS lat0, lag(longitude) OVER w AS lon0,
    lag(battery) OVER w AS bat0
        FROM telemetry WINDOW w AS (PARTITION BY drone_id ORDER BY us, reading_id)),
    steps AS (SELECT *, us0 IS NULL OR us - us0 > 21600e6 AS begins, coalesce(battery - bat0 >= 5, false) AS charged,
        CASE WHEN us0 IS NOT NULL AND us - us0 <= 21600e6 AND lat0 IS NOT NULL AND latitude IS NOT NULL
            THEN sqrt(pow((longitude - lon0) * 111320.0 * cos(radians(lat0)), 2) + pow((latitude - lat0) * 110540.0, 2)) END AS metres FROM l),
    numbered AS (SELECT *, CAST(sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY drone_id ORDER BY us, reading_id ROWS UNBOUNDED
        PRECEDING) AS INTEGER) AS session FROM steps)"""


@PLANS.add(f"""{STEPS_SQL} SELECT drone_id, session, min(us) AS start_us, max(us) AS end_us, count(*) AS readings,
    round(coalesce(sum(metres), 0), 6) AS metres, round((max(us) - min(us)) / 1e6, 6) AS seconds FROM numbered GROUP BY drone_id, session""")
def flight_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sessions.sessions(telemetry(spark, folder), GAP_S))


@PLANS.add(f"""{STEPS_SQL} SELECT reading_id, begins, charged, round(metres, 4) AS metres FROM steps""")
def segment_steps(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sessions.with_steps(telemetry(spark, folder), GAP_S).select("reading_id", "begins", "charged", "metres"), 4)


LIFETIME_SQL = f"""{STEPS_SQL}, per AS (SELECT drone_id, session, (max(us) - min(us)) / 1e6 AS seconds, sum(metres) AS metres, count(*) AS
    n, count(*) FILTER (WHERE charged) AS charges FROM numbered GROUP BY drone_id, session),
    life AS (SELECT drone_id, sum(seconds) / 3600 AS hours, coalesce(sum(metres), 0) / 1000 AS km, CAST(sum(charges) AS BIGINT) AS charges,
        count(*) AS sessions, CAST(sum(n) AS BIGINT) AS readings FROM per GROUP BY drone_id)
    SELECT drone_id, round(hours, 6) AS flight_hours, round(km, 6) AS distance_km, charges, sessions, readings, round(least(100.0, hours /
        300 * 100), 6) AS wear_percent, least(100.0, hours / 300 * 100) >= 80 AS maintenance FROM life"""


@PLANS.add(LIFETIME_SQL)
def lifetime_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sessions.lifetime(telemetry(spark, folder), GAP_S))


KALMAN_SQL = f"WITH RECURSIVE {TELEMETRY_SQL}, {kalman_steps('telemetry')}"


@PLANS.add(f"""{KALMAN_SQL} SELECT reading_id, CAST(track AS INTEGER) AS track, round(x, 5) AS filtered, round(v, 5) AS velocity,
    round(sqrt(greatest(a, 0)), 5) AS deviation, round(innovation, 5) AS innovation, round(nis, 4) AS nis FROM k""")
def kalman_smooth(spark: SparkSession, folder: str) -> DataFrame:
    out = kalman.smooth(telemetry(spark, folder), reset_gap_s=GAP_UNITS, second_us=UNIT_US)
    return rounded(out.select("reading_id", "track", "filtered", "velocity", "deviation", "innovation", F.round("nis", 4).alias("nis")), 5)


@PLANS.add(f"{KALMAN_SQL}, {FAULTS_SQL} SELECT * FROM fr")
def sensor_fault_runs(spark: SparkSession, folder: str) -> DataFrame:
    return kalman.fault_runs(kalman.smooth(telemetry(spark, folder), reset_gap_s=GAP_UNITS, second_us=UNIT_US))


@PLANS.add(f"""WITH {TELEMETRY_SQL}, o AS (SELECT drone_id, arg_min(latitude, (us, reading_id)) AS lat0, arg_min(longitude, (us,
    reading_id)) AS lon0 FROM telemetry WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY drone_id)
    SELECT reading_id, round(radians(longitude - lon0) * 6371000 * cos(radians(lat0)), 4) AS east, round(radians(latitude - lat0) * 6371000,
        4) AS north FROM telemetry LEFT JOIN o USING (drone_id)""")
def local_projection(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(kalman.to_local_metres(telemetry(spark, folder)).select("reading_id", "east", "north"), 4)


@PLANS.add()
def fused_state(spark: SparkSession, folder: str) -> DataFrame:
    """Nine-state estimates with hours for seconds; the attitude is made from the other fields."""
    rows = telemetry(spark, folder).withColumn("us", (F.col("us") / 3600).cast("long"))
    rows = rows.withColumns({"roll": F.col("speed") - 12, "pitch": F.col("temperature") / 10, "yaw": F.col("altitude") % 360})
    return rounded(kalman.fuse(rows, reset_gap_s=GAP_UNITS), 4)
