"""Series operators over events: a user is a series, its values a signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series as S
from ..sources.tables import micros, table
from .common import Plans, rounded

PLANS = Plans()
STEP_US = 21_600_000_000

SERIES_SQL = "series AS (SELECT user_id AS key, event_id AS seq, epoch_us(ts) AS us, value, event_type AS kind FROM events)"
DIRTY_SQL = """dirty AS (SELECT user_id AS key, event_id AS seq, epoch_us(ts) - CASE WHEN user_id % 5 = 0 AND event_id > 3000 + user_id * 30
    THEN 86400000000 * 40 ELSE 0 END AS us,
        CASE WHEN event_id % 19 = 0 AND user_id % 2 = 0 THEN 'nan'::DOUBLE ELSE value END AS value FROM events
    UNION ALL SELECT user_id, event_id + 10000000, epoch_us(ts), value + 1 FROM events WHERE event_id % 17 = 0 AND user_id % 5 <> 0)"""


def signals(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"),
        micros(F.col("ts")).alias("us"), "value", F.col("event_type").alias("kind"))


def dirty(spark: SparkSession, folder: str) -> DataFrame:
    rows = signals(spark, folder).drop("kind")
    turned = F.when((F.col("key") % 5 == 0) & (F.col("seq") > 3000 + F.col("key") * 30), 86_400_000_000 * 40).otherwise(0)
    bad = F.when((F.col("seq") % 19 == 0) & (F.col("key") % 2 == 0), float("nan")).otherwise(F.col("value"))
    again = rows.filter("seq % 17 = 0 AND key % 5 <> 0").select("key", (F.col("seq") + 10_000_000).alias("seq"), "us", (F.col("value") + 1).alias("value"))
    return rows.withColumn("us", F.col("us") - turned).withColumn("value", bad).unionByName(again)


@PLANS.add(f"""WITH {DIRTY_SQL}, k AS (SELECT *, avg(CASE WHEN isnan(value) THEN 1 ELSE 0 END) OVER (PARTITION BY key) > 0.05 AS noisy FROM dirty)
    SELECT key, seq, us, round(value, 6) AS value, noisy FROM k WHERE NOT isnan(value) QUALIFY row_number() OVER (PARTITION BY key, us ORDER BY seq) = 1""")
def series_clean(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.clean(dirty(spark, folder)).select("key", "seq", "us", "value", "noisy"))


@PLANS.add(f"""WITH {DIRTY_SQL}, j AS (SELECT *, us - lag(us) OVER (PARTITION BY key ORDER BY seq) < -1000000 AS jump FROM dirty), a AS
    (SELECT *, min(CASE WHEN jump THEN seq END) OVER (PARTITION BY key) AS cut FROM j),
    h AS (SELECT *, count(*) FILTER (WHERE cut IS NULL OR seq < cut) OVER (PARTITION BY key) AS heads, count(*) OVER (PARTITION BY key) AS n FROM a)
    SELECT key, seq, us FROM h WHERE cut IS NULL OR ((seq < cut) = (heads * 2 >= n))""")
def clock_jump(spark: SparkSession, folder: str) -> DataFrame:
    return S.cut_clock_jump(dirty(spark, folder)).select("key", "seq", "us")


@PLANS.add(f"""WITH {SERIES_SQL}, d AS (SELECT key, us, us - lag(us) OVER (PARTITION BY key ORDER BY us) AS step FROM series)
    SELECT key, round(1e12 / quantile_cont(CASE WHEN step > 0 THEN step END, 0.5), 6) AS rate_uhz, round((max(us) - min(us)) / 1e6, 6) AS
        duration_s FROM d GROUP BY key""")
def native_rate(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.native_rate(signals(spark, folder)).select("key", (F.col("rate_hz") * 1e6).alias("rate_uhz"), "duration_s"))


GRID_SQL = f"""WITH {SERIES_SQL}, s AS (SELECT key, us, value, lead(us) OVER w AS us2, lead(value) OVER w AS v2 FROM series WINDOW w AS
    (PARTITION BY key ORDER BY us)),
    g AS (SELECT key, t0 + i * {STEP_US} AS us, CAST(i AS INTEGER) AS i FROM (SELECT key, min(us) AS t0, greatest(2, CAST(round((max(us) -
        min(us)) / {STEP_US}.0) AS BIGINT) + 1) AS n FROM series GROUP BY key), LATERAL (SELECT unnest(range(0, n)) AS i)),
    m AS (SELECT g.key, g.i, g.us, s.us AS us1, s.value, s.us2, s.v2 FROM g ASOF LEFT JOIN s ON g.key = s.key AND g.us >= s.us)"""


@PLANS.add(f"""{GRID_SQL} SELECT key, i, us, round(CASE WHEN us2 IS NULL THEN CASE WHEN us1 = us THEN value END ELSE value + (us - us1) /
    (us2 - us1) * (v2 - value) END, 6) AS value FROM m""")
def grid_linear(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.on_grid(signals(spark, folder), STEP_US))


@PLANS.add(f"""{GRID_SQL} SELECT key, i, us, round(CASE WHEN us2 IS NOT NULL OR us1 = us THEN value END, 6) AS value FROM m""")
def grid_hold(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.on_grid(signals(spark, folder), STEP_US, hold=True))


@PLANS.add(f"""WITH {SERIES_SQL}, s AS (SELECT key, us, value, lead(us) OVER w AS us2, lead(value) OVER w AS v2 FROM series WHERE kind <>
    'click' WINDOW w AS (PARTITION BY key ORDER BY us)),
    f AS (SELECT key, arg_min(value, us) AS v0 FROM s GROUP BY key), t AS (SELECT key, seq, us FROM series WHERE kind = 'click')
    SELECT t.key, t.seq, round(CASE WHEN s.us IS NULL THEN v0 WHEN us2 IS NULL THEN value ELSE value + (t.us - s.us) / (us2 - s.us) * (v2 -
        value) END, 6) AS value
    FROM t ASOF LEFT JOIN s ON t.key = s.key AND t.us >= s.us JOIN f ON f.key = t.key""")
def value_at_setpoints(spark: SparkSession, folder: str) -> DataFrame:
    rows = signals(spark, folder)
    targets = rows.filter("kind = 'click'").select("key", "seq", "us")
    return rounded(S.at_times(rows.filter("kind <> 'click'"), targets, clamp=True).select("key", "seq", "value"))


RUN_SQL = f"""WITH {SERIES_SQL}, p AS (SELECT *, row_number() OVER w AS place, coalesce(lead(us) OVER w, us) AS after FROM series WINDOW w
    AS (PARTITION BY key ORDER BY us)),
    o AS (SELECT *, place - row_number() OVER (PARTITION BY key ORDER BY us) AS run FROM p WHERE value < 60),
    r AS (SELECT key, run, min(us) AS start_us, max(us) AS end_us, count(*) AS n, max(after) AS next_us FROM o GROUP BY key, run)"""


@PLANS.add(f"""{RUN_SQL} SELECT key, start_us, next_us, n, next_us - start_us AS length_us FROM r QUALIFY row_number() OVER (PARTITION BY
    key ORDER BY next_us - start_us DESC, start_us) = 1""")
def longest_run(spark: SparkSession, folder: str) -> DataFrame:
    return S.longest_run(signals(spark, folder), F.col("value") < 60)


SEGMENT_SQL = f"""{RUN_SQL}, g AS (SELECT key, start_us, end_us, n, end_us - start_us AS length_us, row_number() OVER w AS segment,
    CAST(coalesce(sum(end_us - start_us) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before_us
    FROM r WHERE end_us - start_us >= 86400000000 WINDOW w AS (PARTITION BY key ORDER BY start_us))"""


@PLANS.add(f"""{SEGMENT_SQL} SELECT key, start_us, end_us, n, length_us, CAST(segment AS INTEGER) AS segment, before_us FROM g""")
def steady_segments(spark: SparkSession, folder: str) -> DataFrame:
    return S.steady_segments(signals(spark, folder), F.col("value") < 60, 86_400_000_000)


@PLANS.add(f"""{SEGMENT_SQL} SELECT key, CAST(segment AS INTEGER) AS segment, start_us, least(end_us, start_us + 432000000000 - before_us)
    AS end_us FROM g WHERE before_us < 432000000000""")
def first_steady_stretch(spark: SparkSession, folder: str) -> DataFrame:
    return S.clipped(S.steady_segments(signals(spark, folder), F.col("value") < 60, 86_400_000_000), 432_000_000_000).select("key",
        "segment", "start_us", "end_us")


@PLANS.add(f"""WITH {SERIES_SQL}, d AS (SELECT key, value - lag(value) OVER (PARTITION BY key ORDER BY us) AS rate FROM series)
    SELECT key, CASE WHEN rate > 20 THEN 'climb' WHEN rate < -20 THEN 'descent' ELSE 'cruise' END AS phase, count(*) AS n FROM d WHERE rate
        IS NOT NULL GROUP BY ALL HAVING count(*) >= 10""")
def flight_phases(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    rows = signals(spark, folder).withColumn("rate", F.col("value") - F.lag("value").over(Window.partitionBy("key").orderBy("us")))
    return S.phases(rows, F.col("rate"), 20.0, 10)


ANCHOR_SQL = f"""WITH {SERIES_SQL}, h AS (SELECT key, us, min(CASE WHEN value > 40 THEN 1 ELSE 0 END) OVER w AS held, count(*) OVER w AS n
    FROM series WINDOW w AS (PARTITION BY key ORDER BY us ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
    t AS (SELECT key, min(us) AS t FROM h WHERE held = 1 AND n = 4 GROUP BY key), a AS (SELECT key, min(us) AS a FROM series WHERE kind =
        'signup' AND value > 100 GROUP BY key), f AS (SELECT key, min(us) AS f FROM series GROUP BY key),
    an AS (SELECT key, coalesce(a, t, f) AS us, CASE WHEN a IS NOT NULL THEN 'armed' WHEN t IS NOT NULL THEN 'takeoff' ELSE 'first_sample'
        END AS source FROM f LEFT JOIN t USING (key) LEFT JOIN a USING (key))"""


def _anchors(rows: DataFrame) -> DataFrame:
    first = lambda part: part.groupBy("key").agg(F.min("us").alias("us"))
    return S.anchor(first(rows.filter("kind = 'signup' AND value > 100")), S.first_lasting(rows, F.col("value") > 40, 4), first(rows))


@PLANS.add(f"{ANCHOR_SQL} SELECT key, us, source FROM an")
def arm_anchor(spark: SparkSession, folder: str) -> DataFrame:
    return _anchors(signals(spark, folder))


@PLANS.add(f"""{ANCHOR_SQL} SELECT s.key, coalesce(min(s.us) FILTER (WHERE value > 150), min(s.us)) AS start_us, coalesce(max(s.us) FILTER
    (WHERE value > 150), max(s.us)) AS end_us, count(*) FILTER (WHERE value > 150) = 0 AS ground_only
    FROM series s JOIN an ON s.key = an.key AND s.us >= an.us GROUP BY s.key""")
def airborne_span(spark: SparkSession, folder: str) -> DataFrame:
    rows = signals(spark, folder)
    return S.airborne_span(rows, _anchors(rows), 150.0)


@PLANS.add(f"""WITH {SERIES_SQL}, v AS (SELECT key, us, var_pop(value) OVER w AS variance, count(*) OVER w AS n FROM series WINDOW w AS
    (PARTITION BY key ORDER BY us ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
    SELECT key, arg_max(us, (round(variance, 9), -us)) AS us, round(max(variance), 2) AS variance FROM v WHERE n = 10 GROUP BY key""")
def variance_window(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.variance_window(signals(spark, folder), 10), 2)


@PLANS.add(f"""WITH {SERIES_SQL}, d AS (SELECT key, seq, us, value, value - lag(value) OVER (PARTITION BY key ORDER BY us) AS step FROM
    (SELECT key, seq, us, (value * 7) % 360 AS value FROM series))
    SELECT key, seq, round(sum(CASE WHEN step IS NULL THEN value ELSE (step + 180) - 360 * floor((step + 180) / 360) - 180 END) OVER
        (PARTITION BY key ORDER BY us ROWS UNBOUNDED PRECEDING), 5) AS unwrapped FROM d""")
def yaw_unwrap(spark: SparkSession, folder: str) -> DataFrame:
    rows = signals(spark, folder).withColumn("value", (F.col("value") * 7) % 360)
    return rounded(S.unwrapped(rows).select("key", "seq", "unwrapped"), 5)


@PLANS.add(f"""WITH {SERIES_SQL}, w AS (SELECT *, CASE WHEN kind = 'view' THEN value END AS attitude, CASE WHEN kind = 'click' THEN value
    END AS power FROM series),
    f AS (SELECT key, seq, kind, last_value(attitude IGNORE NULLS) OVER x AS attitude, last_value(power IGNORE NULLS) OVER x AS power FROM w
        WINDOW x AS (PARTITION BY key ORDER BY us ROWS UNBOUNDED PRECEDING))
    SELECT key, seq, attitude, power FROM f WHERE kind = 'purchase'""")
def forward_fill(spark: SparkSession, folder: str) -> DataFrame:
    """A message stream as rows: one for each position message, with the latest state of the others."""
    rows = signals(spark, folder).withColumns({"attitude": F.when(F.col("kind") == "view", F.col("value")),
        "power": F.when(F.col("kind") == "click", F.col("value"))})
    return S.forward_filled(rows, ["attitude", "power"]).filter("kind = 'purchase'").select("key", "seq", "attitude", "power")


@PLANS.add(f"""{RUN_SQL}, l AS (SELECT key, start_us, next_us AS end_us FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY next_us
    - start_us DESC, start_us) = 1),
    c AS (SELECT s.key, arg_max(v, CASE WHEN us <= start_us THEN us END) AS a, arg_max(v, CASE WHEN us <= end_us THEN us END) AS b,
        any_value(end_us - start_us) AS span
        FROM (SELECT key, us, CASE WHEN key % 4 = 0 THEN -seq ELSE seq END AS v FROM series) s JOIN l USING (key) GROUP BY s.key)
    SELECT key, CASE WHEN b >= a THEN b - a END AS increase, CASE WHEN b >= a AND span > 0 THEN round((b - a) / (span / 6e7), 9) END AS
        per_minute, CASE WHEN a IS NULL OR b IS NULL THEN 'no_samples' WHEN b < a THEN 'counter_reset' END AS reason FROM c""")
def counter_rate(spark: SparkSession, folder: str) -> DataFrame:
    rows = signals(spark, folder)
    spans = S.longest_run(rows, F.col("value") < 60).select("key", "start_us", F.col("next_us").alias("end_us"))
    counter = rows.withColumn("value", F.when(F.col("key") % 4 == 0, -F.col("seq")).otherwise(F.col("seq")))
    return rounded(S.counter_rate(counter, spans), 9)


@PLANS.add(f"""WITH {SERIES_SQL}, c AS (SELECT key, kind, count(*) AS n FROM series GROUP BY key, kind) SELECT key, kind, n FROM c QUALIFY
    row_number() OVER (PARTITION BY key ORDER BY n DESC, kind) = 1""")
def modal_instance(spark: SparkSession, folder: str) -> DataFrame:
    return S.modal(signals(spark, folder), "kind")
