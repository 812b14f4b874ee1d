"""Health rules over events: a user is a vehicle, an event type a feature, each event one flight's value of it.

Customers are declared configuration changes of the vehicles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import catalogue as C
from ..functions import phrases
from ..operators import baselines as B
from ..operators import epochs as E
from ..operators import rebuild as R
from ..operators import scoring as S
from ..operators import store as K
from ..operators import trends as T
from ..operators.scans import dealt
from ..sources.tables import micros, table
from .common import Plans, rounded

PLANS = Plans()
FEATURE_OF = {"click": "vib.metric_p50", "view": "act.spread", "purchase": "pwr.r_cell", "error": "gps.nsats_p10", "signup": "gps.eph_p50"}
CHANGE_OF = {"AUTOMOBILE": "props", "BUILDING": "pack", "FURNITURE": "motors_escs", "HOUSEHOLD": "payload", "MACHINERY": "gps"}


def _case(column: str, names: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.items()) + " END"


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """drone_id, feature_key, flight_index from 0, us, value, qualified, valid, reason, autopilot, pack_id, and the feature's own columns."""
    events = table(spark, folder, "events")
    place = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) - 1
    rows = events.select(
        F.col("user_id").alias("drone_id"),
        F.expr(_case("event_type", FEATURE_OF)).alias("feature_key"),
        place.alias("flight_index"),
        micros(F.col("ts")).alias("us"),
        "value",
        (F.col("event_id") % 13 != 0).alias("qualified"),
        (F.col("event_id") % 17 != 0).alias("valid"),
        F.when(F.col("event_id") % 17 == 0, "signal_absent").alias("reason"),
        F.when(F.col("user_id") % 3 == 0, "ardupilot").otherwise("px4").alias("autopilot"),
        (F.col("user_id") % 4).alias("pack_id"),
    )
    return rows.join(F.broadcast(C.features(spark)), "feature_key")


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """drone_id, seq, change_type, us of every declared change."""
    rows = table(spark, folder, "customer")
    us = F.lit(1_704_067_200_000_000) + ((F.col("c_acctbal") + 1000) * 236_000_000).cast("long")
    return rows.select((F.col("c_custkey") % 150).alias("drone_id"), F.col("c_custkey").alias("seq"), F.expr(_case("c_mktsegment",
        CHANGE_OF)).alias("change_type"), us.alias("us"))


def change_events(spark: SparkSession, folder: str) -> DataFrame:
    flights = observations(spark, folder).filter("feature_key = 'vib.metric_p50'")
    return E.flight_of_change(changes(spark, folder), flights).withColumn("epoch", F.col("seq").cast("string"))


def grouped(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    """Observations with their baseline groups, by the declared changes, or by other events."""
    rows = E.feature_epoch(observations(spark, folder), change_events(spark, folder) if events is None else events, C.reset_features(spark))
    rows = rows.withColumn("baseline_group", B.group_key(F.col("feature_key"), F.col("epoch"), F.col("pack_id")))
    return S.with_absolute(rows, C.norms(spark))


def admitted(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    return B.admit(grouped(spark, folder, events))


_FEATURE_ROWS = ", ".join(f"('{k}', {i}, '{sub}', '{tier}', {C.FLOORS.get(k, 0.0)}::DOUBLE, {C.RELATIVE_FLOORS.get(k, 0.0)}::DOUBLE, {k in C.LOWER_IS_WORSE}, {k in C.FLOORS})"
    for i, (k, sub, tier) in enumerate(C.FEATURES))
_RESET_ROWS = ", ".join(f"('{c}', '{k}')" for c, starts in C.RESETS.items() for k, _, _ in C.FEATURES if k.startswith(starts))
OBS_SQL = f"""cat(feature_key, place, subsystem, tier, floor, relative_floor, lower_is_worse, baselined) AS (VALUES {_FEATURE_ROWS}),
    resets(change_type, feature_key) AS (VALUES {_RESET_ROWS}),
    raw AS (SELECT user_id AS drone_id, {_case("event_type", FEATURE_OF)} AS feature_key, CAST(row_number() OVER (PARTITION BY user_id,
        event_type ORDER BY ts, event_id) - 1 AS INTEGER) AS flight_index, epoch_us(ts) AS us, value,
        event_id % 13 <> 0 AS qualified, event_id % 17 <> 0 AS valid, CASE WHEN user_id % 3 = 0 THEN 'ardupilot' ELSE 'px4' END AS
            autopilot, user_id % 4 AS pack_id FROM events),
    obs AS (SELECT * FROM raw JOIN cat USING (feature_key)),
    chg AS (SELECT c_custkey % 150 AS drone_id, c_custkey AS seq, {_case("c_mktsegment", CHANGE_OF)} AS change_type, 1704067200000000 +
        CAST(trunc((c_acctbal + 1000) * 236000000) AS BIGINT) AS us FROM customer),
    fl AS (SELECT drone_id, us, flight_index FROM obs WHERE feature_key = 'vib.metric_p50'), cnt AS (SELECT drone_id, count(*) AS n FROM fl GROUP BY drone_id),
    ev AS (SELECT c.drone_id, c.seq, c.change_type, c.us, CAST(coalesce(min(f.flight_index), any_value(coalesce(n, 0))) AS INTEGER) AS
        flight_index, CAST(c.seq AS VARCHAR) AS epoch FROM chg c LEFT JOIN cnt USING (drone_id) LEFT JOIN fl f ON f.drone_id = c.drone_id
        AND f.us >= c.us GROUP BY c.drone_id, c.seq, c.change_type, c.us),
    fe AS (SELECT drone_id, feature_key, flight_index, seq, epoch FROM ev JOIN resets USING (change_type)),
    ep AS (SELECT o.drone_id, o.feature_key, o.flight_index, arg_max(e.epoch, (e.flight_index, e.seq)) AS epoch FROM obs o JOIN fe e ON
        e.drone_id = o.drone_id AND e.feature_key = o.feature_key AND e.flight_index <= o.flight_index GROUP BY ALL),
    grp AS (SELECT obs.*, epoch, CASE WHEN feature_key LIKE 'pwr.%' THEN 'pack:' || pack_id || CASE WHEN epoch IS NULL THEN '' ELSE
        '/epoch:' || epoch END ELSE 'epoch:' || coalesce(epoch, 'initial') END AS baseline_group,
        CASE WHEN autopilot <> 'px4' THEN NULL WHEN feature_key = 'gps.nsats_p10' THEN CASE WHEN value < 6 THEN 70.0 ELSE 100.0 END WHEN
            feature_key = 'gps.eph_p50' THEN CASE WHEN value > 3 THEN 70.0 ELSE 100.0 END END AS absolute_score FROM obs LEFT JOIN ep USING
            (drone_id, feature_key, flight_index))"""
FOLD_SQL = f"""{OBS_SQL}, s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY drone_id, baseline_group, feature_key ORDER BY
    flight_index) AS rn FROM grp),
    fold AS (SELECT DISTINCT drone_id, baseline_group, feature_key, 0::BIGINT AS rn, []::DOUBLE[] AS last10, []::DOUBLE[] AS first5, 0 AS
        n_adm, CAST(NULL AS DOUBLE) AS med, CAST(NULL AS DOUBLE) AS mad, CAST(NULL AS DOUBLE) AS spread, CAST(NULL AS VARCHAR) AS reason, 0
        AS n_before, 0 AS base_n, []::DOUBLE[] AS ref5 FROM s
        UNION ALL
        SELECT drone_id, baseline_group, feature_key, rn, CASE WHEN why IS NULL THEN list_append(last10, value)[-10:] ELSE last10 END, CASE
            WHEN why IS NULL AND len(first5) < 5 THEN list_append(first5, value) ELSE first5 END,
            n_adm + CASE WHEN why IS NULL THEN 1 ELSE 0 END, med, mad, spread, why, n_adm, CAST(len(last10) AS INTEGER), first5
        FROM (SELECT *, CASE WHEN NOT qualified THEN 'flight_not_qualified' WHEN NOT valid THEN 'feature_invalid' WHEN n_adm >= 5 AND
            abs(value - med) > 3.5 * spread THEN 'outlier' END AS why
            FROM (SELECT *, CASE WHEN med IS NOT NULL THEN greatest(1.4826 * mad, floor, relative_floor * abs(med)) END AS spread FROM
                (SELECT *, list_aggregate(list_transform(last10, lambda x: abs(x - med)), 'median') AS mad
                FROM (SELECT s.*, f.last10, f.first5, f.n_adm, list_aggregate(f.last10, 'median') AS med FROM fold f JOIN s ON s.drone_id =
                    f.drone_id AND s.baseline_group = f.baseline_group AND s.feature_key = f.feature_key AND s.rn = f.rn + 1))))),
    adm AS (SELECT s.*, f.med, f.mad, f.spread, f.reason AS quarantine_reason, f.reason IS NULL AS admitted, f.n_before, f.base_n, f.ref5
        FROM s JOIN fold f USING (drone_id, baseline_group, feature_key, rn))"""


_DELETED_SQL = FOLD_SQL.replace("AS rn FROM grp),", "AS rn FROM grp WHERE NOT (drone_id % 10 = 3 AND flight_index IN (4, 9))),")


@PLANS.add(f"""WITH RECURSIVE {_DELETED_SQL} SELECT drone_id, baseline_group, feature_key, flight_index, admitted, quarantine_reason, n_before, round(med, 6)
    AS base_median, round(spread, 6) AS base_spread FROM adm""")
def flight_deletion(spark: SparkSession, folder: str) -> DataFrame:
    """Admissions after the fifth and the tenth flight of every tenth vehicle were deleted: only what follows them is folded anew."""
    recorded = R.admit_recorded(grouped(spark, folder))
    doomed = recorded.filter("drone_id % 10 = 3 AND flight_index IN (4, 9)").select("drone_id", "flight_index")
    out = R.rebuilt(recorded, doomed)
    return rounded(out.select("drone_id", "baseline_group", "feature_key", "flight_index", "admitted", "quarantine_reason", "n_before", "base_median", "base_spread"))


@PLANS.add(f"""WITH RECURSIVE {FOLD_SQL}, own AS (SELECT drone_id, baseline_group, feature_key, value, flight_index, floor, relative_floor, row_number() OVER
    (PARTITION BY drone_id, baseline_group, feature_key ORDER BY flight_index DESC) AS back, row_number() OVER (PARTITION BY drone_id, baseline_group,
    feature_key ORDER BY flight_index) AS nth FROM adm WHERE admitted),
    k AS (SELECT *, 'rolling' AS kind FROM own WHERE back <= 10 UNION ALL SELECT *, 'reference' AS kind FROM own WHERE nth <= 5),
    g AS (SELECT drone_id, baseline_group, feature_key, kind, median(value) AS m, mad(value) AS d, count(*) AS n, any_value(floor) AS f, any_value(relative_floor)
        AS r, min(flight_index) AS first_flight, max(flight_index) AS last_flight FROM k GROUP BY ALL)
    SELECT drone_id, baseline_group, feature_key, kind, round(m, 6) AS median, round(d, 6) AS mad, round(greatest(1.4826 * d, f, r * abs(m)), 6) AS spread,
        CAST(n AS INTEGER) AS n, first_flight, last_flight FROM g WHERE kind = 'rolling' OR n = 5""")
def stored_baselines(spark: SparkSession, folder: str) -> DataFrame:
    """The baselines that each vehicle's next flight is judged against."""
    out = R.final_baselines(admitted(spark, folder))
    return rounded(out.select("drone_id", "baseline_group", "feature_key", "kind", "median", "mad", "spread", "n", F.array_min("flights").alias("first_flight"),
        F.array_max("flights").alias("last_flight")))


@PLANS.add("""SELECT user_id, event_type, round(median(value), 6) AS median, round(mad(value), 6) AS mad, CAST(count(*) AS INTEGER) AS n
    FROM events GROUP BY user_id, event_type""")
def median_mad(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(B.median_mad(table(spark, folder, "events").select("user_id", "event_type", "value"), ["user_id", "event_type"]))


@PLANS.add(f"WITH {OBS_SQL} SELECT drone_id, seq, change_type, flight_index FROM ev")
def flight_of_change(spark: SparkSession, folder: str) -> DataFrame:
    return change_events(spark, folder).select("drone_id", "seq", "change_type", "flight_index")


@PLANS.add(f"WITH {OBS_SQL} SELECT drone_id, feature_key, flight_index, epoch, baseline_group FROM grp")
def feature_epochs(spark: SparkSession, folder: str) -> DataFrame:
    return grouped(spark, folder).select("drone_id", "feature_key", "flight_index", "epoch", "baseline_group")


@PLANS.add(f"""WITH {OBS_SQL} SELECT f.drone_id, f.flight_index, arg_max(e.epoch, (e.flight_index, e.seq)) AS epoch FROM fl f LEFT JOIN ev e
    ON e.drone_id = f.drone_id AND e.flight_index <= f.flight_index GROUP BY f.drone_id, f.flight_index""")
def latest_epochs(spark: SparkSession, folder: str) -> DataFrame:
    flights = observations(spark, folder).filter("feature_key = 'vib.metric_p50'").select("drone_id", "flight_index")
    return E.latest_epoch(flights, change_events(spark, folder))


@PLANS.add(f"""WITH RECURSIVE {FOLD_SQL} SELECT drone_id, baseline_group, feature_key, flight_index, admitted, quarantine_reason, n_before,
    base_n, round(med, 6) AS base_median, round(mad, 6) AS base_mad, round(spread, 6) AS base_spread,
    CASE WHEN len(ref5) = 5 THEN round(list_aggregate(ref5, 'median'), 6) END AS ref_median FROM adm""")
def admission_gate(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(admitted(spark, folder).select(*B.KEYS, "flight_index", "admitted", "quarantine_reason", "n_before", "base_n",
        "base_median", "base_mad", "base_spread", "ref_median"))


@PLANS.add(f"""WITH RECURSIVE {FOLD_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY drone_id, baseline_group, feature_key ORDER BY
    flight_index DESC) AS p FROM adm WHERE qualified),
    x AS (SELECT drone_id, baseline_group, feature_key, count(*) AS n, bool_and(coalesce(quarantine_reason = 'outlier', false)) AS o,
        min(value) AS lo, max(value) AS hi, max(CASE WHEN p = 3 THEN med END) AS m, max(CASE WHEN p = 3 THEN spread END) AS s FROM l WHERE p <= 3 GROUP BY ALL)
    SELECT drone_id, baseline_group, feature_key, CASE WHEN lo > m THEN 'up' ELSE 'down' END AS direction, round(m, 6) AS baseline_median,
        round((hi - lo) / s, 6) AS max_pairwise_z FROM x WHERE n = 3 AND o AND (lo > m OR hi <= m) AND (hi - lo) / s <= 2""")
def inferred_changes(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(B.inferred_changes(admitted(spark, folder)))


SCORE_SQL = f"""{FOLD_SQL}, sc1 AS (SELECT *, n_before + 1 AS n, CASE WHEN valid THEN greatest(0.0, CASE WHEN lower_is_worse THEN (med -
    value) / spread ELSE (value - med) / spread END) END AS z FROM adm),
    sc2 AS (SELECT *, greatest(0.0, least(100.0, 100 - 15 * (z - 1))) AS own, z IS NOT NULL AND n >= 3 AS use, CASE WHEN n <= 2 THEN 0.0
        WHEN n >= 5 THEN 1.0 ELSE (n - 2) / 3.0 END AS w FROM sc1),
    sc AS (SELECT *, CASE WHEN valid THEN round(CASE WHEN absolute_score IS NULL THEN CASE WHEN use THEN own END WHEN use THEN w * own + (1
        - w) * absolute_score ELSE absolute_score END + 1e-9, 1) END AS score,
        CASE WHEN valid THEN CASE WHEN use THEN CASE WHEN absolute_score IS NULL THEN 1.0 ELSE w END ELSE 0.0 END END AS weight,
        CASE WHEN valid THEN CASE WHEN NOT use THEN 'absolute' WHEN n >= 5 THEN 'personal' WHEN n >= 3 THEN 'blended' ELSE 'absolute' END END AS mode FROM sc2),
    st AS (SELECT *, CASE WHEN NOT valid THEN 'unscored' WHEN score IS NULL THEN 'learning' ELSE 'scored' END AS status FROM sc)"""


@PLANS.add(f"""WITH RECURSIVE {SCORE_SQL} SELECT drone_id, feature_key, flight_index, n, round(z, 5) AS z, round(weight, 6) AS weight, score, status, mode,
    CASE WHEN valid THEN CASE WHEN tier = 'R2' AND n < 5 THEN 'low' WHEN mode = 'personal' THEN CASE WHEN n >= 10 AND tier = 'R1' THEN
        'high' ELSE 'medium' END WHEN mode = 'blended' THEN 'medium' WHEN absolute_score IS NOT NULL THEN 'medium' ELSE 'low' END END AS confidence FROM st""")
def feature_scores(spark: SparkSession, folder: str) -> DataFrame:
    return scores_of(admitted(spark, folder))


def scores_of(rows: DataFrame) -> DataFrame:
    return rounded(S.score_features(rows).select("drone_id", "feature_key", "flight_index", "n", F.round("z", 5).alias("z"), "weight", "score", "status",
        "mode", "confidence"))


@PLANS.add(f"""WITH RECURSIVE {SCORE_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY drone_id, flight_index, subsystem ORDER BY
    score, place) AS r FROM st WHERE status = 'scored')
    SELECT drone_id, flight_index, subsystem, round(0.5 * min(score) + 0.5 * avg(score) + 1e-9, 1) AS score, max(CASE WHEN r = 1 THEN
        feature_key END) AS worst_feature FROM ranked GROUP BY ALL""")
def subsystem_scores(spark: SparkSession, folder: str) -> DataFrame:
    return S.subsystem_scores(S.score_features(admitted(spark, folder)))


@PLANS.add(f"""WITH RECURSIVE {SCORE_SQL}, sub AS (SELECT drone_id, flight_index, subsystem, round(0.5 * min(v) + 0.5 * avg(v) + 1e-9, 1) AS
    own, min(v) AS worst, count(v) AS scored, count(*) FILTER (WHERE valid) AS valid, count(*) AS total FROM (SELECT *, CASE WHEN status =
    'scored' THEN score END AS v FROM st) GROUP BY ALL),
    f AS (SELECT drone_id, flight_index, count(own) AS scored_subsystems, round(0.5 * min(own) + 0.5 * avg(own) + 1e-9, 1) AS raw,
        min(worst) AS worst_score, CAST(sum(scored) AS BIGINT) AS features_scored, CAST(sum(valid) AS BIGINT) AS features_valid,
        CAST(sum(total) AS BIGINT) AS features_total FROM sub GROUP BY ALL),
    c AS (SELECT *, CASE WHEN worst_score < 50 THEN 69.0 WHEN worst_score < 70 THEN 84.0 END AS ceiling FROM f), o AS (SELECT *,
        scored_subsystems >= 4 AND coalesce(raw > ceiling, false) AS capped, CASE WHEN scored_subsystems >= 4 THEN CASE WHEN raw > ceiling
        THEN ceiling ELSE raw END END AS overall FROM c)
    SELECT drone_id, flight_index, scored_subsystems, overall, CASE WHEN overall >= 85 THEN 'fine' WHEN overall >= 70 THEN 'watch' WHEN
        overall >= 50 THEN 'off' WHEN overall IS NOT NULL THEN 'bad' END AS score_band, capped, worst_score, features_scored,
        features_valid, features_total FROM o""")
def flight_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.rollup(S.score_features(admitted(spark, folder))), 1)


@PLANS.add(f"""WITH {OBS_SQL}, c(chk, feature_key, fail, confidence, only_px4) AS (VALUES ('accel_clipping', 'vib.clip_rate', 'watch',
    'low', false), ('prop_imbalance', 'vib.imbalance', 'off', 'medium', true), ('gps_accuracy', 'gps.eph_p50', 'watch', 'medium', true),
    ('gps_satellites', 'gps.nsats_p10', 'watch', 'medium', true),
        ('gps_speed_accuracy', 'gps.sacc_p50', 'watch', 'medium', true), ('estimator_agreement', 'est.test_ratio_p95', 'off', 'high',
            false), ('motor_headroom', 'act.sat_frac', 'watch', 'high', false), ('pack_not_empty', 'pwr.v_cell_min', 'usage_note', 'high', false)),
    f AS (SELECT DISTINCT drone_id, flight_index, autopilot FROM obs), v AS (SELECT drone_id, flight_index, feature_key, value FROM obs WHERE valid)
    SELECT f.drone_id, f.flight_index, f.autopilot, chk AS "check", c.feature_key, CASE WHEN value IS NULL THEN 'unavailable' WHEN
        c.feature_key = 'gps.eph_p50' AND value <= 3 THEN 'ok' WHEN c.feature_key = 'gps.nsats_p10' AND value >= 6 THEN 'ok' ELSE fail END AS status, confidence
    FROM f JOIN c ON NOT only_px4 OR autopilot = 'px4' LEFT JOIN v ON v.drone_id = f.drone_id AND v.flight_index = f.flight_index AND
        v.feature_key = c.feature_key""")
def first_flight_checks(spark: SparkSession, folder: str) -> DataFrame:
    return S.checklist(observations(spark, folder))


@PLANS.add(f"""WITH {OBS_SQL} SELECT drone_id, feature_key, flight_index, CASE WHEN event_gap = 0 THEN 'raw high-rate accelerometer logging' ELSE
    'sensing of every battery cell' END AS needs FROM (SELECT *, flight_index % 3 AS event_gap FROM obs WHERE NOT valid) WHERE event_gap < 2""")
def missing_logging(spark: SparkSession, folder: str) -> DataFrame:
    """What vehicles would have to log for the features that they lack."""
    gaps = F.when(F.col("flight_index") % 3 == 0, "requires_fifo_accel").when(F.col("flight_index") % 3 == 1, "no_per_cell_sensing")
    rows = observations(spark, folder).filter("NOT valid").withColumn("reason", gaps)
    return S.logging_gaps(rows).select("drone_id", "feature_key", "flight_index", "needs")


@PLANS.add(f"""WITH RECURSIVE {FOLD_SQL} SELECT o.drone_id, o.feature_key, o.flight_index, round(o.value, 6) AS value, a.admitted, a.quarantine_reason FROM obs o
    LEFT JOIN adm a ON a.drone_id = o.drone_id AND a.feature_key = o.feature_key AND a.flight_index = o.flight_index AND a.n_before >= 2""")
def features_with_admissions(spark: SparkSession, folder: str) -> DataFrame:
    """Stored features beside what the gate said of them, from the third admitted value on."""
    said = admitted(spark, folder).filter("n_before >= 2")
    rows = K.with_baselines(observations(spark, folder), said, ["drone_id", "feature_key", "flight_index"])
    return rounded(rows.select("drone_id", "feature_key", "flight_index", "value", "admitted", "quarantine_reason"))


@PLANS.add(f"""WITH {OBS_SQL} SELECT drone_id, flight_index, 'Vibration ' || printf('%.1f', round(value, 1)) || ' m/s²: ' || CASE autopilot WHEN 'px4' THEN
    'in 23 public PX4 logs, a small sample that leans high, 15 lay above 4.9 and 7 above 9.8.' ELSE
    'by ArduPilot''s guide fine below 30, mostly a problem above 60.' END AS text, 0 AS claims FROM obs
    WHERE feature_key = 'vib.metric_p50' AND flight_index < 2 AND valid AND value IS NOT NULL""")
def guide_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """What the first two flights of a vehicle say of its vibration, and how many forbidden claims that makes."""
    rows = S.with_absolute(observations(spark, folder), C.norms(spark))
    rows = rows.filter("feature_key = 'vib.metric_p50' AND flight_index < 2 AND valid AND absolute_status = 'context'")
    text = phrases.guide_context(F.col("value"), F.col("autopilot"), F.col("healthy_edge"), F.col("bad_edge"))
    return rows.select("drone_id", "flight_index", text.alias("text")).withColumn("claims", F.size(C.forbidden_claims(F.col("text"))))


FINDING_SQL = f"""{SCORE_SQL}, k AS (SELECT *, CASE WHEN NOT (status = 'scored' AND score < 85) THEN NULL WHEN (med IS NOT NULL AND
    coalesce(weight, 0) > 0.5) OR (absolute_score IS NULL AND med IS NOT NULL) THEN CASE WHEN feature_key = 'act.spread' THEN 'pattern' ELSE
    'personal' END ELSE 'absolute' END AS kind,
        CASE WHEN feature_key LIKE 'vib.metric%' THEN 'vib.metric' WHEN feature_key = 'act.spread' THEN 'pattern.other' WHEN feature_key IN
            ('gps.eph_p50', 'gps.nsats_p10') THEN 'gps.position' ELSE feature_key END AS cause FROM st),
    rk AS (SELECT *, row_number() OVER (PARTITION BY drone_id, flight_index, cause ORDER BY score, tier <> 'R1', place) AS r FROM k WHERE kind IS NOT NULL),
    fnd AS (SELECT drone_id, flight_index, cause, max(CASE WHEN r = 1 THEN feature_key END) AS feature_key, max(CASE WHEN r = 1 THEN kind
        END) AS kind, max(CASE WHEN r = 1 THEN score END) AS rank_score, coalesce(string_agg(CASE WHEN r > 1 THEN feature_key END, ',' ORDER
        BY r), '') AS related FROM rk GROUP BY ALL)"""


def _findings(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    scores = S.score_features(admitted(spark, folder, events)).withColumns({"definitional": S.definitional(F.col("feature_key"), F.col("value"),
        F.lit(0)), "pattern": F.when(F.col("feature_key") == "act.spread", "mixed")})
    return S.findings(scores)


@PLANS.add(f"WITH RECURSIVE {FINDING_SQL} SELECT * FROM fnd")
def findings(spark: SparkSession, folder: str) -> DataFrame:
    return _findings(spark, folder).withColumn("related", F.array_join("related", ","))


@PLANS.add(f"""WITH RECURSIVE {FINDING_SQL} SELECT drone_id, flight_index, cause, rank_score, CAST(row_number() OVER (PARTITION BY drone_id,
    flight_index ORDER BY rank_score, cause) AS INTEGER) AS place FROM fnd QUALIFY place <= 3""")
def worst_findings(spark: SparkSession, folder: str) -> DataFrame:
    return S.worst_findings(_findings(spark, folder)).select("drone_id", "flight_index", "cause", "rank_score", "place")


TREND_SQL = """t1 AS (SELECT *, sum(CASE WHEN admitted THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS ra, row_number() OVER
    (PARTITION BY drone_id, baseline_group, feature_key ORDER BY flight_index DESC) AS back, lead(value) OVER w AS nxt FROM adm WHERE
    qualified WINDOW w AS (PARTITION BY drone_id, baseline_group, feature_key ORDER BY flight_index)),
    t2 AS (SELECT *, max(CASE WHEN admitted THEN ra END) OVER p AS have, list(CASE WHEN admitted AND ra <= 5 THEN value END) OVER p AS five
        FROM t1 WINDOW p AS (PARTITION BY drone_id, baseline_group, feature_key)),
    t3 AS (SELECT *, CASE WHEN have >= 5 THEN list_aggregate(list_filter(five, lambda x: x IS NOT NULL), 'median') END AS ref FROM t2),
    t4 AS (SELECT *, 2 * greatest(1.4826 * list_aggregate(list_transform(list_filter(five, lambda x: x IS NOT NULL), lambda x: abs(x -
        ref)), 'median'), floor, relative_floor * abs(ref)) AS half FROM t3),
    t5 AS (SELECT *, CASE WHEN lower_is_worse THEN ref - half ELSE ref + half END AS edge FROM t4), t6 AS (SELECT *, CASE WHEN
        lower_is_worse THEN value < edge ELSE value > edge END AS beyond FROM t5),
    t7 AS (SELECT drone_id, baseline_group, feature_key, max(flight_index) AS flight_index, arg_max(value, flight_index) AS value,
        any_value(ref) AS ref, any_value(CASE WHEN ref IS NOT NULL THEN half END) AS half, any_value(have) AS have, count(*) AS n, count(*)
        FILTER (WHERE back <= 3 AND beyond) AS recent, quantile_cont(CASE WHEN back <= 5 THEN value END, 0.5) AS med5, any_value(edge) AS edge,
        any_value(lower_is_worse) AS lower, any_value(floor) AS floor, any_value(relative_floor) AS rel, max(CASE WHEN NOT beyond THEN
            flight_index END) AS last_in, any_value(ref IS NULL) AS none FROM t6 GROUP BY ALL),
    t8 AS (SELECT t7.*, abs(t6.nxt - t6.value) >= t7.half AS abr FROM t7 LEFT JOIN t6 ON t6.drone_id = t7.drone_id AND t6.baseline_group =
        t7.baseline_group AND t6.feature_key = t7.feature_key AND t6.flight_index = t7.last_in),
    t9 AS (SELECT *, coalesce(n >= 3 AND recent = 3, false) AS s, coalesce(n >= 5 AND CASE WHEN lower THEN med5 < edge ELSE med5 > edge END,
        false) AS d, coalesce(abr, true) AS a FROM t8)"""


@PLANS.add(f"""WITH RECURSIVE {FOLD_SQL}, {TREND_SQL}
    SELECT drone_id, baseline_group, feature_key, flight_index, round(value, 6) AS value, round(ref, 6) AS reference_median, round(ref -
        half, 5) AS band_low, round(ref + half, 5) AS band_high, round(value - ref, 6) AS delta, s AND (NOT d OR a) AS step, d AND (NOT s OR NOT a) AS drift,
        CASE WHEN none THEN CAST(have AS INTEGER) END AS reference_progress, round(4 * greatest(floor, rel * abs(coalesce(ref, value))), 6)
            AS min_span FROM t9""")
def trend_callouts(spark: SparkSession, folder: str) -> DataFrame:
    out = T.callouts(admitted(spark, folder))
    return rounded(out.withColumns({"band_low": F.round("band_low", 5), "band_high": F.round("band_high", 5)}))


@PLANS.add(f"""WITH RECURSIVE {FOLD_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY drone_id, baseline_group, feature_key ORDER BY
    flight_index DESC) AS back FROM adm WHERE qualified AND feature_key = 'vib.metric_p50' AND autopilot = 'px4')
    SELECT drone_id, baseline_group, feature_key, 30.0::DOUBLE AS guide FROM l WHERE back <= 3 AND value > 30 GROUP BY ALL HAVING count(*) = 3""")
def guide_callouts(spark: SparkSession, folder: str) -> DataFrame:
    """Callouts where a graded norm is registered for a feature."""
    graded = (("vib.metric_p50", "px4", "graded", False, 30.0, 60.0, "low"),)
    return T.guide_crossed(admitted(spark, folder), C.norms(spark, graded))


PARAM_SQL = """par AS (SELECT o_custkey AS drone_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS
    flight_index, o_orderkey, o_orderpriority, o_totalprice FROM orders),
    params AS (SELECT drone_id, flight_index, 'MC_ROLLRATE_P' AS name, CAST(CAST(o_orderkey % 3 AS DOUBLE) / 4 AS VARCHAR) AS value FROM par
        UNION ALL SELECT drone_id, flight_index, 'firmware_version', o_orderpriority FROM par UNION ALL SELECT drone_id, flight_index,
        'BAT1_CAPACITY', CAST(o_orderkey % 2 AS VARCHAR) FROM par WHERE o_orderkey % 5 <> 0
        UNION ALL SELECT drone_id, flight_index, 'CA_ROTOR5_PX', CAST(o_orderkey % 7 AS VARCHAR) FROM par UNION ALL SELECT drone_id,
            flight_index, 'CA_ROTOR_COUNT', CASE WHEN o_orderkey % 4 = 0 THEN '4' ELSE '6' END FROM par UNION ALL SELECT drone_id,
            flight_index, 'COM_OTHER', CAST(o_orderkey AS VARCHAR) FROM par),
    w AS (SELECT *, CASE name WHEN 'MC_ROLLRATE_P' THEN 'firmware_tuning' WHEN 'firmware_version' THEN 'firmware_tuning' WHEN
        'BAT1_CAPACITY' THEN 'pack' WHEN 'CA_ROTOR5_PX' THEN 'frame' WHEN 'CA_ROTOR_COUNT' THEN 'frame' END AS change_type, max(CASE WHEN
        name = 'CA_ROTOR_COUNT' THEN CAST(value AS INTEGER) END) OVER (PARTITION BY drone_id, flight_index) AS rotors FROM params),
    l AS (SELECT *, lag(value) OVER x AS old, lag(flight_index) OVER x AS prev FROM w WHERE change_type IS NOT NULL AND NOT (name =
        'CA_ROTOR5_PX' AND rotors <= 5) WINDOW x AS (PARTITION BY drone_id, name ORDER BY flight_index)),
    pc AS (SELECT drone_id, flight_index, name, old, value AS new, change_type FROM l WHERE prev = flight_index - 1 AND old <> value)"""


def _parameters(spark: SparkSession, folder: str) -> DataFrame:
    """Every order of a customer is a log with five parameters."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    orders = table(spark, folder, "orders")
    rows = dealt(orders, orders.count(), "o_custkey").withColumn("place", place)
    key = F.col("o_orderkey")
    pairs = (
        ("MC_ROLLRATE_P", ((key % 3).cast("double") / 4).cast("string")),
        ("firmware_version", F.col("o_orderpriority")),
        ("BAT1_CAPACITY", F.when(key % 5 != 0, (key % 2).cast("string"))),
        ("CA_ROTOR5_PX", (key % 7).cast("string")),
        ("CA_ROTOR_COUNT", F.when(key % 4 == 0, "4").otherwise("6")),
        ("COM_OTHER", key.cast("string")),
    )
    rows = rows.select(F.col("o_custkey").alias("drone_id"), F.col("place").alias("flight_index"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in pairs])).alias("p"))
    return rows.select("drone_id", "flight_index", "p.*").filter("value IS NOT NULL")


@PLANS.add(f"WITH {PARAM_SQL} SELECT * FROM pc")
def parameter_changes(spark: SparkSession, folder: str) -> DataFrame:
    return E.parameter_changes(_parameters(spark, folder))


@PLANS.add(f"""WITH {PARAM_SQL} SELECT drone_id, flight_index, change_type, string_agg(DISTINCT name, ', ' ORDER BY name) AS note, 'params-'
    || flight_index || '-' || change_type AS epoch FROM pc GROUP BY drone_id, flight_index, change_type""")
def parameter_events(spark: SparkSession, folder: str) -> DataFrame:
    return E.events_from_parameters(E.parameter_changes(_parameters(spark, folder)))


_CLAIM_SQL = " || ".join(f"CASE WHEN regexp_matches(text, '(?i){pattern}') THEN '{kind};' ELSE '' END" for kind, pattern in C.FORBIDDEN)


@PLANS.add(f"""SELECT conv_id, turn, {_CLAIM_SQL} AS claims FROM (SELECT conv_id, turn, coalesce(text, '') || CASE WHEN turn % 3 = 0 THEN
    ' the pack has 80 % health and is safe to fly' ELSE '' END AS text FROM conversations)""")
def forbidden_claims(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 3 == 0, " the pack has 80 % health and is safe to fly").otherwise(""))
    return rows.select("conv_id", "turn", F.array_join(F.transform(C.forbidden_claims(text), lambda x: F.concat(x, F.lit(";"))), "").alias("claims"))
