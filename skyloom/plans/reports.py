"""What reports and charts are made of: merged changes, drawn points, boundaries, pills, causes, spectra of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalogue as C
from ..functions import phrases
from ..operators import baselines as B
from ..operators import epochs as E
from ..operators import scoring as S
from ..operators import spectral as P
from ..operators import trends as T
from ..sources.tables import table
from . import compare, health
from .common import Plans, rounded

PLANS = Plans()

EVENTS_SQL = f"""{health.OBS_SQL}, {health.PARAM_SQL},
    det AS (SELECT drone_id, flight_index, change_type, 'params-' || flight_index || '-' || change_type AS epoch FROM pc GROUP BY ALL),
    al AS (SELECT drone_id, flight_index, 'declared' AS source, change_type, epoch, seq AS own FROM ev UNION ALL SELECT drone_id,
        flight_index, 'detected', change_type, epoch, 0 FROM det),
    me AS (SELECT drone_id, flight_index, source, change_type, epoch, CAST(row_number() OVER (PARTITION BY drone_id ORDER BY flight_index,
        source, own, change_type) AS INTEGER) AS seq FROM al)"""


_DECLARED = "fe AS (SELECT drone_id, feature_key, flight_index, seq, epoch FROM ev JOIN resets USING (change_type))"


def _on_merged(sql: str) -> str:
    """SQL of a health query with the merged events in place of the declared ones."""
    merged = EVENTS_SQL.removeprefix(f"{health.OBS_SQL}, ")
    assert _DECLARED in sql
    return sql.replace(_DECLARED, f"{merged}, {_DECLARED.replace('FROM ev', 'FROM me')}")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Declared changes of the vehicles and those that their parameters show."""
    detected = E.events_from_parameters(E.parameter_changes(health._parameters(spark, folder)))
    return E.merged(health.change_events(spark, folder), detected)


@PLANS.add(f"WITH {EVENTS_SQL} SELECT drone_id, flight_index, source, change_type, epoch, seq FROM me")
def merged_events(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder)


@PLANS.add(f"""WITH {EVENTS_SQL}, fm AS (SELECT drone_id, feature_key, flight_index, seq, epoch FROM me JOIN resets USING (change_type)),
    x AS (SELECT o.drone_id, o.feature_key, o.flight_index, arg_max(e.epoch, e.seq) AS epoch FROM obs o JOIN fm e ON e.drone_id = o.drone_id
        AND e.feature_key = o.feature_key AND e.flight_index <= o.flight_index GROUP BY ALL)
    SELECT drone_id, feature_key, flight_index, epoch, CASE WHEN feature_key LIKE 'pwr.%' THEN 'pack:' || pack_id || CASE WHEN epoch IS NULL
        THEN '' ELSE '/epoch:' || epoch END ELSE 'epoch:' || coalesce(epoch, 'initial') END AS baseline_group FROM obs LEFT JOIN x USING
        (drone_id, feature_key, flight_index)""")
def merged_epochs(spark: SparkSession, folder: str) -> DataFrame:
    """The baseline group of every observation, with detected changes among the declared ones."""
    rows = E.feature_epoch(health.observations(spark, folder), events(spark, folder), C.reset_features(spark))
    return rows.select("drone_id", "feature_key", "flight_index", "epoch", B.group_key(F.col("feature_key"), F.col("epoch"),
        F.col("pack_id")).alias("baseline_group"))


POINTS_SQL = f"""{health.SCORE_SQL}, pt AS (SELECT drone_id, CASE WHEN feature_key LIKE 'pwr.%' THEN CAST(pack_id AS VARCHAR) END AS pack,
    feature_key, flight_index, value, baseline_group, admitted, score,
    baseline_group = last_value(baseline_group) OVER (PARTITION BY drone_id, CASE WHEN feature_key LIKE 'pwr.%' THEN pack_id END,
        feature_key ORDER BY flight_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS current FROM st WHERE qualified)"""


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return S.score_features(health.admitted(spark, folder))


@PLANS.add(f"""WITH RECURSIVE {POINTS_SQL} SELECT drone_id, pack, feature_key, flight_index, round(value, 6) AS value, baseline_group,
    admitted, score, current FROM pt""")
def trend_points(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(T.points(_scored(spark, folder)))


@PLANS.add(f"""WITH {EVENTS_SQL}, r AS (SELECT drone_id, CASE WHEN feature_key LIKE 'pwr.%' THEN CAST(pack_id AS VARCHAR) END AS pack,
    feature_key, min(flight_index) AS a, max(flight_index) AS b FROM obs WHERE qualified GROUP BY ALL)
    SELECT r.drone_id, pack, r.feature_key, me.flight_index, source, change_type FROM r JOIN resets USING (feature_key) JOIN me USING
        (drone_id, change_type) WHERE me.flight_index > a AND me.flight_index <= b""")
def trend_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    pack = F.when(F.col("feature_key").startswith("pwr."), F.col("pack_id").cast("string"))
    drawn = health.observations(spark, folder).filter("qualified AND value IS NOT NULL").withColumn("pack", pack)
    return T.boundaries(drawn, events(spark, folder), C.reset_features(spark))


@PLANS.add(f"""WITH RECURSIVE {health.SCORE_SQL}, {health.TREND_SQL}, tc AS (SELECT drone_id, baseline_group, feature_key, flight_index, (s
    AND (NOT d OR a)) OR (d AND (NOT s OR NOT a)) AS called FROM t9),
    b AS (SELECT tc.*, CASE WHEN score >= 85 THEN 'fine' WHEN score >= 70 THEN 'watch' WHEN score >= 50 THEN 'off' WHEN score IS NOT NULL
        THEN 'bad' END AS band FROM tc JOIN st USING (drone_id, baseline_group, feature_key, flight_index))
    SELECT drone_id, baseline_group, feature_key, flight_index, called, CASE WHEN called AND (band IS NULL OR band = 'fine') THEN 'watch'
        ELSE band END AS pill FROM b""")
def trend_pills(spark: SparkSession, folder: str) -> DataFrame:
    """The colour beside the latest value of every series: never greener than what is called out beside it."""
    keys = ["drone_id", "baseline_group", "feature_key", "flight_index"]
    called = T.callouts(health.admitted(spark, folder)).select(*keys, (F.col("step") | F.col("drift")).alias("called"))
    rows = called.join(_scored(spark, folder).select(*keys, "score"), keys)
    return rows.select(*keys, "called", T.pill(S.band(F.col("score")), F.col("called")).alias("pill"))


_CAUSE_ROWS = ", ".join(f"('{k}', {i}, '{'most_often' if i <= len(most) else 'also_check'}')" for k, (most, also) in phrases.CAUSES.items()
    for i in range(1, len(most) + len(also) + 1))


@PLANS.add(f"""WITH RECURSIVE {health.FINDING_SQL}, ca(cause, rank, likelihood) AS (VALUES {_CAUSE_ROWS})
    SELECT drone_id, flight_index, cause, CAST(rank AS INTEGER) AS rank, likelihood, CASE likelihood WHEN 'most_often' THEN 'Usually' ELSE
        'Or' END AS opener FROM fnd JOIN ca USING (cause)""")
def finding_causes(spark: SparkSession, folder: str) -> DataFrame:
    """The probable causes of every finding, in their order."""
    rows = health._findings(spark, folder).join(F.broadcast(phrases.causes(spark)), "cause")
    phrase = phrases.cause_phrase(F.col("text"), F.col("likelihood"), F.lit("medium"))
    return rows.select("drone_id", "flight_index", "cause", "rank", "likelihood", F.split(phrase, ":")[0].alias("opener"))


@PLANS.add(f"""WITH {compare.SPECTRA_SQL}, c AS (SELECT pair, any_value(label) AS label, sqrt(avg(pow(10 * log10(greatest(real, 1e-12) /
    greatest(sim, 1e-12)), 2))) AS lsd, sum(hz * real) / nullif(sum(real), 0) AS cr, sum(hz * sim) / nullif(sum(sim), 0) AS cs FROM sp GROUP BY pair)
    SELECT pair, CASE WHEN pair % 11 <> 5 THEN round(lsd, 5) END AS lsd_db, CASE WHEN pair % 11 <> 5 THEN round(cr, 5) END AS
        centroid_real_hz, CASE WHEN pair % 11 <> 5 THEN round(cs, 5) END AS centroid_sim_hz,
        CASE WHEN pair % 11 <> 5 THEN round(cs - cr, 5) END AS centroid_shift_hz, CASE WHEN pair % 11 = 5 THEN 'low_rate' END AS reason,
            (CASE WHEN label > 0 THEN label * 30 END) IS DISTINCT FROM (CASE WHEN pair % 3 = 0 THEN 60 WHEN pair % 3 = 1 THEN NULLIF(0, 0)
            ELSE 30 END) AS cutoff_mismatch FROM c""")
def spectral_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Distance, centroids and their shift for every pair, with the warning of unequal filters."""
    sim = F.element_at(F.array(F.lit(60.0), F.lit(0.0), F.lit(30.0)), (F.col("pair") % 3 + 1).cast("int"))
    pairs = compare.vectors(spark, folder)
    cutoffs = pairs.select("pair", (F.col("label") * 30.0).alias("cutoff_real"), sim.alias("cutoff_sim"))
    slow = pairs.filter("pair % 11 = 5").select("pair")
    return rounded(P.comparison(compare.spectra(spark, folder), cutoffs, slow), 5)


@PLANS.add("""SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_name = 'Customer#000000042'""")
def customer_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """A user by a unique name: an equality that reaches the scan."""
    return table(spark, folder, "customer").filter(F.col("c_name") == "Customer#000000042").select("c_custkey", "c_name", "c_nationkey")


RUN_SQL = f"""{health.OBS_SQL}, rk AS (SELECT drone_id, feature_key, flight_index, value, CASE WHEN flight_index < 3 THEN 'low' WHEN
    flight_index < 10 THEN 'medium' ELSE 'high' END AS confidence FROM obs)"""


@PLANS.add(f"""WITH {RUN_SQL} SELECT drone_id, feature_key, flight_index, CASE confidence WHEN 'medium' THEN 'Looks like ' WHEN 'low' THEN
    'Early read: ' ELSE '' END ||
    CASE WHEN confidence = 'medium' THEN CASE feature_key WHEN 'gps.eph_p50' THEN 'GPS error' ELSE 'vibration' END ELSE CASE feature_key
        WHEN 'gps.eph_p50' THEN 'GPS error' ELSE 'Vibration' END END || ' ' ||
    CASE feature_key WHEN 'gps.eph_p50' THEN printf('%.2f m', value) ELSE printf('%.1f m/s²', value) END || ', too high each flight yet' AS
        text FROM rk WHERE feature_key IN ('gps.eph_p50', 'vib.metric_p50')""")
def consistent_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The line of every vibration and GPS error as one that was bad on each flight, hedged by flight number."""
    rows = health.observations(spark, folder).filter("feature_key IN ('gps.eph_p50', 'vib.metric_p50')").drop("name")
    rows = rows.join(F.broadcast(phrases.display(spark)), "feature_key")
    confidence = F.when(F.col("flight_index") < 3, "low").when(F.col("flight_index") < 10, "medium").otherwise("high")
    return rows.select("drone_id", "feature_key", "flight_index", phrases.hedged(phrases.consistent_line(F.col("value"), F.lit(False)),
        confidence).alias("text"))


@PLANS.add(_on_merged(health.PLANS.sql["admission_gate"]))
def report_admissions(spark: SparkSession, folder: str) -> DataFrame:
    """The admission gate of a report: detected changes begin new baselines as declared ones do."""
    out = health.admitted(spark, folder, events(spark, folder))
    return rounded(out.select("drone_id", "baseline_group", "feature_key", "flight_index", "admitted", "quarantine_reason", "n_before", "base_n", "base_median", "base_mad",
        "base_spread", "ref_median"))


@PLANS.add(_on_merged(health.PLANS.sql["feature_scores"]))
def report_scores(spark: SparkSession, folder: str) -> DataFrame:
    return health.scores_of(health.admitted(spark, folder, events(spark, folder)))


@PLANS.add(_on_merged(health.PLANS.sql["flight_rollup"]))
def report_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Each flight's overall score in its report."""
    return rounded(S.rollup(S.score_features(health.admitted(spark, folder, events(spark, folder)))), 1)


@PLANS.add(_on_merged(health.PLANS.sql["worst_findings"]))
def report_findings(spark: SparkSession, folder: str) -> DataFrame:
    """What a report names first."""
    return S.worst_findings(health._findings(spark, folder, events(spark, folder))).select("drone_id", "flight_index", "cause", "rank_score", "place")


@PLANS.add(_on_merged(health.PLANS.sql["trend_callouts"]))
def report_trends(spark: SparkSession, folder: str) -> DataFrame:
    out = T.callouts(health.admitted(spark, folder, events(spark, folder)))
    return rounded(out.withColumns({"band_low": F.round("band_low", 5), "band_high": F.round("band_high", 5)}))
