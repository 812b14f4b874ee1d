"""Flight features, table maintenance and paths over line items, events, documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import paths as P
from ..operators import store as K
from ..sources.tables import table
from .common import Plans, rounded
from .series import SERIES_SQL, signals

PLANS = Plans()

MOTORS_SQL = """motors AS (SELECT l_suppkey AS flight, l_orderkey AS i, l_linenumber % 4 AS motor, l_quantity / 50 + CASE WHEN l_linenumber
    % 4 = l_suppkey % 7 THEN 0.3 ELSE 0 END + CASE WHEN l_suppkey % 3 = 1 AND l_linenumber % 4 IN (0, 2) THEN 0.2 ELSE 0 END AS value FROM lineitem),
    means AS (SELECT flight, motor, avg(value) AS mean FROM motors GROUP BY ALL)"""
GEOMETRY = ((0, 0.2, 0.2, 0.05), (1, -0.2, -0.2, 0.05), (2, 0.2, -0.2, -0.05), (3, -0.2, 0.2, -0.05))


def motors(spark: SparkSession, folder: str) -> DataFrame:
    own = F.col("l_linenumber") % 4
    high = F.when(own == F.col("l_suppkey") % 7, 0.3).otherwise(0.0) + F.when((F.col("l_suppkey") % 3 == 1) & own.isin(0, 2), 0.2).otherwise(0.0)
    return table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("flight"), F.col("l_orderkey").alias("i"), own.alias("motor"),
        (F.col("l_quantity") / 50 + high).alias("value"))


@PLANS.add(f"""WITH {MOTORS_SQL}, s AS (SELECT flight, i, bool_or(value >= 0.98) AS a FROM motors GROUP BY ALL) SELECT flight,
    round(avg(CASE WHEN a THEN 1 ELSE 0 END), 9) AS sat_frac, count(*) AS n FROM s GROUP BY flight HAVING count(*) >= 10""")
def motor_saturation(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(X.saturation(motors(spark, folder)), 9)


@PLANS.add(f"""WITH {MOTORS_SQL} SELECT flight, round(avg(mean), 6) AS mean, round((max(mean) - min(mean)) / avg(mean), 6) AS spread,
    CAST(arg_max(motor, (mean, -motor)) + 1 AS INTEGER) AS highest, CAST(NULL AS VARCHAR) AS reason FROM means GROUP BY flight""")
def motor_spread(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(X.motor_spread(X.motor_means(motors(spark, folder))))


@PLANS.add(f"""WITH {MOTORS_SQL}, g(motor, px, py, km) AS (VALUES (0, 0.2, 0.2, 0.05), (1, -0.2, -0.2, 0.05), (2, 0.2, -0.2, -0.05), (3,
    -0.2, 0.2, -0.05)), d AS (SELECT flight, motor, mean, mean - avg(mean) OVER (PARTITION BY flight) AS d, avg(mean) OVER (PARTITION BY
    flight) AS c, px::DOUBLE AS px, py::DOUBLE AS py, sign(km)::DOUBLE AS s FROM means JOIN g USING (motor)),
    t AS (SELECT flight, (max(mean) - min(mean)) / max(c) AS spread, sum(d * d) AS vv, sum(px * d) / sum(px * px) AS bx, sum(py * d) /
        sum(py * py) AS by_, (pow(sum(px * d), 2) / sum(px * px) + pow(sum(py * d), 2) / sum(py * py)) / sum(d * d) AS side, pow(sum(s * d),
        2) / sum(s * s) / sum(d * d) AS spin, list_sort(list(d), 'DESC') AS o, arg_max(motor, d) AS top, sum(CASE WHEN d > 0 THEN s END) AS
        hs FROM d GROUP BY flight),
    p AS (SELECT *, CASE WHEN spread < 0.02 THEN 'balanced' WHEN o[1] * o[1] / vv >= 0.5 AND o[1] >= 2 * greatest(o[2], 0) THEN
        'single_motor_high' WHEN greatest(side, spin) >= 0.6 AND side >= spin THEN 'one_side_high' WHEN greatest(side, spin) >= 0.6 THEN
        'same_spin_set_high' ELSE 'mixed' END AS pattern FROM t)
    SELECT flight, pattern, CASE pattern WHEN 'single_motor_high' THEN CAST(top + 1 AS VARCHAR) WHEN 'one_side_high' THEN CASE WHEN abs(bx)
        >= abs(by_) THEN CASE WHEN bx > 0 THEN 'front' ELSE 'rear' END ELSE CASE WHEN by_ > 0 THEN 'right' ELSE 'left' END END WHEN
        'same_spin_set_high' THEN CASE WHEN hs > 0 THEN '+' ELSE '-' END END AS detail, round(side, 3) AS r2_one_side, round(spin, 3) AS
        r2_same_spin, CAST(NULL AS VARCHAR) AS reason FROM p""")
def motor_pattern(spark: SparkSession, folder: str) -> DataFrame:
    means = X.motor_means(motors(spark, folder))
    shape = F.explode(F.array(*[F.struct(F.lit(m).alias("motor"), F.lit(x).alias("px"), F.lit(y).alias("py"), F.lit(k).alias("km")) for m,
        x, y, k in GEOMETRY]))
    geometry = means.select("flight").distinct().withColumn("g", shape).select("flight", "g.*")
    return X.motor_pattern(means, geometry)


@PLANS.add("""WITH b AS (SELECT l_suppkey AS flight, 25 - 0.08 * l_quantity - l_orderkey * 1e-5 + l_discount * CASE WHEN l_suppkey % 9 = 0
    THEN 60 ELSE 3 END AS v, l_quantity AS i, l_orderkey / 10.0 AS c FROM lineitem),
    s AS (SELECT flight, count(*) AS n, avg(i) AS mi, quantile_cont(i, 0.95) - quantile_cont(i, 0.05) AS r, covar_pop(c, c) * count(*) AS
        cc, covar_pop(i, i) * count(*) AS ii, covar_pop(c, i) * count(*) AS ci, covar_pop(c, v) * count(*) AS cv, covar_pop(i, v) * count(*)
        AS iv, covar_pop(v, v) * count(*) AS vv FROM b GROUP BY flight),
    f AS (SELECT *, -(iv * cc - cv * ci) / (cc * ii - ci * ci) AS res, (cv * ii - iv * ci) / (cc * ii - ci * ci) AS slope FROM s), e AS
        (SELECT *, greatest(vv - slope * cv + res * iv, 0) AS rest, CASE WHEN n < 20 THEN 'insufficient_samples' WHEN mi <= 0 OR r < 0.3 *
        mi THEN 'insufficient_current_range' WHEN res <= 0 THEN 'non_physical_fit' END AS reason FROM f)
    SELECT flight, CASE WHEN reason IS NULL THEN round(res / 6 * 1000, 5) END AS r_cell_mohm, CASE WHEN reason IS NULL THEN round(sqrt(rest
        / greatest(1, n - 3) * cc / (cc * ii - ci * ci)), 6) END AS se_ohm, CASE WHEN reason IS NULL THEN round(1 - rest / vv, 6) END AS r2,
        n, reason FROM e""")
def pack_resistance(spark: SparkSession, folder: str) -> DataFrame:
    noise = F.col("l_discount") * F.when(F.col("l_suppkey") % 9 == 0, 60).otherwise(3)
    rows = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("flight"), (25 - 0.08 * F.col("l_quantity")
        - F.col("l_orderkey") * 1e-5 + noise).alias("volts"), F.col("l_quantity").alias("amps"), (F.col("l_orderkey") / 10.0).alias("mah"))
    out = X.pack_resistance(rows, F.lit(6.0))
    return rounded(out.withColumn("r_cell_mohm", F.round("r_cell_mohm", 5)))


@PLANS.add("""WITH q AS (SELECT l_suppkey AS flight, 1 + l_discount AS qw, l_tax AS qx, l_discount / 2 AS qy, l_quantity / 200 AS qz, 1.0 AS
    dw, l_discount AS dx, l_tax AS dy, 0.1 AS dz FROM lineitem),
    a AS (SELECT flight, degrees(2 * acos(least(1.0, abs((qw * dw + qx * dx + qy * dy + qz * dz) / (sqrt(qw * qw + qx * qx + qy * qy + qz *
        qz) * sqrt(dw * dw + dx * dx + dy * dy + dz * dz)))))) AS ang FROM q)
    SELECT flight, round(quantile_cont(ang, 0.95), 5) AS value, count(*) AS n FROM a GROUP BY flight""")
def attitude_error(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    rows = table(spark, folder, "lineitem").select(c("l_suppkey").alias("flight"), (1 + c("l_discount")).alias("qw"),
        c("l_tax").alias("qx"), (c("l_discount") / 2).alias("qy"), (c("l_quantity")
        / 200).alias("qz"), F.lit(1.0).alias("dw"), c("l_discount").alias("dx"), c("l_tax").alias("dy"), F.lit(0.1).alias("dz"))
    return rounded(X.attitude_error(rows), 5)


@PLANS.add(f"""WITH {SERIES_SQL}, s AS (SELECT key, us, value, lead(us) OVER w AS us2, lead(value) OVER w AS v2 FROM series WHERE kind <>
    'click' WINDOW w AS (PARTITION BY key ORDER BY us)), f AS (SELECT key, arg_min(value, us) AS v0 FROM s GROUP BY key),
    g AS (SELECT t.key, t.value AS sp, CASE WHEN s.us IS NULL THEN v0 WHEN us2 IS NULL THEN s.value ELSE s.value + (t.us - s.us) / (us2 -
        s.us) * (v2 - s.value) END AS v FROM (SELECT * FROM series WHERE kind = 'click') t ASOF LEFT JOIN s ON t.key = s.key AND t.us >=
        s.us JOIN f ON f.key = t.key)
    SELECT key, CASE WHEN count(*) FILTER (WHERE abs(sp) > 20) >= 5 THEN round(sqrt(avg(CASE WHEN abs(sp) > 20 THEN pow(v - sp, 2) END)) /
        sqrt(avg(CASE WHEN abs(sp) > 20 THEN sp * sp END)), 6) END AS ratio, count(*) FILTER (WHERE abs(sp) > 20) AS active, CASE WHEN
        count(*) FILTER (WHERE abs(sp) > 20) < 5 THEN 'insufficient_manoeuvring' END AS reason FROM g GROUP BY key""")
def rate_tracking(spark: SparkSession, folder: str) -> DataFrame:
    rows = signals(spark, folder)
    return rounded(X.rate_tracking(rows.filter("kind = 'click'"), rows.filter("kind <> 'click'"), rate_hz=0.5, threshold=20.0))


_SIGNAL_OF = {"click": "imu.vibration", "view": "gps.eph", "purchase": "gps.nsats", "error": "gps.sacc", "signup": "gps.noise"}


@PLANS.add(f"""WITH {SERIES_SQL}, k AS (SELECT key AS flight, kind, count(value) AS n, quantile_cont(value, 0.1) AS p10,
    quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM series GROUP BY ALL),
    v AS (SELECT flight, f AS feature_key, n, CASE f WHEN 'vib.metric_p95' THEN p95 WHEN 'gps.nsats_p10' THEN p10 ELSE p50 END AS v FROM k
        JOIN (VALUES ('click', 'vib.metric_p50'), ('click', 'vib.metric_p95'), ('view', 'gps.eph_p50'), ('purchase', 'gps.nsats_p10'),
        ('error', 'gps.sacc_p50'), ('signup', 'gps.noise')) t(kind, f) USING (kind)),
    c(feature_key, subsystem, tier) AS (VALUES
        {", ".join(f"('{a}', '{b}', '{t}')" for a, b, t in __import__("skyloom.functions.catalogue", fromlist=["FEATURES"]).FEATURES)}), fl
        AS (SELECT DISTINCT key AS flight, key % 10 <> 3 AS q FROM series)
    SELECT fl.flight, c.feature_key, subsystem, tier, CASE WHEN q AND n >= 10 THEN round(v, 6) END AS value, CASE WHEN NOT q THEN
        'airborne_too_short' WHEN n >= 10 THEN NULL WHEN n IS NOT NULL THEN 'insufficient_samples' ELSE 'signal_absent' END AS reason FROM
        fl CROSS JOIN c LEFT JOIN v ON v.flight = fl.flight AND v.feature_key = c.feature_key""")
def flight_features(spark: SparkSession, folder: str) -> DataFrame:
    """All catalogue features of every flight; event types are the signals."""
    name = F.expr("CASE kind " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _SIGNAL_OF.items()) + " END")
    rows = signals(spark, folder).select(F.col("key").alias("flight"), name.alias("key"), "us", "value")
    flights = rows.select("flight").distinct().select("flight", (F.col("flight") % 10 != 3).alias("qualified"),
        F.lit("airborne_too_short").alias("window_reason"))
    return rounded(X.all_features(flights, X.percentile_features(rows)))


@PLANS.add(f"""WITH {SERIES_SQL}, k AS (SELECT key AS flight, kind, quantile_cont(value, 0.95) AS p FROM series GROUP BY ALL) SELECT flight,
    round(max(p), 6) AS value, arg_max(kind, (p, kind)) AS worst FROM k GROUP BY flight""")
def worst_test_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(X.worst_ratio(signals(spark, folder).select(F.col("key").alias("flight"), F.col("kind").alias("key"), "value")))


@PLANS.add("""SELECT l_suppkey AS flight, CASE WHEN l_suppkey % 4 <> 0 THEN round(quantile_cont(l_discount, 0.95), 6) END AS value, CASE
    WHEN l_suppkey % 4 = 0 THEN 'no_per_cell_sensing' END AS reason FROM lineitem GROUP BY l_suppkey""")
def cell_delta(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("flight"), F.when(F.col("l_suppkey") % 4 != 0,
        F.col("l_discount")).otherwise(0.0).alias("value"))
    return rounded(X.cell_delta(rows))


CALIBRATION_SQL = """SELECT l_suppkey AS device, round(avg(l_quantity) - 25.5, 6) AS bias, round(stddev_pop(l_quantity), 6) AS noise,
    abs(avg(l_quantity) - 25.5) <= 0.5 AND stddev_pop(l_quantity) <= 14.5 AS axis_pass, round(stddev_pop(m) / avg(m), 6) AS field_cv,
    stddev_pop(m) / avg(m) <= 0.55 AS field_pass,
    CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE stddev_pop(l_tax) / avg(l_tax) <= 0.65 END AS esc_pass FROM (SELECT *, sqrt(l_quantity *
        l_quantity + l_discount * l_discount + l_tax * l_tax) AS m FROM lineitem) GROUP BY l_suppkey"""


@PLANS.add(f"WITH c AS ({CALIBRATION_SQL}) SELECT *, axis_pass AND field_pass AND coalesce(esc_pass, true) AS overall FROM c")
def sensor_calibration(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators import calibration as C

    rows = table(spark, folder, "lineitem")
    bias, noise, axis_pass = C.bias_noise("l_quantity", 25.5, 0.5, 14.5)
    cv, field_pass = C.variation(X.magnitude(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")), 0.55)
    _, esc = C.variation(F.col("l_tax"), 0.65)
    out = rows.groupBy(F.col("l_suppkey").alias("device")).agg(bias.alias("bias"), noise.alias("noise"), axis_pass.alias("axis_pass"),
        cv.alias("field_cv"), field_pass.alias("field_pass"), esc.alias("esc"))
    out = out.withColumn("esc_pass", F.when(F.col("device") % 3 != 0, F.col("esc"))).drop("esc")
    return rounded(out.withColumn("overall", C.overall("axis_pass", "field_pass", "esc_pass")))


@PLANS.add("""SELECT o_custkey AS drone_id, 'price' AS axis, round(sqrt(avg(pow(o_totalprice - d, 2))) / 1000, 6) AS rms,
    round(max(abs(o_totalprice - d)) / 1000, 6) AS max_error, count(*) AS n FROM (SELECT o_custkey, o_totalprice, 200000.0 + o_custkey AS d
    FROM orders) GROUP BY o_custkey HAVING count(*) >= 5""")
def tracking_error(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators import calibration as C

    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("drone_id"), F.lit("price").alias("axis"), ((200000.0
        + F.col("o_custkey")) / 1000).alias("desired"), (F.col("o_totalprice") / 1000).alias("actual"))
    return rounded(C.tracking_error(rows))


# --- maintenance


@PLANS.add("""SELECT source, doc_id, sha256(coalesce(text, '')) AS content_sha256 FROM documents QUALIFY row_number() OVER (PARTITION BY
    source, sha256(coalesce(text, '')) ORDER BY n_chars < 100, doc_id) = 1""")
def dedup_by_content(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each content and source; short ones count as failed uploads."""
    out = K.first_by_content(table(spark, folder, "documents"), ["source"], F.coalesce("text", F.lit("")), ["doc_id"], F.col("n_chars") < 100)
    return out.select("source", "doc_id", "content_sha256")


@PLANS.add("""SELECT doc_id, source, sha256(coalesce(text, '')) AS content_sha256 FROM documents u WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM documents s
    WHERE s.doc_id % 2 = 0 AND s.source = u.source AND sha256(coalesce(s.text, '')) = sha256(coalesce(u.text, '')))""")
def new_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Odd documents are uploads, even ones are stored: the uploads that bring new content to their source."""
    hashed = table(spark, folder, "documents").withColumn("content_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    out = K.new_content(hashed.filter("doc_id % 2 = 1"), hashed.filter("doc_id % 2 = 0"), ["source"])
    return out.select("doc_id", "source", "content_sha256")


@PLANS.add("""WITH r AS (SELECT l_suppkey AS log, CASE l_linenumber % 3 WHEN 0 THEN CAST(l_quantity AS INTEGER) % 7 END AS parameter, median(l_quantity) OVER
    (PARTITION BY l_suppkey) AS m, l_orderkey, l_linenumber, l_discount * 20 AS v, min(l_discount * 20) OVER (PARTITION BY l_suppkey) AS lo, max(l_discount * 20)
    OVER (PARTITION BY l_suppkey) AS hi FROM lineitem)
    SELECT log, CAST(coalesce(nullif(parameter, 0), round(m)) AS INTEGER) AS cells, count(*) AS n, round(sum(CASE WHEN lo >= -0.01 AND hi <= 1.01 THEN v ELSE
        (v - 0) / 2 END), 5) AS outputs FROM r GROUP BY log, 2""")
def cells_and_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Cells by parameter or by the logged count, and actuator outputs as shares of their range, over the lines of each supplier."""
    rows = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("log"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_quantity").cast("int")
        % 7).alias("parameter"), "l_quantity", (F.col("l_discount") * 20).alias("v"))
    own = rows.groupBy("log").agg(F.percentile("l_quantity", F.lit(0.5)).alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    rows = rows.join(own, "log").select("log", X.cell_count(F.col("parameter"), F.col("m")).alias("cells"), X.normalised_actuator(F.col("v"), F.col("lo"),
        F.col("hi"), F.lit(0.0), F.lit(2.0)).alias("share"))
    return rounded(rows.groupBy("log", "cells").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("share"), 5).alias("outputs")), 5)


@PLANS.add("""WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN
    (SELECT c_custkey FROM c)) SELECT 'customer' AS "table", count(*) AS deleted FROM c UNION ALL SELECT 'orders', count(*) FROM o UNION ALL
    SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)""")
def cascade_counts(spark: SparkSession, folder: str) -> DataFrame:
    doomed = table(spark, folder, "nation").filter("n_nationkey = 3").select("n_nationkey")
    chain = [("customer", table(spark, folder, "customer"), "c_nationkey", "c_custkey"), ("orders", table(spark, folder, "orders"),
        "o_custkey", "o_orderkey"), ("lineitem", table(spark, folder, "lineitem"), "l_orderkey", "l_orderkey")]
    return K.cascade(doomed, chain)[0]


@PLANS.add("""SELECT c_custkey, c_name, coalesce(s_acctbal, c_acctbal) AS c_acctbal, c_mktsegment FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def partial_update(spark: SparkSession, folder: str) -> DataFrame:
    changes = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"),
        F.lit(None).cast("string").alias("c_mktsegment"))
    return K.updated(table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), changes, "c_custkey")


@PLANS.add("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def delete_rows(spark: SparkSession, folder: str) -> DataFrame:
    doomed = table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return K.without(table(spark, folder, "orders"), doomed, "o_custkey")[0].select("o_orderkey", "o_custkey")


# --- paths

POINTS_SQL = "pts AS (SELECT vec_id AS path, CAST(i AS INTEGER) AS i, CAST(embedding[3 * i + 1] AS DOUBLE) * 10 AS x, CAST(embedding[3 * i + 2] AS DOUBLE) * 10 AS y, CAST(embedding[3 * i + 3] AS DOUBLE) * 10 AS z, label AS scene FROM embeddings, (SELECT unnest(range(0, 21)) AS i))"


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector as a path of 21 points; its label is the scene."""
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("path"), F.col("label").alias("scene"),
        F.col("embedding").cast("array<double>").alias("e"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"))
    at = lambda k: F.get("e", F.col("i") * 3 + k) * 10
    return rows.select("path", "scene", "i", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


@PLANS.add(f"""WITH {POINTS_SQL}, s AS (SELECT path, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2))
    AS d FROM pts WINDOW w AS (PARTITION BY path ORDER BY i)) SELECT path, round(sum(d), 5) AS metres, count(*) AS n FROM s GROUP BY path""")
def path_length(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(P.path_length(points(spark, folder)), 5)


@PLANS.add(f"""WITH {POINTS_SQL} SELECT a.path, a.i, EXISTS (SELECT 1 FROM pts o WHERE o.i = 20 AND o.scene = a.scene AND (a.x - o.x) * (a.x
    - o.x) + (a.y - o.y) * (a.y - o.y) + (a.z - o.z) * (a.z - o.z) <= 0.36) AS blocked FROM pts a WHERE a.i < 20""")
def blocked_points(spark: SparkSession, folder: str) -> DataFrame:
    """The last point of every path is an obstacle of its scene."""
    rows = points(spark, folder)
    return P.near_obstacles(rows.filter("i < 20"), rows.filter("i = 20"), 0.6).select("path", "i", "blocked")


@PLANS.add(f"""WITH {POINTS_SQL}, h AS (SELECT a.path, o.path AS obstacle, avg(CASE WHEN sqrt(pow(a.x - o.x, 2) + pow(a.y - o.y, 2) +
    pow(a.z - o.z, 2)) <= 2 THEN 1.0 ELSE 0.0 END) AS p FROM pts a JOIN pts o ON o.path = a.path + 1 OR o.path = a.path + 2 WHERE a.i = 0
    GROUP BY a.path, o.path)
    SELECT path, round(1 - CASE WHEN max(p) >= 1 THEN 0 ELSE exp(sum(CASE WHEN p < 1 THEN ln(1 - p) END)) END, 6) AS probability FROM h GROUP BY path""")
def collision_probability(spark: SparkSession, folder: str) -> DataFrame:
    """Each path's first point against the points of the next two, as sampled positions of two obstacles."""
    rows = points(spark, folder)
    first = rows.filter("i = 0").select("path", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("z").alias("z0"),
        F.explode(F.array(F.col("path") + 1, F.col("path") + 2)).alias("obstacle"))
    samples = first.join(rows.select(F.col("path").alias("obstacle"), "x", "y", "z"), "obstacle")
    d = P.distance([F.col(a) for a in "xyz"], [F.col(f"{a}0") for a in "xyz"])
    return rounded(P.collision_probability(samples.withColumn("d", d), 2.0, ["path"]))


def _requests(spark: SparkSession, folder: str, axes: str) -> tuple[DataFrame, DataFrame]:
    """Every path asks for a way from its first to its last point, past the others as obstacles."""
    rows = points(spark, folder).withColumnRenamed("path", "request")
    ends = [rows.filter(f"i = {i}").select("request", *[F.col(a).alias(f"{end}_{a}") for a in axes]) for i, end in ((0, "start"), (20, "goal"))]
    return ends[0].join(ends[1], "request"), rows.filter("i BETWEEN 1 AND 19").select("request", *axes)


@PLANS.add()
def grid_path_2d(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(P.plan(*_requests(spark, folder, "xy"), axes=("x", "y")), 4)


@PLANS.add()
def grid_path_3d(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(P.plan(*_requests(spark, folder, "xyz"), axes=("x", "y", "z")), 4)


@PLANS.add()
def risk_aware_path(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(P.plan(*_requests(spark, folder, "xy"), axes=("x", "y"), spread=0.3), 4)


@PLANS.add()
def smooth_trajectory(spark: SparkSession, folder: str) -> DataFrame:
    asked, obstacles = _requests(spark, folder, "xyz")
    ways = P.plan(asked, obstacles, axes=("x", "y", "z"))
    return rounded(P.smooth(ways, obstacles), 4)
