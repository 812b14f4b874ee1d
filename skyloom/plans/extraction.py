"""All features of flights over lineitem: a thousand order keys are a flight, each of their lines, in order, a fiftieth of a second.

The columns of a line give the values of all signals that are sampled then, so signals grow with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import extraction as E
from ..operators import features as X
from ..operators.scans import stored
from ..sources.tables import table
from .common import Plans, rounded

PLANS = Plans()

#: The signals of a flight: key, step and offset in microseconds, base, amplitude of the noise, growth a sample, and the
#: signal whose noise it shares, if that isn't its own.
SIGNALS = (
    ("vibe.x", 200_000, 0, 3.0, 4.0, 0.0, None),
    *((f"imu.clip{i}", 200_000, 0, 0.0, 0.0, 0.02 * (i + 1), None) for i in range(3)),
    ("fd.imbalance", 200_000, 0, 0.1, 0.3, 0.0, None),
    *((f"act.motor{i}", 200_000, 0, 0.5 + 0.003 * i, 0.5, 0.0, None) for i in range(4)),
    ("thrust.sp", 200_000, 0, 0.4, 0.2, 0.0, None),
    ("batt.current_raw", 200_000, 0, 10.0, 10.0, 0.0, None),
    ("batt.voltage_raw", 200_000, 0, 25.0, -0.6, -0.002, "batt.current_raw"),
    ("batt.discharged_mah", 200_000, 0, 0.0, 0.01, 0.5, None),
    ("batt.cell_delta", 200_000, 0, 0.0, 0.05, 0.0, None),
    ("gps.eph", 200_000, 0, 1.0, 2.0, 0.0, None),
    ("gps.nsats", 200_000, 0, 8.0, 6.0, 0.0, None),
    ("gps.sacc", 200_000, 0, 0.2, 0.4, 0.0, None),
    ("gps.noise", 200_000, 0, 60.0, 40.0, 0.0, None),
    ("gps.jamming", 200_000, 0, 20.0, 20.0, 0.0, None),
    *((f"est.{r}_tr", 200_000, 0, 0.1, 0.5, 0.0, None) for r in ("vel", "pos", "hgt", "mag")),
    *((f"rate_sp.{a}", 100_000, 0, -amp, 2 * amp, 0.0, None) for a, amp in (("roll", 1.0), ("pitch", 0.8), ("yaw", 0.25))),
    *((f"gyro.{a}", 100_000, 37_000, -1.0, 2.0, 0.0, f"rate_sp.{of}") for a, of in (("x", "roll"), ("y", "pitch"), ("z", "yaw"))),
    *((f"att.q{c}", 100_000, 21_000, 0.2, 0.6, 0.0, None) for c in "wxyz"),
    *((f"att_sp.q{c}", 100_000, 0, 0.3, 0.5, 0.0, None) for c in "wxyz"),
    *((f"accel.{a}", 20_000, 0, -1.0, 4.0, 0.0, None) for a in "xyz"),
    *((f"accel_fifo.{a}", 20_000, 0, -2.0, 6.0, 0.0, None) for a in "xyz"),
)
#: Order keys in a flight, and microseconds between its lines.
FLIGHT_ORDERS, TICK_US = 1_000, 20_000
#: Least lines between two samples of a signal that isn't sampled at every line.
THIN = 5
#: Motors as in the other plans: place and spin of each.
GEOMETRY = ((0, 0.2, 0.2, 0.05), (1, -0.2, -0.2, 0.05), (2, 0.2, -0.2, -0.05), (3, -0.2, 0.2, -0.05))
ABSENT = """(key LIKE 'accel_fifo.%' AND flight % 2 = 1) OR (key = 'gps.jamming' AND flight % 5 = 1) OR (key = 'thrust.sp' AND flight % 9 = 4)
    OR (key = 'batt.discharged_mah' AND flight % 11 = 6) OR (key = 'imu.clip2' AND flight % 12 = 7)"""


def _parameters() -> list[tuple]:
    place = {s[0]: i for i, s in enumerate(SIGNALS)}
    return [(key, step, offset, base, amp, growth, place[of or key]) for key, step, offset, base, amp, growth, of in SIGNALS]


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """(flight, tick, cents, part) of every line."""
    flight = F.expr(f"l_orderkey div {FLIGHT_ORDERS}")
    rows = table(spark, folder, "lineitem").select(flight.alias("flight"), "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.col("l_partkey").alias("part"))
    order = Window.partitionBy("flight").orderBy("l_orderkey", "l_linenumber", "part", "cents")
    return rows.select("flight", (F.row_number().over(order) - 1).cast("long").alias("tick"), "cents", "part")


def flights(spark: SparkSession, folder: str) -> DataFrame:
    f = F.col("flight")
    return table(spark, folder, "lineitem").select(F.expr(f"l_orderkey div {FLIGHT_ORDERS}").alias("flight")).distinct().select(
        f.alias("flight"),
        (f % 10 != 3).alias("qualified"),
        F.lit("airborne_too_short").alias("window_reason"),
        F.lit(5_000_000).cast("long").alias("start_us"),
        F.when(f % 10 == 3, 45_000_000).otherwise(75_000_000).cast("long").alias("end_us"),
        (f % 7 != 2).alias("steady_qualified"),
        F.lit(None).cast("string").alias("steady_reason"),
        F.when(f % 8 != 5, 6).alias("cells"),
        F.lit(4).alias("motor_count"),
        F.element_at(F.array(F.lit(30.0), F.lit(15.0), F.lit(0.0)), (f % 3 + 1).cast("int")).alias("accel_cutoff"),
    )


def signals(spark: SparkSession, folder: str) -> DataFrame:
    """All signals. The fifth of the lines that slow signals are sampled at is stored, so that each use needn't sort all lines again."""
    every = lines(spark, folder)
    thin = stored(every.filter(F.col("tick") % THIN == 0))
    # Another number of partitions than the lines have: Spark 4.1 zips a union's sides of equal partitionings, but then cuts one of them anew.
    thin = thin.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")) + 1, "flight")
    fast = [p for p in _parameters() if p[1] < THIN * TICK_US]
    slow = [p for p in _parameters() if p[1] >= THIN * TICK_US]
    return _sampled(every, fast).unionByName(_sampled(thin, slow))


def _sampled(rows: DataFrame, parameters: list[tuple]) -> DataFrame:
    """The signals of parameters at the lines they are sampled at. Parameters are literals, so a filter on key leaves only what it asks for."""
    values = ", ".join(f"('{k}', {step}L, {off}L, {base!r}D, {amp!r}D, {growth!r}D, {noise})" for k, step, off, base, amp, growth, noise in parameters)
    known = rows.sparkSession.sql(f"SELECT * FROM VALUES {values} AS p(key, step, offset, base, amp, growth, noise)")
    every = F.expr(f"step div {TICK_US}")
    rows = rows.crossJoin(F.broadcast(known)).filter(F.col("tick") % every == 0)
    rows = rows.filter(f"NOT ({ABSENT})").withColumn("i", F.floor(F.col("tick") / every))
    noise = (F.col("cents") * 7 + F.col("part") * 13 + F.col("noise") * 17 * (F.col("cents") % 10 + 1)) % 101 / F.lit(101.0)
    growth = F.when((F.col("key") == "imu.clip1") & (F.col("flight") % 6 == 4), -F.col("growth")).otherwise(F.col("growth"))
    more = F.when(F.col("key").startswith("act.motor") & ((F.substring("key", 10, 1).cast("int") + F.col("flight")) % 3 == 0), 0.1).otherwise(0.0)
    value = F.col("base") + F.col("amp") * noise + growth * F.col("i") + more
    value = F.when((F.col("key") == "batt.cell_delta") & (F.col("flight") % 4 == 0), 0.0).otherwise(value)
    return rows.select("flight", "key", (F.col("offset") + F.col("tick") * TICK_US).alias("us"), value.alias("value"))


def steady(own: DataFrame) -> DataFrame:
    spans = F.array(*[F.struct(F.lit(n).alias("segment"), F.lit(a).cast("long").alias("start_us"), F.lit(b).cast("long").alias("end_us"))
        for n, a, b in ((1, 10_000_000, 30_000_000), (2, 40_000_000, 60_000_000))])
    return own.select("flight", F.explode(spans).alias("s")).select("flight", "s.*")


def geometry(own: DataFrame) -> DataFrame:
    shape = F.array(*[F.struct(F.lit(m).alias("motor"), F.lit(x).alias("px"), F.lit(y).alias("py"), F.lit(k).alias("km")) for m, x, y, k in GEOMETRY])
    return own.select("flight", F.explode(shape).alias("g")).select("flight", "g.*")


_SIGNAL_ROWS = ", ".join(f"('{k}', {step}, {off}, {base!r}::DOUBLE, {amp!r}::DOUBLE, {growth!r}::DOUBLE, {noise})" for k, step, off, base,
    amp, growth, noise in _parameters())
SIGNALS_SQL = f"""p(key, step, off, base, amp, growth, noise) AS (VALUES {_SIGNAL_ROWS}),
    ln AS (SELECT l_orderkey // 1000 AS flight, row_number() OVER (PARTITION BY l_orderkey // 1000 ORDER BY l_orderkey, l_linenumber, l_partkey,
        round(l_extendedprice * 100)) - 1 AS tick, round(l_extendedprice * 100)::BIGINT AS cents, l_partkey AS part FROM lineitem),
    fl AS (SELECT flight, flight % 10 <> 3 AS q, CASE WHEN flight % 10 = 3 THEN 45000000 ELSE 75000000 END AS t1, flight % 7 <> 2 AS st, flight % 8 <> 5 AS known,
        CASE flight % 3 WHEN 0 THEN 30.0 WHEN 1 THEN 15.0 END AS cut FROM (SELECT DISTINCT flight FROM ln)),
    every AS (SELECT flight, key, off + tick * 20000 AS us, CASE WHEN key = 'batt.cell_delta' AND flight % 4 = 0 THEN 0 ELSE
        base + amp * (((cents * 7 + part * 13 + noise * 17 * (cents % 10 + 1)) % 101)::DOUBLE / 101) + CASE WHEN key = 'imu.clip1' AND flight % 6 =
            4 THEN -growth ELSE growth END * (tick // (step // 20000))
        + CASE WHEN key LIKE 'act.motor%' AND (TRY_CAST(substr(key, 10, 1) AS INTEGER) + flight) % 3 = 0 THEN 0.1 ELSE 0 END END AS value
        FROM ln, p WHERE tick % (step // 20000) = 0 AND NOT ({ABSENT})),
    sig AS (SELECT every.*, q, t1, st, known, cut, us BETWEEN 5000000 AND t1 AS air, st AND (us BETWEEN 10000000 AND 30000000 OR us BETWEEN
        40000000 AND 60000000) AS calm FROM every JOIN fl USING (flight) WHERE q)"""

MOTORS_PART = """mm AS (SELECT flight, CAST(substr(key, 10, 1) AS INTEGER) AS motor, avg(value) AS mean FROM sig WHERE key LIKE 'act.motor%'
    AND calm GROUP BY ALL),
    md AS (SELECT flight, motor, mean, mean - avg(mean) OVER w AS d, avg(mean) OVER w AS c, px::DOUBLE AS px, py::DOUBLE AS py, sign(km)::DOUBLE AS s FROM mm
        JOIN (VALUES (0, 0.2, 0.2, 0.05), (1, -0.2, -0.2, 0.05), (2, 0.2, -0.2, -0.05), (3, -0.2, 0.2, -0.05)) g(motor, px, py, km) USING
            (motor) WINDOW w AS (PARTITION BY flight)),
    mt AS (SELECT flight, max(c) AS mean, (max(mean) - min(mean)) / max(c) AS spread, arg_max(motor, (mean, -motor)) + 1 AS highest, sum(d *
        d) AS vv, sum(px * d) / sum(px * px) AS bx, sum(py * d) / sum(py * py) AS by_,
        (pow(sum(px * d), 2) / sum(px * px) + pow(sum(py * d), 2) / sum(py * py)) / sum(d * d) AS side, pow(sum(s * d), 2) / sum(s * s) /
            sum(d * d) AS spin, list_sort(list(d), 'DESC') AS o, arg_max(motor, (d, -motor)) AS top, sum(CASE WHEN d > 0 THEN s END) AS hs
            FROM md GROUP BY flight),
    mp AS (SELECT *, CASE WHEN spread < 0.02 THEN 'balanced' WHEN o[1] * o[1] / vv >= 0.5 AND o[1] >= 2 * greatest(o[2], 0) THEN
        'single_motor_high' WHEN greatest(side, spin) >= 0.6 AND side >= spin THEN 'one_side_high' WHEN greatest(side, spin) >= 0.6 THEN
        'same_spin_set_high' ELSE 'mixed' END AS pattern FROM mt),
    mo AS (SELECT *, CASE pattern WHEN 'single_motor_high' THEN CAST(top + 1 AS VARCHAR) WHEN 'one_side_high' THEN CASE WHEN abs(bx) >=
        abs(by_) THEN CASE WHEN bx > 0 THEN 'front' ELSE 'rear' END ELSE CASE WHEN by_ > 0 THEN 'right' ELSE 'left' END END
        WHEN 'same_spin_set_high' THEN CASE WHEN hs > 0 THEN '+' ELSE '-' END END AS where_ FROM mp)"""

FEATURES_SQL = f"""WITH {SIGNALS_SQL}, {MOTORS_PART},
    pc AS (SELECT flight, key, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM
        sig WHERE air GROUP BY ALL),
    cl AS (SELECT flight, key, max(t1) AS t1, arg_max(value, us) FILTER (WHERE us <= 5000000) AS a, arg_max(value, us) FILTER (WHERE us <=
        t1) AS b FROM sig WHERE key LIKE 'imu.clip%' GROUP BY ALL),
    cs AS (SELECT flight, max(t1) AS t1, min(b - a) AS least, sum(b - a) AS total FROM cl GROUP BY flight HAVING count(*) = 3),
    ac AS (SELECT flight, us, sqrt(sum(value * value)) AS x, max(cut) AS cut FROM sig WHERE calm AND CASE WHEN flight % 2 = 0 THEN key LIKE
        'accel_fifo.%' ELSE key LIKE 'accel.%' END GROUP BY flight, us),
    an AS (SELECT *, us > 35000000 AS seg, row_number() OVER (PARTITION BY flight, us > 35000000 ORDER BY us) - 1 AS i FROM ac),
    aw AS (SELECT flight, seg, part, i - part * 32 AS j, x - avg(x) OVER (PARTITION BY flight, seg, part) AS x FROM an, LATERAL (SELECT
        unnest([i // 32, i // 32 - 1]) AS part) WHERE part >= 0 AND part <= (1001 - 64) // 32 AND i < part * 32 + 64),
    ft AS (SELECT flight, seg, part, b, sum(x * (0.5 - 0.5 * cos(2 * pi() * j / 64)) * cos(2 * pi() * b * j / 64)) AS re, sum(x * (0.5 - 0.5
        * cos(2 * pi() * j / 64)) * sin(2 * pi() * b * j / 64)) AS im FROM aw, (SELECT unnest(range(0, 33)) AS b) GROUP BY ALL),
    ps AS (SELECT flight, b * 50.0 / 64 AS hz, avg((re * re + im * im) / (50 * 24.0) * CASE WHEN b BETWEEN 1 AND 31 THEN 2 ELSE 1 END) AS pw
        FROM ft GROUP BY flight, b),
    bd(f, lo, hi) AS (VALUES ('vib.band_lo', 0, 5), ('vib.band_struct', 5, 20), ('vib.band_hi', 20, 25)),
    bw AS (SELECT flight, f, (hz - lag(hz) OVER w) * (pw + lag(pw) OVER w) / 2 AS area FROM ps JOIN bd ON hz > lo AND hz < hi WINDOW w AS
        (PARTITION BY flight, f ORDER BY hz)),
    bp AS (SELECT flight, f, sum(area) AS power FROM bw GROUP BY ALL),
    br AS (SELECT fl.flight, bd.f, power, CASE WHEN flight % 2 = 0 THEN NULL ELSE cut END AS c, hi, CASE WHEN NOT st THEN
        'insufficient_steady_flight' WHEN flight % 2 = 1 AND bd.f = 'vib.band_hi' THEN 'requires_fifo_accel' WHEN flight % 2 = 1 AND lo >=
        cut THEN 'band_above_filter_cutoff' END AS reason FROM fl CROSS JOIN bd LEFT JOIN bp USING (flight, f) WHERE q),
    sm AS (SELECT flight, key, bool_and(st) AS st, quantile_cont(CASE WHEN calm THEN value END, 0.5) AS m FROM sig WHERE key IN
        ('fd.imbalance', 'thrust.sp') GROUP BY ALL),
    sa AS (SELECT flight, avg(a) AS s FROM (SELECT flight, us, CAST(bool_or(value >= 0.98) AS INTEGER) AS a FROM sig WHERE air AND key LIKE
        'act.motor%' GROUP BY ALL) GROUP BY flight),
    bt AS (SELECT flight, us, bool_or(known) AS known, bool_or(air) AS air, max(CASE WHEN key = 'batt.voltage_raw' THEN value END) AS v,
        max(CASE WHEN key = 'batt.current_raw' THEN value END) AS i, max(CASE WHEN key = 'batt.discharged_mah' THEN value END) AS c FROM sig
        WHERE key IN ('batt.voltage_raw', 'batt.current_raw', 'batt.discharged_mah') GROUP BY ALL),
    bs AS (SELECT flight, bool_or(known) AS known, avg(i) AS mi, quantile_cont(i, 0.95) - quantile_cont(i, 0.05) AS r, covar_pop(c, c) AS
        cc, covar_pop(i, i) AS ii, covar_pop(c, i) AS ci, covar_pop(c, v) AS cv, covar_pop(i, v) AS iv FROM bt WHERE air AND c IS NOT NULL GROUP BY flight),
    pr AS (SELECT flight, known, -(iv * cc - cv * ci) / (cc * ii - ci * ci) AS res, r < 0.3 * mi AS narrow FROM bs),
    vo AS (SELECT flight, bool_or(known) AS known, bool_or(st) AS st, min(CASE WHEN air THEN value END) AS low, quantile_cont(CASE WHEN us
        >= 0 AND us < 5000000 THEN value END, 0.5) AS rest, quantile_cont(CASE WHEN us BETWEEN 10000000 AND 30000000 OR us BETWEEN 40000000
        AND 50000000 THEN value END, 0.5) AS hover FROM sig WHERE key = 'batt.voltage_raw' GROUP BY flight),
    cd AS (SELECT flight, quantile_cont(value, 0.95) AS p, bool_or(value <> 0) AS any_ FROM sig WHERE key = 'batt.cell_delta' GROUP BY flight),
    gy AS (SELECT flight, CASE key WHEN 'gyro.x' THEN 'roll' WHEN 'gyro.y' THEN 'pitch' ELSE 'yaw' END AS axis, us, value, lead(us) OVER w
        AS us2, lead(value) OVER w AS v2 FROM sig WHERE key LIKE 'gyro.%' WINDOW w AS (PARTITION BY flight, key ORDER BY us)),
    sp AS (SELECT flight, substr(key, 9) AS axis, us, value AS sp, row_number() OVER (PARTITION BY flight, key ORDER BY us) - 1 AS i,
        count(*) OVER (PARTITION BY flight, key) AS n FROM sig WHERE key LIKE 'rate_sp.%' AND air),
    ip AS (SELECT sp.*, gy.value + (sp.us - gy.us) / (us2 - gy.us) * (v2 - gy.value) AS g FROM sp ASOF JOIN gy ON sp.flight = gy.flight AND
        sp.axis = gy.axis AND sp.us >= gy.us),
    lg AS (SELECT a.flight, a.axis, k, sqrt(avg(pow(b.g - a.sp, 2))) AS e, sqrt(avg(a.sp * a.sp)) AS rms, count(*) AS active FROM ip a,
        (SELECT unnest([0, 1, 2]) AS k) JOIN ip b ON a.flight = b.flight AND a.axis = b.axis AND (b.i + k) % a.n = a.i WHERE abs(a.sp) > 0.3 GROUP BY ALL),
    lb AS (SELECT flight, axis, max(active) AS active, max(CASE WHEN k = 0 THEN e / rms END) AS ratio, arg_min(k, (round(e, 12), k)) AS k,
        min(round(e, 12)) / max(rms) AS best FROM lg GROUP BY ALL),
    qa AS (SELECT flight, substr(key, 5) AS c, us, value, lead(us) OVER w AS us2, lead(value) OVER w AS v2 FROM sig WHERE key LIKE 'att.q%'
        WINDOW w AS (PARTITION BY flight, key ORDER BY us)),
    ad AS (SELECT flight, substr(key, 8) AS c, us, value AS d FROM sig WHERE key LIKE 'att_sp.q%' AND air),
    aq AS (SELECT ad.flight, ad.us, d, qa.value + (ad.us - qa.us) / (us2 - qa.us) * (v2 - qa.value) AS q FROM ad ASOF JOIN qa ON ad.flight =
        qa.flight AND ad.c = qa.c AND ad.us >= qa.us),
    ag AS (SELECT flight, us, degrees(2 * acos(least(1.0, abs(sum(q * d) / sqrt(sum(q * q)) / sqrt(sum(d * d)))))) AS angle FROM aq GROUP BY ALL),
    vals(flight, feature_key, value, label, detail, reason) AS (
        SELECT flight, f, CASE p WHEN 10 THEN p10 WHEN 50 THEN p50 ELSE p95 END, NULL, NULL, NULL FROM pc JOIN (VALUES ('vib.metric_p50',
            'vibe.x', 50), ('vib.metric_p95', 'vibe.x', 95), ('gps.eph_p50', 'gps.eph', 50), ('gps.nsats_p10', 'gps.nsats', 10),
            ('gps.sacc_p50', 'gps.sacc', 50), ('gps.noise', 'gps.noise', 50), ('gps.jamming', 'gps.jamming', 50)) w(f, key, p) USING (key)
        UNION ALL SELECT flight, 'est.test_ratio_p95', max(p95), NULL, arg_max(key, (p95, key)), NULL FROM pc WHERE key LIKE 'est.%' GROUP BY flight
        UNION ALL SELECT flight, 'vib.clip_rate', CASE WHEN least >= 0 THEN total / ((t1 - 5000000) / 6e7) END, NULL, NULL, CASE WHEN least
            < 0 THEN 'counter_reset' END FROM cs
        UNION ALL SELECT flight, f, CASE WHEN reason IS NULL THEN 10 * log10(power) END, NULL, CASE WHEN reason IS NULL AND hi > c THEN
            'band_partially_filtered' END, reason FROM br
        UNION ALL SELECT flight, CASE key WHEN 'thrust.sp' THEN 'act.hover' ELSE 'vib.imbalance' END, CASE WHEN st THEN m END, NULL, NULL,
            CASE WHEN NOT st THEN 'insufficient_steady_flight' END FROM sm
        UNION ALL SELECT flight, 'act.sat_frac', s, NULL, NULL, NULL FROM sa
        UNION ALL SELECT flight, unnest(['act.mean', 'act.spread', 'act.pattern']), NULL, NULL, NULL, 'insufficient_steady_flight' FROM fl WHERE q AND NOT st
        UNION ALL SELECT flight, 'act.mean', mean, NULL, NULL, NULL FROM mo
        UNION ALL SELECT flight, 'act.spread', spread, NULL, CAST(highest AS VARCHAR), NULL FROM mo
        UNION ALL SELECT flight, 'act.pattern', NULL, pattern, where_, NULL FROM mo
        UNION ALL SELECT flight, unnest(['pwr.r_cell', 'pwr.v_cell_min', 'pwr.sag_hover']), NULL, NULL, NULL, 'cell_count_unknown' FROM fl WHERE q AND NOT known
        UNION ALL SELECT flight, 'pwr.r_cell', CASE WHEN NOT narrow AND res > 0 THEN res * 1000 / 6 END, NULL, NULL, CASE WHEN narrow THEN
            'insufficient_current_range' WHEN res <= 0 THEN 'non_physical_fit' END FROM pr WHERE known
        UNION ALL SELECT flight, 'pwr.v_cell_min', low / 6, NULL, NULL, NULL FROM vo WHERE known
        UNION ALL SELECT flight, 'pwr.sag_hover', CASE WHEN st THEN (rest - hover) / 6 END, NULL, NULL, CASE WHEN NOT st THEN
            'insufficient_steady_flight' END FROM vo WHERE known
        UNION ALL SELECT flight, 'pwr.cell_delta', CASE WHEN any_ THEN p END, NULL, NULL, CASE WHEN NOT any_ THEN 'no_per_cell_sensing' END FROM cd
        UNION ALL SELECT flight, 'trk.rate_rms.' || axis, ratio, NULL, printf('lag %.1f ms, ratio %.3f', k * 100.0, best), NULL FROM lb WHERE active >= 100
        UNION ALL SELECT DISTINCT flight, 'trk.rate_rms.' || axis, NULL, NULL, NULL, 'insufficient_manoeuvring' FROM sp WHERE NOT EXISTS
            (SELECT 1 FROM lb WHERE lb.flight = sp.flight AND lb.axis = sp.axis AND active >= 100)
        UNION ALL SELECT flight, 'trk.att_err_p95', quantile_cont(angle, 0.95), NULL, NULL, NULL FROM ag GROUP BY flight)"""

CATALOGUE_SQL = """c(feature_key, subsystem, tier) AS (VALUES ('vib.metric_p50', 'vibration', 'R1'), ('vib.metric_p95', 'vibration', 'R1'),
    ('vib.clip_rate', 'vibration', 'R1'), ('vib.band_lo', 'vibration', 'R2'), ('vib.band_struct', 'vibration', 'R2'), ('vib.band_hi',
    'vibration', 'R3'), ('vib.imbalance', 'vibration', 'R2'),
        ('act.sat_frac', 'motors', 'R1'), ('act.mean', 'motors', 'R1'), ('act.spread', 'motors', 'R1'), ('act.pattern', 'motors', 'R1'),
            ('act.hover', 'motors', 'R1'),
        ('pwr.r_cell', 'power', 'R2'), ('pwr.v_cell_min', 'power', 'R1'), ('pwr.sag_hover', 'power', 'R2'), ('pwr.cell_delta', 'power', 'R3'),
        ('trk.rate_rms.roll', 'attitude', 'R2'), ('trk.rate_rms.pitch', 'attitude', 'R2'), ('trk.rate_rms.yaw', 'attitude', 'R2'),
            ('trk.att_err_p95', 'attitude', 'R1'),
        ('gps.eph_p50', 'position', 'R1'), ('gps.nsats_p10', 'position', 'R1'), ('gps.sacc_p50', 'position', 'R1'), ('gps.noise',
            'position', 'R2'), ('gps.jamming', 'position', 'R2'), ('est.test_ratio_p95', 'position', 'R1'))"""


@PLANS.add(f"""{FEATURES_SQL}, {CATALOGUE_SQL}
    SELECT fl.flight::INTEGER AS flight, c.feature_key, subsystem, tier, round(value, 5) AS value, label, detail, CASE WHEN NOT q THEN
        'airborne_too_short' WHEN value IS NULL AND label IS NULL THEN coalesce(reason, 'signal_absent') END AS reason
    FROM fl CROSS JOIN c LEFT JOIN vals ON vals.flight = fl.flight AND vals.feature_key = c.feature_key""")
def feature_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """The 26 features of every flight from its signals: value, label or reason."""
    own = stored(flights(spark, folder))
    values = E.extracted(signals(spark, folder), own, steady(own), geometry(own))
    found = X.all_features(own, values, extra=("label", "detail"))
    return rounded(found.withColumn("flight", F.col("flight").cast("int")), 5)


@PLANS.add(f"""WITH {SIGNALS_SQL}, {MOTORS_PART} SELECT flight::INTEGER AS flight, round(spread, 6) AS spread, CAST(highest AS INTEGER) AS
    highest_motor, round(mean, 6) AS mean, pattern, where_ AS pattern_detail FROM mo""")
def spread_details(spark: SparkSession, folder: str) -> DataFrame:
    """What the finding of a spread between motors names besides its size."""
    own = stored(flights(spark, folder).filter("qualified"))
    motors = signals(spark, folder).filter("key LIKE 'act.%'")
    found = E.motor_features(motors, E.counts(motors, rated=()), own, steady(own), geometry(own))
    return rounded(E.spread_details(found).withColumn("flight", F.col("flight").cast("int")))
