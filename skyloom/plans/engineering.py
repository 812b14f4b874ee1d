"""Engineering models over parts as vehicle specifications and suppliers as places to fly."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import engineering as N
from ..functions.draws import uniform_sql
from ..operators import uncertainty as U
from ..operators.scans import spread
from ..sources.tables import table
from .common import Plans, rounded

PLANS = Plans()

SPECS_SQL = """specs AS (SELECT p_partkey AS spec, 0.5 + p_size * 0.05 AS mass, 4.0 + 2 * (p_partkey % 3) AS motors, 5.0 + p_size % 12 AS
    inches, 400 + p_retailprice / 2 AS kv, 3.0 + p_partkey % 4 AS cells, 2000.0 + p_size * 100 AS mah FROM part)"""
PLACES_SQL = """places AS (SELECT s_suppkey AS place, greatest(s_acctbal, 0) / 3 AS altitude, s_nationkey * 3.0 - 30 AS temperature FROM supplier)"""
DENSITY = "(101325 * pow(1 - 0.0065 * ({a}) / 288.15, 9.80665 * 0.0289644 / (8.3144598 * 0.0065)) / (8.3144598 / 0.0289644 * (({t}) + 273.15)))"
RPM = "(sqrt(({t}) / (0.105 * ({rho}) * pow({d}, 4))) * 60)"
POWER = "(pow(mass * 9.81 / motors, 1.5) / sqrt(2 * {rho} * pi() * pow(inches * 0.0254 / 2, 2)) / 0.8 * motors)"


def specs(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("spec"),
        (0.5 + size * 0.05).alias("mass"),
        (4.0 + 2 * (F.col("p_partkey") % 3)).alias("motors"),
        (5.0 + size % 12).alias("inches"),
        (400 + F.col("p_retailprice") / 2).alias("kv"),
        (3.0 + F.col("p_partkey") % 4).alias("cells"),
        (2000.0 + size * 100).alias("mah"),
    )


def places(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(F.col("s_suppkey").alias("place"), (F.greatest("s_acctbal", F.lit(0.0))
        / 3).alias("altitude"), (F.col("s_nationkey") * 3.0 - 30).alias("temperature"))


def _hover(density) -> dict:
    return N.hover(F.col("mass"), F.col("motors"), F.col("inches"), F.col("kv"), F.col("cells"), F.col("mah"), density)


def _thrust():
    return N.thrust_per_motor(F.col("mass"), F.col("motors"))


_CAP = "CASE WHEN temperature <= -20 THEN 0.5 WHEN temperature <= -10 THEN 0.5 + (temperature + 20) / 10 * 0.2 WHEN temperature <= 0 THEN 0.7 + (temperature + 10) / 10 * 0.05 WHEN temperature <= 15 THEN 0.75 + temperature / 15 * 0.25 ELSE 1.0 END"


@PLANS.add(f"""WITH {PLACES_SQL}, d AS (SELECT *, {DENSITY.format(a="altitude", t="temperature")} AS rho, {_CAP} AS cap FROM places)
    SELECT place, round(rho, 9) AS density, round(sqrt({N.SEA_LEVEL_DENSITY!r} / rho), 9) AS power_scale, round(cap, 9) AS capacity,
        round(1.5 * sqrt({N.SEA_LEVEL_DENSITY!r} / rho) / cap, 6) AS projected_drain FROM d""")
def flight_conditions(spark: SparkSession, folder: str) -> DataFrame:
    rows = places(spark, folder).select("place", N.air_density(F.col("altitude"), F.col("temperature")).alias("density"),
        N.battery_capacity(F.col("temperature")).alias("capacity"))
    rows = rows.withColumn("power_scale", N.hover_power_scale(F.col("density")))
    return rows.select("place", F.round("density", 9).alias("density"), F.round("power_scale", 9).alias("power_scale"), F.round("capacity",
        9).alias("capacity"), F.round(N.projected_drain(F.lit(1.5), F.col("power_scale"), F.col("capacity")), 6).alias("projected_drain"))


_P = POWER.format(rho="1.225")
_NEED = RPM.format(t="mass * 9.81 / motors", rho="1.225", d="inches * 0.0254")


@PLANS.add(f"""WITH {SPECS_SQL}, h AS (SELECT *, {_NEED} AS need, kv * cells * 3.7 AS have, {_P} AS power FROM specs)
    SELECT spec, round(need, 4) AS required_rpm, round(have, 4) AS available_rpm, need <= have AS feasible, round((have - need) / have *
        100, 5) AS margin_percent, round(power, 5) AS power_w, round(power / (cells * 3.7), 6) AS current_a, round(power / mass, 5) AS
        w_per_kg, round(mah / 1000 * cells * 3.7 / power * 60, 5) AS minutes FROM h""")
def motor_performance(spark: SparkSession, folder: str) -> DataFrame:
    digits = {"required_rpm": 4, "available_rpm": 4, "current_a": 6}
    return specs(spark, folder).select("spec", *((F.round(c, digits.get(n, 5)) if n != "feasible" else c).alias(n) for n,
        c in _hover(F.lit(N.STANDARD_DENSITY)).items()))


@PLANS.add(f"""WITH RECURSIVE {SPECS_SQL}, r AS (SELECT spec, mass * 9.81 / motors AS t, inches * 0.0254 AS d, kv * cells * 3.7 AS have FROM specs),
    b AS (SELECT spec, t, d, have, 0 AS i, 0.0::DOUBLE AS lo, 9000.0::DOUBLE AS hi FROM r UNION ALL
        SELECT spec, t, d, have, i + 1, CASE WHEN
            {RPM.format(t="t", rho=DENSITY.format(a="(lo + hi) / 2", t="15 - 0.0065 * (lo + hi) / 2"), d="d")} <= have THEN (lo + hi) / 2
            ELSE lo END, CASE WHEN {RPM.format(t="t", rho=DENSITY.format(a="(lo + hi) / 2", t="15 - 0.0065 * (lo + hi) / 2"), d="d")} <=
            have THEN hi ELSE (lo + hi) / 2 END FROM b WHERE i < 40),
    c AS (SELECT spec, lo, {RPM.format(t="t", rho=DENSITY.format(a="0.0", t="15"), d="d")} <= have AS low,
        {RPM.format(t="t", rho=DENSITY.format(a="9000.0", t="15 - 0.0065 * 9000"), d="d")} <= have AS high FROM b WHERE i = 40)
    SELECT spec, round(CASE WHEN NOT low THEN 0.0 WHEN high THEN 9000.0 ELSE lo END, 4) AS max_altitude_m, high AS capped FROM c""")
def max_altitude(spark: SparkSession, folder: str) -> DataFrame:
    altitude, capped = N.max_altitude(_thrust(), F.col("inches") * N.INCH, N.available_rpm(F.col("kv"), F.col("cells")))
    return specs(spark, folder).select("spec", F.round(altitude, 4).alias("max_altitude_m"), capped.alias("capped"))


@PLANS.add(f"""WITH {SPECS_SQL}, s AS (SELECT spec, mass, motors, mah, cells, kv, inches, greatest(0.01, mass - 0.8) AS mass2, greatest(0.1,
    inches - 2) AS inches2 FROM specs)
    SELECT spec, round({_P}, 4) AS power_now, round({_P.replace("mass", "mass2").replace("inches", "inches2")}, 4) AS power_swept,
        round(({_P.replace("mass", "mass2").replace("inches", "inches2")} - {_P}) / {_P} * 100, 4) AS change_percent FROM s""")
def parameter_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Every specification against one that is 0.8 kg lighter with propellers 2 inches smaller, clamped."""
    rows = specs(spark, folder)
    now = _hover(F.lit(N.STANDARD_DENSITY))["power_w"]
    swept = N.hover(F.greatest(F.lit(0.01), F.col("mass") - 0.8), F.col("motors"), F.greatest(F.lit(0.1), F.col("inches") - 2), F.col("kv"),
        F.col("cells"), F.col("mah"), F.lit(N.STANDARD_DENSITY))["power_w"]
    return rounded(rows.select("spec", now.alias("power_now"), swept.alias("power_swept"), ((swept - now) / now * 100).alias("change_percent")), 4)


@PLANS.add(f"""WITH {SPECS_SQL}, g AS (SELECT spec, mass, motors, cells, CAST(i AS INTEGER) AS row, CAST(j AS INTEGER) AS col, greatest(2.0,
    inches - 4) + (inches + 4 - greatest(2.0, inches - 4)) / 4 * i AS inches, greatest(50.0, kv - 400) + (kv + 400 - greatest(50.0, kv -
    400)) / 4 * j AS kv FROM specs, (SELECT unnest(range(0, 5)) AS i), (SELECT unnest(range(0, 5)) AS j))
    SELECT spec, row, col, round({_P} / mass, 4) AS w_per_kg, {_NEED} <= kv * cells * 3.7 AS feasible FROM g""")
def efficiency_landscape(spark: SparkSession, folder: str) -> DataFrame:
    """A grid of diameter by KV around every specification."""
    cells = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(4)),
        lambda j: F.struct(i.alias("row"), j.alias("col"))))))
    rows = specs(spark, folder).withColumn("cell", cells)
    span = lambda value, low, wide, k: F.greatest(F.lit(low), value - wide) + (value + wide - F.greatest(F.lit(low), value - wide)) / 4 * k
    rows = rows.withColumns({"inches": span(F.col("inches"), 2.0, 4, F.col("cell.row")), "kv": span(F.col("kv"), 50.0, 400, F.col("cell.col"))})
    hover = _hover(F.lit(N.STANDARD_DENSITY))
    return rows.select("spec", "cell.row", "cell.col", F.round(hover["w_per_kg"], 4).alias("w_per_kg"), hover["feasible"].alias("feasible"))


@PLANS.add(f"""WITH {SPECS_SQL}, f AS (SELECT s.spec, mass, cells, mah, inches, kv, frame, m AS motors, v, rotor FROM specs s, (VALUES
    ('quad', 4.0, 8.0, true), ('hex', 6.0, 8.0, true), ('octo', 8.0, 8.0, true), ('fixed_wing', 1.0, 15.0, false)) t(frame, m, v, rotor)),
    x AS (SELECT *, 0.105 * 1.225 * pow(kv * cells * 3.7 / 60, 2) * pow(inches * 0.0254, 4) * motors / (mass * 9.81) AS twr, sqrt(2 * mass *
        9.81 / (1.225 * 0.5 * 0.5)) AS cruise FROM f),
    y AS (SELECT *, CASE WHEN rotor THEN least(60.0, CASE WHEN twr >= 1 THEN degrees(acos(least(1.0, 1 / twr))) ELSE 0.0 END) ELSE 25.0 END
        AS tilt, CASE WHEN rotor THEN v ELSE cruise END AS vel FROM x)
    SELECT spec, frame, round(twr, 6) AS thrust_to_weight, round(tilt, 6) AS tilt_deg, round(degrees(9.81 * tan(radians(tilt)) / vel), 6) AS
        turn_rate_deg_s, round(CASE WHEN rotor THEN mah / 1000 * cells * 3.7 / {_P} * 60 ELSE 0.7 * mah / 1000 * cells * 3.7 / (mass * 9.81
        / 10 * cruise) * 60 END, 5) AS minutes,
        round(CASE WHEN twr > 1 THEN sqrt(pow(twr * mass * 9.81, 2) - pow(mass * 9.81, 2)) / mass ELSE 2.5 END, 5) AS acceleration FROM y""")
def frame_comparison(spark: SparkSession, folder: str) -> DataFrame:
    frames = F.explode(F.array(*[F.struct(F.lit(n).alias("frame"), F.lit(float(m)).alias("motors"), F.lit(v).alias("v"),
        F.lit(r).alias("rotor")) for n, m, v, r in N.FRAMES]))
    rows = specs(spark, folder).drop("motors").withColumn("f", frames).select("spec", "mass", "inches", "kv", "cells", "mah", "f.*")
    thrust = N.max_thrust(F.col("motors"), F.col("inches"), F.col("kv"), F.col("cells"), F.lit(N.STANDARD_DENSITY))
    ratio = thrust / (F.col("mass") * N.G)
    wing = N.wing_cruise(F.col("mass"), F.col("cells"), F.col("mah"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(N.STANDARD_DENSITY))
    tilt = F.when(F.col("rotor"), N.tilt_limit(ratio)).otherwise(N.BANK_DEG)
    velocity = F.when(F.col("rotor"), F.col("v")).otherwise(wing["velocity"])
    return rows.select(
        "spec",
        "frame",
        F.round(ratio, 6).alias("thrust_to_weight"),
        F.round(tilt, 6).alias("tilt_deg"),
        F.round(N.turn_rate(tilt, velocity), 6).alias("turn_rate_deg_s"),
        F.round(F.when(F.col("rotor"), _hover(F.lit(N.STANDARD_DENSITY))["minutes"]).otherwise(wing["minutes"]), 5).alias("minutes"),
        F.round(N.acceleration_limit(F.col("mass"), thrust), 5).alias("acceleration"),
    )


@PLANS.add(f"""WITH {SPECS_SQL} SELECT spec, CASE WHEN spec % 5 = 4 THEN NULL ELSE {_NEED} <= kv * cells * 3.7 END AS feasible, CASE WHEN
    spec % 5 = 4 THEN 'fixed_wing_does_not_hover' END AS reason FROM specs""")
def build_feasibility(spark: SparkSession, folder: str) -> DataFrame:
    wing = F.col("spec") % 5 == 4
    return specs(spark, folder).select("spec", F.when(~wing, _hover(F.lit(N.STANDARD_DENSITY))["feasible"]).alias("feasible"), F.when(wing,
        "fixed_wing_does_not_hover").alias("reason"))


def _blade_sql(source: str, slope: str, cd0: str, chord: str, root: str, tip: str) -> str:
    """CTEs e0..e3, blade: one row for each element, tip loss and inflow in three rounds."""
    sig = f"(2 * ({chord}) / pi())"
    step = lambda n: f"e{n} AS (SELECT *, 2 / pi() * acos(least(1.0, exp(-least(50.0, (1 - r) / lam{n})))) AS f{n} FROM (SELECT *, greatest({'sig * slope / (16 * f%d) * (sqrt(greatest(1 + 32 * f%d * theta * r / (sig * slope), 0)) - 1)' % (n - 1, n - 1)}, 1e-6) AS lam{n} FROM e{n - 1}))"
    return (
        f"e0 AS (SELECT k, sig, slope, cd0, r, radians(root + (tip - root) * r) AS theta, 1.0::DOUBLE AS f0 FROM (SELECT k, {sig} AS sig, {slope} AS slope, {cd0} AS cd0, {root} AS root, {tip} AS tip, 0.15 + (i + 0.5) * 0.85 / 40 AS r FROM {source}, (SELECT unnest(range(0, 40)) AS i))), "
        + ", ".join(step(n) for n in (1, 2, 3))
        + ", blade AS (SELECT k, sum(4 * f3 * lam3 * lam3 * r * 0.85 / 40) AS ct, sum(lam3 * 4 * f3 * lam3 * lam3 * r * 0.85 / 40) AS cpi, sum(sig * cd0 / 2 * pow(r, 3) * 0.85 / 40) AS cp0 FROM e3 GROUP BY k)"
    )


BLADE_SQL = _blade_sql("(SELECT 0 AS k)", "5.75", "0.02", "0.1", "36.0", "10.0")
_BLADE_RPM = "sqrt(mass * 9.81 / motors / (ct * 1.225 * pi() * pow(inches * 0.0254 / 2, 2))) / (inches * 0.0254 / 2) * 60 / (2 * pi())"


@PLANS.add(f"""WITH {SPECS_SQL}, {BLADE_SQL}, h AS (SELECT spec, ct, cpi + cp0 AS cp, inches * 0.0254 / 2 AS r, {_BLADE_RPM} AS rpm, kv *
    cells * 3.7 AS have FROM specs, blade)
    SELECT spec, round(ct, 9) AS ct, round(cp, 9) AS cp, round(rpm, 4) AS rpm, round(cp * 1.225 * pi() * r * r * pow(rpm * 2 * pi() / 60 *
        r, 3), 5) AS power_w, rpm <= have AS feasible FROM h""")
def blade_element_hover(spark: SparkSession, folder: str) -> DataFrame:
    rows = specs(spark, folder).withColumn("blade", N.standard_blade()).withColumn("d", F.col("inches") * N.INCH)
    rows = rows.withColumn("rpm", N.blade_rpm(_thrust(), F.lit(N.STANDARD_DENSITY), F.col("d"), F.col("blade.ct")))
    cp = F.col("blade.cp_induced") + F.col("blade.cp_profile")
    power = N.blade_power(cp, F.lit(N.STANDARD_DENSITY), F.col("d"), N.tip_speed(F.col("rpm"), F.col("d")))
    return rows.select("spec", F.round("blade.ct", 9).alias("ct"), F.round(cp, 9).alias("cp"), F.round("rpm", 4).alias("rpm"),
        F.round(power, 5).alias("power_w"), (F.col("rpm") <= N.available_rpm(F.col("kv"), F.col("cells"))).alias("feasible"))


@PLANS.add(f"""WITH RECURSIVE {SPECS_SQL}, {BLADE_SQL}, h AS (SELECT spec, ct, cpi, cp0, {_BLADE_RPM} * 2 * pi() / 60 * inches * 0.0254 / 2
    AS tip, 1.0 + spec % 12 AS wind FROM specs, blade),
    l AS (SELECT spec, ct, cpi, cp0, wind / tip AS mu, 0 AS i, sqrt(ct / 2) AS lam FROM h UNION ALL SELECT spec, ct, cpi, cp0, mu, i + 1, ct
        / (2 * sqrt(mu * mu + lam * lam)) FROM l WHERE i < 15)
    SELECT spec, round(mu, 9) AS advance, round(lam, 9) AS inflow, round((cpi / (ct * sqrt(ct / 2)) * ct * lam + cp0 * (1 + 4.6 * mu * mu))
        / (cpi + cp0), 9) AS power_ratio FROM l WHERE i = 15""")
def wind_power(spark: SparkSession, folder: str) -> DataFrame:
    rows = specs(spark, folder).withColumn("blade", N.standard_blade()).withColumn("d", F.col("inches") * N.INCH)
    tip = N.tip_speed(N.blade_rpm(_thrust(), F.lit(N.STANDARD_DENSITY), F.col("d"), F.col("blade.ct")), F.col("d"))
    rows = rows.withColumn("mu", (1.0 + F.col("spec") % 12) / tip).withColumn("inflow", N.glauert_inflow(F.col("blade.ct"), F.col("mu")))
    ratio = N.wind_power_coefficient(F.col("blade"), F.col("mu"), F.col("inflow")) / (F.col("blade.cp_induced") + F.col("blade.cp_profile"))
    return rounded(rows.select("spec", F.col("mu").alias("advance"), "inflow", ratio.alias("power_ratio")), 9)


def _triangular_sql(u: str, lo: float, mode: float, hi: float) -> str:
    return f"(CASE WHEN {u} < {(mode - lo) / (hi - lo)!r} THEN {lo} + sqrt({u} * {(hi - lo) * (mode - lo)!r}) ELSE {hi} - sqrt((1 - {u}) * {(hi - lo) * (hi - mode)!r}) END)"


_DRAWS_SQL = "draws AS (SELECT k, " + ", ".join(f"{_triangular_sql(uniform_sql('k', i), *U.RANGES[n])} AS {n}" for i,
    n in enumerate(U.RANGES)) + " FROM (SELECT unnest(range(0, 2000)) AS k))"


@PLANS.add(f"""WITH {SPECS_SQL}, {_DRAWS_SQL}, {_blade_sql("draws", "lift_slope", "draws.cd0", "chord", "root_deg", "tip_deg")},
    s AS (SELECT avg(1 / sqrt(ct)) AS mean, stddev_pop(1 / sqrt(ct)) AS sd, quantile_cont(1 / sqrt(ct), 0.05) AS p05, quantile_cont(1 /
        sqrt(ct), 0.5) AS p50, quantile_cont(1 / sqrt(ct), 0.95) AS p95 FROM blade),
    u AS (SELECT spec, sqrt(mass * 9.81 / motors / (1.225 * pi() * pow(inches * 0.0254 / 2, 2))) / (inches * 0.0254 / 2) * 60 / (2 * pi()) AS x FROM specs)
    SELECT spec, round(x * mean, 3) AS mean, round(x * sd, 3) AS sd, round(x * p05, 3) AS p05, round(x * p50, 3) AS p50, round(x * p95, 3) AS p95 FROM u, s""")
def rpm_uncertainty(spark: SparkSession, folder: str) -> DataFrame:
    rows = specs(spark, folder).select("spec", _thrust().alias("thrust_n"), (F.col("inches") * N.INCH).alias("diameter_m"))
    return rounded(U.rpm_uncertainty(rows), 3)


@PLANS.add()
def gust_uncertainty(spark: SparkSession, folder: str) -> DataFrame:
    """Power and endurance in gusty wind of every distinct size of vehicle."""
    rows = specs(spark, folder).withColumn("motors", F.lit(4.0)).select("mass", "inches", "mah", "motors").distinct()
    rows = rows.select(F.concat_ws("x", "mass", "inches").alias("spec"), _thrust().alias("thrust_n"), (F.col("inches")
        * N.INCH).alias("diameter_m"), (F.col("inches") / 2).alias("wind"), (F.col("mah") / 1000 * 4 * N.CELL_VOLTS).alias("energy_wh"), "motors")
    return rounded(U.gust_uncertainty(rows), 4)


@PLANS.add(f"""WITH s AS (SELECT p_partkey AS spec, 0.05 + p_size / 40.0 AS z, 2.0 + p_partkey % 10 AS w FROM part)
    SELECT spec, CASE WHEN z < 1 THEN round({math.pi!r} / (w * sqrt(1 - z * z)), 6) END AS peak_time_s, CASE WHEN z < 1 THEN round(100 *
        exp(-z * {math.pi!r} / sqrt(1 - z * z)), 6) ELSE 0.0 END AS overshoot_percent, round(4 / (z * w), 6) AS settling_time_s, CASE WHEN z
        < 1 THEN round(({math.pi!r} - acos(z)) / (w * sqrt(1 - z * z)), 6) END AS rise_time_s FROM s""")
def step_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("spec"), (0.05 + F.col("p_size") / 40.0).alias("z"), (2.0
        + F.col("p_partkey") % 10).alias("w"))
    return rounded(rows.select("spec", *(c.alias(n) for n, c in N.step_metrics(F.col("z"), F.col("w")).items())))


@PLANS.add("""WITH RECURSIVE p AS (SELECT s_suppkey AS spec, axis, step::DOUBLE AS step, 0.1 + (s_nationkey % 10) / 10.0::DOUBLE AS z FROM supplier JOIN
    (VALUES (0, 'roll', 15), (1, 'pitch', 10), (2, 'yaw', 30)) a(k, axis, step) ON k = s_suppkey % 3),
    r AS (SELECT spec, axis, step, z, 0 AS i, 0::DOUBLE AS x, 0::DOUBLE AS v FROM p UNION ALL
        SELECT spec, axis, step, z, i + 1, x + 0.001::DOUBLE / 6 * (v + 2 * v2 + 2 * v3 + v4), v + 0.001::DOUBLE / 6 * (a1 + 2 * a2 + 2 * a3 + 64 * (d3 - (x + v3 * 0.001::DOUBLE)) - 16 * z * v4)
        FROM (SELECT *, v + a3 * 0.001::DOUBLE AS v4 FROM (SELECT *, 64 * (d2 - (x + v2 * 0.0005::DOUBLE)) - 16 * z * v3 AS a3
        FROM (SELECT *, v + a2 * 0.0005::DOUBLE AS v3 FROM (SELECT *, 64 * (d2 - (x + v * 0.0005::DOUBLE)) - 16 * z * v2 AS a2
        FROM (SELECT *, v + a1 * 0.0005::DOUBLE AS v2 FROM (SELECT *, 64 * (d1 - x) - 16 * z * v AS a1
        FROM (SELECT *, CASE WHEN i >= 500 THEN step ELSE 0 END AS d1, CASE WHEN i >= 500 THEN step ELSE 0 END AS d2, CASE WHEN i >= 499 THEN step ELSE 0 END AS d3 FROM r WHERE i < 4000))))))))
    SELECT spec, axis, round(i * 0.001, 4)::DOUBLE AS t, CASE WHEN i >= 500 THEN step ELSE 0 END AS desired, round(x, 4) AS actual FROM r WHERE i % 20 = 0""")
def step_response(spark: SparkSession, folder: str) -> DataFrame:
    """Responses over 4 s at 50 Hz: every supplier is a tuning, by its number of an axis and by its nation of a damping."""
    steps = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(float(d)).alias("step")) for a, d in N.STEPS_DEG.items()])
    rows = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("spec"), F.get(steps, (F.col("s_suppkey") % 3).cast("int")).alias("a"),
        (0.1 + F.col("s_nationkey") % 10 / 10.0).alias("z")).select("spec", "a.*", "z")
    rows = spread(rows, "spec")
    response = N.step_response(F.col("step"), F.col("z"), F.lit(N.OMEGA), 4.0, 50.0)
    return rounded(rows.select("spec", "axis", F.explode(response).alias("r")).select("spec", "axis", "r.*"), 4)
