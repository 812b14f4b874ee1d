"""Engineering models as Column functions: atmosphere, battery, rotor, wind, frames and control response.

Iterative solvers are folds over a short sequence inside the row, so a whole parameter grid is one projection.
"""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Standard atmosphere.
P0, T0, LAPSE, G0, MOLAR, GAS = 101325.0, 288.15, 0.0065, 9.80665, 0.0289644, 8.3144598
SPECIFIC_GAS = GAS / MOLAR
SEA_LEVEL_DENSITY = P0 / (SPECIFIC_GAS * T0)
# Battery capacity by temperature in C.
CAPACITY = ((-20.0, 0.50), (-10.0, 0.70), (0.0, 0.75), (15.0, 1.0), (35.0, 1.0))
# Rotor, pack and gravity.
CT_STATIC, PROP_EFFICIENCY, CELL_VOLTS, G = 0.105, 0.80, 3.7, 9.81
STANDARD_DENSITY, INCH = 1.225, 0.0254
# Blade element model.
LIFT_SLOPE, CD0, CHORD_RATIO, ROOT_DEG, TIP_DEG, CUTOUT, BLADES, ELEMENTS = 5.75, 0.02, 0.10, 36.0, 10.0, 0.15, 2, 40
TIP_ITERATIONS, LEAST_INFLOW, MOST_EXPONENT = 3, 1e-6, 50.0
GLAUERT_ITERATIONS, PROFILE_K = 15, 4.6
CEILING_M, BISECTIONS = 9000.0, 40
# Frames: motors, cruise velocity, whether it is a rotorcraft; tilt limits; fixed wing cruise.
FRAMES = (("quad", 4, 8.0, True), ("hex", 6, 8.0, True), ("octo", 8, 8.0, True), ("fixed_wing", 1, 15.0, False))
BANK_DEG, MOST_TILT_DEG = 25.0, 60.0
WING_CL, WING_EFFICIENCY, WING_AREA, LIFT_TO_DRAG = 0.5, 0.7, 0.5, 10.0
FALLBACK_ACCELERATION = 2.5
# Natural frequency, step commands and their start, and the step of integration.
OMEGA, STEPS_DEG, STEP_AT_S, DT_S = 8.0, {"roll": 15.0, "pitch": 10.0, "yaw": 30.0}, 0.5, 0.001


def let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def air_density(altitude_m: Column, temperature_c: Column) -> Column:
    pressure = P0 * F.pow(1 - LAPSE * altitude_m / T0, F.lit(G0 * MOLAR / (GAS * LAPSE)))
    return pressure / (SPECIFIC_GAS * (temperature_c + 273.15))


def hover_power_scale(density: Column) -> Column:
    """Hover power against sea level."""
    return F.sqrt(SEA_LEVEL_DENSITY / density)


def battery_capacity(temperature_c: Column) -> Column:
    """Usable share of a battery: linear between the points, constant outside."""
    out = F.lit(CAPACITY[-1][1])
    for (t0, f0), (t1, f1) in reversed(list(zip(CAPACITY, CAPACITY[1:], strict=False))):
        out = F.when(temperature_c <= t1, f0 + (temperature_c - t0) / (t1 - t0) * (f1 - f0)).otherwise(out)
    return F.when(temperature_c <= CAPACITY[0][0], CAPACITY[0][1]).otherwise(out)


def projected_drain(rate: Column, power_scale: Column, capacity: Column) -> Column:
    """Drain under other conditions; null without a positive rate."""
    return F.when(rate > 0, rate * power_scale / capacity)


def thrust_per_motor(mass_kg: Column, motors: Column) -> Column:
    return mass_kg * G / motors


def required_rpm(thrust_n: Column, density: Column, diameter_m: Column) -> Column:
    return F.sqrt(thrust_n / (CT_STATIC * density * F.pow(diameter_m, F.lit(4.0)))) * 60


def available_rpm(kv: Column, cells: Column) -> Column:
    return kv * cells * CELL_VOLTS


def ideal_hover_power(thrust_n: Column, density: Column, diameter_m: Column) -> Column:
    area = math.pi * F.pow(diameter_m / 2, F.lit(2.0))
    return F.pow(thrust_n, F.lit(1.5)) / F.sqrt(2 * density * area)


def hover(mass_kg: Column, motors: Column, diameter_in: Column, kv: Column, cells: Column, capacity_mah: Column, density: Column) -> dict[str, Column]:
    """Required and available rpm, feasibility and margin, power, current, watts per kilogram and minutes of hover."""
    thrust, diameter = thrust_per_motor(mass_kg, motors), diameter_in * INCH
    need, have = required_rpm(thrust, density, diameter), available_rpm(kv, cells)
    power = ideal_hover_power(thrust, density, diameter) / PROP_EFFICIENCY * motors
    volts = cells * CELL_VOLTS
    return {
        "required_rpm": need,
        "available_rpm": have,
        "feasible": need <= have,
        "margin_percent": (have - need) / have * 100,
        "power_w": power,
        "current_a": power / volts,
        "w_per_kg": power / mass_kg,
        "minutes": capacity_mah / 1000 * volts / power * 60,
    }


def max_altitude(thrust_n: Column, diameter_m: Column, have_rpm: Column) -> tuple[Column, Column]:
    """(altitude, capped): the highest altitude to hover at in a standard atmosphere, by bisection below the ceiling.

    0 if even sea level is out of reach; capped where the ceiling is within it.
    """

    def reaches(altitude: Column) -> Column:
        return required_rpm(thrust_n, air_density(altitude, 15.0 - LAPSE * altitude), diameter_m) <= have_rpm

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(CEILING_M).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["lo"] + s["hi"]) / 2
        return F.when(reaches(middle), F.struct(middle.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle.alias("hi")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, halve)["lo"]
    capped = reaches(F.lit(CEILING_M))
    return F.when(~reaches(F.lit(0.0)), 0.0).when(capped, CEILING_M).otherwise(found), capped


def blade_coefficients(lift_slope: Column, cd0: Column, chord: Column, root_deg: Column, tip_deg: Column) -> Column:
    """Struct of ct, cp_induced, cp_profile: blade elements at midpoints from the cutout to the tip.

    Inflow and tip loss of an element follow from one another in TIP_ITERATIONS rounds; the loss kept is that of the last
    round's inflow.
    """
    sigma = BLADES * chord / math.pi
    width = (1 - CUTOUT) / ELEMENTS

    def element(acc: Column, i: Column) -> Column:
        r = CUTOUT + (i + 0.5) * width
        theta = F.radians(root_deg + (tip_deg - root_deg) * r)

        def round_(s: Column, _: Column) -> Column:
            root = F.sqrt(F.greatest(1 + 32 * s["f"] * theta * r / (sigma * lift_slope), F.lit(0.0)))
            inflow = F.greatest(sigma * lift_slope / (16 * s["f"]) * (root - 1), F.lit(LEAST_INFLOW))
            loss = lambda x: 2 / math.pi * F.acos(F.least(F.lit(1.0), F.exp(-F.least(F.lit(MOST_EXPONENT), BLADES / 2 * (1 - r) / x))))
            return let(inflow, lambda x: F.struct(x.alias("x"), loss(x).alias("f")))

        start = F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("f"))
        solved = F.aggregate(F.sequence(F.lit(1), F.lit(TIP_ITERATIONS)), start, round_)

        def add(s: Column) -> Column:
            thrust = 4 * s["f"] * s["x"] * s["x"] * r * width
            return F.struct((acc["ct"] + thrust).alias("ct"), (acc["cp_induced"] + s["x"] * thrust).alias("cp_induced"), (acc["cp_profile"]
                + sigma * cd0 / 2 * r * r * r * width).alias("cp_profile"))

        return let(solved, add)

    zero = F.struct(F.lit(0.0).alias("ct"), F.lit(0.0).alias("cp_induced"), F.lit(0.0).alias("cp_profile"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ELEMENTS - 1)), zero, element)


@cache
def _standard_blade() -> tuple[float, float, float]:
    blade = blade_coefficients(F.lit(LIFT_SLOPE), F.lit(CD0), F.lit(CHORD_RATIO), F.lit(ROOT_DEG), F.lit(TIP_DEG))
    return tuple(SparkSession.active().sql("SELECT 1").select(blade.alias("b")).first().b)


def standard_blade() -> Column:
    """Coefficients of the fixed blade as literals: solved once, not for every row."""
    return F.struct(*[F.lit(v).alias(n) for n, v in zip(("ct", "cp_induced", "cp_profile"), _standard_blade(), strict=True)])


def blade_rpm(thrust_n: Column, density: Column, diameter_m: Column, ct: Column) -> Column:
    radius = diameter_m / 2
    return F.sqrt(thrust_n / (ct * density * math.pi * radius * radius)) / radius * 60 / (2 * math.pi)


def tip_speed(rpm: Column, diameter_m: Column) -> Column:
    return rpm * 2 * math.pi / 60 * diameter_m / 2


def blade_power(cp: Column, density: Column, diameter_m: Column, tip: Column) -> Column:
    return cp * density * math.pi * F.pow(diameter_m / 2, F.lit(2.0)) * F.pow(tip, F.lit(3.0))


def glauert_inflow(ct: Column, advance: Column) -> Column:
    step = lambda x, _: ct / (2 * F.sqrt(advance * advance + x * x))
    return F.aggregate(F.sequence(F.lit(1), F.lit(GLAUERT_ITERATIONS)), F.sqrt(F.greatest(ct, F.lit(0.0)) / 2), step)


def wind_power_coefficient(blade: Column, advance: Column, inflow: Column | None = None) -> Column:
    """Power coefficient at an advance ratio: induced power by Glauert's inflow (given, or solved here), profile power growing with its square."""
    ct = blade["ct"]
    kappa = blade["cp_induced"] / (ct * F.sqrt(ct / 2))
    return kappa * ct * (glauert_inflow(ct, advance) if inflow is None else inflow) + blade["cp_profile"] * (1 + PROFILE_K * advance * advance)


def max_thrust(motors: Column, diameter_in: Column, kv: Column, cells: Column, density: Column) -> Column:
    """Thrust of all motors at full rpm."""
    return CT_STATIC * density * F.pow(available_rpm(kv, cells) / 60, F.lit(2.0)) * F.pow(diameter_in * INCH, F.lit(4.0)) * motors


def tilt_limit(thrust_to_weight: Column) -> Column:
    """Degrees of tilt that leave enough lift, at most MOST_TILT_DEG."""
    own = F.when(thrust_to_weight >= 1, F.degrees(F.acos(F.least(F.lit(1.0), 1 / thrust_to_weight)))).otherwise(0.0)
    return F.least(own, F.lit(MOST_TILT_DEG))


def turn_rate(tilt_deg: Column, velocity: Column) -> Column:
    return F.degrees(G * F.tan(F.radians(tilt_deg)) / velocity)


def wing_cruise(mass_kg: Column, cells: Column, capacity_mah: Column, area: Column, lift_to_drag: Column, density: Column) -> dict[str, Column]:
    """Cruise of a fixed wing; area and lift-to-drag ratio fall back to standard ones where null or 0."""
    area = F.coalesce(F.nullif(area, F.lit(0.0)), F.lit(WING_AREA))
    ratio = F.coalesce(F.nullif(lift_to_drag, F.lit(0.0)), F.lit(LIFT_TO_DRAG))
    weight = mass_kg * G
    velocity = F.sqrt(2 * weight / (density * area * WING_CL))
    power = weight / ratio * velocity
    return {"wing_loading": weight / area, "velocity": velocity, "power_w": power, "minutes": WING_EFFICIENCY * capacity_mah / 1000 * cells
        * CELL_VOLTS / power * 60}


def acceleration_limit(mass_kg: Column, thrust_n: Column) -> Column:
    """Horizontal acceleration left beside hovering; a fallback where thrust is unknown or no more than weight."""
    weight = mass_kg * G
    return F.when(thrust_n > weight, F.sqrt(thrust_n * thrust_n - weight * weight) / mass_kg).otherwise(FALLBACK_ACCELERATION)


def step_metrics(zeta: Column, omega: Column) -> dict[str, Column]:
    """Closed forms of a second-order step response; peak and rise exist only under critical damping."""
    under = zeta < 1
    root = F.sqrt(F.greatest(1 - zeta * zeta, F.lit(0.0)))
    damped = omega * root
    return {
        "peak_time_s": F.when(under, math.pi / damped),
        "overshoot_percent": F.when(under, 100 * F.exp(-zeta * math.pi / root)).otherwise(0.0),
        "settling_time_s": F.when(zeta * omega > 0, 4 / (zeta * omega)),
        "rise_time_s": F.when(under, (math.pi - F.acos(F.least(zeta, F.lit(1.0)))) / damped),
    }


def step_response(step_deg: Column, zeta: Column, omega: Column, duration_s: float, rate_hz: float) -> Column:
    """Array of structs (t, desired, actual): the response by fourth-order Runge-Kutta steps of DT_S.

    Such a step of a linear system under a constant command multiplies its distance from rest at the command by a fixed
    matrix. So the few steps in which the command begins are taken one by one, and each output after them is one product
    with that matrix to the power of the steps between outputs.
    """
    every = max(1, round(1 / (rate_hz * DT_S)))
    outputs = int(duration_s / DT_S) // every
    h = DT_S
    begun = [[t >= STEP_AT_S for t in (i * h, i * h + h / 2, i * h + h)] for i in range(outputs * every)]
    first = next((i for i, b in enumerate(begun) if any(b)), len(begun))  # at rest until then
    settled = next((i for i, b in enumerate(begun) if all(b)), len(begun))
    if first == len(begun):
        return F.transform(F.sequence(F.lit(0), F.lit(outputs)), lambda k: F.struct((k * every * DT_S).alias("t"), F.lit(0.0).alias("desired"),
            F.lit(0.0).alias("actual")))

    def mixed(x: Column, v: Column, b: list[bool]) -> tuple[Column, Column]:
        slope = lambda on, x, v: omega * omega * ((step_deg if on else F.lit(0.0)) - x) - 2 * zeta * omega * v
        a1 = slope(b[0], x, v)
        v2 = v + a1 * h / 2
        a2 = slope(b[1], x + v * h / 2, v2)
        v3 = v + a2 * h / 2
        a3 = slope(b[1], x + v2 * h / 2, v3)
        v4 = v + a3 * h
        a4 = slope(b[2], x + v3 * h, v4)
        return x + h / 6 * (v + 2 * v2 + 2 * v3 + v4), v + h / 6 * (a1 + 2 * a2 + 2 * a3 + a4)

    x, v = F.lit(0.0), F.lit(0.0)
    for b in begun[first:settled]:
        x, v = mixed(x, v, b)

    names = ("a", "b", "c", "d")
    matrix = lambda *cells: F.struct(*[cell.alias(n) for n, cell in zip(names, cells, strict=True)])
    times = lambda p, q: matrix(p["a"] * q["a"] + p["b"] * q["c"], p["a"] * q["b"] + p["b"] * q["d"], p["c"] * q["a"] + p["d"] * q["c"], p["c"]
        * q["b"] + p["d"] * q["d"])
    one = matrix(*map(F.lit, (1.0, 0.0, 0.0, 1.0)))

    def power(base: Column, n: int) -> Column:
        if n == 0:
            return one
        half = let(power(base, n // 2), lambda p: times(p, p)) if n > 1 else one
        return let(half, lambda p: times(p, base)) if n % 2 else half

    # I + hM + (hM)^2 / 2 + (hM)^3 / 6 + (hM)^4 / 24 with M = (0, 1; -omega^2, -2 zeta omega)
    generator = matrix(F.lit(0.0), F.lit(1.0) * h, -omega * omega * h, -2 * zeta * omega * h)
    series = lambda m: let(matrix(*[F.lit(1.0 if n in "ad" else 0.0) + m[n] / 4 for n in names]), lambda p: let(_plus_one(times(m, p), 3, names),
        lambda p: let(_plus_one(times(m, p), 2, names), lambda p: _plus_one(times(m, p), 1, names))))
    behind = -(-settled // every)  # the first output with the command settled
    moved = lambda p, s: F.struct((p["a"] * s["x"] + p["b"] * s["v"]).alias("x"), (p["c"] * s["x"] + p["d"] * s["v"]).alias("v"))

    def course(p: Column, s: Column) -> Column:
        if behind == outputs:
            return F.array(s)
        return F.aggregate(F.sequence(F.lit(behind + 1), F.lit(outputs)), F.array(s), lambda acc, _: F.concat(acc, F.array(moved(p, F.element_at(acc, -1)))))

    def solved(one_step: Column) -> Column:
        start = F.struct((x - step_deg).alias("x"), v.alias("v"))
        begin = let(power(one_step, behind * every - settled), lambda p: moved(p, start)) if behind * every > settled else start
        rest = F.transform(F.sequence(F.lit(1), F.lit(behind)), lambda _: F.lit(0.0)) if behind else F.array().cast("array<double>")
        return let(power(one_step, every), lambda p: let(begin, lambda s: F.concat(rest, F.transform(course(p, s), lambda s: s["x"] + step_deg))))

    actual = let(let(generator, series), solved)
    return F.transform(actual, lambda x, k: F.struct((k * every * DT_S).alias("t"), F.when(k * every * DT_S >= STEP_AT_S,
        step_deg).otherwise(0.0).alias("desired"), x.alias("actual")))


def _plus_one(product: Column, over: int, names: tuple[str, ...]) -> Column:
    """Identity plus a matrix divided by a number."""
    return F.struct(*[(F.lit(1.0 if n in "ad" else 0.0) + product[n] / over).alias(n) for n in names])
