"""Canonical signals of flight logs from their messages: names, units, instances, attitudes, actuators, provenance."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import series
from ..operators.scans import quantiles, scanned, stored
from .logs import INFO, PARAMETER, STREAM_MESSAGES, TEXT, log_files, messages

# Signal, topic, field and factor of both log formats.
ULOG_SIGNALS = (
    ("gyro.x", "vehicle_angular_velocity", "xyz[0]", 1.0),
    ("gyro.y", "vehicle_angular_velocity", "xyz[1]", 1.0),
    ("gyro.z", "vehicle_angular_velocity", "xyz[2]", 1.0),
    ("accel.x", "sensor_combined", "accelerometer_m_s2[0]", 1.0),
    ("accel.y", "sensor_combined", "accelerometer_m_s2[1]", 1.0),
    ("accel.z", "sensor_combined", "accelerometer_m_s2[2]", 1.0),
    ("pos.x", "vehicle_local_position", "x", 1.0),
    ("pos.y", "vehicle_local_position", "y", 1.0),
    ("pos.z", "vehicle_local_position", "z", 1.0),
    ("vel.x", "vehicle_local_position", "vx", 1.0),
    ("vel.y", "vehicle_local_position", "vy", 1.0),
    ("vel.z", "vehicle_local_position", "vz", 1.0),
    ("alt.rel", "vehicle_local_position", "z", -1.0),
    ("gps.fix_type", "vehicle_gps_position", "fix_type", 1.0),
    ("gps.nsats", "vehicle_gps_position", "satellites_used", 1.0),
    ("gps.eph", "vehicle_gps_position", "eph", 1.0),
    ("rate_sp.roll", "vehicle_rates_setpoint", "roll", 1.0),
    ("rate_sp.pitch", "vehicle_rates_setpoint", "pitch", 1.0),
    ("rate_sp.yaw", "vehicle_rates_setpoint", "yaw", 1.0),
    ("thrust.sp", "vehicle_thrust_setpoint", "xyz[2]", -1.0),
    ("batt.voltage", "battery_status", "voltage_filtered_v", 1.0),
    ("batt.current", "battery_status", "current_filtered_a", 1.0),
    ("cpu.load", "cpuload", "load", 1.0),
    ("mem.free", "cpuload", "ram_usage", 1.0),
    ("batt.voltage_raw", "battery_status", "voltage_v", 1.0),
    ("batt.current_raw", "battery_status", "current_a", 1.0),
    ("batt.discharged_mah", "battery_status", "discharged_mah", 1.0),
    ("batt.cell_delta", "battery_status", "max_cell_voltage_delta", 1.0),
    ("batt.cell_count", "battery_status", "cell_count", 1.0),
    ("gps.sacc", "vehicle_gps_position", "s_variance_m_s", 1.0),
    ("gps.noise", "vehicle_gps_position", "noise_per_ms", 1.0),
    ("gps.jamming", "vehicle_gps_position", "jamming_indicator", 1.0),
    ("fd.imbalance", "failure_detector_status", "imbalanced_prop_metric", 1.0),
    ("est.vel_tr", "estimator_status", "vel_test_ratio", 1.0),
    ("est.pos_tr", "estimator_status", "pos_test_ratio", 1.0),
    ("est.hgt_tr", "estimator_status", "hgt_test_ratio", 1.0),
    ("est.mag_tr", "estimator_status", "mag_test_ratio", 1.0),
    ("imu.clip0", "vehicle_imu_status", "accel_clipping[0]", 1.0),
    ("imu.clip1", "vehicle_imu_status", "accel_clipping[1]", 1.0),
    ("imu.clip2", "vehicle_imu_status", "accel_clipping[2]", 1.0),
    ("vibe.x", "vehicle_imu_status", "accel_vibration_metric", 1.0),
    ("land.landed", "vehicle_land_detected", "landed", 1.0),
)
RADIANS = math.pi / 180
DATAFLASH_SIGNALS = (
    ("att.roll", "ATT", "Roll", RADIANS),
    ("att.pitch", "ATT", "Pitch", RADIANS),
    ("att.yaw", "ATT", "Yaw", RADIANS),
    ("gyro.x", "IMU", "GyrX", 1.0),
    ("gyro.y", "IMU", "GyrY", 1.0),
    ("gyro.z", "IMU", "GyrZ", 1.0),
    ("accel.x", "IMU", "AccX", 1.0),
    ("accel.y", "IMU", "AccY", 1.0),
    ("accel.z", "IMU", "AccZ", 1.0),
    ("alt.rel", "CTUN", "Alt", 1.0),
    ("gps.fix_type", "GPS", "Status", 1.0),
    ("gps.nsats", "GPS", "NSats", 1.0),
    ("gps.hdop", "GPS", "HDop", 1.0),
    ("rate_sp.roll", "RATE", "RDes", RADIANS),
    ("rate_sp.pitch", "RATE", "PDes", RADIANS),
    ("rate_sp.yaw", "RATE", "YDes", RADIANS),
    ("thrust.sp", "RATE", "AOut", 1.0),
    ("batt.voltage", "BAT", "Volt", 1.0),
    ("batt.current", "BAT", "Curr", 1.0),
    ("vibe.x", "VIBE", "VibeX", 1.0),
    ("vibe.y", "VIBE", "VibeY", 1.0),
    ("vibe.z", "VIBE", "VibeZ", 1.0),
    ("cpu.load", "PM", "Load", 0.001),
    ("mem.free", "PM", "MemFree", 1.0),
    ("batt.voltage_raw", "BAT", "Volt", 1.0),
    ("batt.current_raw", "BAT", "Curr", 1.0),
    ("batt.discharged_mah", "BAT", "CurrTot", 1.0),
    ("imu.clip0", "VIBE", "Clip0", 1.0),
    ("imu.clip1", "VIBE", "Clip1", 1.0),
    ("imu.clip2", "VIBE", "Clip2", 1.0),
    ("gps.sacc", "GPA", "SAcc", 1.0),
    *((k, t, f, 1.0) for t in ("XKF1", "NKF1") for k, f in (("pos.x", "PN"), ("pos.y", "PE"), ("pos.z", "PD"), ("vel.x", "VN"), ("vel.y",
        "VE"), ("vel.z", "VD"))),
)
ARMED_STATE, MOTOR_FUNCTIONS = 2, 101
OUTPUT_BANKS = ("PWM_MAIN", "PWM_AUX")
PWM_RANGE = (1000.0, 2000.0)
FIFO_TOPICS = {"sensor_accel_fifo": "fifo.accel", "sensor_gyro_fifo": "fifo.gyro"}
FIFO_WIDTH, HIGH_RATE_HZ = 32, 500.0
FIR_HALF, SHORTEST = 10, 27
GPS_EPOCH_S, LEAP_S, WEEK_S = 315_964_800, 18, 604_800
EARLIEST_US = 1_420_070_400_000_000


def parameters(logged: DataFrame) -> DataFrame:
    """(log, params): each log's numeric parameters as a map; of repeated ones the last."""
    rows = logged.filter((F.col("topic") == PARAMETER) & F.col("value").isNotNull()).groupBy("log", "field").agg(F.max_by("value", "seq").alias("value"))
    return rows.groupBy("log").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("params"))


def primary_instances(logged: DataFrame) -> DataFrame:
    """(log, topic, instance): the instance of each topic that stands for it.

    The lowest, except the estimator that the selector names most often, and the inertial unit whose accelerometer that
    estimator uses.
    """
    data = logged.filter(~F.col("topic").startswith("$"))
    lowest = data.groupBy("log", "topic").agg(F.min("instance").alias("instance"))
    named = series.modal(data.filter("topic = 'estimator_selector_status' AND field = 'primary_instance'"), "value", "log").select("log",
        F.col("value").cast("int").alias("named"))
    device = data.filter("field = 'accel_device_id'").groupBy("log", "topic", "instance").agg(F.min_by("value", "seq").alias("device"))
    estimators = data.filter("topic = 'estimator_status'").select("log", "instance").distinct().withColumnRenamed("instance", "named")
    chosen = lowest.join(named.join(estimators, ["log", "named"]), "log", "left").withColumn("instance",
        F.when(F.col("topic") == "estimator_status", F.coalesce("named", "instance")).otherwise(F.col("instance"))).drop("named")
    used = chosen.filter("topic = 'estimator_status'").join(device.filter("topic = 'estimator_status'"), ["log", "topic", "instance"]).select("log", "device")
    unit = device.filter("topic = 'vehicle_imu_status'").join(used, ["log", "device"]).groupBy("log").agg(F.min("instance").alias("unit"))
    return chosen.join(unit, "log", "left").select("log", "topic", F.when(F.col("topic") == "vehicle_imu_status", F.coalesce("unit",
        "instance")).otherwise(F.col("instance")).alias("instance"))


def euler(w: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Roll, pitch and yaw in radians of a quaternion, in the order z, y, x; pitch is held to a quarter turn."""
    pitch = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - z * x))))
    return F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), pitch, F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def by_message(logged: DataFrame, topic: str, fields: dict[str, str]) -> DataFrame:
    """(log, seq, us, names): one row for each message of a topic, fields as columns."""
    rows = logged.filter(F.col("topic") == topic).withColumn("message", F.col("us"))
    return rows.groupBy("log", "instance", "us").agg(F.min("seq").alias("seq"), *(F.max(F.when(F.col("field") == f,
        F.col("value"))).alias(n) for n, f in fields.items()))


def _named(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in columns.items()]))
    return rows.select("log", "seq", "us", pairs.alias("p")).select("log", "seq", "us", "p.key", "p.value").filter("value IS NOT NULL")


def canonical(logged: DataFrame) -> DataFrame:
    """(log, key, us, value): the canonical signals of all logs, cleaned.

    A signal is there only if its log carries it. Values are finite, times unique per signal (the first in file order)
    and on one side of a backward clock step. Yaw is unwrapped.
    """
    spark = logged.sparkSession
    names = spark.createDataFrame([*ULOG_SIGNALS, *DATAFLASH_SIGNALS], "key string, topic string, field string, factor double")
    own = logged.join(primary_instances(logged), ["log", "topic", "instance"])
    direct = own.join(F.broadcast(names), ["topic", "field"]).select("log", "key", "seq", "us", (F.col("value") * F.col("factor")).alias("value"), "topic")
    first = F.min(F.when(F.col("topic") == "XKF1", 0).when(F.col("topic") == "NKF1", 1).otherwise(-1)).over(Window.partitionBy("log", "key"))
    direct = direct.withColumn("best",
        first).filter("topic NOT IN ('XKF1', 'NKF1') OR (topic = 'XKF1' AND best <= 0) OR (topic = 'NKF1' AND best = 1)").select("log", "seq", "us", "key", "value")

    q = {f"q{c}": f"q[{i}]" for i, c in enumerate("wxyz")}
    attitude = by_message(own, "vehicle_attitude", q)
    roll, pitch, yaw = euler(*(F.col(c) for c in q))
    attitude = _named(attitude, {"att.roll": roll, "att.pitch": pitch, "att.yaw": yaw, **{f"att.{c}": F.col(c) for c in q}})
    wanted = by_message(own, "vehicle_attitude_setpoint", {f"q{c}": f"q_d[{i}]" for i, c in enumerate("wxyz")})
    wanted = _named(wanted, {f"att_sp.{c}": F.col(c) for c in q})
    armed = own.filter("topic = 'vehicle_status' AND field = 'arming_state'").select("log", "seq", "us", F.lit("status.armed").alias("key"),
        (F.col("value") == ARMED_STATE).cast("double").alias("value"))

    parts = direct.unionByName(attitude).unionByName(wanted).unionByName(armed).unionByName(actuators(logged)).unionByName(decimated(fifo(logged)))
    rows = parts.select(F.struct("log", "key").alias("key"), "seq", "us", "value")
    rows = series.clean(series.cut_clock_jump(rows)).drop("noisy")
    turned = series.unwrapped(rows.filter("key.key = 'att.yaw'"), 2 * math.pi).select("key", "seq", "us", F.col("unwrapped").alias("value"))
    return rows.filter("key.key <> 'att.yaw'").unionByName(turned).select("key.log", "key.key", "us", "value")


def actuators(logged: DataFrame) -> DataFrame:
    """(log, seq, us, key, value): motor commands act.motor<i>, and outputs act.out<i> as shares of their range.

    Which channel drives which motor comes from the output functions; of several output instances the one with most
    moving motor channels counts, then the lowest.
    """
    control = logged.filter("topic = 'actuator_motors' AND instance = 0 AND field LIKE 'control[%'")
    number = F.regexp_extract("field", r"\[(\d+)\]", 1)
    control = control.select("log", "seq", "us", F.concat(F.lit("act.motor"), number).alias("key"), "value")
    params = logged.filter(F.col("topic") == PARAMETER)
    function = params.select("log", F.regexp_extract("field", r"^(PWM_MAIN|PWM_AUX)_FUNC(\d+)$", 1).alias("bank"), F.regexp_extract("field",
        r"_FUNC(\d+)$", 1).alias("channel"), (F.col("value") - MOTOR_FUNCTIONS).cast("int").alias("motor"))
    px4 = function.filter("bank <> '' AND motor BETWEEN 0 AND 11").groupBy("log",
        "motor").agg(F.min(F.struct(F.when(F.col("bank") == OUTPUT_BANKS[0], 0).otherwise(1).alias("o"),
        F.col("channel").cast("int").alias("channel"), "bank")).alias("m"))
    px4 = px4.select("log", "motor", "m.bank", "m.channel", F.lit("actuator_outputs").alias("topic"), F.concat(F.lit("output["),
        F.col("m.channel") - 1, F.lit("]")).alias("field"))
    servo = params.select("log", F.regexp_extract("field", r"^SERVO(\d+)_FUNCTION$", 1).alias("channel"),
        F.col("value").cast("int").alias("f")).filter("channel <> '' AND (f BETWEEN 33 AND 40 OR f BETWEEN 82 AND 85)")
    pilot = servo.select("log", F.when(F.col("f") <= 40, F.col("f") - 33).otherwise(F.col("f") - 74).alias("motor"),
        F.lit("SERVO").alias("bank"), F.col("channel").cast("int").alias("channel"), F.lit("RCOU").alias("topic"), F.concat(F.lit("C"),
        F.col("channel")).alias("field"))
    mapping = px4.unionByName(pilot)
    limit = lambda which: F.when(F.col("bank") == "SERVO", F.concat(F.lit("SERVO"), "channel",
        F.lit(f"_{which}"))).otherwise(F.concat("bank", F.lit(f"_{which}"), "channel"))
    maps = mapping.join(parameters(logged), "log", "left")
    low = F.coalesce(F.try_element_at("params", limit("MIN")), F.lit(PWM_RANGE[0]))
    high = F.coalesce(F.try_element_at("params", limit("MAX")), F.lit(PWM_RANGE[1]))
    maps = maps.select("log", "topic", "field", "motor", low.alias("low"), high.alias("high"))
    rows = logged.join(maps, ["log", "topic", "field"])
    per = rows.groupBy("log", "topic", "instance", "motor").agg((F.max("value") > F.min("value")).cast("int").alias("moves")).groupBy("log",
        "topic", "instance").agg(F.sum("moves").alias("moves"))
    best = per.groupBy("log", "topic").agg(F.max_by("instance", F.struct("moves", -F.col("instance"))).alias("instance"))
    rows = rows.join(best, ["log", "topic", "instance"])
    by = Window.partitionBy("log", "motor")
    share = F.when((F.min("value").over(by) >= -0.01) & (F.max("value").over(by) <= 1.01) | (F.col("high") <= F.col("low")),
        F.col("value")).otherwise((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")))
    return control.unionByName(rows.select("log", "seq", "us", F.concat(F.lit("act.out"), "motor").alias("key"), share.alias("value")))


def fifo(logged: DataFrame) -> DataFrame:
    """(log, seq, us, key, value, dt): batched raw samples, one row each: time + i dt, value x scale, valid ones only."""
    fields = {"base": "timestamp_sample", "dt": "dt", "scale": "scale", "samples": "samples", **{f"{a}{i}": f"{a}[{i}]" for a in "xyz"
        for i in range(FIFO_WIDTH)}}
    out = None
    for topic, prefix in FIFO_TOPICS.items():
        rows = by_message(logged.filter("instance = 0"), topic, fields)
        for axis in "xyz":
            values = F.posexplode(F.slice(F.array(*[F.col(f"{axis}{i}") for i in range(FIFO_WIDTH)]), 1, F.greatest(F.lit(1), F.col("samples").cast("int"))))
            one = rows.filter("samples > 0").select("log", "seq", F.coalesce("base", "us").alias("t"), "dt", "scale", values.alias("i", "v"))
            one = one.select("log", "seq", (F.col("t") + F.col("i") * F.round("dt")).cast("long").alias("us"),
                F.lit(f"{prefix}.{axis}").alias("key"), (F.col("v") * F.col("scale")).alias("value"), "dt").filter("value IS NOT NULL")
            out = one if out is None else out.unionByName(one)
    return out


def low_pass(factor: int) -> np.ndarray:
    """The anti-alias filter of a decimation: 20 factor + 1 taps of a windowed sinc at the new Nyquist rate, with a gain of 1 at rest."""
    half = FIR_HALF * factor
    k = np.arange(-half, half + 1)
    taps = np.sinc(k / factor) * (0.54 + 0.46 * np.cos(np.pi * k / half))
    return taps / taps.sum()


def decimated(samples: DataFrame) -> DataFrame:
    """(log, seq, us, key, value): series above HIGH_RATE_HZ (by the median of their dt) with every factor-th sample, low-passed without delay.

    samples has dt beside these columns. The factor is the whole part of rate / HIGH_RATE_HZ. Outside its ends a series
    counts as 0; one of 27 factor samples or fewer keeps all of them, as it is. Series are scanned in ranges
    (scans.scanned): a range gets the samples around it that the filter needs, so no flight is held whole.
    """
    rates = quantiles(samples.filter("dt IS NOT NULL"), ["log", "key"], "dt", [0.5]).select("log", "key", F.get("q", F.lit(0)).alias("dt"))
    rate = F.when(F.col("dt") > 0, 1e6 / F.col("dt")).otherwise(F.lit(0.0))
    sizes = samples.groupBy("log", "key").agg(F.count(F.lit(1)).alias("n"))
    rates = rates.join(sizes, ["log", "key"]).select("log", "key", F.when((rate > HIGH_RATE_HZ) & (F.col("n") > SHORTEST * F.floor(rate / HIGH_RATE_HZ)),
        F.floor(rate / HIGH_RATE_HZ)).otherwise(1).cast("int").alias("factor"))
    rates = stored(rates)
    halo = FIR_HALF * (rates.agg(F.max("factor")).first()[0] or 1)  # samples that a range tells its neighbours
    rows = samples.join(rates, ["log", "key"], "left").select("log", "key", "us", "seq", "value", F.coalesce("factor", F.lit(1)).alias("factor"))

    def summary(piece: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
        x = piece["value"].to_numpy(float)
        return len(x), x[:halo], x[-halo:]

    def combine(one: tuple, other: tuple) -> tuple:
        return one[0] + other[0], np.concatenate([one[1], other[1]])[:halo], np.concatenate([one[2], other[2]])[-halo:]

    def run(piece: pd.DataFrame, before: tuple | None, after: tuple | None) -> pd.DataFrame:
        factor = int(piece["factor"].iloc[0])
        own = piece[["log", "seq", "us", "key", "value"]]
        if factor == 1:
            return own
        half, x = FIR_HALF * factor, piece["value"].to_numpy(float)
        left, right = np.zeros(half), np.zeros(half)
        if before:
            left[half - min(half, len(before[2])) :] = before[2][-half:]
        if after:
            right[: min(half, len(after[1]))] = after[1][:half]
        smooth = np.convolve(np.concatenate([left, x, right]), low_pass(factor), "valid")
        at = np.arange((-(before[0] if before else 0)) % factor, len(x), factor)
        return own.iloc[at].assign(value=smooth[at])

    return scanned(rows, ["log", "key"], ["us", "seq"], summary, combine, run, "log string, seq long, us long, key string, value double")


def release(code: Column, branch: Column) -> Column:
    """Firmware release from its packed number: major.minor.patch, kind, branch."""
    n = code.cast("long")
    part = lambda shift: F.shiftright(n, shift).bitwiseAND(255).cast("string")
    kind = n.bitwiseAND(255)
    label = F.when(kind == 255, "").when(kind >= 192, " rc").when(kind >= 128, " beta").when(kind >= 64, " alpha").otherwise(" dev")
    return F.when(n != 0, F.concat(part(24), F.lit("."), part(16), F.lit("."), part(8), label, F.when(branch.isNotNull() & (branch != ""),
        F.concat(F.lit(" ("), branch, F.lit(")"))).otherwise("")))


def provenance(logged: DataFrame) -> DataFrame:
    """One row per log: firmware, release, airframe, whether it looks simulated and why, UTC start in microseconds.

    The start comes from the clock at boot, else from the first three-dimensional fix wound back to the log's start;
    dates before 2015 are clocks that were never set.
    """
    info = lambda name, c: F.max(F.when((F.col("topic") == INFO) & (F.col("field") == name), F.col(c)))
    param = lambda name: F.max(F.when((F.col("topic") == PARAMETER) & (F.col("field") == name), F.col("value")))
    banner = F.min_by("text", F.when((F.col("topic") == TEXT)
        & F.col("text").rlike(r"^\s*(ArduCopter|ArduPlane|ArduRover|ArduSub|ArduPilot|APM)\b"), F.col("seq")))
    data = ~F.col("topic").startswith("$")
    out = logged.groupBy("log").agg(
        F.coalesce(info("ver_sw", "text"), F.trim(banner)).alias("firmware"),
        release(info("ver_sw_release", "value"), info("ver_sw_branch", "text")).alias("release"),
        F.coalesce(param("SYS_AUTOSTART"), param("FRAME_CLASS")).cast("int").cast("string").alias("airframe"),
        F.coalesce(param("SYS_HITL"), F.lit(0.0)).alias("hitl"),
        param("SYS_AUTOSTART").alias("autostart"),
        F.bool_or((F.col("topic") == PARAMETER) & F.col("field").startswith("SIM_")).alias("sim"),
        F.bool_or(F.coalesce((((F.col("topic") == INFO) & (F.col("field") == "sys_name")) | (F.col("topic") == TEXT))
            & F.upper("text").contains("SITL"), F.lit(False))).alias("sitl"),
        info("boot_time_utc_us", "value").alias("boot"),
        F.coalesce(info("start_us", "value"), F.min(F.when(data, F.col("us"))).cast("double")).alias("start"),
    )
    fix = by_message(logged.filter("instance = 0"), "vehicle_gps_position", {"utc": "time_utc_usec",
        "fix": "fix_type"}).filter("utc > 0 AND coalesce(fix, 3) >= 3").select("log", "us", "utc")
    gps = by_message(logged, "GPS", {"status": "Status", "week": "GWk", "ms": "GMS"}).filter("status >= 3 AND week > 0")
    gps = gps.select("log", "us", ((GPS_EPOCH_S + F.col("week") * WEEK_S + F.col("ms") / 1000 - LEAP_S) * 1e6).alias("utc"))
    first = fix.unionByName(gps).groupBy("log").agg(F.min_by(F.struct("us", "utc"), "us").alias("f"))
    out = out.join(first, "log", "left")
    real = lambda us: F.when(us >= EARLIEST_US, us.cast("long"))
    start = F.coalesce(real(F.when(F.col("boot") > 0, F.col("boot") + F.col("start"))), real(F.col("f.utc") - (F.col("f.us") - F.col("start"))))
    evidence = F.array_compact(F.array(F.when(F.col("hitl") != 0, "SYS_HITL set"), F.when((F.col("autostart") >= 10000)
        & (F.col("autostart") < 20000), "simulation airframe"), F.when(F.col("sim"), "has SIM_* parameters"), F.when(F.col("sitl"), "SITL named")))
    return out.select("log", "firmware", "release", "airframe", F.when(F.size(evidence) > 0, True).alias("looks_simulated"),
        evidence.alias("evidence"), start.alias("start_utc_us"))


def telemetry_points(logged: DataFrame) -> DataFrame:
    """One telemetry row for each position message of a stored stream, with the latest state of everything else.

    Headings are 0 to 360 degrees. A servo value of 0 clears the motor's command; an unknown battery level (-1) leaves
    the last one. flight_state follows the armed bit.
    """
    rows = logged.filter(~F.col("topic").startswith("$"))
    fields = [f.split() for _, _, f in STREAM_MESSAGES.values()]
    names = sorted({f for own in fields for f in own})
    marked = rows.withColumn("head", F.col("field").isin(*{own[0] for own in fields}).cast("int"))  # a message begins with its first field
    order = Window.partitionBy("log").orderBy("seq")
    wide = marked.withColumn("message", F.sum("head").over(order)).groupBy("log", "message").agg(F.min("seq").alias("seq"),
        F.min("us").alias("us"), F.first("topic").alias("topic"), *(F.max(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in names))
    at = lambda *topics: F.col("topic").isin(*topics)
    imu = at("SCALED_IMU", "RAW_IMU")
    roll, pitch, yaw = euler(F.col("q0"), F.col("q1"), F.col("q2"), F.col("q3"))
    held = {
        "armed": F.when(at("HEARTBEAT"), F.struct((F.col("base_mode").cast("int").bitwiseAND(128) != 0).alias("v"))),
        "roll": F.when(at("ATTITUDE"), F.struct(F.degrees("roll").alias("v"))),
        "pitch": F.when(at("ATTITUDE"), F.struct(F.degrees("pitch").alias("v"))),
        "yaw": F.when(at("ATTITUDE"), F.struct(F.pmod(F.degrees("yaw"), F.lit(360.0)).alias("v"))),
        "battery": F.when(at("SYS_STATUS", "BATTERY_STATUS") & (F.col("battery_remaining") >= 0), F.struct(F.col("battery_remaining").alias("v"))),
        "speed": F.when(at("VFR_HUD"), F.struct(F.col("groundspeed").alias("v"))),
        "desired_roll": F.when(at("ATTITUDE_TARGET"), F.struct(F.degrees(roll).alias("v"))),
        "desired_pitch": F.when(at("ATTITUDE_TARGET"), F.struct(F.degrees(pitch).alias("v"))),
        "desired_yaw": F.when(at("ATTITUDE_TARGET"), F.struct(F.pmod(F.degrees(yaw), F.lit(360.0)).alias("v"))),
        **{f"motor_pwm_{i}": F.when(at("SERVO_OUTPUT_RAW"), F.struct(F.nullif(F.col(f"servo{i}_raw"), F.lit(0.0)).alias("v"))) for i in range(1, 5)},
        **{f"accel_{a}": F.when(imu, F.struct((F.col(f"{a}acc") / 1000 * 9.81).alias("v"))) for a in "xyz"},
        **{f"gyro_{a}": F.when(imu, F.struct(F.degrees(F.col(f"{a}gyro") / 1000).alias("v"))) for a in "xyz"},
    }
    state = wide.select("log", "seq", "us", "topic", F.col("lat").alias("lat7"), F.col("lon").alias("lon7"),
        F.col("relative_alt").alias("alt_mm"), *(v.alias(n) for n, v in held.items()))
    filled = series.forward_filled(state, list(held), "log", ("seq",)).filter("topic = 'GLOBAL_POSITION_INT'")
    return filled.select(
        "log",
        F.timestamp_micros("us").alias("ts"),
        (F.col("lat7") / 1e7).alias("latitude"),
        (F.col("lon7") / 1e7).alias("longitude"),
        (F.col("alt_mm") / 1000).alias("altitude"),
        *(F.col(f"{n}.v").alias(n) for n in held if n != "armed"),
        F.when(F.coalesce(F.col("armed.v"), F.lit(False)), "flying").otherwise("idle").alias("flight_state"),
    )


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """Canonical signals of every log below a path."""
    return canonical(messages(log_files(spark, path)))
