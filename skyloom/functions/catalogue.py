"""Dimensions of the health rules: features, norms, change types and claims, as small tables that rules join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Features with subsystem and tier; the order is part of the rules.
FEATURES = (
    ("vib.metric_p50", "vibration", "R1"),
    ("vib.metric_p95", "vibration", "R1"),
    ("vib.clip_rate", "vibration", "R1"),
    ("vib.band_lo", "vibration", "R2"),
    ("vib.band_struct", "vibration", "R2"),
    ("vib.band_hi", "vibration", "R3"),
    ("vib.imbalance", "vibration", "R2"),
    ("act.sat_frac", "motors", "R1"),
    ("act.mean", "motors", "R1"),
    ("act.spread", "motors", "R1"),
    ("act.pattern", "motors", "R1"),
    ("act.hover", "motors", "R1"),
    ("pwr.r_cell", "power", "R2"),
    ("pwr.v_cell_min", "power", "R1"),
    ("pwr.sag_hover", "power", "R2"),
    ("pwr.cell_delta", "power", "R3"),
    ("trk.rate_rms.roll", "attitude", "R2"),
    ("trk.rate_rms.pitch", "attitude", "R2"),
    ("trk.rate_rms.yaw", "attitude", "R2"),
    ("trk.att_err_p95", "attitude", "R1"),
    ("gps.eph_p50", "position", "R1"),
    ("gps.nsats_p10", "position", "R1"),
    ("gps.sacc_p50", "position", "R1"),
    ("gps.noise", "position", "R2"),
    ("gps.jamming", "position", "R2"),
    ("est.test_ratio_p95", "position", "R1"),
)
# Least spread of a baseline in the feature's own units, and as a share of its median.
FLOORS = {
    "vib.metric_p50": 0.5,
    "vib.metric_p95": 0.5,
    "vib.clip_rate": 0.5,
    "vib.band_lo": 1.0,
    "vib.band_struct": 1.0,
    "vib.imbalance": 0.1,
    "act.sat_frac": 0.01,
    "act.spread": 0.02,
    "act.hover": 0.02,
    "pwr.r_cell": 0.5,
    "pwr.sag_hover": 0.02,
    "trk.rate_rms.roll": 0.05,
    "trk.rate_rms.pitch": 0.05,
    "trk.rate_rms.yaw": 0.05,
    "trk.att_err_p95": 0.5,
    "gps.eph_p50": 0.3,
    "gps.nsats_p10": 1.0,
    "gps.sacc_p50": 0.05,
    "gps.noise": 5.0,
    "gps.jamming": 5.0,
    "est.test_ratio_p95": 0.1,
}
RELATIVE_FLOORS = {"vib.metric_p50": 0.10, "vib.metric_p95": 0.10}
NOT_BASELINED = ("act.pattern", "act.mean", "pwr.v_cell_min")
LOWER_IS_WORSE = ("gps.nsats_p10",)
# Published lines by feature and autopilot: kind, whether lower is worse, healthy and bad edge, confidence.
NORMS = (
    ("vib.metric_p50", "px4", "context", False, 4.905, 9.81, "low"),
    ("vib.metric_p50", "ardupilot", "context", False, 30.0, 60.0, "medium"),
    ("gps.eph_p50", "px4", "gate", False, 3.0, None, "medium"),
    ("gps.nsats_p10", "px4", "gate", True, 6.0, None, "medium"),
    ("gps.sacc_p50", "px4", "gate", False, 0.5, None, "medium"),
    ("pwr.v_cell_min", "px4", "usage", True, 3.6, None, "high"),
)
# Prefixes and names of the features that a change resets.
RESETS = {
    "props": ("vib.", "act.", "pwr.sag_hover"),
    "motors_escs": ("vib.", "act.", "trk."),
    "pack": ("pwr.",),
    "frame": ("vib.", "act.", "pwr.", "trk.", "est."),
    "payload": ("act.hover", "act.sat_frac", "pwr.sag_hover", "trk."),
    "firmware_tuning": ("trk.", "vib.band_"),
    "gps": ("gps.", "est."),
}
# Watched parameters by pattern, and the change they signal.
WATCHED = (
    (r"^MC_(ROLL|PITCH|YAW)RATE_(P|I|D|K)$", "firmware_tuning"),
    (r"^MC_(ROLL|PITCH|YAW)_P$", "firmware_tuning"),
    (r"^IMU_(GYRO|ACCEL|DGYRO)_CUTOFF$", "firmware_tuning"),
    (r"^CA_ROTOR_COUNT$", "frame"),
    (r"^CA_ROTOR(\d+)_(PX|PY|PZ|AX|AY|AZ|KM|CT)$", "frame"),
    (r"^SYS_AUTOSTART$", "frame"),
    (r"^BAT1_(N_CELLS|CAPACITY)$", "pack"),
    (r"^firmware_version$", "firmware_tuning"),
)
# What a report never says, by kind of claim.
FORBIDDEN = (
    ("remaining life",
        r"remaining life|life (left|remaining)|lifespan|life expectancy|until (it )?fail|wear out in|\b\d+\s*(more )?(hours?|cycles?|flights?) (left|remaining)\b|end of (its )?life"),
    ("failed part",
        r"\b(is|has|was) (failed|failing|broken|dead|faulty|defective|bad)\b|\bfailed (motor|esc|prop|arm|cell)\b|\bfaulty\b|\bdiagnos|\bthe cause is\b|\bcaused by\b|\bdefinitely\b|\bcertainly\b"),
    ("battery capacity",
        r"state of health|\bsoh\b|\b\d+(\.\d+)?\s*%\s*(health|healthy|capacity|charge|battery|remaining|left)\b|remaining capacity|capacity (left|remaining|fade of)|\b(battery|pack) (health|life)\b|health\s*(of\s*|at\s*)?\d+(\.\d+)?\s*%"),
    ("rotor frequency", r"blade[- ]?pass|rotor (frequency|speed)|\b\d+(\.\d+)?\s*hz\b"),
    ("motor internals", r"\brpm\b|motor (temperature|temp|current)|esc (temperature|temp|current)"),
    ("safe to fly", r"safe to fly|\bunsafe\b|airworth|cleared (for|to) fl|fit to fly|ok to fly|certif"),
    ("other drones",
        r"better than (average|most|other)|worse than (average|most|other)|other drones|\bfleet\b|\baverage drone\b|than most drones|percentile|\b\d+\s+drones\b|\bmost drones\b|\b(typical|normal) drone\b"),
    ("wind", r"(due to|because of|caused by) (the )?wind|not (the )?wind|wind,? not|mechanical,? not wind"),
    ("unrecorded change", r"because you|since you (swapped|changed|replaced|installed)"),
    ("tuning quality",
        r"\b(pids?|tune|tuning|gains) (is|are) (bad|good|poor|wrong|off|great)\b|badly tuned|well tuned|poorly tuned|\bbad (tune|tuning|pids?)\b"),
    ("payload mass", r"\b\d+(\.\d+)?\s*(g|kg|grams?) (heavier|lighter|of payload)\b|payload (is|weighs|of) \d|heavier by \d"),
    ("equivalence", r"(same as|equivalent to|equals) (ardupilot|px4)|(ardupilot|px4) equivalent"),
    ("simulator", r"simulat|sim[- ]vs[- ]real|digital twin|fidelity"),
)


def features(spark: SparkSession) -> DataFrame:
    """feature_key, place, subsystem, tier, floor, relative_floor, lower_is_worse, baselined: 26 rows."""
    rows = [(k, i, sub, tier, FLOORS.get(k, 0.0), RELATIVE_FLOORS.get(k, 0.0), k in LOWER_IS_WORSE, k in FLOORS and k not in NOT_BASELINED)
        for i, (k, sub, tier) in enumerate(FEATURES)]
    return spark.createDataFrame(rows,
        "feature_key string, place int, subsystem string, tier string, floor double, relative_floor double, lower_is_worse boolean, baselined boolean")


def norms(spark: SparkSession, rows: tuple = NORMS) -> DataFrame:
    """feature_key, autopilot, norm_kind, norm_lower, healthy_edge, bad_edge, norm_confidence; pass other rows to change rules."""
    return spark.createDataFrame(list(rows),
        "feature_key string, autopilot string, norm_kind string, norm_lower boolean, healthy_edge double, bad_edge double, norm_confidence string")


def reset_features(spark: SparkSession) -> DataFrame:
    """(change_type, feature_key): what each change resets."""
    rows = [(change, k) for change, starts in RESETS.items() for k, _, _ in FEATURES if k.startswith(starts)]
    return spark.createDataFrame(rows, "change_type string, feature_key string")


def change_type(name: Column) -> Column:
    """The change that a watched parameter signals; null for any other parameter."""
    out = F.lit(None).cast("string")
    for pattern, change in reversed(WATCHED):
        out = F.when(name.rlike(pattern), change).otherwise(out)
    return out


def is_watched(name: Column) -> Column:
    """Whether change_type() tells a change for the name, by one pattern."""
    return name.rlike("|".join(f"(?:{pattern})" for pattern, _ in WATCHED))


def forbidden_claims(text: Column) -> Column:
    """Array of the kinds of claim that a text makes and a report may not."""
    found = F.array(*[F.when(text.rlike(f"(?i){pattern}"), kind) for kind, pattern in FORBIDDEN])
    return F.filter(found, lambda x: x.isNotNull())
