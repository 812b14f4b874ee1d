"""Log readers on synthesised files: what was written comes back as signals."""

from __future__ import annotations

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.sources import logs, signals


def ulog(seconds: int = 20, rate: int = 10) -> bytes:
    out = bytearray(logs.ULOG_MAGIC + b"\x01" + struct.pack("<Q", 1_000_000))

    def add(kind: bytes, payload: bytes) -> None:
        out.extend(struct.pack("<Hc", len(payload), kind) + payload)

    def keyed(kind: bytes, name: str, value) -> None:
        head = (f"char[{len(value)}] {name}" if isinstance(value, str) else f"float {name}" if isinstance(value, float)
            else f"uint64_t {name}" if value > 2**32 - 1 else f"uint32_t {name}").encode()
        body = value.encode() if isinstance(value, str) else struct.pack("<f" if isinstance(value, float) else "<Q" if value > 2**32 - 1 else "<I", value)
        add(kind, bytes([len(head)]) + head + body)

    formats = {
        "vehicle_attitude": "uint64_t timestamp;float[4] q;",
        "vehicle_local_position": "uint64_t timestamp;float x;float z;",
        "vehicle_imu_status": "uint64_t timestamp;uint32_t accel_device_id;float accel_vibration_metric;uint32_t[3] accel_clipping;uint8_t[4] _padding0;",
        "estimator_status": "uint64_t timestamp;uint32_t accel_device_id;float vel_test_ratio;",
        "estimator_selector_status": "uint64_t timestamp;uint8_t primary_instance;",
        "actuator_outputs": "uint64_t timestamp;float[16] output;",
        "vehicle_status": "uint64_t timestamp;uint8_t arming_state;",
        "inner": "float a;float b;",
        "cpuload": "uint64_t timestamp;float load;inner nested;",
        "sensor_accel_fifo": "uint64_t timestamp;uint64_t timestamp_sample;float dt;float scale;uint8_t samples;int16_t[32] x;int16_t[32] y;int16_t[32] z;",
    }
    for name, fields in formats.items():
        add(b"F", f"{name}:{fields}".encode())
    for name, value in {"sys_name": "PX4", "ver_sw": "abc", "ver_sw_release": 0x010E00FF, "ver_sw_branch": "main",
        "boot_time_utc_us": 1_700_000_000_000_000}.items():
        keyed(b"I", name, value)
    for name, value in {"CA_ROTOR_COUNT": 2.0, "PWM_MAIN_FUNC3": 101.0, "PWM_MAIN_FUNC1": 102.0, "PWM_MAIN_MIN3": 1100.0,
        "PWM_MAIN_MAX3": 1900.0, "SYS_AUTOSTART": 4001.0}.items():
        keyed(b"P", name, value)
    topics = [("vehicle_attitude", 0), ("vehicle_local_position", 0), ("vehicle_imu_status", 0), ("vehicle_imu_status", 1),
        ("estimator_status", 0), ("estimator_status", 1), ("estimator_selector_status", 0), ("actuator_outputs", 0), ("actuator_outputs",
        1), ("vehicle_status", 0), ("cpuload", 0), ("sensor_accel_fifo", 0)]
    for number, (name, instance) in enumerate(topics):
        add(b"A", struct.pack("<BH", instance, number) + name.encode())
    for k in range(seconds * rate):
        us = 1_000_000 + k * 1_000_000 // rate
        t = k / rate
        yaw = math.radians(170 + t * 2)  # passes half a turn
        add(b"D", struct.pack("<HQ4f", 0, us, math.cos(yaw / 2), 0, 0, math.sin(yaw / 2)))
        add(b"D", struct.pack("<HQ2f", 1, us, t, -t))
        for i, device in ((2, 11), (3, 22)):
            add(b"D", struct.pack("<HQIf3I", i, us, device, float(device), 0, 0, 0))
        for i, device in ((4, 11), (5, 22)):
            add(b"D", struct.pack("<HQIf", i, us, device, device / 100))
        add(b"D", struct.pack("<HQB", 6, us, 1))
        add(b"D", struct.pack("<HQ16f", 7, us, *[0.0] * 16))
        add(b"D", struct.pack("<HQ16f", 8, us, 1000 + t * 10, 0.0, 1500.0 + (k % 2) * 100, *[0.0] * 13))
        add(b"D", struct.pack("<HQB", 9, us, 2 if t > 5 else 1))
        add(b"D", struct.pack("<HQ3f", 10, us, 0.5, 1.0, 2.0))
        add(b"D", struct.pack("<HQQ2fB96h", 11, us, us, 250.0, 0.01, 3, *([100, 200, 300] + [0] * 29), *[0] * 64))
    return bytes(out)


def dataflash(seconds: int = 10) -> bytes:
    out = bytearray()

    def fmt(number: int, name: str, letters: str, labels: str) -> None:
        size = 3 + struct.calcsize("<" + "".join(logs.DATAFLASH_TYPES[c][0] for c in letters))
        out.extend(logs.DATAFLASH_HEAD + bytes([128]) + struct.pack("<BB4s16s64s", number, size, name.encode(), letters.encode(), labels.encode()))

    def row(number: int, layout: str, *values) -> None:
        out.extend(logs.DATAFLASH_HEAD + bytes([number]) + struct.pack("<" + layout, *values))

    fmt(1, "ATT", "Qccc", "TimeUS,Roll,Pitch,Yaw")
    fmt(2, "PARM", "QNf", "TimeUS,Name,Value")
    fmt(3, "RCOU", "QHH", "TimeUS,C1,C2")
    fmt(4, "MSG", "QZ", "TimeUS,Message")
    fmt(5, "GPS", "QBIHBf", "TimeUS,Status,GMS,GWk,NSats,HDop")
    row(4, "Q64s", 0, b"ArduCopter V4.3")
    row(2, "Q16sf", 0, b"SERVO2_FUNCTION", 33.0)
    for k in range(seconds * 10):
        us = 500_000 + k * 100_000
        row(1, "Qhhh", us, 100 * k, -50, 9000)
        row(3, "QHH", us, 1500, 1000 + 5 * k)
        row(5, "QBIHBf", us, 3, 1000 + k * 100, 2200, 9, 0.7)
    return bytes(out)


def stream() -> bytes:
    out = bytearray()

    def packet(us: int, number: int, payload: bytes, version: int = 2) -> None:
        if version == 1:
            out.extend(struct.pack(">Q", us) + bytes([0xFE, len(payload), 0, 1, 1, number]) + payload + b"\0\0")
        else:
            payload = payload.rstrip(b"\0") or b"\0"
            out.extend(struct.pack(">Q", us) + bytes([0xFD, len(payload), 0, 0, 0, 1, 1]) + number.to_bytes(3, "little") + payload + b"\0\0")

    t0 = 1_700_000_000_000_000
    position = lambda k: struct.pack("<IiiiihhhH", k, 476_000_000 + k, 85_000_000, 0, 1000 * k, 0, 0, 0, 0)
    packet(t0, 33, position(1))
    packet(t0 + 1, 0, struct.pack("<IBBBBB", 0, 2, 3, 128, 4, 3), version=1)
    packet(t0 + 2, 30, struct.pack("<Iffffff", 0, 0.1, -0.2, -math.pi / 2, 0, 0, 0))
    packet(t0 + 3, 1, struct.pack("<IIIHHhHHHHHHb", *[0] * 12, 77))
    packet(t0 + 4, 36, struct.pack("<IHHHHHHHHB", 0, 1500, 0, 1600, 1700, 0, 0, 0, 0, 0))
    packet(t0 + 5, 27, struct.pack("<Qhhhhhhhhh", 0, 0, 0, 1000, 1000, 0, 0, 0, 0, 0))
    packet(t0 + 6, 33, position(2))
    packet(t0 + 7, 1, struct.pack("<IIIHHhHHHHHHb", *[0] * 12, -1))
    packet(t0 + 8, 36, struct.pack("<IHHHHHHHHB", 0, 0, 0, 1600, 1700, 0, 0, 0, 0, 0))
    packet(t0 + 9, 33, position(3), version=1)
    return bytes(out)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("logs")
    whole = ulog()
    for name, data in {"a.ulg": whole, "cut.ulg": whole[: len(whole) * 6 // 10], "renamed.bin": whole, "b.bin": dataflash(),
        "c.tlog": stream(), "empty.ulg": b"", "garbage.bin": bytes(range(256)) * 4}.items():
        (path / name).write_bytes(data)
    return str(path)


@pytest.fixture(scope="module")
def logged(spark, folder):
    return logs.messages(logs.log_files(spark, folder)).cache()


def test_formats_by_mark_first(spark, folder):
    kinds = {r.log: r.format for r in logs.log_files(spark, folder).select("log", "format").collect()}
    assert kinds == {"a.ulg": "ulog", "cut.ulg": "ulog", "renamed.bin": "ulog", "b.bin": "dataflash", "c.tlog": "tlog", "garbage.bin": None}


def test_signals_of_a_self_described_log(logged):
    out = signals.canonical(logged.filter("log IN ('a.ulg', 'cut.ulg')"))
    rows = {}
    for r in out.orderBy("us").collect():
        rows.setdefault((r.log, r.key), []).append((r.us, r.value))
    own = {k: np.array(v) for (log, k), v in rows.items() if log == "a.ulg"}
    t = (own["alt.rel"][:, 0] - 1e6) / 1e6
    assert np.allclose(own["alt.rel"][:, 1], t, atol=1e-4) and len(t) == 200
    assert np.allclose(own["att.yaw"][:, 1] - own["att.yaw"][0, 1], np.radians(2 * t), atol=1e-4)
    assert set(own["vibe.x"][:, 1]) == {22.0} and np.allclose(own["est.vel_tr"][:, 1], 0.22)
    assert own["status.armed"][:, 1].tolist() == [float(x > 5) for x in t]
    assert set(own["act.out0"][:, 1].round(6)) == {0.5, 0.625} and own["act.out1"][-1, 1] == pytest.approx(t[-1] * 10 / 1000, rel=1e-3)
    raw = signals.fifo(logged.filter("log = 'a.ulg'")).filter("key = 'fifo.accel.x'").orderBy("us").limit(3).collect()
    assert [(r.us, round(r.value, 6), r.dt) for r in raw] == [(1_000_000, 1.0, 250.0), (1_000_250, 2.0, 250.0), (1_000_500, 3.0, 250.0)]
    assert len(own["fifo.accel.x"]) == 600 // 8  # at 500 of 4,000 Hz
    assert "gps.eph" not in own
    assert 0 < len(rows["cut.ulg", "alt.rel"]) < 200
    assert logged.filter("log = 'cut.ulg' AND text = 'partial_parse_recovered'").count() == 1
    assert logged.filter("log = 'a.ulg' AND field = 'nested.b'").count() == 200


def test_signals_of_a_format_described_log(logged):
    rows = {}
    for r in signals.canonical(logged.filter("log = 'b.bin'")).orderBy("us").collect():
        rows.setdefault(r.key, []).append(r.value)
    assert np.allclose(rows["att.roll"], np.radians(np.arange(100)), atol=1e-9)
    assert rows["act.out0"] == pytest.approx([0.005 * k for k in range(100)]) and rows["gps.hdop"][0] == pytest.approx(0.7)


def test_provenance(logged):
    out = {r.log: r for r in signals.provenance(logged).collect()}
    assert (out["a.ulg"].firmware, out["a.ulg"].release, out["a.ulg"].airframe, out["a.ulg"].looks_simulated) == ("abc", "1.14.0 (main)", "4001", None)
    assert out["a.ulg"].start_utc_us == 1_700_000_001_000_000
    assert out["b.bin"].firmware == "ArduCopter V4.3" and out["b.bin"].start_utc_us == int((signals.GPS_EPOCH_S + 2200 * signals.WEEK_S + 1 - 18) * 1e6)


def test_telemetry_points_carry_the_latest_state(logged):
    out = signals.telemetry_points(logged.filter("log = 'c.tlog'")).orderBy("ts").collect()
    assert [(round(r.latitude, 7), r.altitude, r.flight_state) for r in out] == [(47.6000001, 1.0, "idle"), (47.6000002, 2.0, "flying"),
        (47.6000003, 3.0, "flying")]
    assert out[0].roll is None and out[1].yaw == pytest.approx(270.0) and out[1].battery == 77 and out[2].battery == 77
    assert (out[1].motor_pwm_1, out[1].motor_pwm_2, out[1].motor_pwm_3) == (1500.0, None, 1600.0) and out[2].motor_pwm_1 is None
    assert out[1].accel_z == pytest.approx(9.81) and out[1].gyro_x == pytest.approx(math.degrees(1))


def test_decimated_signals_are_the_closed_form(spark):
    """Samples of 4 kHz to 500 Hz, 5 kHz to 500 Hz, a slow and a short series: every factor-th sample of the filtered series, wherever ranges end."""
    rng = np.random.default_rng(7)
    series = {("a", "fifo.accel.x", 250.0): rng.normal(0, 1, 5003), ("a", "fifo.accel.y", 200.0): rng.normal(0, 1, 3001), ("b", "fifo.gyro.x", 2500.0): rng.normal(0, 1,
        400), ("b", "fifo.gyro.y", 250.0): rng.normal(0, 1, 27 * 8), ("c", "fifo.accel.x", 250.0): np.full(2000, 2.0)}
    rows = [(log, i // 10, int(i * dt), key, float(v), dt) for (log, key, dt), x in series.items() for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "log string, seq long, us long, key string, value double, dt double").repartition(6)
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        out = {}
        for r in signals.decimated(frame).collect():
            out.setdefault((r.log, r.key), []).append((r.us, r.value))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for (log, key, dt), x in series.items():
        factor = {250.0: 8, 200.0: 10}.get(dt, 1) if len(x) > 27 * 8 else 1
        got = sorted(out[log, key])
        assert [us for us, _ in got] == [int(i * dt) for i in range(0, len(x), factor)]
        if factor == 1:
            assert [v for _, v in got] == x.tolist()
            continue
        k = np.arange(-10 * factor, 10 * factor + 1)
        h = np.sinc(k / factor) / factor * np.hamming(len(k))
        h /= h.sum()
        true = [sum(h[j] * x[i - k[j]] for j in range(len(k)) if 0 <= i - k[j] < len(x)) for i in range(0, len(x), factor)]
        assert np.allclose([v for _, v in got], true, atol=1e-9)
    middle = [v for _, v in sorted(out["c", "fifo.accel.x"])][20:-20]
    assert np.allclose(middle, 2.0)  # a level stays
