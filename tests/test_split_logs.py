"""Logs read in ranges give the rows of the whole file, whatever the ranges; topics that nobody asks for are not decoded."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F
from test_logs import dataflash, stream, ulog

from skyloom.sources import logs, signals, split_logs


def ranges(path, size, split):
    return [split_logs.Range(str(path), size, lo, min(size, lo + split)) for lo in range(0, size, split)]


def late_topic() -> bytes:
    """A log in which a topic begins after most data, with text and parameter messages in between."""
    out = bytearray(ulog(60))
    add = lambda kind, payload: out.extend(struct.pack("<Hc", len(payload), kind) + payload)
    add(b"A", struct.pack("<BH", 1, 40) + b"cpuload")
    for k in range(3000):
        add(b"D", struct.pack("<HQ3f", 40, 70_000_000 + k, k, 1.0, 2.0))
        if k % 50 == 0:
            add(b"P", bytes([9]) + b"float P_X" + struct.pack("<f", k))
            add(b"L", b"6" + struct.pack("<Q", k) + b"some text, DDDD")
    return bytes(out)


def files():
    noisy = bytearray(dataflash(30))
    noisy[9_000:9_000] = b"\x00\xa3\x95 not a record \xa3"
    return {"a.ulg": ulog(120), "late.ulg": late_topic(), "cut.ulg": ulog(60)[:-37], "b.bin": dataflash(32), "noisy.bin": bytes(noisy), "c.tlog": stream() * 300}


@pytest.mark.parametrize("split", [4_000, 37_777, 1 << 20])
def test_ranges_give_the_rows_of_the_whole_file(tmp_path, monkeypatch, split):
    monkeypatch.setattr(split_logs, "BEYOND", 2_000)
    for name, data in files().items():
        (tmp_path / name).write_bytes(data)
        parts = ranges(tmp_path / name, len(data), split)
        found = [list(split_logs.range_rows(p)) for p in parts]
        whole = list(logs.file_rows(split_logs.format_of(data[:16], name), data))
        assert [r for rows in found for r in rows] == whole, name
        assert len(parts) == 1 or sum(bool(rows) for rows in found) > len(parts) // 2


def test_a_large_log_is_read_by_many_tasks_without_decoding_the_rest(tmp_path):
    head, one = ulog(0), bytearray()
    for i in (11, 11, 10, 11):
        payload = struct.pack("<HQ3f", 10, 5, 0.5, 1.0, 2.0) if i == 10 else struct.pack("<HQQ2fB96h", 11, 5, 5, 250.0, 0.01, 3, *range(96))
        one += struct.pack("<Hc", len(payload), b"D") + payload
    data = head + bytes(one) * (60_000_000 // len(one))
    path = tmp_path / "large.ulg"
    path.write_bytes(data)
    parts = ranges(path, len(data), split_logs.SPLIT_BYTES)
    rows = [sum(1 for r in split_logs.range_rows(p, frozenset(["cpuload"])) if r[2] == "cpuload") for p in parts]
    assert len(parts) == 4 and min(rows) > 0 and sum(rows) == 3 * (60_000_000 // len(one))


def test_payloads_of_other_topics_are_not_looked_at():
    data = ulog(5)
    damaged = data.replace(b"cpuload:uint64_t timestamp;float load", b"cpuload:uint64_t timestamp;fl0at load")
    skipped = lambda wanted: sum(r[2] == logs.WARNING for r in logs.decoded(logs.UlogDecoder(wanted), damaged, 16, len(damaged)))
    assert skipped(None) == 50 and skipped(frozenset(["vehicle_status"])) == 0


def test_the_source_reads_folders_and_takes_filters(spark, tmp_path):
    for name, data in {**files(), "empty.ulg": b"", "garbage.bin": bytes(range(256)) * 40}.items():
        (tmp_path / name).write_bytes(data)
    whole = logs.messages(logs.log_files(spark, str(tmp_path)))
    split = split_logs.split_messages(spark, str(tmp_path), split_bytes=50_000)
    assert split.rdd.getNumPartitions() > 10 and split.columns == whole.columns
    assert split.exceptAll(whole).isEmpty() and whole.exceptAll(split).isEmpty()
    some = split_logs.split_messages(spark, str(tmp_path), 50_000, ["cpuload"])
    assert {r.topic for r in some.select("topic").distinct().collect()} <= {"cpuload", *split_logs.ALWAYS}
    assert some.filter("topic = 'cpuload'").count() == whole.filter("topic = 'cpuload'").count()
    pushed = split_logs.split_messages(spark, str(tmp_path), 50_000).filter("topic IN ('ATT', 'RCOU') AND log = 'b.bin'")
    assert pushed.count() == whole.filter("topic IN ('ATT', 'RCOU') AND log = 'b.bin'").count() > 0
    reader = split_logs.FlightLogReader({"path": str(tmp_path), "splitBytes": "50000"})
    list(reader.pushFilters([split_logs.EqualTo(("log",), "b.bin"), split_logs.In(("topic",), ("ATT", "RCOU"))]))
    assert {p.path.rsplit("/", 1)[-1] for p in reader.partitions()} == {"b.bin"} and reader.pushed == {"ATT", "RCOU"}
    assert split_logs.split_messages(spark, str(tmp_path / "empty.ulg")).count() == 0


def test_signals_of_split_logs(spark, tmp_path):
    (tmp_path / "a.ulg").write_bytes(ulog(20))
    split = signals.canonical(split_logs.split_messages(spark, str(tmp_path), 9_000).cache())
    whole = signals.canonical(logs.messages(logs.log_files(spark, str(tmp_path))).cache())
    key = lambda f: {(r.log, r.key, r.us, round(r.value, 9)) for r in f.collect()}
    assert key(split) == key(whole) and split.select(F.countDistinct("key")).first()[0] > 10
