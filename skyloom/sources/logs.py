"""Flight logs as a table of messages: one row for each field of each message, in file order.

A folder of logs is read with Spark's binary source, one file per row; decoding emits rows in batches, so only the file
itself is in memory. Large files are read in parts by the data source of split_logs.py. What messages mean is left to
DataFrame operators (signals.py).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGES = "log string, seq long, us long, topic string, instance int, field string, value double, text string"
#: Topics of rows that are not telemetry.
PARAMETER, INFO, WARNING, TEXT = "$parameter", "$info", "$warning", "$text"
#: Rows in an emitted batch.
BATCH = 50_000

# File marks; element types of both log formats; messages of the telemetry stream with their wire order.
ULOG_MAGIC, DATAFLASH_HEAD = b"ULog\x01\x12\x35", b"\xa3\x95"
ULOG_TYPES = {"int8_t": "b", "uint8_t": "B", "int16_t": "h", "uint16_t": "H", "int32_t": "i", "uint32_t": "I", "int64_t": "q",
    "uint64_t": "Q", "float": "f", "double": "d", "bool": "?", "char": "c"}
DATAFLASH_TYPES = {"a": ("32h", 1), "b": ("b", 1), "B": ("B", 1), "h": ("h", 1), "H": ("H", 1), "i": ("i", 1), "I": ("I", 1), "f": ("f", 1),
    "d": ("d", 1), "n": ("4s", 0), "N": ("16s", 0), "Z": ("64s", 0), "c": ("h", 0.01), "C": ("H", 0.01), "e": ("i", 0.01), "E": ("I",
    0.01), "L": ("i", 1e-7), "M": ("B", 1), "q": ("q", 1), "Q": ("Q", 1)}
STREAM_MESSAGES = {
    0: ("HEARTBEAT", "IBBBBB", "custom_mode type autopilot base_mode system_status version"),
    1: ("SYS_STATUS", "IIIHHhHHHHHHb", "present enabled health load voltage_battery current_battery drop_rate errors e1 e2 e3 e4 battery_remaining"),
    26: ("SCALED_IMU", "Ihhhhhhhhh", "time_boot_ms xacc yacc zacc xgyro ygyro zgyro xmag ymag zmag"),
    27: ("RAW_IMU", "Qhhhhhhhhh", "time_usec xacc yacc zacc xgyro ygyro zgyro xmag ymag zmag"),
    30: ("ATTITUDE", "Iffffff", "time_boot_ms roll pitch yaw rollspeed pitchspeed yawspeed"),
    33: ("GLOBAL_POSITION_INT", "IiiiihhhH", "time_boot_ms lat lon alt relative_alt vx vy vz hdg"),
    36: ("SERVO_OUTPUT_RAW", "IHHHHHHHHB", "time_usec servo1_raw servo2_raw servo3_raw servo4_raw servo5_raw servo6_raw servo7_raw servo8_raw port"),
    74: ("VFR_HUD", "ffffhH", "airspeed groundspeed alt climb heading throttle"),
    83: ("ATTITUDE_TARGET", "IffffffffB", "time_boot_ms q0 q1 q2 q3 roll_rate pitch_rate yaw_rate thrust type_mask"),
    116: ("SCALED_IMU", "Ihhhhhhhhh", "time_boot_ms xacc yacc zacc xgyro ygyro zgyro xmag ymag zmag"),
    129: ("SCALED_IMU", "Ihhhhhhhhh", "time_boot_ms xacc yacc zacc xgyro ygyro zgyro xmag ymag zmag"),
    147: ("BATTERY_STATUS", "iihHHHHHHHHHHhBBBb",
        "current_consumed energy_consumed temperature v1 v2 v3 v4 v5 v6 v7 v8 v9 v10 current_battery id function type battery_remaining"),
}


def log_format(content: Column, path: Column) -> Column:
    """ulog, dataflash, tlog or null: by the first bytes, and by the name only where there is no mark."""
    head = F.hex(F.substring(content, 1, 7))
    return F.when(head.startswith(ULOG_MAGIC.hex().upper()), "ulog").when(head.startswith(DATAFLASH_HEAD.hex().upper()),
        "dataflash").when(F.lower(path).endswith(".tlog"), "tlog")


def _text(data: bytes) -> str:
    return data.split(b"\0")[0].decode("utf-8", "replace")


class UlogDecoder:
    """Messages of a log with self-described formats; nested formats are flattened. Definitions come in as they stand in the file.

    wanted holds the topics whose payloads are decoded; None stands for all.
    """

    mark = ULOG_MAGIC
    first = 16

    def __init__(self, wanted: frozenset[str] | None = None):
        self.wanted = wanted
        self.formats: dict[str, list[tuple[str, int, str]]] = {}
        self.layouts: dict[str, tuple[struct.Struct, list[str]]] = {}
        self.topics: dict[int, tuple[str, int]] = {}

    def _flat(self, name: str, prefix: str = "") -> Iterator[tuple[str, str]]:
        for kind, count, field in self.formats[name]:
            for i in range(count):
                label = prefix + field + (f"[{i}]" if count > 1 else "")
                if kind in ULOG_TYPES:
                    yield (ULOG_TYPES[kind] if not field.startswith("_padding") else "x"), label
                else:
                    yield from self._flat(kind, label + ".")

    def layout(self, name: str) -> tuple[struct.Struct, list[str]]:
        if name not in self.layouts:
            parts = list(self._flat(name))
            while parts and parts[-1][0] == "x":  # trailing padding is not logged
                parts.pop()
            self.layouts[name] = struct.Struct("<" + "".join(c for c, _ in parts)), [n for c, n in parts if c != "x"]
        return self.layouts[name]

    @staticmethod
    def _typed(payload: bytes) -> tuple[str, float | None, str | None]:
        n = payload[0]
        kind, name = payload[1 : 1 + n].decode("utf-8", "replace").split(" ", 1)
        body = payload[1 + n :]
        if kind.startswith("char"):
            return name, None, _text(body)
        return name, float(struct.unpack_from("<" + ULOG_TYPES[kind], body)[0]), None

    def opening(self, data: bytes) -> Iterator[tuple]:
        """Rows of the file's first bytes."""
        start = struct.unpack_from("<Q", data, 8)[0] if len(data) >= 16 else 0
        yield start, INFO, 0, "start_us", float(start), None

    def length(self, data: bytes, at: int) -> int | None:
        """Bytes of the message at a place; None where even its head is cut."""
        return 3 + struct.unpack_from("<H", data, at)[0] if at + 3 <= len(data) else None

    def define(self, data: bytes, at: int, end: int) -> bool:
        """Takes up a format or a subscription; False for any other message."""
        kind, payload = data[at + 2], data[at + 3 : end]
        if kind == ord("F"):
            name, _, fields = payload.decode("utf-8", "replace").partition(":")
            own = []
            for part in filter(None, fields.split(";")):
                what, _, label = part.strip().partition(" ")
                base, _, count = what.partition("[")
                own.append((base, int(count.rstrip("]")) if count else 1, label))
            self.formats[name] = own
        elif kind == ord("A"):
            instance, number = struct.unpack_from("<BH", payload)
            self.topics[number] = (payload[3:].decode("utf-8", "replace"), instance)
        return kind in b"FA"

    def is_data(self, data: bytes, at: int) -> bool:
        return data[at + 2] == ord("D")

    def is_known(self, data: bytes, at: int) -> bool:
        return not self.is_data(data, at) or struct.unpack_from("<H", data, at + 3)[0] in self.topics

    def rows(self, data: bytes, at: int, end: int) -> Iterator[tuple]:
        try:
            if self.define(data, at, end):
                return
            kind = data[at + 2]
            if kind in b"IP":
                name, value, text = self._typed(data[at + 3 : end])
                yield 0, PARAMETER if kind == ord("P") else INFO, 0, name, value, text
            elif kind == ord("D"):
                topic, instance = self.topics[struct.unpack_from("<H", data, at + 3)[0]]
                if self.wanted is not None and topic not in self.wanted:
                    return
                shape, names = self.layout(topic)
                values = dict(zip(names, shape.unpack_from(data[at + 5 : end]), strict=True))
                us = values.pop("timestamp")
                for field, value in values.items():
                    if not isinstance(value, bytes):
                        yield us, topic, instance, field, float(value), None
        except (struct.error, KeyError, ValueError, IndexError):
            yield 0, WARNING, 0, "", None, "message_skipped"

    def plausible(self, data: bytes, at: int) -> bool:
        """Whether a whole message of a known kind may begin here."""
        kind, size = data[at + 2 : at + 3], struct.unpack_from("<H", data, at)[0]
        if kind == b"D":
            topic = self.topics.get(struct.unpack_from("<H", data, at + 3)[0]) if at + 5 <= len(data) else None
            try:
                return size > 10 and (topic is None or size == 2 + self.layout(topic[0])[0].size)
            except KeyError:
                return False
        return kind != b"" and kind in b"FIMPQAROSLCB" and size > 0

    def candidates(self, data: bytes, at: int) -> Iterator[int]:
        """Places from which a data message of a known topic may begin."""
        while (found := data.find(b"D", at + 2)) >= 0:
            at = found - 2
            if at + 5 <= len(data) and struct.unpack_from("<H", data, at + 3)[0] in self.topics:
                yield at
            at += 1


class DataflashDecoder:
    """Records of a log whose format messages describe the others; scaled integers come out in their units."""

    mark = DATAFLASH_HEAD
    first = 0
    FORMAT = 128

    def __init__(self, wanted: frozenset[str] | None = None):
        self.wanted = wanted
        self.formats: dict[int, tuple[str, struct.Struct, list[tuple[str, float]], int]] = {}
        self.us = 0

    def opening(self, data: bytes) -> Iterator[tuple]:
        return iter(())

    def length(self, data: bytes, at: int) -> int | None:
        if at + 3 > len(data):
            return None
        if data[at : at + 2] != DATAFLASH_HEAD:
            found = data.find(DATAFLASH_HEAD, at + 1)
            return (found if found >= 0 else len(data)) - at
        kind = data[at + 2]
        return 89 if kind == self.FORMAT else self.formats[kind][3] if kind in self.formats else 1

    def define(self, data: bytes, at: int, end: int) -> bool:
        if data[at : at + 2] != DATAFLASH_HEAD or data[at + 2] != self.FORMAT:
            return False
        number, length, name, letters, labels = struct.unpack_from("<BB4s16s64s", data, at + 3)
        letters = _text(letters)
        try:
            shape = struct.Struct("<" + "".join(DATAFLASH_TYPES[c][0] for c in letters if c != "a"))
            fields = list(zip(_text(labels).split(","), (DATAFLASH_TYPES[c][1] for c in letters), strict=False))
            if "a" not in letters and length >= 3 + shape.size:
                self.formats[number] = (_text(name), shape, fields, length)
        except (KeyError, struct.error):
            pass
        return True

    def is_data(self, data: bytes, at: int) -> bool:
        return data[at : at + 2] == DATAFLASH_HEAD and data[at + 2] != self.FORMAT

    def is_known(self, data: bytes, at: int) -> bool:
        return not self.is_data(data, at) or data[at + 2] in self.formats

    def rows(self, data: bytes, at: int, end: int) -> Iterator[tuple]:
        if data[at : at + 2] != DATAFLASH_HEAD or self.define(data, at, end) or data[at + 2] not in self.formats:
            return
        name, shape, fields, _ = self.formats[data[at + 2]]
        if self.wanted is not None and name not in self.wanted and name not in ("PARM", "MSG"):
            return
        row = {f: (_text(v) if isinstance(v, bytes) else v if scale == 1 else v * scale) for (f, scale), v in zip(fields,
            shape.unpack_from(data, at + 3), strict=True)}
        us = self.us = int(row.pop("TimeUS", self.us))
        if name == "PARM":
            yield us, PARAMETER, 0, row.get("Name"), float(row.get("Value", "nan")), None
        elif name == "MSG":
            yield us, TEXT, 0, "", None, row.get("Message")
        else:
            for field, value in row.items():
                if not isinstance(value, str):
                    yield us, name, 0, field, float(value), None

    def plausible(self, data: bytes, at: int) -> bool:
        return data[at : at + 2] == DATAFLASH_HEAD and at + 2 < len(data) and (data[at + 2] == self.FORMAT or data[at + 2] in self.formats)

    def candidates(self, data: bytes, at: int) -> Iterator[int]:
        while (at := data.find(DATAFLASH_HEAD, at)) >= 0:
            if self.is_data(data, at) and self.plausible(data, at):
                yield at
            at += 1


class StreamDecoder:
    """Packets of a stored telemetry stream, of both versions, each after its time in microseconds."""

    mark = b""
    first = 0
    EARLIEST, LATEST = 10**15, 10**16  # microseconds; between 2001 and 2286

    def __init__(self, wanted: frozenset[str] | None = None):
        self.wanted = wanted
        self.shapes = {k: (name, struct.Struct("<" + kinds), fields.split()) for k, (name, kinds, fields) in STREAM_MESSAGES.items()}

    def opening(self, data: bytes) -> Iterator[tuple]:
        return iter(())

    def length(self, data: bytes, at: int) -> int | None:
        if at + 16 > len(data):
            return None
        size = data[at + 9]
        if data[at + 8] == 0xFE:
            return 14 + size + 2
        return 18 + size + 2 + (13 if data[at + 10] & 1 else 0) if data[at + 8] == 0xFD else 1

    def define(self, data: bytes, at: int, end: int) -> bool:
        return False

    def is_data(self, data: bytes, at: int) -> bool:
        return data[at + 8] in (0xFE, 0xFD)

    def is_known(self, data: bytes, at: int) -> bool:
        return True

    def rows(self, data: bytes, at: int, end: int) -> Iterator[tuple]:
        if not self.is_data(data, at):
            return
        us, size = struct.unpack_from(">Q", data, at)[0], data[at + 9]
        number, body = (data[at + 13], at + 14) if data[at + 8] == 0xFE else (int.from_bytes(data[at + 15 : at + 18], "little"), at + 18)
        if number in self.shapes and (self.wanted is None or self.shapes[number][0] in self.wanted):
            name, shape, fields = self.shapes[number]
            payload = data[body : body + size][: shape.size].ljust(shape.size, b"\0")  # zeros at the end may be cut
            for field, value in zip(fields, shape.unpack(payload), strict=True):
                yield us, name, 0, field, float(value), None

    def plausible(self, data: bytes, at: int) -> bool:
        return at + 16 <= len(data) and self.is_data(data, at) and self.EARLIEST < struct.unpack_from(">Q", data, at)[0] < self.LATEST

    def candidates(self, data: bytes, at: int) -> Iterator[int]:
        for at in range(at, len(data) - 15):
            if data[at + 8] in (0xFE, 0xFD) and self.plausible(data, at):
                yield at


DECODERS = {"ulog": UlogDecoder, "dataflash": DataflashDecoder, "tlog": StreamDecoder}
#: A row's seq is its message's place in the file times this, plus its number within the message.
PLACES = 1 << 16


def decoded(decoder, data: bytes, at: int, stop: int, base: int = 0, last: bool = True) -> Iterator[tuple]:
    """(seq, us, topic, instance, field, value, text) of the messages that begin in data[at:stop]; data begins at base in its file.

    Of the last part of a file, a message that is cut gives a warning.
    """
    us = 0
    while at < stop:
        size = decoder.length(data, at)
        if size is None or at + size > len(data):
            if last and size is not None:
                yield (base + at) * PLACES, us, WARNING, 0, "", None, "partial_parse_recovered"
            return
        for i, row in enumerate(decoder.rows(data, at, at + size)):
            us = row[0]
            yield (base + at) * PLACES + i, *row
        at += size


def file_rows(kind: str, data: bytes) -> Iterator[tuple]:
    """All rows of a whole file, in file order."""
    decoder = DECODERS[kind]()
    for i, row in enumerate(decoder.opening(data)):
        yield i, *row
    yield from decoded(decoder, data, decoder.first, len(data))


_SCHEMA = pa.schema([("log", pa.string()), ("seq", pa.int64()), ("us", pa.int64()), ("topic", pa.string()), ("instance", pa.int32()), ("field", pa.string()),
    ("value", pa.float64()), ("text", pa.string())])


def in_batches(log: str, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of one log as Arrow batches with the columns of MESSAGES."""
    while held := list(islice(rows, BATCH)):
        columns = zip(*held, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([log] * len(held)), *(pa.array(c, t.type) for c, t in zip(columns, list(_SCHEMA)[1:], strict=True))], schema=_SCHEMA)


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """log (file name), format, length and content of every file below a path; format is null where it is none that is known.

    Spark passes over empty files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("log"), log_format(F.col("content"), F.col("path")).alias("format"), "length", "content")


def messages(files: DataFrame) -> DataFrame:
    """Messages of all files of a known format; unreadable parts give warning rows, never an exception."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for log, kind, content in zip(*(batch.column(i) for i in range(3)), strict=True):
                yield from in_batches(log.as_py(), file_rows(kind.as_py(), content.as_py()))

    return files.filter("format IS NOT NULL").select("log", "format", "content").mapInArrow(decode, MESSAGES)
