"""Large flight logs in parts: a data source whose tasks read byte ranges of a file and find the first record in theirs.

A range begins at the first place at or after its offset from which a data record of a known kind and size is followed by
CHAIN plausible ones, and ends where the next range begins by the same rule. So each record is read by one task, and the
rows are those of the whole-file decoder. Where a file is damaged, a range recovers at its first whole record.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from .logs import DATAFLASH_HEAD, DECODERS, INFO, MESSAGES, PARAMETER, TEXT, ULOG_MAGIC, WARNING, decoded, in_batches

#: Bytes of a range, and so many more that a task reads at first to find where the next one begins.
SPLIT_BYTES, BEYOND = 16 << 20, 256 << 10
#: Plausible records that follow the first of a range.
CHAIN = 8
#: Bytes that are read at once where definitions are looked for.
HEAD_STEP = 1 << 20
#: Rows with these topics are there whatever topics are wanted.
ALWAYS = frozenset([PARAMETER, INFO, WARNING, TEXT])


@dataclass
class Range(InputPartition):
    path: str
    size: int
    lo: int
    hi: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def format_of(head: bytes, path: str) -> str | None:
    """As logs.log_format: by the first bytes, and by the name only where there is no mark."""
    if head.startswith(ULOG_MAGIC):
        return "ulog"
    return "dataflash" if head.startswith(DATAFLASH_HEAD) else "tlog" if path.lower().endswith(".tlog") else None


def _definitions(decoder, file, size: int, until: int | None) -> None:
    """Takes up definitions from the start of the file: those before the first data record, or all before a place."""
    data, base, at = file.read_at(min(size, HEAD_STEP), 0), 0, decoder.first
    while until is None or at < until:
        n = decoder.length(data, at - base)
        if n is None or at + n > base + len(data):
            if base + len(data) >= size:
                return
            data, base = file.read_at(min(size - at, HEAD_STEP + (n or 0)), at), at
            continue
        if not decoder.define(data, at - base, at - base + n) and until is None and decoder.is_data(data, at - base) and decoder.is_known(data, at - base):
            return
        at += n


def first_record(decoder, data: bytes, at: int, ended: bool) -> int | None:
    """The place in data of the first record at or after `at`; len(data) if there is none in the file's rest, None if data is too short to tell."""
    for place in decoder.candidates(data, at):
        here, n = place, 0
        while n <= CHAIN:
            size = decoder.length(data, here)
            if size is not None and not decoder.plausible(data, here):
                break
            if size is None or here + size > len(data):
                return place if ended else None  # the file ends, perhaps within a record
            here, n = here + size, n + 1
        else:
            return place
    return len(data) if ended else None


def range_rows(part: Range, wanted: frozenset[str] | None = None) -> Iterator[tuple]:
    """Rows of the records that begin in a range."""
    where, path = _opened(part.path)
    with where.open_input_file(path) as file:
        head = file.read_at(min(part.size, 16), 0)
        kind = format_of(head, part.path)
        if kind is None:
            return
        decoder = DECODERS[kind](wanted)
        _definitions(decoder, file, part.size, None)
        beyond = BEYOND
        while True:
            end = min(part.size, part.hi + beyond)
            data, ended = file.read_at(end - part.lo, part.lo), end == part.size
            start = decoder.first if part.lo == 0 else first_record(decoder, data, 0, ended)
            stop = len(data) if part.hi >= part.size else first_record(decoder, data, part.hi - part.lo, ended)
            if start is not None and stop is not None:
                break
            beyond *= 4
        if part.lo == 0:
            for i, row in enumerate(decoder.opening(head)):
                yield i, *row
        elif _unknown(decoder, data, start, stop):  # a topic that begins later in the file: the definitions before this range are read
            _definitions(decoder, file, part.size, part.lo + start)
        yield from decoded(decoder, data, start, stop, part.lo, part.hi >= part.size)


def _unknown(decoder, data: bytes, at: int, stop: int) -> bool:
    while at < stop:
        size = decoder.length(data, at)
        if size is None or at + size > len(data):
            return False
        if not decoder.is_known(data, at):
            return True
        at += size
    return False


class FlightLogs(DataSource):
    """Messages of all logs below a path. Options: path, splitBytes, and topics (comma-separated; all without it).

    Filters on topic and log (equal to, or one of, constants) are taken up: payloads of other topics are not decoded,
    and other files not opened. Paths are those that pyarrow's file systems reach; for others there is logs.messages().
    """

    @classmethod
    def name(cls) -> str:
        return "flightlogs"

    def schema(self) -> str:
        return MESSAGES

    def reader(self, schema: StructType) -> DataSourceReader:
        return FlightLogReader(self.options)


class FlightLogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))
        topics = options.get("topics")
        self.topics = None if topics is None else frozenset(filter(None, topics.split(",")))
        self.pushed: frozenset[str] | None = None
        self.logs: frozenset[str] | None = None

    def pushFilters(self, filters: list[Filter]):
        for one in filters:
            if isinstance(one, EqualTo | In) and one.attribute in (("topic",), ("log",)):
                values = frozenset([one.value] if isinstance(one, EqualTo) else one.value)
                if one.attribute == ("topic",):
                    self.pushed = values if self.pushed is None else self.pushed & values
                else:
                    self.logs = values if self.logs is None else self.logs & values
            yield one  # also evaluated by Spark: warnings and parameters come whatever topics are wanted

    def partitions(self) -> list[Range]:
        where, path = _opened(self.path)
        prefix = self.path.removesuffix(path) if self.path.endswith(path) else ""
        found = where.get_file_info(path)
        files = [found] if found.is_file else where.get_file_info(fs.FileSelector(path, recursive=True))
        out = []
        for f in sorted((f for f in files if f.is_file and f.size), key=lambda f: f.path):
            if self.logs is None or PurePosixPath(f.path).name in self.logs:
                out += [Range(prefix + f.path, f.size, lo, min(f.size, lo + self.split)) for lo in range(0, f.size, self.split)]
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.size:
            wanted = [x for x in (self.topics, self.pushed) if x is not None]
            yield from in_batches(PurePosixPath(part.path).name, range_rows(part, frozenset.intersection(*wanted) if wanted else None))


def split_messages(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, topics: list[str] | None = None) -> DataFrame:
    """Messages as of logs.messages(), each file read by as many tasks as it has ranges.

    With topics, only those are decoded, besides parameters, infos, texts and warnings; a filter on topic does the same.
    The session takes filters of Python sources up from now on, as the source needs it.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FlightLogs)
    reader = spark.read.format("flightlogs").option("splitBytes", split_bytes)
    return (reader if topics is None else reader.option("topics", ",".join(topics))).load(path)
