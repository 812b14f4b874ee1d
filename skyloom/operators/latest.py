"""Scans: pages and newest rows per vehicle, optional-field filters, owner scope. Each is one pass and at most one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(readings: DataFrame, limit: int, offset: int = 0, key: str = "drone_id", order: tuple[str, ...] = ("us", "reading_id")) -> DataFrame:
    """Rows offset + 1 to offset + limit of every key, newest first, with their place from 1.

    The rank filter also works before the shuffle: each task sends at most offset + limit rows of a key.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return readings.withColumn("place", place).filter(F.col("place").between(offset + 1, offset + limit))


def time_range(readings: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Readings between start and end, both included, each optional; the filter reaches the scan."""
    if start is not None:
        readings = readings.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        readings = readings.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return readings


def complete(readings: DataFrame, fields: list[str]) -> DataFrame:
    """Rows in which every field has a value."""
    return readings.dropna(subset=fields)


def any_of(readings: DataFrame, fields: list[str]) -> DataFrame:
    """Rows in which at least one field has a value."""
    return readings.dropna(how="all", subset=fields)


def owned_by(rows: DataFrame, owners: DataFrame, key: str, owner: Column) -> DataFrame:
    """Rows whose key belongs to an owner that satisfies the predicate: the row-level scope of every read."""
    return rows.join(owners.filter(owner).select(key), key, "left_semi")


def truthy(*fields: str) -> Column:
    """All fields have values other than 0; 0 counts as missing."""
    checks = [F.coalesce(F.col(f) != 0, F.lit(False)) for f in fields]
    out = checks[0]
    for check in checks[1:]:
        out = out & check
    return out


def current_and_history(readings: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Of the newest rows: the current one and those before it."""
    rows = newest(readings, limit)
    return rows.filter("place = 1"), rows.filter("place > 1")
