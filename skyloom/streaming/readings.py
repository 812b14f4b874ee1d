"""Streams of readings: sources, windows, sessions, live filters, and delivery to watchers.

A stream has the columns of a batch table with ts as a time stamp with zone, on which watermarks work. Batch queries see
late rows in order; a stream drops what comes later than its watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.kalman import ACCELERATION_STD, MEASUREMENT_STD, RESET_GAP_S, altitude_filter


def readings_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream; each file is processed once per checkpoint."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def simulated(spark: SparkSession, vehicles: int, rows_per_second: int = 10) -> DataFrame:
    """A generator of readings on the rate source: headings sway, speeds and battery follow from row numbers."""
    n = F.col("value")
    step = (n / vehicles).cast("long")
    return (
        spark.readStream.format("rate")
        .option("rowsPerSecond", rows_per_second)
        .load()
        .select(
            (n % vehicles).alias("drone_id"),
            n.alias("reading_id"),
            F.col("timestamp").alias("ts"),
            (20 + 10 * F.sin(step / 15.0)).alias("altitude"),
            F.greatest(F.lit(0.0), 100 - step * 0.05).alias("battery"),
            F.least(F.lit(15.0), F.greatest(F.lit(2.0), 8.5 + 6.5 * F.sin(step / 7.0 + n % vehicles))).alias("speed"),
            F.pmod(step * 4 * F.sin(step / 3.0), F.lit(360.0)).alias("heading"),
        )
    )


def owned_stream(stream: DataFrame, owners: DataFrame, owner_id: int) -> DataFrame:
    """Rows of the owner's vehicles only: each micro-batch is joined with the static table of (drone_id, owner_id)."""
    return stream.join(owners.filter(F.col("owner_id") == owner_id).select("drone_id"), "drone_id", "left_semi")


def deduplicated(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each reading once, by vehicle and reading id; state is dropped behind the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["drone_id", "reading_id"])


def counts(stream: DataFrame, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Readings and mean altitude of each vehicle in tumbling windows."""
    return stream.withWatermark("ts", delay).groupBy("drone_id", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"),
        F.avg("altitude").alias("altitude")).select("drone_id", F.col("w.start").alias("start"), "n", "altitude")


def sliding_means(stream: DataFrame, width: str = "10 minutes", slide: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Mean battery of each vehicle in sliding windows."""
    return stream.withWatermark("ts", delay).groupBy("drone_id", F.window("ts", width,
        slide).alias("w")).agg(F.avg("battery").alias("battery")).select("drone_id", F.col("w.start").alias("start"), "battery")


def live_sessions(stream: DataFrame, gap: str = "45 seconds", delay: str = "10 minutes") -> DataFrame:
    """Sessions that the watermark has closed: start, seconds between first and last reading, readings. A gap of exactly `gap` does not split."""
    w = F.session_window("ts", gap)
    out = stream.withWatermark("ts", delay).groupBy("drone_id", w.alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("last"),
        F.count(F.lit(1)).alias("readings"))
    return out.select("drone_id", "start", (F.unix_micros("last") - F.unix_micros("start")).alias("length_us"), "readings")


FILTER_OUTPUT = "drone_id long, reading_id long, us long, value double, filtered double, velocity double, innovation double, nis double"


def live_filter(stream: DataFrame, value: str = "altitude", reset_gap_s: float = RESET_GAP_S, second_us: float = 1e6,
    delay: str = "10 minutes", forget_s: float = 3600.0) -> DataFrame:
    """The altitude filter on a stream: its state goes from one micro-batch to the next.

    Readings of a micro-batch are put in order first. One that is not later than the vehicle's last is left out, as is a
    null; a gap above reset_gap_s starts anew. A vehicle that is silent for forget_s of event time loses its state.
    """
    q, r = ACCELERATION_STD**2, MEASUREMENT_STD**2

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, kept = (state.get[0], list(state.get[1:])) if state.exists else (None, None)
        advance = altitude_filter(q, r)(kept)
        rows = pd.concat(list(batches)).dropna(subset=["value"]).sort_values(["us", "reading_id"])
        out = []
        for one in rows.itertuples():
            dt = None if last is None else (one.us - last) / second_us
            if dt is not None and dt <= 0:
                continue
            last = one.us
            x, v, _, innovation, nis = advance(one.value, None if dt is None or dt > reset_gap_s else dt)
            out.append((key[0], one.reading_id, one.us, one.value, x, v, innovation, nis))
        if last is not None:
            state.update((int(last), *advance.state()))
            state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + int(forget_s * 1000))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FILTER_OUTPUT.split(", ")])

    rows = stream.withWatermark("ts", delay).select("drone_id", "reading_id", "ts", F.unix_micros("ts").alias("us"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("drone_id").applyInPandasWithState(step, FILTER_OUTPUT,
        "last long, x double, v double, a double, b double, c double", "append", GroupStateTimeout.EventTimeTimeout)


def newest_connection(stream: DataFrame) -> DataFrame:
    """The newest connection of each vehicle and user, as an updating table: a newer one replaces the older."""
    return stream.groupBy("drone_id", "user_id").agg(F.max_by("connection", "ts").alias("connection"), F.max("ts").alias("ts"))


def deliver(stream: DataFrame, watchers: Callable[[], DataFrame], send: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts delivery: each micro-batch, joined with the vehicles being watched just then, goes to send(rows, batch id) once."""

    def each(batch: DataFrame, batch_id: int) -> None:
        send(batch.join(watchers().select("drone_id").distinct(), "drone_id", "left_semi"), batch_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Writes what there is to a Parquet table, exactly once, and ends; the checkpoint takes the place of job states."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation",
        checkpoint).outputMode(mode).trigger(availableNow=True).start()
