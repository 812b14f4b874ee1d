"""Series of (key, us, value): cleaning, clock jumps, rates, grids, interpolation and runs.

Every operator works on all keys at once with windows partitioned by key, so a shuffle on the key serves them all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Share of bad values that draws a warning, backward step that cuts a clock, alignment and phase rules.
BAD_SHARE, CLOCK_JUMP_US = 0.05, 1_000_000
GRAVITY, TAKEOFF_EXCESS, TAKEOFF_S = 9.81, 1.0, 0.5
CLIMB_RATE, BODY_RATE = 0.5, 0.3
MIN_AIRBORNE_S, MIN_SEGMENT_S, MIN_STEADY_S = 60.0, 5.0, 30.0
PHASE_SAMPLES = 250


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < math.inf)


def cut_clock_jump(series: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """Series whose clock steps back by more than a second, in ingest order, keep the longer side of the first such step.

    Of equal sides the first stays. Others are unchanged.
    """
    by = Window.partitionBy(key)
    jump = F.col("us") - F.lag("us").over(by.orderBy(order)) < -CLOCK_JUMP_US
    rows = series.withColumn("jumps", jump).withColumn("at", F.min(F.when(F.col("jumps"), F.col(order))).over(by))
    head = F.col("at").isNull() | (F.col(order) < F.col("at"))
    rows = rows.withColumn("head", head).withColumn("heads", F.count_if("head").over(by)).withColumn("rows", F.count(F.lit(1)).over(by))
    keep_head = F.col("heads") * 2 >= F.col("rows")
    return rows.filter(F.col("at").isNull() | (F.col("head") == keep_head)).drop("jumps", "at", "head", "heads", "rows")


def clean(series: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """Finite values, one for each time (the first in ingest order), and whether more than BAD_SHARE of a series was bad."""
    rows = series.withColumn("ok", finite(F.col("value")))
    rows = rows.withColumn("noisy", F.avg((~F.col("ok")).cast("int")).over(Window.partitionBy(key)) > BAD_SHARE).filter("ok")
    first = F.row_number().over(Window.partitionBy(key, "us").orderBy(order))
    return rows.withColumn("first", first).filter("first = 1").drop("ok", "first")


def native_rate(series: DataFrame, key: str = "key") -> DataFrame:
    """(key, rate_hz, duration_s): a million over the median positive interval; null without one."""
    step = F.col("us") - F.lag("us").over(Window.partitionBy(key).orderBy("us"))
    rows = series.withColumn("step", step)
    median = F.percentile(F.when(F.col("step") > 0, F.col("step")), F.lit(0.5))
    return rows.groupBy(key).agg((1e6 / median).alias("rate_hz"), ((F.max("us") - F.min("us")) / 1e6).alias("duration_s"))


def at_times(samples: DataFrame, targets: DataFrame, key: str | list[str] = "key", hold: bool = False, clamp: bool = False, order: str = "us") -> DataFrame:
    """targets (key, us, ...) with the value of the series at their times: linear between samples, or the last one held.

    Outside the samples' span the value is null, or with clamp that of the nearest end. Both sides are merged in time
    order, each sample carrying the one after it, so one running window answers all targets of a key.
    """
    keys = [key] if isinstance(key, str) else key
    ends = Window.partitionBy(*keys)
    by = ends.orderBy("us")
    rows = samples.select(*keys, "us", F.struct(F.col("us").cast("double").alias("us"), F.col("value").cast("double").alias("v"),
        F.lead("us").over(by).cast("double").alias("us2"), F.lead("value").over(by).cast("double").alias("v2")).alias("s"))
    merged = rows.withColumn("side", F.lit(0)).unionByName(targets.withColumn("side", F.lit(1)), allowMissingColumns=True)
    running = ends.orderBy("us", "side").rowsBetween(Window.unboundedPreceding, 0)
    merged = merged.withColumn("left", F.last("s", ignorenulls=True).over(running))
    if clamp:
        merged = merged.withColumn("start", F.min(F.when(F.col("s").isNotNull(), F.struct(F.col("s.us").alias("us"), F.col("s.v").alias("v")))).over(ends))
    left, t = F.col("left"), F.col("us").cast("double")
    inside = left["v"] + (t - left["us"]) / (left["us2"] - left["us"]) * (left["v2"] - left["v"])
    end = left["v"] if clamp else F.when(left["us"] == t, left["v"])
    value = F.when(left["us2"].isNull(), end).otherwise(left["v"] if hold else inside)
    if clamp:
        value = F.coalesce(value, F.col("start.v"))
    return merged.withColumn("value", value).filter("side = 1").select(*targets.columns, "value")


def grid(samples: DataFrame, step_us: int, key: str = "key") -> DataFrame:
    """(key, i, us): a uniform grid from the first sample, max(2, round(span / step) + 1) points."""
    spans = samples.groupBy(key).agg(F.min("us").alias("t0"), F.max("us").alias("t1"))
    n = F.greatest(F.lit(2), F.round((F.col("t1") - F.col("t0")) / step_us).cast("int") + 1)
    points = spans.select(key, "t0", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    return points.select(key, "i", (F.col("t0") + F.col("i").cast("long") * step_us).alias("us"))


def on_grid(samples: DataFrame, step_us: int, key: str = "key", hold: bool = False) -> DataFrame:
    """(key, i, us, value): the series resampled; null past the last sample."""
    return at_times(samples, grid(samples, step_us, key), key, hold)


def runs(rows: DataFrame, flag: Column, key: str = "key", order: tuple[str, ...] = ("us",)) -> DataFrame:
    """(key, run, start_us, end_us, n, next_us): stretches of consecutive rows in which flag holds.

    next_us is the time of the first row after the stretch; where there is none, that of its last row.
    """
    by = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("place", F.row_number().over(by)).withColumn("after", F.coalesce(F.lead("us").over(by),
        F.col("us"))).filter(F.coalesce(flag, F.lit(False)))
    marked = marked.withColumn("run", F.col("place") - F.row_number().over(by))
    return marked.groupBy(key, "run").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n"),
        F.max("after").alias("next_us"))


def longest_run(rows: DataFrame, flag: Column, key: str = "key", order: tuple[str, ...] = ("us",)) -> DataFrame:
    """Each key's longest stretch up to the first row after it; of equal ones the first."""
    found = runs(rows, flag, key, order).withColumn("length_us", F.col("next_us") - F.col("start_us"))
    best = F.max_by(F.struct("start_us", "next_us", "n", "length_us"), F.struct("length_us", -F.col("start_us")))
    return found.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def steady_segments(rows: DataFrame, flag: Column, least_us: int, key: str = "key", order: tuple[str, ...] = ("us",)) -> DataFrame:
    """Stretches of at least least_us in which flag holds, numbered, with the running total before each."""
    return lasting(runs(rows, flag, key, order).drop("run", "next_us"), least_us, key)


def lasting(stretches: DataFrame, least_us: int, key: str = "key") -> DataFrame:
    """Those stretches (key, start_us, end_us, ...) that last at least least_us, numbered, with the running total before each."""
    found = stretches.withColumn("length_us", F.col("end_us") - F.col("start_us")).filter(F.col("length_us") >= least_us)
    by = Window.partitionBy(key).orderBy("start_us")
    before = F.coalesce(F.sum("length_us").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("segment", F.row_number().over(by)).withColumn("before_us", before)


def clipped(segments: DataFrame, most_us: int) -> DataFrame:
    """Segments cut so that together they last most_us: the first stretch of steady flight."""
    end = F.least("end_us", F.col("start_us") + most_us - F.col("before_us"))
    return segments.filter(F.col("before_us") < most_us).withColumn("end_us", end).withColumn("length_us", end - F.col("start_us"))


def phases(rows: DataFrame, rate: Column, threshold: float = CLIMB_RATE, least: int = PHASE_SAMPLES, key: str = "key") -> DataFrame:
    """(key, phase, n): climb above the threshold, descent below its negative, cruise between; small phases are left out."""
    phase = F.when(rate > threshold, "climb").when(rate < -threshold, "descent").otherwise("cruise")
    return rows.filter(rate.isNotNull()).groupBy(key, phase.alias("phase")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def first_lasting(rows: DataFrame, flag: Column, need: int, key: str = "key", order: tuple[str, ...] = ("us",)) -> DataFrame:
    """(key, us): the first row from which flag holds for `need` rows; keys without one are absent."""
    by = Window.partitionBy(key).orderBy(*order)
    ahead = by.rowsBetween(0, need - 1)
    held = (F.min(F.coalesce(flag, F.lit(False)).cast("int")).over(ahead) == 1) & (F.count(F.lit(1)).over(ahead) == need)
    return rows.withColumn("held", held).filter("held").groupBy(key).agg(F.min("us").alias("us"))


def anchor(armed: DataFrame, takeoff: DataFrame, first: DataFrame, key: str = "key") -> DataFrame:
    """(key, us, source): armed, else takeoff, else the first sample."""
    rows = first.select(key, F.col("us").alias("f")).join(armed.select(key, F.col("us").alias("a")), key, "left").join(takeoff.select(key,
        F.col("us").alias("t")), key, "left")
    source = F.when(F.col("a").isNotNull(), "armed").when(F.col("t").isNotNull(), "takeoff").otherwise("first_sample")
    return rows.select(key, F.coalesce("a", "t", "f").alias("us"), source.alias("source"))


def airborne_span(rows: DataFrame, anchors: DataFrame, above: float, key: str = "key") -> DataFrame:
    """(key, start_us, end_us, ground_only): first and last time above a height after the anchor; the whole span if none."""
    rows = rows.join(anchors.select(key, F.col("us").alias("anchor_us")), key).filter(F.col("us") >= F.col("anchor_us"))
    up = F.when(F.col("value") > above, F.col("us"))
    out = rows.groupBy(key).agg(F.min(up).alias("a"), F.max(up).alias("b"), F.min("us").alias("c"), F.max("us").alias("d"))
    return out.select(key, F.coalesce("a", "c").alias("start_us"), F.coalesce("b", "d").alias("end_us"), F.col("a").isNull().alias("ground_only"))


def variance_window(rows: DataFrame, width: int, key: str = "key", order: tuple[str, ...] = ("us",)) -> DataFrame:
    """(key, us, variance): where the `width` following samples vary most; of equal windows the first."""
    by = Window.partitionBy(key).orderBy(*order)
    ahead = by.rowsBetween(0, width - 1)
    out = rows.withColumn("variance", F.var_pop("value").over(ahead)).withColumn("n", F.count("value").over(ahead)).filter(F.col("n") == width)
    return out.groupBy(key).agg(F.max_by("us", F.struct(F.round("variance", 9), -F.col("us"))).alias("us"), F.max("variance").alias("variance"))


def unwrapped(rows: DataFrame, turn: float = 360.0, key: str = "key", order: tuple[str, ...] = ("us",)) -> DataFrame:
    """Adds unwrapped: the angle without jumps, each step taken the short way round."""
    by = Window.partitionBy(key).orderBy(*order)
    step = F.col("value") - F.lag("value").over(by)
    half = step + turn / 2
    short = half - turn * F.floor(half / turn) - turn / 2  # pmod() would take a step a rounding error beyond half a turn back to the other side
    rows = rows.withColumn("short", F.coalesce(short, F.col("value")))
    return rows.withColumn("unwrapped", F.sum("short").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("short")


def forward_filled(rows: DataFrame, fields: list[str], key: str = "key", order: tuple[str, ...] = ("us",)) -> DataFrame:
    """Each field's last known value at or before the row: the state of a message stream."""
    by = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({f: F.last(f, ignorenulls=True).over(by) for f in fields})


def counter_rate(rows: DataFrame, spans: DataFrame, key: str = "key") -> DataFrame:
    """(key, increase, per_minute, reason): growth of a counter between the last values at or before a span's ends.

    A counter that falls was reset: null with a reason. A span without values has a reason, too.
    """
    rows = rows.join(spans.select(key, "start_us", "end_us"), key)
    at = lambda bound: F.max_by("value", F.when(F.col("us") <= F.col(bound), F.col("us")))
    out = rows.groupBy(key).agg(at("start_us").alias("a"), at("end_us").alias("b"), (F.first("end_us") - F.first("start_us")).alias("span"))
    grown = F.col("b") - F.col("a")
    reason = F.when(F.col("a").isNull() | F.col("b").isNull(), "no_samples").when(grown < 0, "counter_reset")
    return out.select(key, F.when(reason.isNull(), grown).alias("increase"), F.when(reason.isNull() & (F.col("span") > 0), grown
        / (F.col("span") / 6e7)).alias("per_minute"), reason.alias("reason"))


def modal(rows: DataFrame, value: str, key: str = "key") -> DataFrame:
    """(key, value, n): the commonest value; of equal ones the smallest."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), value))
    return counts.withColumn("rank", rank).filter("rank = 1").drop("rank")
