"""Spectra and lags: Welch densities, band power and its ratios, spectral distance, and bounded cross-correlation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bands in Hz (None: up to the Nyquist frequency), segment length, floor of a density, lag gate.
BANDS = (("motion", 0.0, 5.0), ("structure", 5.0, 20.0), ("rotor", 20.0, 100.0), ("noise_floor", 100.0, None))
SEGMENT, DENSITY_FLOOR = 1024, 1e-12
LAG_GATE = 0.3


def segment_length(n: Column) -> Column:
    """SEGMENT, or for shorter series the largest power of two up to n / 8, 8 at least; never more than n."""
    eighth = F.greatest(F.lit(8), F.floor(n / 8))
    own = F.pow(F.lit(2.0), F.floor(F.log2(eighth.cast("double")) + 1e-12)).cast("int")
    return F.least(F.when(n >= SEGMENT * 8, SEGMENT).otherwise(F.greatest(F.lit(8), own)), n).cast("int")


def _density(segments: pd.Series, rate: pd.Series) -> pd.Series:
    """One-sided density of each segment, its mean removed, under a periodic Hann window."""
    out = []
    for segment, fs in zip(segments, rate, strict=True):
        x = np.asarray(segment, float)
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(len(x)) / len(x))
        power = np.abs(np.fft.rfft((x - x.mean()) * window)) ** 2 / (fs * (window**2).sum())
        power[1 : None if len(x) % 2 else -1] *= 2
        out.append(power)
    return pd.Series(out)


def welch(series: DataFrame, rate: float, key: str = "key", order: str = "us") -> DataFrame:
    """(key, bin, hz, power): averaged densities of half-overlapping segments.

    A task never holds more than a segment: samples are dealt to their one or two segments, densities averaged by bin.
    """
    by = Window.partitionBy(key)
    rows = series.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    rows = rows.select(key, "value", (F.row_number().over(by.orderBy(order)) - 1).alias("i"), F.count(F.lit(1)).over(by).alias("n"))
    rows = rows.withColumn("length", segment_length(F.col("n"))).withColumn("step", F.col("length") - F.floor(F.col("length") / 2).cast("int"))
    at = F.floor(F.col("i") / F.col("step")).cast("int")
    last = F.floor((F.col("n") - F.col("length")) / F.col("step")).cast("int")
    rows = rows.withColumn("last", last).withColumn("segment", F.explode(F.array(at, at
        - 1))).filter("segment >= 0 AND segment <= last AND i < segment * step + length")
    segments = rows.groupBy(key, "segment", "length").agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("s"))
    power = F.pandas_udf(_density, "array<double>")(F.transform("s", lambda x: x["value"]), F.lit(rate))
    bins = segments.select(key, "length", F.posexplode(power).alias("bin", "power"))
    return bins.groupBy(key, "bin", "length").agg(F.avg("power").alias("power")).select(key, "bin", (F.col("bin") * rate
        / F.col("length")).alias("hz"), "power")


def averaged_density(rows: DataFrame, series: list[str], keys: list[str]) -> DataFrame:
    """(keys, bin, hz, power): densities of half-overlapping segments averaged over all series of a key.

    rows: (series columns, us, value, rate, length), of which rate and length are those of the key. Series shorter than
    a segment don't count.
    """
    by = Window.partitionBy(*series)
    placed = rows.select(*series, "rate", "length", "value", (F.row_number().over(by.orderBy("us")) - 1).alias("i"), F.count(F.lit(1)).over(by).alias("n"))
    step = F.floor(F.col("length") / 2).cast("int")
    placed = placed.filter(F.col("n") >= F.col("length")).withColumn("step", F.col("length") - step)
    at = F.floor(F.col("i") / F.col("step")).cast("int")
    last = F.floor((F.col("n") - F.col("length")) / F.col("step")).cast("int")
    dealt = placed.withColumn("last", last).withColumn("part", F.explode(F.array(at, at - 1))).filter("part >= 0 AND part <= last AND i < part * step + length")
    parts = dealt.groupBy(*series, "part", "rate", "length").agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("s"))  # one segment
    power = F.pandas_udf(_density, "array<double>")(F.transform("s", lambda x: x["value"]), F.col("rate"))
    bins = parts.select(*keys, "rate", "length", F.posexplode(power).alias("bin", "power"))
    mean = bins.groupBy(*keys, "rate", "length", "bin").agg(F.avg("power").alias("power"))
    return mean.select(*keys, "bin", (F.col("bin") * F.col("rate") / F.col("length")).alias("hz"), "power")


def log_distance(spectra: DataFrame, key: str = "pair") -> DataFrame:
    """(key, lsd_db): root mean square of 10 log10 of the ratio of two densities, both floored."""
    floored = lambda c: F.greatest(F.col(c), F.lit(DENSITY_FLOOR))
    db = 10 * F.log10(floored("real") / floored("sim"))
    return spectra.groupBy(key).agg(F.sqrt(F.avg(db * db)).alias("lsd_db"))


def centroid(spectra: DataFrame, power: str = "real", key: str = "pair") -> DataFrame:
    """(key, centroid_hz): null where there is no power."""
    total = F.sum(power)
    return spectra.groupBy(key).agg(F.when(total > 0, F.sum(F.col("hz") * F.col(power)) / total).alias("centroid_hz"))


def band_ratios(spectra: DataFrame, nyquist: float, cutoffs: DataFrame, key: str = "pair") -> DataFrame:
    """(key, band, ratio_db, reason, partial): power of sim over real in each band.

    spectra: (key, hz, real, sim); cutoffs: (key, cutoff_real, cutoff_sim), filter cutoffs in Hz, 0 or null for none.
    A band must lie under the Nyquist frequency; one that begins above a cutoff was filtered away; one that holds a
    cutoff is partial. Powers are trapezoids over the band's own bins.
    """
    names = F.array(*[F.struct(F.lit(n).alias("band"), F.lit(lo).alias("lo"), F.lit(float(hi or nyquist)).alias("hi"),
        F.lit(hi is not None).alias("closed")) for n, lo, hi in BANDS])
    bands = cutoffs.select(key, "cutoff_real", "cutoff_sim", F.explode(names).alias("b")).select(key, "cutoff_real", "cutoff_sim", "b.*")
    rows = spectra.join(bands.select(key, "band", "lo", "hi"), key).filter("hz >= lo AND hz < hi")
    by = Window.partitionBy(key, "band").orderBy("hz")
    width = F.col("hz") - F.lag("hz").over(by)
    area = lambda c: (width * (F.col(c) + F.lag(c).over(by)) / 2).alias(c)
    power = rows.select(key, "band", area("real"), area("sim")).groupBy(key, "band").agg(F.sum("real").alias("real"), F.sum("sim").alias("sim"))
    out = bands.join(power, [key, "band"], "left")
    cuts = [F.when(F.col(c) > 0, F.col(c)) for c in ("cutoff_real", "cutoff_sim")]
    any_cut = lambda test: F.coalesce(test(cuts[0]), F.lit(False)) | F.coalesce(test(cuts[1]), F.lit(False))
    reason = (
        F.when((F.col("lo") >= nyquist) | (F.col("closed") & (F.col("hi") > nyquist)), "band_above_nyquist")
        .when(any_cut(lambda c: c <= F.col("lo")), "band_above_antialiasing_cutoff")
        .when(~(F.coalesce(F.col("real") > 0, F.lit(False)) & F.coalesce(F.col("sim") > 0, F.lit(False))), "no_power_in_band")
    )
    partial = reason.isNull() & any_cut(lambda c: (c > F.col("lo")) & (c < F.col("hi")))
    return out.select(key, "band", F.when(reason.isNull(), 10 * F.log10(F.col("sim") / F.col("real"))).alias("ratio_db"),
        reason.alias("reason"), partial.alias("partial"))


def comparison(spectra: DataFrame, cutoffs: DataFrame, low_rate: DataFrame | None = None, key: str = "pair") -> DataFrame:
    """(key, lsd_db, centroid_real_hz, centroid_sim_hz, centroid_shift_hz, reason, cutoff_mismatch) of two densities.

    spectra: (key, hz, real, sim); cutoffs: (key, cutoff_real, cutoff_sim), 0 or null for none. Where the cutoffs differ,
    every figure rests on spectra that two filters shaped differently, and cutoff_mismatch says so. Without power on
    both sides there is no shift. Keys of low_rate have no figures, with that reason.
    """
    cut = lambda c: F.when(F.col(c) > 0, F.col(c))
    mismatch = cutoffs.select(key, (~cut("cutoff_real").eqNullSafe(cut("cutoff_sim"))).alias("cutoff_mismatch"))
    slow = (cutoffs.select(key).limit(0) if low_rate is None else low_rate.select(key)).withColumn("slow", F.lit(True))
    db = 10 * F.log10(F.greatest("real", F.lit(DENSITY_FLOOR)) / F.greatest("sim", F.lit(DENSITY_FLOOR)))
    middle = lambda c: F.when(F.sum(c) > 0, F.sum(F.col("hz") * F.col(c)) / F.sum(c))
    out = spectra.groupBy(key).agg(F.sqrt(F.avg(db * db)).alias("lsd_db"), middle("real").alias("centroid_real_hz"), middle("sim").alias("centroid_sim_hz"))
    out = mismatch.join(out, key, "left").join(slow, key, "left").withColumn("centroid_shift_hz", F.col("centroid_sim_hz") - F.col("centroid_real_hz"))
    reason = F.when(F.col("slow"), "low_rate").when(F.col("lsd_db").isNull(),
        "insufficient_samples").when(F.col("centroid_shift_hz").isNull(), "no_spectral_power")
    figures = [F.when(F.col("slow").isNull(), F.col(c)).alias(c) for c in ("lsd_db", "centroid_real_hz", "centroid_sim_hz", "centroid_shift_hz")]
    return out.select(key, *figures, reason.alias("reason"), "cutoff_mismatch")


def correlation_lags(a: Column, b: Column, most: int) -> Column:
    """Scores of lags -most to most of the first array against the second, normalised by both lengths after their means go.

    Only the lags asked for are computed, in the row that holds the arrays.
    """
    n = F.least(F.size(a), F.size(b))
    mean = lambda x: F.aggregate(F.slice(x, 1, n), F.lit(0.0), lambda s, v: s + v) / n
    centred = lambda x: F.transform(F.slice(x, 1, n), lambda v: v - mean(x))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    bound = F.transform(F.array(F.struct(centred(a).alias("a"), centred(b).alias("b"))), lambda x: F.struct(x["a"].alias("a"),
        x["b"].alias("b"), F.sqrt(dot(x["a"], x["a"]) * dot(x["b"], x["b"])).alias("norm")))

    def scores(x: Column) -> Column:
        shifted = lambda v, k: F.slice(v, k + 1, n)
        one = lambda k: F.when(k >= 0, dot(shifted(x["a"], F.greatest(k, F.lit(0))), x["b"])).otherwise(dot(x["a"], shifted(x["b"],
            F.greatest(-k, F.lit(0)))))
        return F.transform(F.sequence(F.lit(-most), F.lit(most)), lambda k: F.when(x["norm"] > 0, one(k) / x["norm"]).otherwise(0.0))

    return F.transform(bound, scores)[0]


def best_lag(scores: Column, most: int) -> tuple[Column, Column, Column]:
    """(lag, score, refined lag): the first highest score, and the vertex of the parabola through it and its neighbours."""
    peak = F.array_max(scores)
    at = F.array_position(scores, peak).cast("int")
    left, right = F.get(scores, at - 2), F.get(scores, at)
    bend = left - 2 * peak + right
    offset = F.when((bend != 0) & (F.abs((left - right) / (2 * bend)) <= 1), (left - right) / (2 * bend))
    lag = at - 1 - most
    return lag, peak, lag + F.coalesce(offset, F.lit(0.0))


def actuator_lag(real_lag: Column, real_score: Column, sim_lag: Column, sim_score: Column, rate: float) -> tuple[Column, Column]:
    """(delta in milliseconds or null, reason): lags read off pairs that hardly correlate are not reported."""
    weak = (real_score < LAG_GATE) | (sim_score < LAG_GATE)
    return F.when(~weak, (sim_lag - real_lag) / rate * 1000), F.when(weak, "lag_unreliable")
