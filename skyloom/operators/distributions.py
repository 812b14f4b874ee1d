"""Comparison of two recordings of a signal: errors, distribution distances and their reasons for having no value.

Rows are (pair, i, real, sim): sample i of both recordings. Everything is exact; nothing is collected per pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import quantiles, scanned, split

# Smoothing, bin limits, degeneracy and range floors.
EPSILON = 1e-6
MIN_BINS, MAX_BINS = 20, 200
RANGE_FLOOR, DEGENERATE_VARIANCE = 1e-9, 1e-12
KS_TERMS = 50


def both_sides(pairs: DataFrame) -> DataFrame:
    """(pair, side, value): 1 for real, 0 for sim."""
    return pairs.select("pair", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("real").alias("value")),
        F.struct(F.lit(0).alias("side"), F.col("sim").alias("value")))).alias("x")).select("pair", "x.*")


def effective_samples(rows: DataFrame, key: str = "pair", value: str = "real", order: str = "i") -> DataFrame:
    """(key, n_eff): n (1 - phi) / (1 + phi) with the lag-1 autocorrelation phi; null if n < 3, no variance or phi at 1."""
    by = Window.partitionBy(key)
    centred = rows.select(key, order, (F.col(value) - F.avg(value).over(by)).alias("x"))
    centred = centred.withColumn("next", F.lead("x").over(by.orderBy(order, "x")))
    sums = centred.groupBy(key).agg(F.count("x").alias("n"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("next")).alias("xy"))
    phi = F.try_divide("xy", "xx")
    fine = (F.col("n") >= 3) & (F.col("xx") > DEGENERATE_VARIANCE) & (phi < 1 - 1e-12)
    return sums.select(key, F.when(fine, F.col("n") * (1 - phi) / (1 + phi)).alias("n_eff"))


def bin_edges(sides: DataFrame) -> DataFrame:
    """(pair, lo, hi, bins): bins of width 2 IQR n^(-1/3) over both sides together, within limits; sqrt(n) where IQR is 0."""
    found = quantiles(sides.select("pair", "value"), ["pair"], "value", [0.0, 0.25, 0.75, 1.0])
    s = found.select("pair", F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(3)).alias("hi"), "n", F.slice("q", 2, 2).alias("q"))
    iqr = F.col("q")[1] - F.col("q")[0]
    wide = F.ceil(F.round((F.col("hi") - F.col("lo")) / (2 * iqr * F.pow(F.col("n").cast("double"), F.lit(-1.0 / 3))), 9))
    raw = F.when(iqr > 0, wide).otherwise(F.ceil(F.sqrt("n")))
    bins = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(MAX_BINS), F.greatest(F.lit(MIN_BINS), raw))).cast("int")
    return s.select("pair", "lo", "hi", bins.alias("bins"))


def histograms(sides: DataFrame, edges: DataFrame) -> DataFrame:
    """(pair, bin, p, q): smoothed shares of real and sim in each bin; the last bin is closed. Pairs without range are absent."""
    edges = edges.filter("bins IS NOT NULL")
    place = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")), F.col("bins") - 1).cast("int")
    counts = sides.join(edges, "pair").groupBy("pair", place.alias("bin")).agg(F.count_if(F.col("side") == 1).alias("a"),
        F.count_if(F.col("side") == 0).alias("b"))
    every = edges.select("pair", "bins", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    totals = Window.partitionBy("pair")
    filled = every.join(counts, ["pair", "bin"], "left").select("pair", "bin", "bins", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b",
        F.lit(0)).alias("b"))
    share = lambda c: (F.col(c) + EPSILON) / (F.sum(c).over(totals) + F.col("bins") * EPSILON)
    return filled.select("pair", "bin", share("a").alias("p"), share("b").alias("q"))


def divergences(shares: DataFrame) -> DataFrame:
    """(pair, bins, kl_bits, jsd_bits, psi): KL of real against sim and JSD in bits, PSI with natural logarithms."""
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2
    return shares.groupBy("pair").agg(
        F.count(F.lit(1)).cast("int").alias("bins"),
        F.sum(p * F.log2(p / q)).alias("kl_bits"),
        F.sum((p * F.log2(p / m) + q * F.log2(q / m)) / 2).alias("jsd_bits"),
        F.sum((p - q) * F.log(p / q)).alias("psi"),
    )


def distances(sides: DataFrame) -> DataFrame:
    """(pair, wasserstein, ks, ks_pvalue): both from the two step functions along the values; ties move together.

    Pairs that a task can hold are walked in a window. Of larger ones (scans.split), equal values are counted first; the
    counts are then scanned in order (scans.scanned), so a pair may have any number of rows. Null values don't count.
    Distances are null if a side has no value. The p-value is the asymptotic one. At these sizes it says nothing about
    significance.
    """
    plain, large = split(sides.filter("value IS NOT NULL").select(F.col("pair").alias("pair"), "side", "value"), "pair")
    out = _walked(plain)
    if large is not None:
        out = out.unionByName(_scanned_distances(large).coalesce(1))  # few rows
    x2 = F.col("ks") * F.col("ks") * F.col("n") * F.col("m") / (F.col("n") + F.col("m"))
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(KS_TERMS)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * x2))
    return out.select("pair", "wasserstein", "ks", F.when(x2 < 0.04, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), terms))).alias("ks_pvalue"))


def _walked(rows: DataFrame) -> DataFrame:
    """(pair, wasserstein, ks, n, m) of pairs (pair, side, value) that a task can hold; of equal values, the last one has the gap."""
    by = Window.partitionBy("pair")
    order = by.orderBy("value")
    real = (F.col("side") == 1).cast("long")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("pair", F.sum(real).over(running).alias("a"), F.row_number().over(order).alias("i"), F.sum(real).over(by).alias("n"),
        F.count(F.lit(1)).over(by).alias("rows"), F.col("value"), F.lead("value").over(order).alias("after"))
    rows = rows.withColumn("m", F.col("rows") - F.col("n")).filter(F.col("after").isNull() | (F.col("after") != F.col("value")))
    gap = F.abs(F.try_divide("a", "n") - F.try_divide(F.col("i") - F.col("a"), F.col("m")))
    step = F.coalesce(F.col("after") - F.col("value"), F.lit(0.0))
    return rows.select("pair", (gap * step).alias("area"), gap.alias("most"), "n", "m").groupBy("pair").agg(F.nanvl(F.sum("area"), F.lit(None)).alias("wasserstein"),
        F.max("most").alias("ks"), F.max("n").alias("n"), F.max("m").alias("m"))


def _scanned_distances(sides: DataFrame) -> DataFrame:
    """(pair, wasserstein, ks, n, m) of pairs of any size."""
    counted = sides.groupBy("pair", "value").agg(F.count_if(F.col("side") == 1).alias("a"), F.count_if(F.col("side") == 0).alias("b"))

    def summary(piece: pd.DataFrame) -> tuple[int, int, float]:
        return int(piece["a"].sum()), int(piece["b"].sum()), float(piece["value"].iloc[0])

    def walk(piece: pd.DataFrame, before: tuple | None, after: tuple | None) -> list[tuple]:
        a, b = (piece[c].to_numpy().cumsum() + (before[i] if before else 0) for i, c in enumerate("ab"))
        n, m = (int(x[-1]) + (after[i] if after else 0) for i, x in enumerate((a, b)))
        values = piece["value"].to_numpy(float)
        steps = np.diff(values, append=after[2] if after else values[-1])
        gap = np.abs(a / n - b / m) if n and m else np.full(len(a), np.nan)
        return [(piece["pair"].iat[0], float(gap @ steps), float(gap.max()), n, m)]

    found = scanned(counted, ["pair"], ["value"], summary, lambda x, y: (x[0] + y[0], x[1] + y[1], x[2]), walk,
        f"pair {dict(sides.dtypes)['pair']}, area double, most double, n long, m long")
    return found.groupBy("pair").agg(F.sum(F.nanvl("area", F.lit(None))).alias("wasserstein"), F.max(F.nanvl("most", F.lit(None))).alias("ks"), F.max("n").alias("n"),
        F.max("m").alias("m"))


def or_reason(value: Column, *reasons: tuple[Column, str]) -> tuple[Column, Column]:
    """(value or null, reason or null): the first condition that holds gives the reason."""
    reason = F.lit(None).cast("string")
    for condition, name in reversed(reasons):
        reason = F.when(condition, name).otherwise(reason)
    return F.when(reason.isNull(), value), reason


def compare(pairs: DataFrame) -> DataFrame:
    """One row for each pair of recordings: errors, variance ratio, divergences, distances, n_eff, and reasons for nulls.

    Of samples with one i, the smaller counts as first. Samples with a null or non-finite side don't take part.
    """
    rows = pairs.filter(F.col("real").isNotNull() & F.col("sim").isNotNull() & ~F.isnan("real") & ~F.isnan("sim"))
    error = F.col("sim") - F.col("real")
    stats = rows.groupBy("pair").agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg("sim") - F.avg("real")).alias("bias"),
        (F.max("real") - F.min("real")).alias("range"),
        F.when(F.count("real") > 1, F.var_samp("real")).otherwise(0.0).alias("var_real"),
        F.when(F.count("real") > 1, F.var_samp("sim")).otherwise(0.0).alias("var_sim"),
        F.covar_samp("real", "sim").alias("covar"),
    )
    sides = both_sides(rows)
    out = stats.join(effective_samples(rows), "pair", "left").join(divergences(histograms(sides, bin_edges(sides))), "pair",
        "left").join(distances(sides), "pair", "left")
    flat_real, flat_sim = F.col("var_real") < DEGENERATE_VARIANCE, F.col("var_sim") < DEGENERATE_VARIANCE
    flat = flat_real | flat_sim
    short = F.col("range") < RANGE_FLOOR
    ratio = F.col("var_sim") / F.col("var_real")
    nrmse_range, range_reason = or_reason(F.col("rmse") / F.col("range"), (short, "range_below_floor"))
    vr, vr_reason = or_reason(ratio, (flat_real, "real_variance_degenerate"), (flat_sim, "sim_variance_degenerate"))
    return out.select(
        "pair",
        "n",
        "rmse",
        "bias",
        nrmse_range.alias("nrmse_range"),
        range_reason.alias("nrmse_range_reason"),
        F.when(~flat_real, F.col("rmse") / F.sqrt("var_real")).alias("nrmse_sigma"),
        F.when(~flat, F.col("covar") / F.sqrt(F.col("var_real") * F.col("var_sim"))).alias("pearson_r"),
        vr.alias("variance_ratio"),
        F.when(~flat, F.log2(ratio)).alias("variance_ratio_log2"),
        vr_reason.alias("variance_ratio_reason"),
        *(F.when(~flat, F.col(c)).alias(c) for c in ("bins", "kl_bits", "jsd_bits", "psi", "wasserstein", "ks", "ks_pvalue")),
        F.when(~flat & ~short, F.col("wasserstein") / F.col("range")).alias("wasserstein_normalised"),
        "n_eff",
        flat.alias("degenerate"),
    )


def resources(samples: DataFrame, key: str = "key") -> DataFrame:
    """(key, mean, p95, reason): load figures, reported and never scored; a key without values has a reason."""
    out = samples.groupBy(key).agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.95)).alias("p95"), F.count("value").alias("n"))
    return out.select(key, "mean", "p95", F.when(F.col("n") == 0, "topic_absent").alias("reason"))
