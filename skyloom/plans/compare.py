"""Comparison and spectra over line items (prices before and after discount) and embeddings (as signals and densities)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distributions as D
from ..operators import spectral as P
from ..sources.tables import table
from .common import Plans, rounded
from .series import SERIES_SQL, signals

PLANS = Plans()

PAIRS_SQL = """pairs AS (SELECT l_suppkey AS pair, l_orderkey * 10 + l_linenumber AS i, l_extendedprice / 1000 AS real,
    CASE WHEN l_suppkey % 25 = 0 THEN 1.0 ELSE l_extendedprice * (1 - l_discount) * (1 + l_tax) / 1000 END AS sim FROM lineitem),
    sides AS (SELECT pair, 1 AS side, real AS value FROM pairs UNION ALL SELECT pair, 0, sim FROM pairs)"""


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    sim = F.when(F.col("l_suppkey") % 25 == 0, 1.0).otherwise(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")) / 1000)
    return table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("pair"), (F.col("l_orderkey") * 10
        + F.col("l_linenumber")).alias("i"), (F.col("l_extendedprice") / 1000).alias("real"), sim.alias("sim"))


NEFF_SQL = """c AS (SELECT pair, i, real - avg(real) OVER (PARTITION BY pair) AS x FROM pairs), c2 AS (SELECT pair, x, lead(x) OVER
    (PARTITION BY pair ORDER BY i, x) AS nx FROM c),
    neff AS (SELECT pair, CASE WHEN count(x) >= 3 AND sum(x * x) > 1e-12 AND sum(x * nx) / sum(x * x) < 1 - 1e-12 THEN count(x) * (1 - sum(x
        * nx) / sum(x * x)) / (1 + sum(x * nx) / sum(x * x)) END AS n_eff FROM c2 GROUP BY pair)"""
EDGES_SQL = """q AS (SELECT pair, min(value) AS lo, max(value) AS hi, count(value) AS n, quantile_cont(value, 0.75) - quantile_cont(value,
    0.25) AS iqr FROM sides GROUP BY pair),
    edges AS (SELECT pair, lo, hi, CASE WHEN hi > lo THEN CAST(least(200, greatest(20, CASE WHEN iqr > 0 THEN ceil(round((hi - lo) / (2 *
        iqr * pow(n, -1.0 / 3)), 9)) ELSE ceil(sqrt(n)) END)) AS INTEGER) END AS bins FROM q)"""
SHARES_SQL = """cnt AS (SELECT s.pair, CAST(least(floor((value - lo) / (hi - lo) * bins), bins - 1) AS INTEGER) AS bin, count(*) FILTER
    (WHERE side = 1) AS a, count(*) FILTER (WHERE side = 0) AS b FROM sides s JOIN edges e ON e.pair = s.pair WHERE bins IS NOT NULL GROUP BY ALL),
    every AS (SELECT pair, bins, CAST(unnest(range(0, bins)) AS INTEGER) AS bin FROM edges WHERE bins IS NOT NULL),
    f AS (SELECT e.pair, e.bin, bins, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM every e LEFT JOIN cnt c ON c.pair = e.pair AND c.bin = e.bin),
    shares AS (SELECT pair, bin, (a + 1e-6) / (sum(a) OVER (PARTITION BY pair) + bins * 1e-6) AS p, (b + 1e-6) / (sum(b) OVER (PARTITION BY
        pair) + bins * 1e-6) AS q FROM f),
    div AS (SELECT pair, CAST(count(*) AS INTEGER) AS bins, sum(p * log2(p / q)) AS kl_bits, sum((p * log2(2 * p / (p + q)) + q * log2(2 * q
        / (p + q))) / 2) AS jsd_bits, sum((p - q) * ln(p / q)) AS psi FROM shares GROUP BY pair)"""
DISTANCE_SQL = """g AS (SELECT pair, value, abs(sum(side) OVER u / (sum(side) OVER t)::DOUBLE - sum(1 - side) OVER u / (sum(1 - side) OVER
    t)::DOUBLE) AS gap, lead(value) OVER o - value AS step
        FROM sides WINDOW t AS (PARTITION BY pair), o AS (PARTITION BY pair ORDER BY value), u AS (PARTITION BY pair ORDER BY value RANGE
            BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    dist AS (SELECT pair, sum(gap * step) AS wasserstein, max(gap) AS ks FROM g GROUP BY pair)"""


@PLANS.add(f"WITH {PAIRS_SQL}, {NEFF_SQL} SELECT pair, round(n_eff, 4) AS n_eff FROM neff")
def effective_samples(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(D.effective_samples(pairs(spark, folder)), 4)


@PLANS.add(f"WITH {PAIRS_SQL}, {EDGES_SQL} SELECT pair, round(lo, 6) AS lo, round(hi, 6) AS hi, bins FROM edges")
def histogram_bins(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(D.bin_edges(D.both_sides(pairs(spark, folder))))


@PLANS.add(f"""WITH {PAIRS_SQL}, {EDGES_SQL}, {SHARES_SQL} SELECT pair, bins, round(kl_bits, 6) AS kl_bits, round(jsd_bits, 6) AS jsd_bits,
    round(psi, 6) AS psi FROM div""")
def histogram_divergence(spark: SparkSession, folder: str) -> DataFrame:
    sides = D.both_sides(pairs(spark, folder))
    return rounded(D.divergences(D.histograms(sides, D.bin_edges(sides))))


@PLANS.add(f"WITH {PAIRS_SQL}, {DISTANCE_SQL} SELECT pair, round(wasserstein, 6) AS wasserstein, round(ks, 9) AS ks FROM dist")
def ks_wasserstein(spark: SparkSession, folder: str) -> DataFrame:
    out = D.distances(D.both_sides(pairs(spark, folder)))
    return out.select("pair", F.round("wasserstein", 6).alias("wasserstein"), F.round("ks", 9).alias("ks"))


@PLANS.add(f"""WITH {PAIRS_SQL}, {NEFF_SQL}, {EDGES_SQL}, {SHARES_SQL}, {DISTANCE_SQL}, st AS (SELECT pair, count(*) AS n, sqrt(avg(pow(sim
    - real, 2))) AS rmse, avg(sim) - avg(real) AS bias, max(real) - min(real) AS rng, coalesce(var_samp(real), 0) AS vr, coalesce(var_samp(sim), 0) AS vs,
        CASE WHEN var_samp(real) > 0 AND var_samp(sim) > 0 THEN corr(real, sim) END AS r FROM pairs GROUP BY pair),
    x AS (SELECT *, vr < 1e-12 OR vs < 1e-12 AS flat, rng < 1e-9 AS short FROM st JOIN neff USING (pair) JOIN div USING (pair) JOIN dist USING (pair))
    SELECT pair, n, round(rmse, 5) AS rmse, round(bias, 5) AS bias, CASE WHEN NOT short THEN round(rmse / rng, 5) END AS nrmse_range, CASE
        WHEN short THEN 'range_below_floor' END AS nrmse_range_reason,
        CASE WHEN vr >= 1e-12 THEN round(rmse / sqrt(vr), 5) END AS nrmse_sigma, CASE WHEN NOT flat THEN round(r, 5) END AS pearson_r, CASE
            WHEN NOT flat THEN round(vs / vr, 5) END AS variance_ratio, CASE WHEN NOT flat THEN round(log2(vs / vr), 5) END AS variance_ratio_log2,
        CASE WHEN vr < 1e-12 THEN 'real_variance_degenerate' WHEN vs < 1e-12 THEN 'sim_variance_degenerate' END AS variance_ratio_reason,
            CASE WHEN NOT flat THEN bins END AS bins, CASE WHEN NOT flat THEN round(kl_bits, 5) END AS kl_bits,
        CASE WHEN NOT flat THEN round(jsd_bits, 5) END AS jsd_bits, CASE WHEN NOT flat THEN round(psi, 5) END AS psi, CASE WHEN NOT flat
            THEN round(wasserstein, 5) END AS wasserstein, CASE WHEN NOT flat THEN round(ks, 5) END AS ks,
        CASE WHEN NOT flat AND NOT short THEN round(wasserstein / rng, 5) END AS wasserstein_normalised, round(n_eff, 4) AS n_eff, flat AS degenerate FROM x""")
def compare_series(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(D.compare(pairs(spark, folder)).drop("ks_pvalue").withColumn("n_eff", F.round("n_eff", 4)), 5)


@PLANS.add("""SELECT l_suppkey AS key, round(avg(CASE WHEN l_suppkey % 30 <> 0 THEN l_quantity END), 6) AS mean, round(quantile_cont(CASE
    WHEN l_suppkey % 30 <> 0 THEN l_quantity END, 0.95), 6) AS p95, CASE WHEN l_suppkey % 30 = 0 THEN 'topic_absent' END AS reason FROM
    lineitem GROUP BY l_suppkey""")
def resource_panel(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("key"), F.when(F.col("l_suppkey") % 30 != 0, F.col("l_quantity")).alias("value"))
    return rounded(D.resources(rows))


VECTORS_SQL = "v AS (SELECT a.vec_id AS pair, CAST(a.embedding AS DOUBLE[]) AS a, CAST(b.embedding AS DOUBLE[]) AS b, a.label FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector with the one of the next id, as two recordings of a signal."""
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("pair"), F.col("embedding").cast("array<double>").alias("a"), "label")
    return rows.join(rows.select((F.col("pair") - 1).alias("pair"), F.col("a").alias("b")), "pair")


SCORES_SQL = f"""{VECTORS_SQL}, m AS (SELECT pair, [x - list_avg(a) FOR x IN a] AS a, [x - list_avg(b) FOR x IN b] AS b FROM v),
    k AS (SELECT pair, a, b, unnest(range(-5, 6)) AS lag FROM m),
    s AS (SELECT pair, lag, CASE WHEN lag >= 0 THEN list_inner_product(a[lag + 1:], b[:len(b) - lag]) ELSE list_inner_product(a[:len(a) +
        lag], b[1 - lag:]) END / sqrt(list_inner_product(a, a) * list_inner_product(b, b)) AS score FROM k)"""


@PLANS.add(f"""WITH {SCORES_SQL}, p AS (SELECT pair, arg_max(lag, (score, -lag)) AS lag, max(score) AS score FROM s GROUP BY pair),
    n AS (SELECT p.pair, p.lag, p.score, l.score AS ls, r.score AS rs, l.score - 2 * p.score + r.score AS bend FROM p LEFT JOIN s l ON
        l.pair = p.pair AND l.lag = p.lag - 1 LEFT JOIN s r ON r.pair = p.pair AND r.lag = p.lag + 1)
    SELECT pair, CAST(lag AS INTEGER) AS lag, round(score, 6) AS score, round(lag + coalesce(CASE WHEN bend <> 0 AND abs((ls - rs) / (2 *
        bend)) <= 1 THEN (ls - rs) / (2 * bend) END, 0), 5) AS refined FROM n""")
def correlation_lag(spark: SparkSession, folder: str) -> DataFrame:
    rows = vectors(spark, folder).withColumn("scores", P.correlation_lags(F.col("a"), F.col("b"), 5))
    lag, score, refined = P.best_lag(F.col("scores"), 5)
    return rows.select("pair", lag.alias("lag"), F.round(score, 6).alias("score"), F.round(refined, 5).alias("refined"))


@PLANS.add(f"""WITH {VECTORS_SQL}, w AS (SELECT pair, 0 AS side, a, b FROM v UNION ALL SELECT pair, 1, list_reverse(a), list_reverse(b) FROM v),
    m AS (SELECT pair, side, [x - list_avg(a) FOR x IN a] AS a, [x - list_avg(b) FOR x IN b] AS b FROM w), k AS (SELECT pair, side, a, b,
        unnest(range(-5, 6)) AS lag FROM m),
    s AS (SELECT pair, side, lag, CASE WHEN lag >= 0 THEN list_inner_product(a[lag + 1:], b[:len(b) - lag]) ELSE
        list_inner_product(a[:len(a) + lag], b[1 - lag:]) END / sqrt(list_inner_product(a, a) * list_inner_product(b, b)) AS score FROM k),
    p AS (SELECT pair, side, arg_max(lag, (score, -lag)) AS lag, max(score) AS score FROM s GROUP BY pair, side),
    n AS (SELECT p.pair, p.side, p.lag, p.score, l.score AS ls, r.score AS rs, l.score - 2 * p.score + r.score AS bend FROM p LEFT JOIN s l
        ON l.pair = p.pair AND l.side = p.side AND l.lag = p.lag - 1 LEFT JOIN s r ON r.pair = p.pair AND r.side = p.side AND r.lag = p.lag + 1),
    f AS (SELECT pair, side, score, lag + coalesce(CASE WHEN bend <> 0 AND abs((ls - rs) / (2 * bend)) <= 1 THEN (ls - rs) / (2 * bend) END, 0) AS lag FROM n)
    SELECT x.pair, CASE WHEN x.score >= 0.3 AND y.score >= 0.3 THEN round((y.lag - x.lag) / 50 * 1000, 4) END AS delta_ms, CASE WHEN x.score
        < 0.3 OR y.score < 0.3 THEN 'lag_unreliable' END AS reason FROM f x JOIN f y ON y.pair = x.pair AND x.side = 0 AND y.side = 1""")
def actuator_lag(spark: SparkSession, folder: str) -> DataFrame:
    """Lag of the reversed signals against the plain ones, in milliseconds at 50 Hz."""
    rows = vectors(spark, folder)
    real = P.correlation_lags(F.col("a"), F.col("b"), 5)
    sim = P.correlation_lags(F.reverse("a"), F.reverse("b"), 5)
    rows = rows.select("pair", real.alias("r"), sim.alias("s"))
    (_, real_score, real_lag), (_, sim_score, sim_lag) = P.best_lag(F.col("r"), 5), P.best_lag(F.col("s"), 5)
    delta, reason = P.actuator_lag(real_lag, real_score, sim_lag, sim_score, 50.0)
    return rounded(rows.select("pair", delta.alias("delta_ms"), reason.alias("reason")), 4)


SPECTRA_SQL = f"{VECTORS_SQL}, sp AS (SELECT pair, (i - 1) * 2.0 AS hz, a[i] * a[i] AS real, b[i] * b[i] AS sim, label FROM v, (SELECT unnest(range(1, 65)) AS i))"


def spectra(spark: SparkSession, folder: str) -> DataFrame:
    """Squares of both vectors as densities at every 2 Hz."""
    rows = vectors(spark, folder).select("pair", "label", F.posexplode(F.arrays_zip("a", "b")).alias("i", "x"))
    return rows.select("pair", "label", (F.col("i") * 2.0).alias("hz"), (F.col("x.a") * F.col("x.a")).alias("real"), (F.col("x.b") * F.col("x.b")).alias("sim"))


@PLANS.add(f"""WITH {SPECTRA_SQL} SELECT pair, round(sqrt(avg(pow(10 * log10(greatest(real, 1e-12) / greatest(sim, 1e-12)), 2))), 5) AS
    lsd_db FROM sp GROUP BY pair""")
def log_spectral_distance(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(P.log_distance(spectra(spark, folder)), 5)


@PLANS.add(f"WITH {SPECTRA_SQL} SELECT pair, round(sum(hz * real) / sum(real), 5) AS centroid_hz FROM sp GROUP BY pair")
def spectral_centroid(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(P.centroid(spectra(spark, folder)), 5)


@PLANS.add(f"""WITH {SPECTRA_SQL}, b AS (SELECT pair, label * 30.0 AS cut, band, lo, hi, closed FROM (SELECT DISTINCT pair, label FROM sp),
    (VALUES ('motion', 0.0, 5.0, true), ('structure', 5.0, 20.0, true), ('rotor', 20.0, 100.0, true), ('noise_floor', 100.0, 126.0, false))
    t(band, lo, hi, closed)),
    w AS (SELECT sp.pair, band, (hz - lag(hz) OVER o) * (real + lag(real) OVER o) / 2 AS r, (hz - lag(hz) OVER o) * (sim + lag(sim) OVER o)
        / 2 AS s FROM sp JOIN b ON b.pair = sp.pair AND hz >= lo AND hz < hi WINDOW o AS (PARTITION BY sp.pair, band ORDER BY hz)),
    p AS (SELECT pair, band, sum(r) AS r, sum(s) AS s FROM w GROUP BY pair, band), x AS (SELECT b.*, r, s, CASE WHEN cut > 0 AND cut <= lo
        THEN 'band_above_antialiasing_cutoff' WHEN r > 0 AND s > 0 THEN NULL ELSE 'no_power_in_band' END AS reason FROM b LEFT JOIN p USING (pair, band))
    SELECT pair, band, CASE WHEN reason IS NULL THEN round(10 * log10(s / r), 5) END AS ratio_db, reason, reason IS NULL AND cut > lo AND
        cut < hi AS partial FROM x""")
def band_ratios(spark: SparkSession, folder: str) -> DataFrame:
    rows = spectra(spark, folder)
    cutoffs = vectors(spark, folder).select("pair", (F.col("label") * 30.0).alias("cutoff_real"), F.lit(None).cast("double").alias("cutoff_sim"))
    return rounded(P.band_ratios(rows.select("pair", "hz", "real", "sim"), 126.0, cutoffs), 5)


@PLANS.add(f"""WITH {SERIES_SQL}, r AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY us) - 1 AS i, count(*) OVER
    (PARTITION BY key) AS n FROM series),
    l AS (SELECT *, CASE WHEN n >= 8192 THEN 1024 ELSE CAST(least(n, greatest(8, pow(2, floor(log2(greatest(8, n // 8)) + 1e-12)))) AS
        BIGINT) END AS len FROM r),
    g AS (SELECT key, len, s, i - s * (len // 2) AS j, value FROM (SELECT *, i // (len // 2) AS s FROM l UNION ALL SELECT *, i // (len // 2)
        - 1 FROM l) WHERE s >= 0 AND s <= (n - len) // (len // 2) AND i < s * (len // 2) + len),
    c AS (SELECT key, len, s, j, (value - avg(value) OVER (PARTITION BY key, s)) * (0.5 - 0.5 * cos(2 * pi() * j / len)) AS x, pow(0.5 - 0.5
        * cos(2 * pi() * j / len), 2) AS w2 FROM g),
    e AS (SELECT *, unnest(range(0, len // 2 + 1)) AS k FROM c),
    d AS (SELECT key, len, s, k, (pow(sum(x * cos(2 * pi() * k * j / len)), 2) + pow(sum(x * sin(2 * pi() * k * j / len)), 2)) / (50 *
        sum(w2)) * CASE WHEN k = 0 OR k * 2 = len THEN 1 ELSE 2 END AS p FROM e GROUP BY key, len, s, k)
    SELECT key, CAST(k AS INTEGER) AS bin, round(k * 50.0 / len, 6) AS hz, round(avg(p), 4) AS power FROM d GROUP BY key, len, k""")
def welch_density(spark: SparkSession, folder: str) -> DataFrame:
    out = P.welch(signals(spark, folder), 50.0)
    return out.select("key", "bin", F.round("hz", 6).alias("hz"), F.round("power", 4).alias("power"))
