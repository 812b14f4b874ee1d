"""Time alignment of two recordings of one mission, and both on one grid.

Anchors, spans and axes are DataFrame operators over all samples. The search for the lag and the grids take one signal of one
pair at a time, a row with the samples of both sides, which a flight bounds. gathered() shuffles and sorts samples for these
rows; a caller whose pairs' samples lie together anyway gives a gather of its own, and then none move.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import series as S
from .scans import spread, stored
from .windows import RATE_HZ

# Band in Hz, window and search in seconds, gate, least overlap, low rates and share of a short overlap.
BAND, WINDOW_S, SEARCH_S, GATE = (0.2, 5.0), 120, 10, 0.5
MIN_OVERLAP_S, SHORT_SHARE, LOW_RATE_HZ = 20.0, 0.40, 5.0
HELD = ("gps.fix_type", "gps.nsats", "status.armed", "land.landed")


@cache
def butterworth_sections(rate: float) -> np.ndarray:
    """Second-order band-pass by bilinear transform: two sections (b0, b1, b2, a1, a2)."""
    low, high = BAND[0], min(BAND[1], 0.9 * rate / 2)
    warp = lambda f: 2 * rate * np.tan(np.pi * f / rate)
    w1, w2 = warp(low), warp(high)
    centre, width = np.sqrt(w1 * w2), w2 - w1
    half = np.exp(1j * np.pi * np.array([3, 5]) / 4) * width / 2  # prototype poles, scaled
    poles = np.concatenate([half + np.sqrt(half**2 - centre**2), half - np.sqrt(half**2 - centre**2)])
    z = (2 * rate + poles) / (2 * rate - poles)
    pairs = [p for p in z if p.imag > 0]
    gain = width**2 * (2 * rate) ** 2 / np.prod(2 * rate - poles)
    sections = np.array([[1.0, 0.0, -1.0, -2 * p.real, abs(p) ** 2] for p in pairs])
    sections[0, :3] *= gain.real
    return sections


#: Samples that the recursion of a filter takes at once: so few that the products of one pair stay on one thread.
BLOCK = 64


@cache
def _blocks(b0: float, b1: float, b2: float, a1: float, a2: float) -> tuple[np.ndarray, ...]:
    """What one section makes of a block: outputs of a state, outputs of the samples, the state behind, and what a block leaves of a state."""
    step, into, out = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0]), np.array([1.0, 0.0])
    powers = [np.eye(2)]
    for _ in range(BLOCK):
        powers.append(step @ powers[-1])
    of_state = np.array([out @ p for p in powers[:BLOCK]])
    echo = np.r_[b0, of_state[:-1] @ into]
    at = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
    within = np.where(at >= 0, echo[np.maximum(at, 0)], 0.0)
    return of_state, within, np.array([powers[BLOCK - 1 - i] @ into for i in range(BLOCK)]), powers[BLOCK]


def _run(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The sections one after another, each in blocks: within one, outputs and the state behind it are linear in its samples and the state before."""
    for b0, b1, b2, a1, a2 in sections.tolist():
        of_state, within, behind, left = _blocks(b0, b1, b2, a1, a2)
        # The recursion's start is the steady state for the first value.
        s2 = (b2 - a2 * (b0 + b1 + b2) / (1 + a1 + a2)) * x[0]
        s1 = (b1 - a1 * (b0 + b1 + b2) / (1 + a1 + a2)) * x[0] + s2
        blocks = np.concatenate([x, np.zeros(-len(x) % BLOCK)]).reshape(-1, BLOCK)
        (l11, l12), (l21, l22) = left.tolist()
        states = []
        for c1, c2 in (blocks @ behind).tolist():
            states.append((s1, s2))
            s1, s2 = l11 * s1 + l12 * s2 + c1, l21 * s1 + l22 * s2 + c2
        x = (blocks @ within.T + np.array(states) @ of_state.T).ravel()[: len(x)]
    return x


def band_pass(x: np.ndarray, rate: float = RATE_HZ) -> np.ndarray:
    """Zero-phase band-pass: forwards and backwards over a series extended by reflection; short ones lose their mean."""
    if len(x) < 16:
        return x - x.mean() if len(x) else x
    sections = butterworth_sections(rate)
    pad = min(3 * (2 * len(sections) + 1), len(x) - 1)
    whole = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    return _run(sections, _run(sections, whole)[::-1])[::-1][pad : pad + len(x)]


def best_shift(real: np.ndarray, sim: np.ndarray, rate: float = RATE_HZ, window_s: float = WINDOW_S, search_s: float = SEARCH_S) -> tuple[int, float]:
    """(lag in samples, correlation) over the stretch of the real series that varies most; the first highest counts."""
    both = np.isfinite(real) & np.isfinite(sim)
    a, b = real[both], sim[both]
    if len(a) < 32:
        return 0, 0.0
    a, b = band_pass(a, rate), band_pass(b, rate)
    width = int(window_s * rate)
    if len(a) > width:
        c, c2 = np.cumsum(np.r_[0.0, a]), np.cumsum(np.r_[0.0, a * a])
        start = int(np.argmax((c2[width:] - c2[:-width]) / width - ((c[width:] - c[:-width]) / width) ** 2))
        a, b = a[start : start + width], b[start : start + width]
    a, b = a - a.mean(), b - b.mean()
    norm = float(np.sqrt((a @ a) * (b @ b)))
    if norm <= 0:
        return 0, 0.0
    most = min(int(search_s * rate), len(a) - 1)
    lags = np.arange(-most, most + 1)
    size = 1 << (len(a) + most).bit_length()
    scores = np.fft.irfft(np.fft.rfft(a, size) * np.conj(np.fft.rfft(b, size)), size)[lags] / norm  # lag k at place k, negative ones from the end
    scores = np.round(scores, 12)  # the transform's noise decides nothing
    best = int(scores.argmax())
    return int(lags[best]), float(scores[best])


def anchors(signals: DataFrame, key: str = "log", first: DataFrame | None = None) -> DataFrame:
    """(log, us, source): where each log's flight begins: armed, else takeoff, else the first sample (first, where known)."""
    of = lambda name: signals.filter(F.col("key") == name).select(key, "us", "value")
    armed = of("status.armed").filter("value > 0.5").groupBy(key).agg(F.min("us").alias("us"))
    pull = S.runs(of("accel.z"), F.abs(F.abs("value") - S.GRAVITY) > S.TAKEOFF_EXCESS, key).filter(F.col("next_us")
        - F.col("start_us") >= int(S.TAKEOFF_S * 1e6))
    first = signals.groupBy(key).agg(F.min("us").alias("us")) if first is None else first
    return S.anchor(armed, pull.groupBy(key).agg(F.min("start_us").alias("us")), first, key)


def _spans(signals: DataFrame) -> DataFrame:
    """(log, key, first, last, v): times of every signal, and how much an axis varies; a row for each, from one pass over all samples."""
    axis = F.when(F.col("key").isin("att.roll", "att.pitch"), F.col("value"))
    return stored(signals.groupBy("log", "key").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.var_pop(axis).alias("v")))


def reference_axis(pairs: DataFrame, signals: DataFrame) -> DataFrame:
    """(pair, axis): of roll and pitch, where both logs have them, the one that varies more in the real log; ties to roll."""
    return _axis(pairs, _spans(signals))


def _axis(pairs: DataFrame, spans: DataFrame) -> DataFrame:
    spread = spans.filter("key IN ('att.roll', 'att.pitch')").select("log", "key", "v")
    both = pairs.join(spread.withColumnRenamed("log", "real_log"), "real_log").join(spread.select(F.col("log").alias("sim_log"), "key"), ["sim_log", "key"])
    return both.groupBy("pair").agg(F.max_by("key", F.struct("v", "key")).alias("axis"))


def reading(us: np.ndarray, value: np.ndarray, known: np.ndarray, at: np.ndarray, hold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The samples at the asked times and which of these are known: linear between two samples, or the last one held, and unknown outside, as S.at_times() has it."""
    order = np.argsort(us, kind="stable")
    us, value, known = us[order].astype(float), value[order], known[order]
    left = np.searchsorted(us, at, side="right") - 1
    out, told = np.full(len(at), np.nan), np.zeros(len(at), bool)
    inside, end = (left >= 0) & (left < len(us) - 1), at == us[-1] if len(us) else np.zeros(len(at), bool)
    a = left[inside]
    b = a if hold else a + 1
    with np.errstate(invalid="ignore"):
        out[inside] = value[a] if hold else value[a] + (at[inside] - us[a]) / (us[b] - us[a]) * (value[b] - value[a])
    told[inside] = known[a] & known[b]
    if end.any():
        out[end], told[end] = value[-1], known[-1]
    return out, told


def on_grid(us: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The samples at the asked times, linear between two of them and missing outside."""
    return reading(us, value, np.ones(len(us), bool), at)[0]


#: From asked (pair, n, real_log, sim_log, real_us, sim_us, and key where not all are meant) to (pair, key, n, real_us, sim_us, real, sim): a row for each
#: signal with the samples of both logs, as struct of arrays us and value in any order. A side that lacks the signal may be empty.
Gather = Callable[[DataFrame], DataFrame]


def gathered(asked: DataFrame, signals: DataFrame) -> DataFrame:
    """What is asked for, as Gather has it, from signals (log, key, us, value): dealt by log, then by pair, where samples are sorted and packed."""
    on = ["log"] + [c for c in asked.columns if c == "key"]
    sides = F.inline(F.array(*(F.struct(F.lit(i).alias("side"), F.col(f"{name}_log").alias("log")) for i, name in enumerate(("real", "sim")))))
    kept = ["pair", "n", "real_us", "sim_us"]
    rows = asked.select(*kept, *on[1:], sides).hint("shuffle_hash").join(signals, on)  # a row for each log is the side that is hashed
    rows = rows.select(*kept, "key", "side", F.col("us").cast("long").alias("us"), F.col("value").cast("double").alias("value"))
    series = "struct<us: array<bigint>, value: array<double>>"
    return spread(rows, "pair").sortWithinPartitions("pair", "key").mapInArrow(_packed, f"pair {dict(asked.dtypes)['pair']}, key string, n int, real_us long, "
        f"sim_us long, real {series}, sim {series}")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each signal of a pair, which follow each other, as one."""
    names = ["pair", "key", "n", "real_us", "sim_us"]
    for piece in _pieces(batches):
        packed = [piece.column(c).chunk(0).slice(0, 1) for c in names]
        for i in (0, 1):
            own = piece.filter(pc.equal(piece.column("side"), i))
            ends = pa.array([0, len(own)], pa.int32())
            packed.append(pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, own.column(c).combine_chunks()) for c in ("us", "value")], ["us", "value"]))
        yield pa.RecordBatch.from_arrays(packed, [*names, "real", "sim"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each signal of a pair, which follow each other."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in (batch.column("pair"), batch.column("key"))]
        starts = [0, *(np.flatnonzero(new[0] | new[1]) + 1).tolist()]
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = batch.column("pair")[a].as_py(), batch.column("key")[a].as_py()
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _sides(batch: pa.RecordBatch) -> Iterator[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Of each gathered row: times since its log's beginning, values, and which are known, of both sides."""
    columns = []
    for name in ("real", "sim"):
        us, value = (batch.column(name).field(c) for c in ("us", "value"))
        columns.append((us.offsets.to_numpy(), us.values.to_numpy(), value.offsets.to_numpy(), value.values.to_numpy(zero_copy_only=False),
            value.values.is_valid().to_numpy(zero_copy_only=False), batch.column(f"{name}_us").to_numpy()))
    for k in range(batch.num_rows):
        yield [(us[u[k] : u[k + 1]] - start[k], value[v[k] : v[k + 1]], known[v[k] : v[k + 1]]) for u, us, v, value, known, start in columns]


def align(pairs: DataFrame, signals: DataFrame, step_us: int = 1_000_000 // RATE_HZ, gather: Gather | None = None) -> DataFrame:
    """One row per pair (pair, real_log, sim_log) of logs in signals (log, key, us, value).

    pair, real_us, sim_us, methods, axis, shift_s, correlation, quality, overlap_s, reason, short_overlap. quality is fine
    where the correlation reaches GATE, else coarse_only without a shift; a pair with too little overlap has a reason.
    shift_s is the lag of the real series against the other, negative where the other one is late; resample() adds it to
    the other's times, as the rules have it.
    """
    spans = _spans(signals)
    ends = spans.groupBy("log").agg(F.min("first").alias("us"), F.max("last").alias("last"))
    start = stored(anchors(signals, "log", ends.select("log", "us")).join(ends.select("log", "last"), "log"))  # a row for each log, read for both sides
    side = lambda name: start.select(F.col("log").alias(f"{name}_log"), F.col("us").alias(f"{name}_us"),
        F.col("source").alias(f"{name}_method"), ((F.col("last") - F.col("us")) / 1e6).alias(f"{name}_s"))
    rows = pairs.join(side("real"), "real_log").join(side("sim"), "sim_log").join(_axis(pairs, spans), "pair", "left")
    n = (F.greatest(F.lit(1.0), F.least("real_s", "sim_s")) * 1e6 / step_us).cast("int")
    rows = rows.withColumn("n", n)

    rate = 1e6 / step_us

    def shifts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The samples of one pair's axis at a time, a flight's length each."""
        for batch in batches:
            grids = (np.arange(n) * float(step_us) for n in batch.column("n").to_pylist())
            found = [best_shift(*(on_grid(us, value, at) for us, value, _ in sides), rate) for at, sides in zip(grids, _sides(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("pair"), *(pa.array([float(x[i]) for x in found], pa.float64()) for i in (0, 1))],
                ["pair", "lag", "correlation"])

    asked = rows.filter("n >= 32 AND axis IS NOT NULL").withColumnRenamed("axis", "key")
    both = gather(asked) if gather else gathered(asked, signals)
    found = both.mapInArrow(shifts, f"pair {dict(rows.dtypes)['pair']}, lag double, correlation double")
    rows = rows.join(found.select("pair", F.struct("lag", "correlation").alias("found")), "pair", "left")
    fine = F.coalesce(F.col("found.correlation") >= GATE, F.lit(False))
    rows = rows.withColumn("shift_s", F.when(fine, F.col("found.lag") / rate).otherwise(0.0))
    overlap = F.greatest(F.lit(0.0), F.least(F.col("real_s"), F.col("sim_s") - F.col("shift_s")))
    return rows.select(
        "pair",
        "real_log",
        "sim_log",
        "real_us",
        "sim_us",
        F.concat(F.lit("real:"), "real_method", F.lit(",sim:"), "sim_method").alias("methods"),
        "axis",
        "shift_s",
        F.col("found.correlation").alias("correlation"),
        F.when(fine, "fine").otherwise("coarse_only").alias("quality"),
        overlap.alias("overlap_s"),
        F.when(overlap < MIN_OVERLAP_S, "insufficient_overlap").alias("reason"),
        (overlap < SHORT_SHARE * F.least("real_s", "sim_s")).alias("short_overlap"),
    )


def resample(aligned: DataFrame, signals: DataFrame, step_us: int = 1_000_000 // RATE_HZ, gather: Gather | None = None) -> DataFrame:
    """(pair, key, i, t_s, real, sim, low_rate, upsampled): every signal that both logs have, on one grid over the overlap.

    States are held, other signals interpolated; outside a signal's span there is null. Pairs with a reason are left out.
    """
    n = F.greatest(F.lit(2), F.round(F.col("overlap_s") * 1e6 / step_us).cast("int") + 1)
    asked = aligned.filter("reason IS NULL").select("pair", n.alias("n"), "real_log", "sim_log", "real_us", (F.col("sim_us") + (F.col("shift_s")
        * 1e6).cast("long")).alias("sim_us"))

    def rate_hz(us: np.ndarray) -> float:
        """A million over the median positive interval, 0 without one."""
        steps = np.diff(np.sort(us))
        return 1e6 / float(np.median(steps[steps > 0])) if (steps > 0).any() else 0.0

    def grids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One signal of a pair at a time."""
        for batch in batches:
            for k, (key, n, sides) in enumerate(zip(batch.column("key").to_pylist(), batch.column("n").to_pylist(), _sides(batch), strict=True)):
                if not all(len(us) for us, _, _ in sides):
                    continue
                at, least = np.arange(n) * float(step_us), min(rate_hz(us) for us, _, _ in sides)
                read = [pa.array(values, mask=~known) for values, known in (reading(*side, at, key in HELD) for side in sides)]
                flags = [pa.array(np.full(n, flag)) for flag in (least < LOW_RATE_HZ, least < 1e6 / step_us)]
                same = pa.array(np.full(n, k))
                yield pa.RecordBatch.from_arrays([batch.column("pair").take(same), batch.column("key").take(same), pa.array(np.arange(n, dtype=np.int32)),
                    *read, *flags], ["pair", "key", "i", "real", "sim", "low_rate", "upsampled"])

    both = gather(asked) if gather else gathered(asked, signals)
    out = both.mapInArrow(grids, f"pair {dict(aligned.dtypes)['pair']}, key string, i int, real double, sim double, low_rate boolean, upsampled boolean")
    return out.select("pair", "key", "i", (F.col("i").cast("long") * step_us / 1e6).alias("t_s"), "real", "sim", "low_rate", "upsampled")
