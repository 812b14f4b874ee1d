"""Gap-aware altitude filter with fault runs, and a nine-state filter over position, attitude and speed."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold_sorted
from .scans import scanned

# Noise of the altitude filter, reset gap, chi-square cuts and run length of its fault test.
ACCELERATION_STD, MEASUREMENT_STD, FIRST_VARIANCE = 0.5, 0.3, 10.0
RESET_GAP_S = 30.0
NIS_95, NIS_99, FAULT_RUN = 3.841, 6.635, 3


def altitude_filter(q: float, r: float):
    """Starts steps of the constant-velocity filter: (value, dt) to filtered value, velocity, deviation, innovation, NIS.

    A start may take up a state; step.state() gives the five numbers of the current one.
    """

    def start(kept: list[float] | None = None):
        state: list[float] = kept or []

        def step(value: float, dt: float | None) -> tuple:
            nonlocal state
            if dt is None:
                state = [value, 0.0, FIRST_VARIANCE, 0.0, FIRST_VARIANCE]
                return value, 0.0, math.sqrt(FIRST_VARIANCE), None, None
            x, v, a, b, c = state  # covariance [[a, b], [b, c]]
            x, a, b, c = x + dt * v, a + 2 * dt * b + dt * dt * c + q * dt**4 / 4, b + dt * c + q * dt**3 / 2, c + q * dt**2
            innovation, s = value - x, a + r
            gain, gain_v = a / s, b / s
            state = [x + gain * innovation, v + gain_v * innovation, (1 - gain) * a, (1 - gain) * b, c - gain_v * b]
            return state[0], state[1], math.sqrt(max(state[2], 0.0)), innovation, innovation**2 / s

        step.state = lambda: state
        return step

    return start


@dataclass(frozen=True)
class Element:
    """What stretches of rows do to a Gaussian state, in closed form: arrays with a stretch in each row.

    A stretch that follows another is composed with it by then(); composition is associative, so a long series can be cut
    anywhere. (A, b, C) are the state after the stretch given the one before, (eta, J) what its rows say about that one.
    """

    A: np.ndarray
    b: np.ndarray
    C: np.ndarray
    eta: np.ndarray
    J: np.ndarray

    @classmethod
    def of(cls, dt: np.ndarray, y: np.ndarray, q: float, r: float) -> Element:
        """One reading each, dt after the one before; where dt is NaN, a start that forgets all before."""
        n, fresh = len(dt), np.isnan(dt)
        t = np.where(fresh, 0.0, dt)
        one, nil = np.ones(n), np.zeros(n)
        F = np.stack([np.stack([one, t], -1), np.stack([nil, one], -1)], -2)
        Q = q * np.stack([np.stack([t**4 / 4, t**3 / 2], -1), np.stack([t**3 / 2, t**2], -1)], -2)
        s = Q[:, 0, 0] + r
        gain = Q[:, :, 0] / s[:, None]
        kept = np.eye(2) - gain[:, :, None] * np.array([1.0, 0.0])
        row = F[:, 0, :]
        A, b, C = kept @ F, gain * y[:, None], kept @ Q
        eta, J = row * (y / s)[:, None], row[:, :, None] * row[:, None, :] / s[:, None, None]
        A[fresh], C[fresh], eta[fresh], J[fresh] = 0, np.eye(2) * FIRST_VARIANCE, 0, 0
        b[fresh] = np.stack([y[fresh], np.zeros(fresh.sum())], -1)
        return cls(A, b, C, eta, J)

    def __getitem__(self, i) -> Element:
        return Element(self.A[i], self.b[i], self.C[i], self.eta[i], self.J[i])

    def then(self, other: Element) -> Element:
        i, j = self, other
        T = lambda m: np.swapaxes(m, -1, -2)
        dot = lambda m, v: (m @ v[..., None])[..., 0]
        D = j.A @ np.linalg.inv(np.eye(2) + i.C @ j.J)
        E = T(i.A) @ np.linalg.inv(np.eye(2) + j.J @ i.C)
        return Element(D @ i.A, dot(D, i.b + dot(i.C, j.eta)) + j.b, D @ i.C @ T(j.A) + j.C, dot(E, j.eta - dot(j.J, i.b)) + i.eta, E @ j.J @ i.A + i.J)

    def composed(self) -> Element:
        """All stretches as one, by halves."""
        own = self
        while len(own.b) > 1:
            odd = own[-1:] if len(own.b) % 2 else None
            own = own[: len(own.b) // 2 * 2 : 2].then(own[1::2])
            if odd is not None:
                own = Element(*(np.concatenate([x, y]) for x, y in zip((own.A, own.b, own.C, own.eta, own.J), (odd.A, odd.b, odd.C, odd.eta, odd.J), strict=True)))
        return own

    def after(self, state: list[float]) -> list[float]:
        """The state (position, velocity, covariance) after the one stretch, given that before it."""
        x, v, a, b, c = state
        D = self.A[0] @ np.linalg.inv(np.eye(2) + np.array([[a, b], [b, c]]) @ self.J[0])
        P = np.array([[a, b], [b, c]])
        m = D @ (np.array([x, v]) + P @ self.eta[0]) + self.b[0]
        P = D @ P @ self.A[0].T + self.C[0]
        return [float(m[0]), float(m[1]), float(P[0, 0]), float(P[0, 1]), float(P[1, 1])]


def smooth(readings: DataFrame, value: str = "altitude", reset_gap_s: float = RESET_GAP_S, second_us: float = 1e6) -> DataFrame:
    """Filtered series of every vehicle: drone_id, reading_id, us, value, dt, track, filtered, velocity, deviation, innovation, nis.

    Rows with a null value don't take part; rows that repeat the time stamp before them are left out. A gap above
    reset_gap_s starts a new track, on which nothing earlier bears; dt (seconds since the row before), innovation and
    NIS are null at its start. The filter is a scan (scans.scanned): stretches of a series
    compose, so a vehicle's rows are dealt over as many tasks as they fill, each of which begins with the state that
    the stretches before it lead to.
    """
    q, r = ACCELERATION_STD**2, MEASUREMENT_STD**2
    rows = readings.filter(F.col(value).isNotNull()).select("drone_id", "reading_id", "us", F.col(value).cast("double").alias("value"))
    kinds = dict(rows.dtypes)
    begin = altitude_filter(q, r)

    def steps(us: np.ndarray, last: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Seconds since the row before, NaN at the start of a track; which rows count."""
        dt = np.diff(us, prepend=us[0] if last is None else last) / second_us
        counts = dt > 0
        if last is None:
            counts[0], dt[0] = True, np.nan
        return np.where(dt <= reset_gap_s, dt, np.nan), counts

    def rest(us: np.ndarray, y: np.ndarray, last: int) -> tuple[Element | None, int]:
        """The element of rows that follow one at `last`, and how many tracks begin in them."""
        dt, counts = steps(us, last)
        dt, y = dt[counts], y[counts]
        if not len(dt):
            return None, 0
        starts = np.flatnonzero(np.isnan(dt))
        own = slice(starts[-1] if len(starts) else 0, None)  # nothing before a start bears on what follows
        return Element.of(dt[own], y[own], q, r).composed(), len(starts)

    def joined(one: Element | None, other: Element | None) -> Element | None:
        return other if one is None else one if other is None else one.then(other)

    def summary(piece: pd.DataFrame) -> tuple:
        us, y = piece["us"].to_numpy(np.int64), piece["value"].to_numpy(float)
        return (int(us[0]), float(y[0]), int(us[-1]), *rest(us[1:], y[1:], int(us[0])))

    def combine(one: tuple, other: tuple) -> tuple:
        between, starts = rest(np.array([other[0]]), np.array([other[1]]), one[2])
        return one[0], one[1], other[2], joined(joined(one[3], between), other[3]), one[4] + starts + other[4]

    def run(piece: pd.DataFrame, before: tuple | None, after: tuple | None) -> pd.DataFrame:
        us = piece["us"].to_numpy(np.int64)
        if before is None:
            step, track, last = begin(), 0, None
        else:
            state = [before[1], 0.0, FIRST_VARIANCE, 0.0, FIRST_VARIANCE]
            step, track, last = begin(state if before[3] is None else before[3].after(state)), before[4] + 1, before[2]
        dt, counts = steps(us, last)
        own, dt = piece[counts], dt[counts]
        found = [step(y, None if t != t else t) for y, t in zip(own["value"].tolist(), dt.tolist(), strict=True)]
        out = pd.DataFrame(found, columns=["filtered", "velocity", "deviation", "innovation", "nis"], index=own.index, dtype="float64")
        numbers = track + np.isnan(dt).cumsum()
        return pd.concat([own.assign(dt=dt, track=numbers.astype(np.int32)), out], axis=1)

    schema = (f"drone_id {kinds['drone_id']}, reading_id {kinds['reading_id']}, us long, value double, dt double, track int, filtered double, "
        "velocity double, deviation double, innovation double, nis double")
    out = scanned(rows, ["drone_id"], ["us", "reading_id"], summary, combine, run, schema)
    return out.select(*(F.nanvl(c, F.lit(None)).alias(c) if c in ("dt", "innovation", "nis") else c for c in out.columns))


def fault_runs(smoothed: DataFrame, cut: float = NIS_95, least: int = FAULT_RUN) -> DataFrame:
    """Runs of at least `least` readings whose NIS, rounded to 3 digits, is above cut; a null breaks a run.

    CRITICAL if the peak is above NIS_99, else WARNING.
    """
    order = Window.partitionBy("drone_id").orderBy("us", "reading_id")
    rows = smoothed.withColumn("nis", F.round("nis", 3)).withColumn("place", F.row_number().over(order))
    over = rows.filter(F.col("nis") > cut)
    over = over.withColumn("run", F.col("place") - F.row_number().over(order))
    runs = over.groupBy("drone_id", "run").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n"),
        F.max("nis").alias("peak_nis")).filter(F.col("n") >= least)
    return runs.select("drone_id", "start_us", "end_us", "n", "peak_nis", F.when(F.col("peak_nis") > NIS_99, "CRITICAL").otherwise("WARNING").alias("severity"))


def fault_points(runs: DataFrame) -> DataFrame:
    """Risk points of each vehicle's fault runs: 20 for a critical one, 10 for a warning."""
    return runs.groupBy("drone_id").agg(F.sum(F.when(F.col("severity") == "CRITICAL", 20).otherwise(10)).alias("fault_points"))


# Earth radius; measurement variances of the nine-state filter and its attitude process noise.
EARTH_RADIUS_M = 6_371_000.0
POSITION_VAR, ATTITUDE_VAR, SPEED_VAR = 0.09, 4.0, 0.25
ATTITUDE_RATE_STD = 2.0
LEAST_SPEED = 1e-6


def to_local_metres(readings: DataFrame) -> DataFrame:
    """Adds east and north of each vehicle's first known position, in metres; null where the position is."""
    known = readings.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    first = known.groupBy(F.col("drone_id").alias("first_id")).agg(F.min_by(F.struct("latitude", "longitude"), F.struct("us", "reading_id")).alias("origin"))
    rows = readings.join(first, readings["drone_id"].eqNullSafe(first["first_id"]), "left")
    origin = F.col("origin")
    east = F.radians(F.col("longitude") - origin["longitude"]) * EARTH_RADIUS_M * F.cos(F.radians(origin["latitude"]))
    north = F.radians(F.col("latitude") - origin["latitude"]) * EARTH_RADIUS_M
    return rows.select(*(readings[c] for c in readings.columns), east.alias("east"), north.alias("north"))


def nine_state_filter(reset_gap_s: float):
    """A step over (us, east, north, altitude, speed, roll, pitch, yaw): the state is position, velocity and attitude.

    Updates are scalar, one after another; a position or attitude with a null in it, or a null speed, is left out. The first row of a series sets what it
    measures and is then filtered as any other; a row after a gap above reset_gap_s starts anew without updates; rows
    that don't advance in time are left out.
    """

    def start():
        x, p, last = np.zeros(9), np.eye(9), None

        def fresh(fields):
            state = np.zeros(9)
            for i, value in zip((0, 1, 2, 6, 7, 8), (*fields[:3], *fields[4:]), strict=True):
                state[i] = value or 0.0
            return state, np.eye(9) * FIRST_VARIANCE

        def update(h, residual, variance):
            nonlocal x, p
            s = h @ p @ h + variance
            gain = p @ h / s
            x, p = x + gain * residual, p - np.outer(gain, h @ p)

        def measure(fields):
            groups = (((0, 1, 2), fields[:3], POSITION_VAR), ((6, 7, 8), fields[4:], ATTITUDE_VAR))
            for at, values, variance in groups:
                if all(v is not None for v in values):
                    for i, value in zip(at, values, strict=True):
                        update(np.eye(9)[i], value - x[i], variance)
            pace = math.sqrt(x[3] ** 2 + x[4] ** 2 + x[5] ** 2)
            if fields[3] is not None and pace >= LEAST_SPEED:
                h = np.zeros(9)
                h[3:6] = x[3:6] / pace
                update(h, fields[3] - pace, SPEED_VAR)

        def step(us, *fields):
            nonlocal x, p, last
            dt = None if last is None else (us - last) / 1e6
            if dt is not None and dt <= 0:
                return None
            last = us
            if dt is None or dt > reset_gap_s:
                x, p = fresh(fields)
                if dt is None:
                    measure(fields)
            else:
                x = x.copy()
                x[:3] += x[3:6] * dt
                moved = p.copy()  # each axis by itself; covariance between axes stays as it was
                for i, v in ((0, 3), (1, 4), (2, 5)):
                    moved[i, i] = p[i, i] + 2 * dt * p[i, v] + dt * dt * p[v, v] + ACCELERATION_STD**2 * dt**4 / 4
                    moved[i, v] = moved[v, i] = p[i, v] + dt * p[v, v] + ACCELERATION_STD**2 * dt**3 / 2
                    moved[v, v] = p[v, v] + ACCELERATION_STD**2 * dt**2
                moved[[6, 7, 8], [6, 7, 8]] += ATTITUDE_RATE_STD**2 * dt
                p = moved
                measure(fields)
            return (*map(float, x), float(math.sqrt(max(p[0, 0] + p[1, 1] + p[2, 2], 0.0))))

        return step

    return start


def fuse(readings: DataFrame, reset_gap_s: float = RESET_GAP_S) -> DataFrame:
    """Nine-state estimates of every vehicle: x, y, z, vx, vy, vz, roll_est, pitch_est, yaw_est and a position deviation.

    Expects drone_id, reading_id, us, latitude, longitude, altitude, speed, roll, pitch, yaw; nulls are allowed.
    """
    rows = to_local_metres(readings).select("drone_id", "reading_id", "us", "east", "north", "altitude", "speed", "roll", "pitch", "yaw")
    names = ("x", "y", "z", "vx", "vy", "vz", "roll_est", "pitch_est", "yaw_est", "position_std")
    return fold_sorted(rows, ["drone_id"], ["us", "reading_id"], nine_state_filter(reset_gap_s), ["us", "east", "north", "altitude",
        "speed", "roll", "pitch", "yaw"], ", ".join(f"{n} double" for n in names))
