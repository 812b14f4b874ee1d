"""Paths among obstacles: clearance, collision probability, grid search, and smooth trajectories.

Searches run per request in grouped pandas: a request's scene is small, requests are many. Clearance of many cells
against many obstacles is a join on grid buckets.
"""

from __future__ import annotations

import heapq
import itertools
import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import spread as spread_out
from .uncertainty import DRAWS

# Cell size, clearance, margin, risk weight and block, peak factors and retries of a trajectory.
CELL, RADIUS, MARGIN = 0.5, 0.6, 3.0
RISK_WEIGHT, RISK_BLOCK = 50.0, 0.98
PEAK_VELOCITY, PEAK_ACCELERATION = 1.875, 10 / math.sqrt(3)
RESCALES, RESCALE_MARGIN, RETRIES = 4, 1.02, 3


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a, b, strict=True)), F.lit(0.0)))


def path_length(points: DataFrame, key: str = "path", order: str = "i", axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(key, metres, n): length of the line through each path's points in order."""
    by = Window.partitionBy(key).orderBy(order)
    step = distance([F.col(a) for a in axes], [F.lag(a).over(by) for a in axes])
    return points.withColumn("step", step).groupBy(key).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("metres"), F.count(F.lit(1)).alias("n"))


def near_obstacles(points: DataFrame, obstacles: DataFrame, radius: float = RADIUS, scene: str = "scene", axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """points with blocked: whether an obstacle of their scene lies within the radius, that distance included.

    Obstacles are put into buckets as wide as the radius and each point looks into its own and the neighbouring ones:
    an equi-join, not a comparison of all pairs.
    """
    bucket = lambda c, shift=None: F.floor(F.col(c) / radius) + (F.lit(0) if shift is None else shift)
    shifts = F.array(*[F.struct(*[F.lit(s).alias(a) for s, a in zip(shift, axes, strict=True)]) for shift in itertools.product((-1, 0, 1), repeat=len(axes))])
    places = obstacles.select(scene, *[F.col(a).alias(f"o_{a}") for a in axes], *[bucket(a).alias(f"b_{a}") for a in axes])
    looks = points.select(scene, *axes).distinct().withColumn("shift", F.explode(shifts)).select(scene, *axes, *[bucket(a,
        F.col(f"shift.{a}")).alias(f"b_{a}") for a in axes])
    near = distance([F.col(a) for a in axes], [F.col(f"o_{a}") for a in axes]) <= radius
    hits = looks.join(places, [scene, *[f"b_{a}" for a in axes]]).filter(near).select(scene, *axes).distinct()
    return points.join(hits.withColumn("hit", F.lit(True)), [scene, *axes], "left").withColumn("blocked", F.coalesce("hit", F.lit(False))).drop("hit")


def collision_probability(samples: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """(keys, probability): 1 - product of (1 - p) over obstacles; p is the share of an obstacle's sampled positions within the radius.

    samples: keys, obstacle, d (distance of one sampled position).
    """
    hits = samples.groupBy(*keys, "obstacle").agg(F.avg((F.col("d") <= radius).cast("int")).alias("p"))
    survive = F.exp(F.sum(F.when(F.col("p") < 1, F.log(1 - F.col("p")))))
    return hits.groupBy(*keys).agg((1 - F.when(F.max("p") >= 1, 0.0).otherwise(survive)).alias("probability"))


def search(start: np.ndarray, goal: np.ndarray, obstacles: np.ndarray, radius: float, cell: float, margin: float, risk=None) -> list[np.ndarray]:
    """Cheapest way on a grid around start, goal and obstacles, diagonal steps allowed; empty if there is none.

    A cell within the radius of an obstacle is blocked, except those of start and goal. With risk(points), cells cost
    RISK_WEIGHT times their probability more, and are blocked only where it is above RISK_BLOCK. Cells are numbered in
    order of their coordinates, with a closed rim around the grid.
    """
    every = np.vstack([start[None], goal[None], *([obstacles] if len(obstacles) else [])])
    low, high = every.min(axis=0) - margin, every.max(axis=0) + margin
    shape = np.ceil((high - low) / cell).astype(int) + 1
    strides = [math.prod(int(n) + 2 for n in shape[k + 1 :]) for k in range(len(shape))]
    ends = [np.round((p - low) / cell).astype(int) for p in (start, goal)]
    first, last = (sum((int(a) + 1) * s for a, s in zip(at, strides, strict=True)) for at in ends)
    moves = [(sum(a * s for a, s in zip(step, strides, strict=True)), math.hypot(*step) * cell) for step in itertools.product((-1, 0, 1),
        repeat=len(start)) if any(step)]
    closed = np.ones(shape + 2, dtype=np.uint8)
    closed[(slice(1, -1),) * len(shape)] = 0
    if risk is None:
        for o in obstacles:
            box = [np.arange(max(0, math.floor((o[k] - radius - low[k]) / cell)), min(int(shape[k]), math.ceil((o[k] + radius - low[k])
                / cell) + 1)) for k in range(len(shape))]
            apart = sum((np.square(o[k] - (low[k] + at * cell)).reshape([-1 if i == k else 1 for i in range(len(shape))]) for k,
                at in enumerate(box)), 0.0)
            closed[tuple(slice(at[0] + 1, at[-1] + 2) for at in box)] |= np.sqrt(apart) <= radius
    done = bytearray(closed.tobytes())
    done[first] = done[last] = 0
    rest = [np.square(np.arange(-1, n + 1) - at).reshape([-1 if i == k else 1 for i in range(len(shape))]) for k, (n, at) in enumerate(zip(shape,
        ends[1], strict=True))]
    ahead = (np.sqrt(sum(rest)) * cell).ravel().tolist()
    place = lambda at: low + np.array([at // s % (int(n) + 2) - 1 for s, n in zip(strides, shape, strict=True)]) * cell
    extra = None if risk is None else _prices(risk, place, first, last, [m for m, _ in moves], done)

    waiting, best, back = [(ahead[first], first)], {first: 0.0}, {}
    while waiting:
        _, at = heapq.heappop(waiting)
        if at == last:
            way = [at]
            while way[-1] in back:
                way.append(back[way[-1]])
            return [start, *(place(p) for p in way[-2:0:-1]), goal]
        if done[at]:
            continue
        done[at] = 1
        here = best[at]
        costs = None if extra is None else extra(at)
        for move, length in moves:
            to = at + move
            if done[to]:
                continue
            cost = here + length if costs is None else here + length + costs[to]
            if cost < best.get(to, math.inf):
                best[to], back[to] = cost, at
                heapq.heappush(waiting, (cost + ahead[to], to))
    return []


def _prices(risk, place, first: int, last: int, moves: list[int], done: bytearray):
    """The function of a cell that gives what its neighbours cost for their risk, each asked for once."""
    costs = {first: 0.0, last: 0.0}

    def around(at: int) -> dict[int, float]:
        new = [to for to in (at + m for m in moves) if not done[to] and to not in costs]
        if new:
            for to, p in zip(new, risk(np.array([place(to) for to in new])).tolist(), strict=True):
                costs[to] = math.inf if p > RISK_BLOCK else RISK_WEIGHT * p
        return costs

    return around


def risk_of(obstacles: np.ndarray, places: np.ndarray, radius: float):
    """The function of points that gives their probability of meeting an obstacle, from drawn places of each.

    Obstacles none of whose places can lie within the radius of a point are passed over; their probability is 0.
    """
    reach = radius + np.sqrt(((places - obstacles[:, None, :]) ** 2).sum(axis=2)).max(axis=1) + 1e-9
    axes = [np.ascontiguousarray(places[:, :, k]) for k in range(places.shape[2])]

    def risk(points: np.ndarray) -> np.ndarray:
        points = np.atleast_2d(points)
        at, which = np.nonzero(np.sqrt(((obstacles[None] - points[:, None]) ** 2).sum(axis=2)) <= reach)
        out = np.ones(len(points))
        if len(at):
            apart = sum((np.square(axis[which] - points[at, k][:, None]) for k, axis in enumerate(axes)), 0.0)
            np.multiply.at(out, at, 1 - np.count_nonzero(np.sqrt(apart) <= radius, axis=1) / axes[0].shape[1])
        return 1 - out

    return risk


@lru_cache(maxsize=4)
def _shifts(seed: int, spread: float, shape: tuple[int, int, int]) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, spread, shape)


def plan(requests: DataFrame, obstacles: DataFrame, axes: tuple[str, ...] = ("x", "y"), radius: float = RADIUS, cell: float = CELL,
    margin: float = MARGIN, spread: float | None = None, draws: int = DRAWS, seed: int = 42) -> DataFrame:
    """(request, i, axes): way points of each request; a request without a way has none.

    requests: request, start_<axis>, goal_<axis>; obstacles: request, axes. With spread, obstacles are uncertain by that
    standard deviation, and the way weighs the probability of meeting one, from `draws` seeded positions of each.
    """

    def run(asked: pd.DataFrame, scene: pd.DataFrame) -> pd.DataFrame:
        out = []
        fixed = scene[list(axes)].to_numpy(float)
        for r in asked.itertuples():
            start, goal = (np.array([getattr(r, f"{end}_{a}") for a in axes], float) for end in ("start", "goal"))
            risk = None
            if spread is not None and len(fixed):
                shifts = _shifts(seed, spread, (len(fixed), draws, len(axes)))
                risk = risk_of(fixed, fixed[:, None, :] + shifts, radius)
            way = search(start, goal, fixed, radius, cell, margin, risk)
            out += [(r.request, i, *map(float, p)) for i, p in enumerate(way)]
        return pd.DataFrame(out, columns=["request", "i", *axes])

    kind = dict(requests.dtypes)["request"]
    schema = f"request {kind}, i int, " + ", ".join(f"{a} double" for a in axes)
    obstacles = obstacles.select(F.col("request").alias("request"), *[F.col(a).alias(a) for a in axes])  # a side of its own, should both come from one table
    return spread_out(requests, "request").groupBy("request").cogroup(spread_out(obstacles, "request").groupBy("request")).applyInPandas(run, schema)


def segment_distance(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    along = b - a
    t = np.clip(((points - a) @ along) / max(along @ along, 1e-12), 0, 1)
    return np.sqrt(((points - a - t[:, None] * along) ** 2).sum(axis=1))


def simplified(points: np.ndarray, obstacles: np.ndarray, tolerance: float, clearance: float) -> np.ndarray:
    """Way points that stay within the tolerance, keeping every shortcut clear of obstacles."""
    keep, waiting = {0, len(points) - 1}, [(0, len(points) - 1)]
    while waiting:
        lo, hi = waiting.pop()
        if hi - lo < 2:
            continue
        off = segment_distance(points[lo + 1 : hi], points[lo], points[hi])
        blocked = len(obstacles) and segment_distance(obstacles, points[lo], points[hi]).min() < clearance + tolerance  # the curve bulges
        if off.max() > tolerance or blocked:
            middle = lo + 1 + int(off.argmax())
            keep.add(middle)
            waiting += [(lo, middle), (middle, hi)]
    return points[sorted(keep)]


def quintic(p0, p1, v0, v1, duration: float) -> np.ndarray:
    """Coefficients (6, axes) of the least-jerk motion between two states at rest in acceleration."""
    a, b, t = (p1 - p0) - v0 * duration, (v1 - v0), duration
    return np.array([p0, v0, np.zeros_like(p0), 10 * a / t**3 - 4 * b / t**2, -15 * a / t**4 + 7 * b / t**3, 6 * a / t**5 - 3 * b / t**4])


def trajectory(points: np.ndarray, obstacles: np.ndarray, max_velocity: float, max_acceleration: float, tolerance: float, clearance: float,
    rate_hz: float = 20.0) -> tuple[np.ndarray, bool]:
    """(rows of t and position, smooth): a least-jerk spline through simplified way points within velocity and acceleration.

    Where the spline comes too near an obstacle the tolerance is halved, RETRIES times; after that the raw way is kept.
    """
    for _ in range(RETRIES + 1):
        way = simplified(points, obstacles, tolerance, clearance)
        legs = np.diff(way, axis=0)
        length = np.sqrt((legs**2).sum(axis=1))
        times = np.maximum(np.maximum(PEAK_VELOCITY * length / max_velocity, np.sqrt(PEAK_ACCELERATION * length / max_acceleration)), 1e-3)
        for _ in range(RESCALES):
            speed = legs / times[:, None]
            via = np.vstack([np.zeros(way.shape[1]), (speed[:-1] + speed[1:]) / 2, np.zeros(way.shape[1])])
            pieces = [quintic(way[i], way[i + 1], via[i], via[i + 1], times[i]) for i in range(len(times))]
            grid = [np.linspace(0, t, 25) for t in times]
            power = lambda t, order: np.array([math.perm(k, order) * t ** max(0, k - order) if k >= order else 0 * t for k in range(6)]).T
            peak_v = max(np.sqrt(((power(g, 1) @ c) ** 2).sum(axis=1)).max() for g, c in zip(grid, pieces, strict=True))
            peak_a = max(np.sqrt(((power(g, 2) @ c) ** 2).sum(axis=1)).max() for g, c in zip(grid, pieces, strict=True))
            over = max(peak_v / max_velocity, math.sqrt(peak_a / max_acceleration))
            if over <= 1:
                break
            times = times * over * RESCALE_MARGIN
        begins = np.cumsum(times) - times
        t = np.arange(0, times.sum(), 1 / rate_hz)
        leg = np.clip(np.searchsorted(begins, t, side="right") - 1, 0, len(times) - 1)
        where = np.einsum("ij,ijk->ik", power(t - begins[leg], 0), np.array(pieces)[leg]).reshape(len(t), -1)
        if not len(obstacles) or np.sqrt(((where[:, None] - obstacles[None]) ** 2).sum(axis=2)).min() > clearance:
            return np.column_stack([t, where]), True
        tolerance /= 2
    length = np.sqrt((np.diff(points, axis=0) ** 2).sum(axis=1))
    return np.column_stack([np.r_[0, np.cumsum(length)] / max_velocity, points]), False


def smooth(ways: DataFrame, obstacles: DataFrame, axes: tuple[str, ...] = ("x", "y", "z"), max_velocity: float = 5.0,
    max_acceleration: float = 2.5, tolerance: float = 0.5, clearance: float = RADIUS) -> DataFrame:
    """(request, t, axes, smooth): timed positions along each request's way; a single point stands still at time 0."""

    def run(way: pd.DataFrame, scene: pd.DataFrame) -> pd.DataFrame:
        points = way.sort_values("i")[list(axes)].to_numpy(float)
        columns = ["request", "t", *axes, "smooth"]
        if not len(points):
            return pd.DataFrame(columns=columns)
        rows, fine = (np.column_stack([[0.0], points]), True) if len(points) == 1 else trajectory(points, scene[list(axes)].to_numpy(float),
            max_velocity, max_acceleration, tolerance, clearance)
        out = pd.DataFrame(rows, columns=["t", *axes])
        return out.assign(request=way.request.iloc[0], smooth=fine)[columns]

    kind = dict(ways.dtypes)["request"]
    obstacles = obstacles.select(F.col("request").alias("request"), *[F.col(a).alias(a) for a in axes])
    return spread_out(ways, "request").groupBy("request").cogroup(spread_out(obstacles, "request").groupBy("request")).applyInPandas(run, f"request {kind}, t double, "
        + ", ".join(f"{a} double" for a in axes) + ", smooth boolean")
