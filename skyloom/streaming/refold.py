"""Folds on streams that late rows correct: states are kept before each recent row of a key, so a late row rolls back to its place.

A fold goes over the rows of a key in order, as fold_sorted() does in batches. On a stream each row is given out as soon
as it is folded, with a revision of 0; when a later micro-batch brings a row that belongs before it, the fold is taken up
from the state before that row, and every row whose result changes by that is given out again, with the next revision.
So the last revision of each row is the batch result over the same rows, however the stream was cut or shuffled.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.baselines import GATE_INPUTS, GATE_OUTPUTS, KEYS, REFERENCE, ROLLING, gate
from ..operators.kalman import ACCELERATION_STD, MEASUREMENT_STD, RESET_GAP_S, altitude_filter

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Refold(StatefulProcessor):
    """start(state) gives a step over (order, inputs) to outputs, or None for a row that is left out; step.state() tells its state.

    `order` are long columns, unique in a key; rows that are further behind the newest one than `horizon`, in units of the
    first, can no longer be placed: they are given out with kept null. History is as long as the horizon.
    """

    def __init__(self, start: Callable, keys: list[str], order: list[str], inputs: list[str], outputs: list[str], horizon: int):
        self.start, self.keys, self.order, self.inputs, self.outputs, self.horizon = start, keys, order, inputs, outputs, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getListState("history", "place array<bigint>, inputs string, before string, output string, revision int")
        self.head = handle.getValueState("head", "sequence long, base string, floor array<bigint>")  # base: the state after all that is forgotten

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.head.update((0, row["state"], [int(x) for x in row["floor"]]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sequence, base, floor = self.head.get() if self.head.exists() else (0, None, None)
        floor = None if floor is None else tuple(floor)
        kept = [(tuple(place), *rest) for place, *rest in self.history.get()] if self.history.exists() else []
        fresh = pd.concat(list(rows))
        new = []
        for place, inputs in zip(zip(*(fresh[c].astype("int64") for c in self.order), strict=True), zip(*(fresh[c].astype(object).where(fresh[c].notna(),
                None) for c in self.inputs), strict=True), strict=True):
            new.append((tuple(map(int, place)), json.dumps(list(inputs), default=lambda x: x.item())))
        out = []

        def tell(place, inputs, kept_now, output, revision):
            nonlocal sequence
            out.append((*key, *place, *json.loads(inputs), *(json.loads(output) or [None] * len(self.outputs)), kept_now, revision, sequence))
            sequence += 1

        known = {place for place, *_ in kept}
        timely = []
        for place, inputs in sorted(new):
            if floor is not None and place <= floor:
                tell(place, inputs, None, "null", 0)
            elif place not in known:  # a repeated row is the one that is there
                known.add(place)
                timely.append((place, inputs))
        if timely:
            at = bisect_left(kept, timely[0][0], key=lambda x: x[0])
            state = kept[at][2] if at < len(kept) else self._after(kept, base)
            step = self.start(None if state in (None, "null") else json.loads(state))
            todo = sorted([(x[0], x[1], x[3], x[4]) for x in kept[at:]] + [(place, inputs, None, -1) for place, inputs in timely])
            done = kept[:at]
            for place, inputs, old, revision in todo:
                before = json.dumps(step.state())
                output = json.dumps(step(place, json.loads(inputs)))
                if output != old and not (old is None and output == "null"):
                    revision += 1
                    tell(place, inputs, output != "null", output, revision)
                done.append((place, inputs, before, output, max(revision, 0)))
            newest = done[-1][0][0]
            cut = next(i for i, x in enumerate(done) if x[0][0] >= newest - self.horizon)
            if cut:
                base, floor = done[cut][2], done[cut - 1][0]
            self.history.put([(list(place), *rest) for place, *rest in done[cut:]])
        self.head.update((sequence, base, None if floor is None else list(floor)))
        names = [*self.keys, *self.order, *self.inputs, *self.outputs, "kept", "revision", "sequence"]
        yield pd.DataFrame(out, columns=names)

    def _after(self, kept: list[tuple], base: str | None) -> str | None:
        """The state after the newest row."""
        if not kept:
            return base
        place, inputs, before, *_ = kept[-1]
        step = self.start(None if before == "null" else json.loads(before))
        step(place, json.loads(inputs))
        return json.dumps(step.state())

    def close(self) -> None:
        pass


def refolded(stream: DataFrame, start: Callable, keys: list[str], order: list[str], inputs: list[str], outputs: str, horizon: int,
        initial: DataFrame | None = None) -> DataFrame:
    """The stream's rows with outputs, kept, revision and sequence (rising within a key); see Refold.

    initial has the keys, `state` (as step.state() tells it, in JSON) and `floor` (the order of the last row in it) of series
    that began before the stream. The session's states are kept by RocksDB from now on.
    """
    stream.sparkSession.conf.set(PROVIDER, ROCKS)
    kinds = dict(stream.dtypes)
    names = [part.split()[0] for part in outputs.split(", ")]
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), *(f"{c} long" for c in order), *(f"{c} {kinds[c]}" for c in inputs), outputs,
        "kept boolean, revision int, sequence long"])
    grouped = stream.select(*keys, *order, *inputs).groupBy(*keys)
    seeds = None if initial is None else initial.select(*keys, "state", F.col("floor").alias("floor")).groupBy(*keys)
    return grouped.transformWithStateInPandas(Refold(start, keys, order, inputs, names, horizon), schema, "Append", "None", seeds)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of what a refolded stream gave out, the last word on each row that is kept."""
    last = F.row_number().over(Window.partitionBy(*keys, *order).orderBy(F.desc("sequence")))
    return rows.filter("kept IS NOT NULL").withColumn("place", last).filter("place = 1 AND kept").drop("place", "kept", "revision", "sequence")


def _altitude_fold(reset_gap_s: float, second_us: float) -> Callable:
    begin = altitude_filter(ACCELERATION_STD**2, MEASUREMENT_STD**2)

    def start(state: list | None):
        last = None if not state else state[0]
        advance = begin(list(state[1:]) if state else None)

        def step(place, inputs):
            nonlocal last
            if inputs[0] is None:
                return None
            dt = None if last is None else (place[0] - last) / second_us
            if dt is not None and dt <= 0:
                return None
            last = place[0]
            return list(advance(inputs[0], None if dt is None or dt > reset_gap_s else dt))

        step.state = lambda: None if last is None else [last, *advance.state()]
        return step

    return start


def corrected_filter(stream: DataFrame, value: str = "altitude", horizon_s: int = 3600, reset_gap_s: float = RESET_GAP_S, second_us: float = 1e6) -> DataFrame:
    """kalman.smooth() on a stream whose readings may come late by horizon_s: corrections follow with higher revisions.

    Needs drone_id, reading_id, us and the value. A reading that turns out to repeat the time of one with a smaller id is
    given out once more with kept false.
    """
    rows = stream.select("drone_id", "us", "reading_id", F.col(value).cast("double").alias("value"))
    outputs = "filtered double, velocity double, deviation double, innovation double, nis double"
    return refolded(rows, _altitude_fold(reset_gap_s, second_us), ["drone_id"], ["us", "reading_id"], ["value"], outputs, int(horizon_s * second_us))


def _gate_fold(state: list | None):
    judge = gate(state)

    def step(place, inputs):
        return list(judge(*inputs))

    step.state = judge.state
    return step


def live_admission(stream: DataFrame, initial: DataFrame | None = None, horizon: int = 64) -> DataFrame:
    """baselines.admit() on a stream of observations: decisions carry over from one micro-batch to the next.

    initial is gate_states() of the history that a batch has admitted. A flight that is analysed late, by up to `horizon`
    flights, goes to its place, and decisions about later flights follow as corrections.
    """
    return refolded(stream, _gate_fold, KEYS, ["flight_index"], GATE_INPUTS, GATE_OUTPUTS, horizon, initial)


def gate_states(admitted: DataFrame) -> DataFrame:
    """(keys, state, floor): the gate of each series after the rows of baselines.admit()."""
    by = Window.partitionBy(*KEYS)
    values = F.struct("flight_index", "value")
    rows = admitted.withColumn("nth", F.when(F.col("admitted"), F.sum(F.col("admitted").cast("int")).over(by.orderBy("flight_index"))))
    rows = rows.withColumn("back", F.when(F.col("admitted"), F.sum(F.col("admitted").cast("int")).over(by.orderBy(F.desc("flight_index")))))
    listed = lambda condition: F.transform(F.sort_array(F.collect_list(F.when(condition, values))), lambda x: x["value"])
    out = rows.groupBy(*KEYS).agg(
        F.max("flight_index").cast("long").alias("newest"),
        F.count_if("admitted").alias("count"),
        listed(F.col("back") <= ROLLING).alias("rolling"),
        listed(F.col("nth") <= REFERENCE).alias("reference"),
    )
    state = F.concat(F.lit("["), F.col("count").cast("string"), F.lit(","), F.to_json("rolling"), F.lit(","), F.to_json("reference"), F.lit("]"))
    return out.select(*KEYS, state.alias("state"), F.array("newest").alias("floor"))
