"""Deleting flights: admissions and baselines as if they had never been, refolded from the state before them, in touched series only."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .baselines import GATE_INPUTS, GATE_OUTPUTS, KEYS, MAD_SCALE, REFERENCE, ROLLING, gate
from .folds import fold_sorted
from .scans import stored

STATE = "gate_state string"
#: Vehicles of deleted flights that are named to the scan of a stored table; beyond, it is joined with them.
NAMED = 1_000


def _recorded():
    """The admission step, which also tells the state before each row, and can take one up at the first."""
    step = None

    def run(start, *inputs):
        nonlocal step
        if step is None:
            step = gate(None if start is None else json.loads(start))
        before = json.dumps(step.state())
        return (*step(*inputs), before)

    return run


def admit_recorded(observations: DataFrame, start: str | None = None) -> DataFrame:
    """baselines.admit() with gate_state, the state of the gate before each row, in JSON (16 numbers at most).

    start names a column with the state that a series begins with; null for a new one.
    """
    rows = observations.withColumn("_start", F.lit(None).cast("string") if start is None else F.col(start))
    return fold_sorted(rows, KEYS, ["flight_index"], _recorded, ["_start", *GATE_INPUTS], f"{GATE_OUTPUTS}, {STATE}").drop("_start")


def without_flights(recorded: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed, gone) of the rows of admit_recorded() when flights (drone_id, flight_index) are deleted.

    changed are the rows of touched series behind their first deleted flight, admitted anew from the state before it; gone
    is (table, deleted). Earlier rows and other series stay as they are and are not folded.
    """
    doomed = doomed.select("drone_id", "flight_index").distinct().withColumn("doomed", F.lit(True))
    marked = recorded.join(doomed, ["drone_id", "flight_index"], "left")
    order = Window.partitionBy(*KEYS).orderBy("flight_index")
    first = F.first(F.when(F.col("doomed"), F.col("gate_state")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    later = marked.withColumn("_state", first).filter("_state IS NOT NULL AND doomed IS NULL")
    names = [c.split()[0] for c in f"{GATE_OUTPUTS}, {STATE}".split(", ")]
    changed = admit_recorded(later.drop("doomed", *names), "_state").drop("_state").select(*recorded.columns)
    features = marked.filter("doomed").agg(F.count(F.lit(1)).alias("deleted")).select(F.lit("flight_features").alias("table"), "deleted")
    flights = marked.filter("doomed").select("drone_id", "flight_index").distinct().agg(F.count(F.lit(1)).alias("deleted")).select(F.lit("flights").alias("table"), "deleted")
    return changed, flights.unionByName(features)


def rebuilt(recorded: DataFrame, doomed: DataFrame) -> DataFrame:
    """All admissions after the deletion: unchanged rows, and those that were folded anew."""
    changed, _ = without_flights(recorded, doomed)
    place = [*KEYS, "flight_index"]
    gone = doomed.select("drone_id", "flight_index").distinct()
    kept = recorded.join(gone, ["drone_id", "flight_index"], "left_anti").join(changed.select(*place), place, "left_anti")
    return kept.unionByName(changed)


def final_baselines(admitted: DataFrame) -> DataFrame:
    """(keys, kind, median, mad, spread, n, flights) that the next flight is judged against: rolling and, from five on, reference.

    Needs admitted, value, floor and relative_floor. A series without an admitted value has none.
    """
    rows = admitted.filter("admitted")
    by = Window.partitionBy(*KEYS)
    rows = rows.withColumn("back", F.row_number().over(by.orderBy(F.desc("flight_index")))).withColumn("nth", F.row_number().over(by.orderBy("flight_index")))
    kinds = F.explode(F.array_compact(F.array(F.when(F.col("back") <= ROLLING, "rolling"), F.when(F.col("nth") <= REFERENCE, "reference")))).alias("kind")
    held = rows.select(*KEYS, "flight_index", "value", "floor", "relative_floor", kinds).groupBy(*KEYS, "kind").agg(
        F.sort_array(F.collect_list("value")).alias("v"), F.sort_array(F.collect_list("flight_index")).alias("flights"), F.first("floor").alias("floor"),
        F.first("relative_floor").alias("relative_floor"))  # ROLLING values at most
    middle = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2
    held = held.withColumn("n", F.size("v")).filter(f"kind = 'rolling' OR n = {REFERENCE}").withColumn("median", middle(F.col("v")))
    held = held.withColumn("mad", middle(F.sort_array(F.transform("v", lambda x: F.abs(x - F.col("median"))))))
    spread = F.greatest(MAD_SCALE * F.col("mad"), F.col("floor"), F.col("relative_floor") * F.abs("median"))
    return held.select(*KEYS, "kind", "median", "mad", spread.alias("spread"), "n", "flights")


def _of_vehicles(table: DataFrame, doomed: DataFrame) -> DataFrame:
    vehicles = [r.drone_id for r in doomed.select("drone_id").distinct().limit(NAMED + 1).collect()]
    if len(vehicles) <= NAMED:
        return table.filter(F.col("drone_id").isin(vehicles))  # prunes the folders of all others
    return table.join(doomed.select("drone_id").distinct(), "drone_id", "left_semi")


def delete_flights(spark: SparkSession, path: str, baselines_path: str, doomed: DataFrame) -> DataFrame:
    """Deletes flights from a table of admit_recorded() at path, stored by drone_id, and rebuilds what follows; returns (table, deleted).

    Only the folders of the vehicles concerned are read and replaced, there and in the table of final_baselines(). Replaced
    rows are written beside the table first, so that it is never read and overwritten at once.
    """
    own = stored(_of_vehicles(spark.read.parquet(path), doomed))
    _, gone = without_flights(own, doomed)
    gone = stored(gone)
    after = stored(rebuilt(own, doomed))
    emptied = own.select("drone_id").distinct().join(after.select("drone_id").distinct(), "drone_id", "left_anti")
    for rows, where in ((after, path), (final_baselines(after), baselines_path)):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("drone_id").parquet(where)
        for r in emptied.collect():  # vehicles of which no flight is left, among those of the deleted flights
            _remove(spark, f"{where}/drone_id={r.drone_id}")
    return gone


def _remove(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)

