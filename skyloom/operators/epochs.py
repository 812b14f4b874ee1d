"""Configuration changes: from declarations and parameter differences to the epoch that each feature is in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalogue import change_type, is_watched

# Tolerances of a parameter comparison.
RELATIVE, ABSOLUTE = 1e-6, 1e-9


def flight_of_change(changes: DataFrame, flights: DataFrame, key: str = "drone_id") -> DataFrame:
    """changes with flight_index: the first flight at or after each change, else the number of flights.

    changes has key and us; flights key, us and flight_index from 0. Both are merged in time order and each change takes
    the smallest index to come, so there is no range join.
    """
    both = flights.select(key, "us", "flight_index").withColumn("side", F.lit(1)).unionByName(changes.withColumn("side", F.lit(0)), allowMissingColumns=True)
    ahead = Window.partitionBy(key).orderBy(F.desc("us"), F.desc("side")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("ahead", F.min("flight_index").over(ahead)).withColumn("flights", F.count("flight_index").over(Window.partitionBy(key)))
    return both.filter("side = 0").withColumn("flight_index", F.coalesce("ahead", "flights").cast("int")).select(*changes.columns, "flight_index")


def feature_epoch(observations: DataFrame, events: DataFrame, resets: DataFrame, key: str = "drone_id") -> DataFrame:
    """observations with epoch: the latest event at or before the flight that resets the feature; null before any.

    events has key, flight_index, seq (order among events), epoch (its name) and change_type. Of events at one flight the
    later in seq counts. Events and observations are merged in flight order per feature.
    """
    marks = events.join(resets, "change_type").select(key, "feature_key", "flight_index", F.struct("seq", "epoch").alias("event"), "seq")
    both = observations.withColumn("side", F.lit(1)).unionByName(marks.withColumn("side", F.lit(0)), allowMissingColumns=True)
    upto = Window.partitionBy(key, "feature_key").orderBy("flight_index", "side", "seq").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("epoch", F.last("event", ignorenulls=True).over(upto)["epoch"]).filter("side = 1")
    return both.select(*observations.columns, "epoch")


def latest_epoch(flights: DataFrame, events: DataFrame, key: str = "drone_id") -> DataFrame:
    """flights with epoch: the latest event of any type at or before each flight."""
    both = flights.withColumn("side", F.lit(1)).unionByName(events.select(key, "flight_index", "seq",
        F.struct("epoch").alias("event")).withColumn("side", F.lit(0)), allowMissingColumns=True)
    upto = Window.partitionBy(key).orderBy("flight_index", "side", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("epoch", F.last("event", ignorenulls=True).over(upto)["epoch"]).filter("side = 1").select(*flights.columns, "epoch")


def watched(params: DataFrame) -> DataFrame:
    """params (drone_id, flight_index, name, value) that matter; slots of absent rotors are left out."""
    count = F.max(F.when(F.col("name") == "CA_ROTOR_COUNT", F.col("value").cast("double"))).over(Window.partitionBy("drone_id", "flight_index"))
    slot = F.when(F.col("name").startswith("CA_ROTOR"), F.regexp_extract("name", r"^CA_ROTOR(\d+)_", 1)).otherwise("")
    rows = params.filter(is_watched(F.col("name"))).withColumn("count", count)
    unused = F.when(slot != "", slot.cast("int") >= F.col("count"))
    return rows.filter(~F.coalesce(unused, F.lit(False))).drop("count")


def differs(a: Column, b: Column) -> Column:
    """Whether two values differ: as numbers, within tolerances, where both are; else as text."""
    x, y = a.try_cast("double"), b.try_cast("double")
    near = F.abs(x - y) <= F.greatest(RELATIVE * F.greatest(F.abs(x), F.abs(y)), F.lit(ABSOLUTE))
    return F.when(x.isNotNull() & y.isNotNull(), ~near).otherwise(a != b)


def parameter_changes(params: DataFrame) -> DataFrame:
    """(drone_id, flight_index, name, old, new, change_type): watched parameters that changed since the flight before.

    A parameter that only one of two neighbouring flights has did not change.
    """
    by = Window.partitionBy("drone_id", "name").orderBy("flight_index")
    rows = watched(params).withColumns({"old": F.lag("value").over(by), "at": F.lag("flight_index").over(by)})
    rows = rows.filter((F.col("at") == F.col("flight_index") - 1) & differs(F.col("old"), F.col("value")))
    return rows.select("drone_id", "flight_index", "name", "old", F.col("value").alias("new"), change_type(F.col("name")).alias("change_type"))


def events_from_parameters(changes: DataFrame) -> DataFrame:
    """(drone_id, flight_index, change_type, epoch, note): one event for each flight and type, with the names that changed."""
    out = changes.groupBy("drone_id", "flight_index", "change_type").agg(F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("note"))
    return out.withColumn("epoch", event_key(F.lit(None), F.lit("params"), F.col("flight_index"), F.col("change_type")))


def merged(declared: DataFrame, detected: DataFrame) -> DataFrame:
    """(drone_id, flight_index, source, change_type, epoch, seq): declared and detected changes in flight order.

    declared: (drone_id, flight_index, seq, change_type, epoch); detected: rows of events_from_parameters. At one flight
    declared changes come first, in their own order. seq counts from 1 for each vehicle.
    """
    one = declared.select("drone_id", "flight_index", F.lit("declared").alias("source"), "change_type", "epoch", F.col("seq").cast("long").alias("own"))
    two = detected.select("drone_id", "flight_index", F.lit("detected").alias("source"), "change_type", "epoch", F.lit(0).cast("long").alias("own"))
    order = Window.partitionBy("drone_id").orderBy("flight_index", "source", "own", "change_type")
    return one.unionByName(two).withColumn("seq", F.row_number().over(order)).drop("own")


def event_key(epoch_id: Column, source: Column, flight: Column, change: Column) -> Column:
    """The stored id, else a name that later events don't alter."""
    return F.coalesce(epoch_id.cast("string"), F.concat_ws("-", source, flight.cast("string"), change))
