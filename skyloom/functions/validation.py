"""Range checks of specifications, environments and scene objects, as arrays of reasons instead of exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lowest and highest accepted value of each field; kinds of scene object.
SPEC_LIMITS = {
    "mass_kg": (0.01, 50.0),
    "max_speed_mps": (0.0, 100.0),
    "motor_count": (1.0, 16.0),
    "max_thrust_n": (0.0, 3000.0),
    "battery_capacity_mah": (50.0, 100000.0),
    "propeller_diameter_in": (1.0, 40.0),
    "motor_kv": (30.0, 3000.0),
    "battery_cells": (1.0, 16.0),
    "wing_area_m2": (0.01, 20.0),
    "lift_to_drag_ratio": (3.0, 60.0),
}
ENVIRONMENT_LIMITS = {"altitude_m": (-500.0, 9000.0), "temperature_c": (-60.0, 60.0), "wind_speed_mps": (0.0, 40.0)}
PACK_LIMITS = {"cell_count": (1.0, 24.0), "capacity_mah": (5e-324, float("inf"))}
OBJECT_TYPES = ("obstacle", "landing", "path", "building", "tree")


def out_of_range(columns: list[str], limits: dict[str, tuple[float, float]]) -> Column:
    """Array of the named fields whose value lies outside its limits; nulls pass."""
    checks = [F.when(~F.col(c).between(*limits[c]), c) for c in columns if c in limits]
    return F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.array().cast("array<string>")


def split_valid(rows: DataFrame, limits: dict[str, tuple[float, float]]) -> tuple[DataFrame, DataFrame]:
    """(rows within all limits, rows in quarantine with their reasons)."""
    checked = rows.withColumn("out_of_range", out_of_range(rows.columns, limits))
    return checked.filter(F.size("out_of_range") == 0).drop("out_of_range"), checked.filter(F.size("out_of_range") > 0)


def scene(objects: DataFrame, key: str = "drone_id") -> tuple[DataFrame, DataFrame]:
    """(obstacles, landing point of each vehicle): of several landing points the first by id counts; unknown kinds are left out."""
    landing = objects.filter("object_type = 'landing'").groupBy(key).agg(F.min_by(F.struct("x", "y", "z"), "id").alias("p")).select(key, "p.*")
    return objects.filter("object_type = 'obstacle'").select(key, "id", "x", "y", "z"), landing
