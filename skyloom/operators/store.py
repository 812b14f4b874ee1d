"""Table maintenance as set operations: deduplication, cascades, partial updates, deletes and write-backs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by_content(rows: DataFrame, keys: list[str], content: Column, order: list[str], failed: Column | None = None) -> DataFrame:
    """The first row of each content per key, by SHA-256; rows whose upload failed don't hold their content back."""
    rows = rows.withColumn("content_sha256", F.sha2(content, 256))
    place = F.row_number().over(Window.partitionBy(*keys, "content_sha256").orderBy(F.coalesce(failed, F.lit(False)) if failed is not None
        else F.lit(0), *order))
    return rows.withColumn("place", place).filter("place = 1").drop("place")


def new_content(uploads: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Uploads whose content is not stored yet under their key."""
    return uploads.join(stored.select(*keys, "content_sha256"), [*keys, "content_sha256"], "left_anti")


def cascade(doomed: DataFrame, children: list[tuple[str, DataFrame, str, str]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Counts of rows that go with the doomed ones, level by level, and what survives of each table.

    children: (name, table, parent key column, own key column) from the top down; each level's doomed rows are those
    whose parent key is doomed. Nothing is collected: levels are chained semi-joins.
    """
    spark = doomed.sparkSession
    keys, counts, survivors = doomed.select(F.col(doomed.columns[0]).alias("k")), [], {}
    for name, table, parent, own in children:
        on = table[parent] == keys["k"]
        gone = table.join(keys, on, "left_semi")
        survivors[name] = table.join(keys, on, "left_anti")
        counts.append(gone.agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(name).alias("table"), "deleted"))
        keys = gone.select(F.col(own).alias("k")).distinct()
    out = counts[0] if counts else spark.createDataFrame([], "table string, deleted long")
    for one in counts[1:]:
        out = out.unionByName(one)
    return out, survivors


def updated(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with the fields that changes sets; a null there leaves the field as it is. One change row per key."""
    fields = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *(F.col(c).alias(f"new_{c}") for c in fields))
    rows = base.join(renamed, key, "left")
    return rows.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns))


def without(rows: DataFrame, doomed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(survivors, one row with the number deleted)."""
    keys = doomed.select(key).distinct()
    return rows.join(keys, key, "left_anti"), rows.join(keys, key, "left_semi").agg(F.count(F.lit(1)).alias("deleted"))


def append(rows: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Appends rows to a Parquet table."""
    rows.write.mode("append").partitionBy(*(partition or [])).parquet(path)


def replace_partitions(rows: DataFrame, path: str, partition: list[str]) -> None:
    """Overwrites only the partitions that rows touch: the write-back of derived rows of some vehicles."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def with_baselines(features: DataFrame, admissions: DataFrame, keys: list[str]) -> DataFrame:
    """features with admitted and quarantine_reason of their admission row; null where a feature has none."""
    return features.drop("admitted", "quarantine_reason").join(admissions.select(*keys, "admitted", "quarantine_reason"), keys, "left")
