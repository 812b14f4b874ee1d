"""Sharding over fixed virtual slots: records hash into slots for good, and a versioned map says which shard holds a slot."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Virtual slots. The number never changes over the life of a corpus; only the map does.
SLOTS = 8192
#: Rows equal in id, checksum and size that one task writes out.
EQUAL_ROWS = 10_000


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot] is the shard of a slot; edits give a new map of the next version."""

    version: int
    shards: int
    shard_of: np.ndarray

    @classmethod
    def even(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(1, shards, np.arange(slots) % shards)

    def loads(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.shard_of, weight, self.shards).astype(np.int64)

    def rebalanced(self, weight: np.ndarray, tolerance: float = 1e-4) -> SlotMap:
        """Edits the map: moves a slot from the heaviest shard to a lighter one, or swaps two, wherever that narrows their gap.

        A shard that no edit makes lighter is settled, and the next heaviest follows, until all are settled or within
        tolerance of the mean.
        """
        shard_of, load = self.shard_of.copy(), self.loads(weight)
        open_shards, slack = set(range(self.shards)), tolerance * max(1.0, weight.sum() / self.shards)
        while len(open_shards) > 1:
            order = sorted(open_shards, key=lambda s: (load[s], s))
            heavy = order[-1]
            if load[heavy] - load[order[0]] <= slack:
                break
            mine = np.flatnonzero((shard_of == heavy) & (weight > 0))
            mine = mine[np.argsort(weight[mine], kind="stable")]
            for light in order[:-1]:
                gap = int(load[heavy] - load[light])
                theirs = np.r_[-1, np.flatnonzero((shard_of == light) & (weight > 0))]  # -1: a move without return
                back = np.where(theirs < 0, 0, weight[theirs])
                at = np.searchsorted(weight[mine], back + gap / 2)
                k = np.clip(np.stack([at - 1, at]), 0, len(mine) - 1)
                shift = weight[mine[k]] - back
                left = np.where((shift > 0) & (shift < gap), np.abs(gap - 2 * shift), gap)
                side, j = np.unravel_index(left.argmin(), left.shape)
                if left[side, j] < gap:
                    shard_of[mine[k[side, j]]] = light
                    if theirs[j] >= 0:
                        shard_of[theirs[j]] = heavy
                    load[heavy] -= shift[side, j]
                    load[light] += shift[side, j]
                    break
            else:
                open_shards.remove(heavy)
        return self if (shard_of == self.shard_of).all() else SlotMap(self.version + 1, self.shards, shard_of)

    def grown(self, weight: np.ndarray) -> SlotMap:
        """One more shard: it takes slots from the heaviest shards until it holds its share; no other slot moves."""
        shard_of, load, new = self.shard_of.copy(), self.loads(weight), self.shards
        share, held = weight.sum() / (new + 1), 0
        while True:
            heavy = int(load.argmax())
            mine = np.flatnonzero((shard_of == heavy) & (weight > 0) & (weight <= share - held))
            if not len(mine) or load[heavy] <= share:
                return SlotMap(self.version + 1, new + 1, shard_of)
            slot = int(mine[weight[mine].argmax()])
            shard_of[slot] = new
            load[heavy] -= weight[slot]
            held += weight[slot]


_MAP_SCHEMA = "version int, shards int, virtual_slot int, shard int"


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The map table at path, or None where there is none yet."""
    try:
        return spark.read.schema(_MAP_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def store_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Adds one version to the map table, in a folder of its own; a stored version is never changed, nor stored again.

    Of two jobs that store the same version at once, the folder lets one pass.
    """
    rows = [(slot_map.shards, slot, int(shard)) for slot, shard in enumerate(slot_map.shard_of)]
    table = spark.createDataFrame(rows, "shards int, virtual_slot int, shard int").coalesce(1)
    try:
        table.write.mode("errorifexists").parquet(f"{path}/version={slot_map.version}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        raise ValueError(f"version {slot_map.version} is stored at {path} already") from e


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
    """A stored version, by default the newest; None where there is none."""
    table = _stored(spark, path)
    if table is None:
        return None
    version = version if version is not None else table.agg(F.max("version")).first()[0]
    rows = table.filter(F.col("version") == version).orderBy("virtual_slot").collect()  # SLOTS rows
    return SlotMap(version, rows[0].shards, np.array([r.shard for r in rows])) if rows else None


def slot_weights(slotted: DataFrame, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of every slot; SLOTS rows reach the driver, whatever the table."""
    weight, rows = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for r in slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect():
        weight[r.virtual_slot], rows[r.virtual_slot] = r.bytes, r.rows
    return weight, rows


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot). Size: UTF-8 bytes of the text plus 8. Null text counts as empty.

    The slot is a hash of id, checksum and size, so copies with ids of their own spread, and of the row's number among
    those that are equal in all three, so that these spread too. Equal rows are counted, in each task first, and written
    out again from their counts by as many tasks as they need.
    """
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    out = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    counted = out.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / EQUAL_ROWS)))
    parts = counted.withColumn("part", part).repartition("doc_id", "size", "text_crc32", "part")
    last = F.least(F.col("n"), (F.col("part") + 1) * EQUAL_ROWS) - 1
    single = parts.withColumn("number", F.explode(F.sequence(F.col("part") * EQUAL_ROWS, last))).drop("n", "part")
    return single.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "number"), F.lit(slots)).cast("int")).drop("number")


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    Law `bytes`: bytes per slot are aggregated once, and the map is edited until no move or swap of slots brings the
    heaviest shard nearer another one. It starts from the newest version at map_path, which grows by whole shards where
    more are asked for (fewer are an error), else from an even map, and every edit is appended there as a new version;
    so a table that changed little moves few slots. slot is the row's place in its shard, from 0 without gaps, in order
    of virtual slot, id, checksum and size; rows equal in all of these may change places. Null ids come first in their
    slot. grown_shard is null under this law. An empty table gives an empty result and moves nothing.
    """
    spark = docs.sparkSession
    table = written(slotted(docs, id_col, text_col), "slotted")
    weight, rows = slot_weights(table)
    first = load_map(spark, map_path) if map_path is not None else None
    if first is None:
        first = SlotMap.even(shards)
        if map_path is not None:
            store_map(spark, first, map_path)
    if first.shards > shards:
        raise ValueError(f"the map at {map_path} has {first.shards} shards, more than {shards}")
    now = first
    while now.shards < shards:
        now = now.grown(weight)
    now = now.rebalanced(weight)
    if map_path is not None and now is not first:
        store_map(spark, now, map_path)
    # Where a slot begins in its shard: the rows of the shard's slots before it.
    order = np.lexsort((np.arange(len(rows)), now.shard_of))
    before = np.cumsum(rows[order]) - rows[order]
    starts = np.searchsorted(now.shard_of[order], now.shard_of[order])
    begin = np.empty(len(rows), np.int64)
    begin[order] = before - before[starts]
    places = spark.createDataFrame([(s, int(now.shard_of[s]), int(begin[s])) for s in range(len(rows))], "virtual_slot int, shard int, begin long")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return (
        table.withColumn("place", place)
        .join(F.broadcast(places), "virtual_slot")  # SLOTS rows
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("begin") + F.col("place") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(now.version).alias("map_version"))
    )
