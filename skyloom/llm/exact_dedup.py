"""Exact deduplication: per-partition counting quotient filters, merged by sorted remainders, route repeats to byte verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, broadcast_if_small, discard, first_row, mark, without_dropped, written
from .quotient_filter import CountingQuotientFilter

#: Fingerprints that one merge block holds on average; blocks are added as the table grows.
BLOCK_FINGERPRINTS = 1 << 19
#: Quotients in a block of a partition's filter.
RUN_BITS = 6


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """(fp, count) of each fingerprint that occurs more than once in the one long column of the table.

    Every partition builds a filter over its own rows, so a copy group of any size leaves it as one counted
    remainder. Filters are cut into blocks of neighbouring quotients; each block is merged by itself, in quotients of
    its own, at a cost in proportion to what its parts hold.
    """
    block_bits = max(2, int(np.ceil(np.log2(max(1, rows) / BLOCK_FINGERPRINTS + 1e-9))))
    column = fingerprints.columns[0]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[CountingQuotientFilter] = []
        for batch in batches:
            parts.append(CountingQuotientFilter.of(block_bits + RUN_BITS, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            if len(parts) >= 32:
                parts = [CountingQuotientFilter.merged(parts)]
        for block, own in CountingQuotientFilter.merged(parts).blocks(block_bits) if parts else ():
            data = [[own.runs.astype("<u4").tobytes()], [own.remainders.astype("<u8").tobytes()], [own.counts.astype("<i8").tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array(x, pa.binary()) for x in data)], ["block", "runs",
                "remainders", "counts"])

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        found = CountingQuotientFilter.merged(
            [CountingQuotientFilter(64 - block_bits, RUN_BITS, np.frombuffer(r, "<u4"), np.frombuffer(m, "<u8"), np.frombuffer(c, "<i8"))
                for r, m, c in zip(parts.runs, parts.remainders, parts["counts"], strict=True)]
        )
        fingerprints, counts = found.repeated()
        return pd.DataFrame({"fp": ((np.uint64(key[0]) << np.uint64(64 - block_bits)) | fingerprints).view(np.int64), "n": counts})

    built = fingerprints.select(column).mapInArrow(build, "block int, runs binary, remainders binary, counts binary")
    return built.groupBy("block").applyInPandas(merge, "fp long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, mark (a hash of the text as it is), stays.

    Texts are equal when their bytes are, after normalised(). Null text counts as empty. keep_id is the smallest
    id of the group, nulls last; kept says whether the row carries it, so rows repeated with one id share their fate;
    stays holds for one (id, mark) of a group. An empty table gives an empty result. Other columns of docs are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"),
        mark(F.col(text_col)).alias("mark")).withColumn("fp", F.xxhash64("norm"))
    digest = written(rows.select("id", "mark", "fp", F.unhex(F.sha2("norm", 256)).alias("sha")), "digest")
    repeated = written(repeated_fingerprints(digest.select("fp"), digest.count()).select("fp"), "repeated")
    # Byte verification: the grouping key is the text itself. Map-side aggregation leaves one text per task and group.
    candidates = rows.join(broadcast_if_small(repeated), "fp", "left_semi")
    groups = candidates.groupBy("fp", "norm").agg(F.min(first_row(F.col("id"), F.col("mark"))).alias("first"), F.count(F.lit(1)).alias("size"))
    groups = written(groups.filter("size > 1").select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), F.col("first.id").alias("keep"),
        F.col("first.mark").alias("first_mark"), "size"), "groups")
    discard(repeated)
    found = digest.join(broadcast_if_small(groups), ["fp", "sha"], "left")
    alone = F.col("size").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.col("keep"))
    kept = F.col("id").eqNullSafe(keep)
    return found.select(
        F.col("id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        kept.alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "mark",
        (kept & (alone | (F.col("mark") == F.col("first_mark")))).alias("stays"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup lets stay, with their columns: one of each group of equal texts."""
    return without_dropped(docs, exact_dedup(docs, id_col, text_col), id_col, text_col)
