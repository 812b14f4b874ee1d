"""Scans in order over keys of any size: rows are dealt by ranges of (key, order), and what lies beyond a range is carried into it.

A key that holds a third of all rows is spread over as many ranges as its rows fill. Each range tells a summary of its first
and its last piece (the rows of one key in it); the driver combines these, two for each range at most, into what comes
before and after, and a second pass over the same ranges does the work. So no key is held in one task.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Column with the number of a range.
PART = "_part"


def stored(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder of spark.checkpoint.dir, with its partitions; a local session without one gets a temporary folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="skyloom-"))
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over as many tasks as the session shuffles to.

    For small tables whose rows take long: a file that is one split would be one task, and of a shuffle without a number
    adaptive execution makes few.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


#: Rows that a task sorts.
TASK_ROWS = 100_000


def dealt(rows: DataFrame, total: int, *keys: str) -> DataFrame:
    """rows by hash of keys, in as many parts as `total` of them fill: what one task sorts doesn't grow with the table."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS)), *keys)


def split(rows: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame | None]:
    """(plain, large): rows of keys that a task can hold, dealt by key, and those of keys with more than TASK_ROWS rows, None without any.

    The sizes are a job of their own, which runs now; of keys, only the large ones reach the driver, one for TASK_ROWS
    rows at most.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    told = sizes.agg(F.sum("_rows").alias("total"), F.collect_list(F.when(F.col("_rows") > TASK_ROWS, F.struct(*keys))).alias("large")).first()
    if not told.large:
        return dealt(rows, told.total or 0, *keys), None
    large = F.broadcast(rows.sparkSession.createDataFrame(told.large, rows.select(*keys).schema))
    return dealt(rows.join(large, [*keys], "left_anti"), told.total, *keys), rows.join(large, [*keys], "left_semi")


def _pieces(rows: pd.DataFrame, keys: list[str]) -> list[tuple[tuple, int, int]]:
    """(key, start, end) of each key's rows in a sorted frame; null keys are equal."""
    if rows.empty:
        return []
    columns = [rows[k] for k in keys]
    new = reduce(np.logical_or, [((c != c.shift()) & ~(c.isna() & c.shift().isna())).to_numpy() for c in columns])
    new[0] = True
    starts = np.flatnonzero(new)
    return [(tuple(None if pd.isna(c.iloc[a]) else c.iloc[a] for c in columns), int(a), int(b)) for a, b in zip(starts, [*starts[1:], len(rows)], strict=True)]


def scanned(rows: DataFrame, keys: list[str], order: list[str], summarise: Callable[[pd.DataFrame], object], combine: Callable[[object, object], object],
        run: Callable[[pd.DataFrame, object | None, object | None], pd.DataFrame | list[tuple]], schema: str, parts: int | None = None) -> DataFrame:
    """The rows that run(piece, before, after) makes of every piece, as a frame or, where pieces are small, as a list of rows.

    A piece is the rows of one key in one range, in order; rows that are equal in keys and order stay in one range. before
    and after are the combined summaries of the key's pieces in earlier and later ranges, None without any. combine() is
    associative and takes summaries in order. There are `parts` ranges (by default spark.sql.shuffle.partitions), of about
    the same size each; a task holds one. The dealing and the summaries are jobs of their own, which run now.
    """
    spark = rows.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The number of a range goes with its rows: a task's own number is another one where the result is part of a union.
    dealt = stored(rows.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn(PART, F.spark_partition_id()))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(batches) or [pd.DataFrame()])
        found = _pieces(own, keys)
        told = [(key, summarise(own.iloc[a:b])) for key, a, b in ([found[0], found[-1]] if len(found) > 1 else found)]
        if told:
            yield pd.DataFrame({"part": [int(own[PART].iat[0])], "told": [pickle.dumps(told)]})

    told = {r.part: pickle.loads(r.told) for r in dealt.mapInPandas(ends, "part int, told binary").collect()}
    order_of = sorted(told)
    before, after = _carried(order_of, told, combine), _carried(order_of[::-1], {p: x[::-1] for p, x in told.items()}, lambda a, b: combine(b, a))
    known = spark.sparkContext.broadcast((before, after))

    names = [part.split()[0] for part in schema.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(batches) or [pd.DataFrame()])
        found, part = _pieces(own, keys), int(own[PART].iat[0]) if len(own) else None
        own = own.drop(columns=PART) if len(own) else own
        frames, rows, held = [], [], 0
        for i, (_, a, b) in enumerate(found):
            first, last = known.value[0].get(part) if i == 0 else None, known.value[1].get(part) if i == len(found) - 1 else None
            made = run(own.iloc[a:b], first, last)
            held += len(made)
            if isinstance(made, list):
                rows += made
            elif len(made):
                frames.append(made)
            if held > 50_000 or i == len(found) - 1:
                if rows:
                    frames.append(pd.DataFrame(rows, columns=names))
                if frames:
                    yield pd.concat(frames)
                frames, rows, held = [], [], 0

    return dealt.mapInPandas(work, schema)


def _carried(parts: list[int], told: dict[int, list], combine: Callable) -> dict[int, object]:
    """For each range, the combined summaries of the ranges before it that end with the key it begins with."""
    out, key, held = {}, None, None
    for p in parts:
        first, *rest = told[p]
        if key is not None and first[0] == key[0]:
            out[p] = held
        if rest:
            key, held = (rest[-1][0],), rest[-1][1]
        else:
            held = combine(held, first[1]) if p in out else first[1]
            key = (first[0],)
    return out


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, n, q): exact quantiles q of each key, an array in the order of shares, linear between neighbouring values; nulls don't count.

    Keys that a task can hold are ranked in a window. Of larger ones (split()), values are counted first, so one that
    repeats is one row; then ranks are looked for among the sorted values, range by range. A key without values is absent.
    """
    own = [F.col(k).alias(k) for k in keys]  # columns of their own, so that the result joins rows
    plain, large = split(rows.filter(F.col(value).isNotNull()).select(*own, (F.col(value).cast("double") + 0.0).alias("_v")), *keys)
    by = Window.partitionBy(*keys)
    ranked = plain.select(*keys, "_v", (F.row_number().over(by.orderBy("_v")) - 1).alias("_rank"), F.count(F.lit(1)).over(by).alias("_n"))

    def at(share: float) -> Column:
        place = share * (F.col("_n") - 1)
        return F.sum(F.when((F.col("_rank") == F.floor(place)) | (F.col("_rank") == F.ceil(place)), F.when(place == F.floor(place),
            F.col("_v")).otherwise(F.col("_v") * (1 - F.abs(place - F.col("_rank"))))))

    found = ranked.groupBy(*keys).agg(F.max("_n").alias("n"), F.array(*map(at, shares)).alias("q"))
    return found if large is None else found.unionByName(_scanned_quantiles(large, keys, shares).coalesce(1))  # few rows


def _scanned_quantiles(rows: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """quantiles() of the values _v of keys of any size."""
    counted = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    kinds = dict(counted.dtypes)

    def pick(piece: pd.DataFrame, before: int | None, after: int | None) -> list[tuple]:
        ends, values = piece["_n"].to_numpy().cumsum() + (before or 0), piece["_v"].to_numpy(float)
        total = int(ends[-1]) + (after or 0)
        key, out = tuple(piece[k].iat[0] for k in keys), []
        for i, share in enumerate(shares):
            place = share * (total - 1)
            for rank in {int(np.floor(place)), int(np.ceil(place))}:
                if (before or 0) <= rank < ends[-1]:
                    weight = 1.0 if place == int(place) else 1 - abs(place - rank)
                    out.append((*key, total, i, float(values[np.searchsorted(ends, rank, side="right")]) * weight))
        return out

    found = scanned(counted, keys, ["_v"], lambda piece: int(piece["_n"].sum()), lambda a, b: a + b, pick,
        ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n long, i int, part double"]))
    each = [F.sum(F.when(F.col("i") == i, F.col("part"))) for i in range(len(shares))]
    return found.groupBy(*keys).agg(F.max("n").alias("n"), F.array(*each).alias("q"))
