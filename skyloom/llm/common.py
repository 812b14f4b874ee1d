"""Helpers shared by the corpus operators: durable tables, size-checked broadcasts, sorted streams."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of rows that are broadcast, as counted beforehand; above it Spark shuffles.
BROADCAST_BYTES = 8 << 20
#: A key that holds more than one part in so many of all rows is hot: there are at most so many hot keys.
HOT_PARTS = 200

#: Narrow rows that fill a file of a table whose size is known.
FILE_ROWS = 100_000

#: Rows of an Arrow batch, as rows here hold whole texts, sets or sketches.
ARROW_CONF, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 512
#: Texts that a Python task works on at once.
SLICE_ROWS = 256

#: ASCII white space, as the contracts define it.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary one; on a cluster a folder of one machine would lose data, so
    that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="skyloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """From now on rows of this session cross to Python in batches of ARROW_ROWS at most; a smaller setting stays."""
    now = int(spark.conf.get(ARROW_CONF))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(ARROW_CONF, ARROW_ROWS)


def written(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, so a lost executor costs its own tasks only.

    most is a bound of its narrow rows, where the caller knows one: then no more files than these need are written.
    Tables that no returned DataFrame reads are given to discard() by their makers; clean_up() removes all of a session.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    small_batches(spark)
    dealt = df if most is None else df.coalesce(-(-most // FILE_ROWS) or 1)
    dealt.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/skyloom-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() returned and nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, _PATHS.pop(table))


def clean_up(spark: SparkSession) -> None:
    """Deletes all tables that written() left in this session; results that were not collected or written can't be read then."""
    _delete(spark, _own_folder(spark))


def _row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: 8 a column, and the lengths of strings and binaries."""
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    return sum(wide, F.lit(8 * len(df.columns))).cast("long")


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint when its rows hold BROADCAST_BYTES at most, as summed now, else df, which is then shuffled.

    df has flat columns and should be a table or cheap to make, since it is read for the sum.
    """
    held = df.agg(F.sum(_row_bytes(df))).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def join_salted(many: DataFrame, one: DataFrame, keys: list[str], n: str, spread: list[str], total: int | None = None) -> DataFrame:
    """many joined with one, which has one row for each key and in column n the number of rows of many with it.

    Keys with more than a HOT_PARTS-th of all rows, of which there are HOT_PARTS at most, are dealt over several tasks:
    rows of many by a hash of the spread columns, while one's row is repeated for each part, 2 HOT_PARTS repetitions in
    all at most. So no task gets a key that holds, say, a third of all rows. Null keys are equal. `one` is read for its
    hot keys, whose hashes the driver collects, and for the rows in all where total doesn't tell them, so it should be
    a table or cheap to make. Column n is dropped.
    """
    own = [f"{k}_of_one" for k in keys]
    total = (one.agg(F.sum(n)).first()[0] or 0) if total is None else total
    share = max(1, total // HOT_PARTS)
    hot = dict(one.filter(F.col(n) > share).select(F.xxhash64(*keys), F.ceil(F.col(n) / share).cast("int")).collect())

    def salted(rows: DataFrame, name: str, salt) -> DataFrame:
        h = F.xxhash64(*keys)  # equal hashes of unequal keys are dealt alike, which does no harm
        parts = F.map_from_arrays(F.array(*map(F.lit, hot)), F.array(*map(F.lit, hot.values())))
        return rows.withColumn(name, salt(F.when(h.isin(list(hot)), F.element_at(parts, h)).otherwise(1)))

    if hot:
        many = salted(many, "salt", lambda parts: F.pmod(F.xxhash64(*spread), parts).cast("int"))
        one = salted(one, "salt_of_one", lambda parts: F.explode(F.sequence(F.lit(0), parts - 1)))
    pairs = [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)]
    if hot:
        pairs.append(F.col("salt") == F.col("salt_of_one"))
    renamed = one.select(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), *(c for c in one.columns if c not in (*keys, n)))
    return many.join(renamed, reduce(Column.__and__, pairs)).drop("salt", "salt_of_one", *own)


def fresh(rows: DataFrame, name: str) -> str:
    """name, lengthened until no column of rows has it."""
    while name.lower() in {c.lower() for c in rows.columns}:
        name += "_"
    return name


def mark(text: Column) -> Column:
    """A hash that tells rows of one id apart by their text; never null."""
    return F.xxhash64(text)


def without_dropped(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose (doc_id, mark) stays in found, with the columns of docs; of rows equal in both, one.

    found has a row (doc_id, mark, stays) for each row of docs. What is dropped is broadcast if small, else shuffled.
    """
    gone = found.groupBy("doc_id", "mark").agg(F.bool_and("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    gone = written(gone.filter("NOT stays OR n > 1"), "gone")
    own_id, own_mark = fresh(docs, "gone_id"), fresh(docs, "gone_mark")
    key = [F.col(id_col).eqNullSafe(F.col(own_id)), mark(F.col(text_col)) == F.col(own_mark)]

    def of(rows: DataFrame) -> DataFrame:
        return broadcast_if_small(rows.select(F.col("doc_id").alias(own_id), F.col("mark").alias(own_mark)))

    once = docs.join(of(gone), key, "left_anti")
    twice = gone.filter("stays")
    if twice.isEmpty():
        return once
    one = docs.join(of(twice), key, "left_semi").withColumn(own_mark, mark(F.col(text_col))).dropDuplicates([id_col, own_mark]).drop(own_mark)
    return once.unionByName(one)


def first_row(id_col: Column, mark_col: Column) -> Column:
    """Orders the rows of a group by id, nulls last, and mark: its minimum is the row that stays."""
    return F.struct(id_col.isNull().alias("none"), id_col.alias("id"), mark_col.alias("mark"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def release_memory() -> None:
    """Gives freed memory of a Python task back: the worker lives on, its batches and memos don't."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that a task holds Python objects of a few texts only."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release_memory()


def runs_of(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The groups of a stream sorted by keys; a group may span batches. Holds one group and one batch."""
    held: list[pd.DataFrame] = []
    held_key: tuple | None = None
    for batch in batches:
        if batch.empty:
            continue
        starts = batch[keys].ne(batch[keys].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
        for lo, hi in zip(starts, [*starts[1:], len(batch)], strict=True):
            key = tuple(batch.iloc[lo][k] for k in keys)
            if held and key != held_key:
                yield held_key, pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(batch.iloc[lo:hi])
            held_key = key
    if held:
        yield held_key, pd.concat(held) if len(held) > 1 else held[0]
