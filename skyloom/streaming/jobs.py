"""Jobs of uploads: queued, processing, done or failed, followed from their events; a job nobody ends is failed when its time is up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .refold import PROVIDER, ROCKS

QUEUED, PROCESSING, DONE, FAILED = "queued", "processing", "done", "failed"
EVENTS = "upload_id string, event string, ts timestamp, error string"
TRANSITIONS = "upload_id string, sequence long, status string, attempt int, ts timestamp, error string"
#: Error of a job whose batch was lost.
LOST = "lost: the job ended without a result"


class JobStates(StatefulProcessor):
    """One job for each upload id, whatever the number of uploads of the same content.

    An upload is queued once; a repeated one changes nothing. Work begins an attempt, also after a failure, as when a
    batch runs again from its checkpoint; a finished job stays done. Of an attempt that neither ends nor is begun anew
    within the time limit, the timer says that it failed.
    """

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, attempt int, sequence long, due long")

    def _tell(self, key: tuple, job: list, status: str, ms: float, error: str | None) -> tuple:
        job[0], job[2] = status, job[2] + 1
        return key[0], job[2] - 1, status, job[1], pd.Timestamp(ms, unit="ms"), error

    def _store(self, job: list, due: int | None) -> None:
        if job[3] is not None:
            self.handle.deleteTimer(job[3])
        if due is not None:
            self.handle.registerTimer(due)
        job[3] = due
        self.job.update(tuple(job))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        job = list(self.job.get()) if self.job.exists() else [None, 0, 0, None]
        rank = {QUEUED: 0, PROCESSING: 1, FAILED: 2, DONE: 3}
        events = pd.concat(list(rows))
        events = events[events["event"].isin(rank)]
        events = events.assign(rank=events["event"].map(rank), ms=events["ts"].astype("datetime64[ms]").astype("int64")).sort_values(["ms", "rank"])
        out, due = [], job[3]
        for e in events.itertuples():
            if job[0] == DONE or (e.event == QUEUED and job[0] is not None) or (e.event == FAILED and job[0] == FAILED):
                continue
            if e.event == PROCESSING:
                job[1] += 1
            out.append(self._tell(key, job, e.event, e.ms, e.error if e.event == FAILED else None))
            due = e.ms + self.limit_ms if e.event in (QUEUED, PROCESSING) else None
        if due is not None and due <= timerValues.getCurrentWatermarkInMs():
            out.append(self._tell(key, job, FAILED, due, LOST))
            due = None
        if job[0] is not None:
            self._store(job, due)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TRANSITIONS.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job = list(self.job.get())
        out = [self._tell(key, job, FAILED, job[3], LOST)]
        job[3] = None  # the timer is gone
        self.job.update(tuple(job))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TRANSITIONS.split(", ")])

    def close(self) -> None:
        pass


def job_states(events: DataFrame, limit_s: int = 900, delay: str = "1 minute") -> DataFrame:
    """(upload_id, sequence, status, attempt, ts, error): every change of every job, from a stream of EVENTS.

    An attempt is lost when event time has gone limit_s beyond its last event. Events later than the delay are left out.
    States are kept by RocksDB from now on.
    """
    events.sparkSession.conf.set(PROVIDER, ROCKS)
    rows = events.filter(F.col("upload_id").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", delay)
    return rows.groupBy("upload_id").transformWithStateInPandas(JobStates(limit_s * 1000), TRANSITIONS, "Append", "EventTime")


def current(transitions: DataFrame) -> DataFrame:
    """The last state of each job."""
    last = F.row_number().over(Window.partitionBy("upload_id").orderBy(F.desc("sequence")))
    return transitions.withColumn("place", last).filter("place = 1").drop("place")


def log_event(uploads: DataFrame, event: str, path: str, error: str | None = None) -> None:
    """Appends an event of each upload to the event table."""
    rows = uploads.select("upload_id").distinct()
    rows.select("upload_id", F.lit(event).alias("event"), F.current_timestamp().alias("ts"), F.lit(error).cast("string").alias("error")).write.mode(
        "append").parquet(path)


def run_jobs(uploads: DataFrame, analyse: Callable[[DataFrame], DataFrame], events: str, results: str, checkpoint: str):
    """Starts the work on a stream of uploads (upload_id and whatever analyse needs) and ends when none are left.

    Each micro-batch is one folder of results, which a batch that runs again replaces, so results are there once. Uploads
    that are done are left out. Results may have a column error: such an upload has failed. When analyse itself
    raises, the batch's uploads have failed, and the stream goes on; when the process dies, the timer of job_states()
    says so, and the batch runs again when the stream is started again.
    """
    spark = uploads.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        new = batch.filter(F.col("upload_id").isNotNull()).dropDuplicates(["upload_id"])
        done = _finished(spark, events, number)
        new = (new if done is None else new.join(done, "upload_id", "left_anti")).persist()
        try:
            log_event(new, QUEUED, events)
            log_event(new, PROCESSING, events)
            target = f"{results}/batch={number}"
            try:
                analyse(new).write.mode("overwrite").parquet(target)
                found = spark.read.parquet(target)
            except Exception as e:  # noqa: BLE001  a crash ends as failed jobs that can be seen
                log_event(new, FAILED, events, f"internal error: {type(e).__name__}")
                return
            bad = found.filter("error IS NOT NULL").groupBy("upload_id").agg(F.first("error").alias("error")) if "error" in found.columns else None
            if bad is not None:
                bad.select("upload_id", F.lit(FAILED).alias("event"), F.current_timestamp().alias("ts"), "error").write.mode("append").parquet(events)
            log_event(new if bad is None else new.join(bad, "upload_id", "left_anti"), DONE, events)
        finally:
            new.unpersist()

    return uploads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _finished(spark: SparkSession, events: str, number: int) -> DataFrame | None:
    """Uploads that are done; None before the first event."""
    table = spark.read.schema(EVENTS)
    where = spark._jvm.org.apache.hadoop.fs.Path(events)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return table.parquet(events).filter(F.col("event") == DONE).select("upload_id").distinct()
