"""The job log as a stream: events are numbered per job, folded into state, published, and followed from a cursor.

State is kept by `transformWithState` in the RocksDB store: a job's numbers in one value, its files in a map by path, of which an event
touches one. Timers close jobs that have gone silent and forget jobs some time after they have closed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cadenza.operators.joblog import JOB_TTL, TERMINAL_ITEMS, sse

FOLDED = "job long, event_id long, kind string, path string, state string, finished long, closed boolean"
#: The store that `transformWithState` needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(df: DataFrame) -> DataFrame:
    """``df``, whose session keeps the state of streams in RocksDB from now on."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return df


class JobLog(StatefulProcessor):
    """Numbers a job's events from 1 and counts its finished files; a ``done`` event closes the job, and later events are dropped.

    A closed job is forgotten ``keep`` seconds of event time after it closed. With ``idle``, an open one that has had no event for so long
    gets a last event, ``done`` in state ``interrupted``.
    """

    def __init__(self, keep: int, idle: int | None):
        self.keep, self.idle = keep, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "last long, finished long, closed boolean, due long")
        self.files = handle.getMapState("files", "path string", "state string, finished boolean")

    def _load(self) -> list:
        return list(self.job.get()) if self.job.exists() else [0, 0, False, None]

    def _wait(self, now: list, due: int | None) -> None:
        """One timer a job: it is moved."""
        if now[3] is not None:
            self.handle.deleteTimer(now[3])
        if due is not None:
            self.handle.registerTimer(due)
        now[3] = due

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now, newest = self._load(), None
        for e in sorted(rows, key=lambda r: (r.at is not None, r.at)):  # at most a job's events of one batch
            if now[2]:
                break
            now[0] += 1
            newest = max(newest or 0, int(e.ts.timestamp() * 1000)) if e.ts is not None else newest
            if e.path is not None and e.state is not None:
                known = self.files.getValue((e.path,)) if self.files.containsKey((e.path,)) else None
                finished = e.state in TERMINAL_ITEMS
                if finished and not (known and known[1]):
                    now[1] += 1
                self.files.updateValue((e.path,), (e.state, finished or bool(known and known[1])))
            now[2] = e.kind == "done"
            yield Row(job=key[0], event_id=now[0], kind=e.kind, path=e.path, state=e.state, finished=now[1], closed=now[2])
        if now[2] and newest is not None or self.idle and newest is not None:
            self._wait(now, max(newest, timerValues.getCurrentWatermarkInMs()) + 1000 * (self.keep if now[2] else self.idle))
        if now[2]:
            self.files.clear()
        self.job.update(tuple(now))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = self._load()
        now[3] = None
        if now[2]:
            self.job.clear()
            return
        now[0], now[2] = now[0] + 1, True
        self._wait(now, timerValues.getCurrentWatermarkInMs() + 1000 * self.keep)
        self.files.clear()
        self.job.update(tuple(now))
        yield Row(job=key[0], event_id=now[0], kind="done", path=None, state="interrupted", finished=now[1], closed=True)

    def close(self) -> None:
        pass


def fold(events: DataFrame, keep: int = JOB_TTL, idle: int | None = None, late: str = "10 minutes") -> DataFrame:
    """(job, at, kind, path, state, ts) to the same events with ids from 1 per job, how many files are finished, and whether the job is closed.

    Events that come more than ``late`` behind the newest are dropped, as are those after a job's ``done``. Null paths and states touch no
    file; an event without a time moves no timer.
    """
    timed = with_state_store(events).select("job", "at", "kind", "path", "state", "ts").withWatermark("ts", late)
    return timed.groupBy("job").transformWithState(JobLog(keep, idle), FOLDED, "Append", "EventTime")


def state_counts(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events of each kind per five minutes of event time, late ones dropped after ``delay``."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "5 minutes").alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("from_ts"), "kind", "n")


def publish(folded: DataFrame, path: str, checkpoint: str):
    """Appends the folded events to Parquet, exactly once."""
    return folded.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)


def follow(spark: SparkSession, log: str, cursors: DataFrame, out: str, checkpoint: str):
    """For readers (reader, job, cursor): what was published after their cursors, then what is published from now on, each event once.

    Frames (reader, job, event_id, frame) are written by micro-batch to ``out``/batch=n; a batch that is run again after a failure replaces
    its folder. A job's last event is its ``done``. ``cursors`` is read once a batch.
    """
    body = F.to_json(F.struct("event_id", "kind", "path", "state", "finished"), {"ignoreNullFields": "false"})
    events = spark.readStream.schema(FOLDED).parquet(log)
    wanted = events.join(cursors.select("reader", "job", "cursor"), "job").where("event_id > cursor")

    def send(batch: DataFrame, number: int) -> None:
        frames = batch.select("reader", "job", "event_id", sse(F.col("event_id"), body).alias("frame"))
        frames.repartition("reader", "job").sortWithinPartitions("reader", "job", "event_id").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return wanted.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)


def new_entries(polls: DataFrame, operations: DataFrame, memory: str = "1 hour") -> DataFrame:
    """Log entries of polls (operation, generation, log_id, message, ts), each once: only of the operations (operation, baseline) that are expected, and of generations newer than theirs.

    A poll repeats the entries before it. An entry is remembered for ``memory`` of event time after it was first seen.
    """
    current = polls.join(operations.select("operation", "baseline"), "operation").where("generation > baseline").drop("baseline")
    return current.withWatermark("ts", memory).dropDuplicatesWithinWatermark(["operation", "log_id"])
