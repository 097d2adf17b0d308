"""Job logs: state folded from events, summaries, retention, replay and recovery.

Events are (job, event_id, kind, …) rows; nothing needs more than one shuffle by job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL_ITEMS = ("done", "cached", "skipped", "error", "cancelled", "interrupted")
TERMINAL_JOBS = ("ok", "partial", "error", "cancelled", "interrupted")
RETRYABLE = ("error", "cancelled", "interrupted")
MAX_EVENTS, MAX_JOBS, MAX_LOGS, JOB_TTL = 2000, 16, 250, 3600


def item_counts(items: DataFrame, declared: Column | None = None) -> DataFrame:
    """Per job: how many items there are and in which states; at least ``declared`` in all."""
    state = F.col("state")
    out = items.groupBy("job").agg(
        F.count("*").alias("total"), F.count_if(state == "done").alias("done"), F.count_if(state == "cached").alias("cached"), F.count_if(state == "skipped").alias("skipped"),
        F.count_if(state == "error").alias("failed"), F.count_if(state.isin("cancelled", "interrupted")).alias("cancelled"), F.count_if(state.isin("done", "cached")).alias("succeeded"),
    )
    return out if declared is None else out.withColumn("total", F.greatest("total", declared))


def job_status(counts: DataFrame, unhandled: Column | None = None) -> DataFrame:
    """With status: cancelled, then an unhandled error, then ok, partial, error."""
    bad = F.col("failed") + F.col("cancelled")
    status = F.when(F.col("cancelled") > 0, "cancelled")
    if unhandled is not None:
        status = status.when(unhandled, "error")
    return counts.withColumn("status", status.when(bad == 0, "ok").when(F.col("succeeded") + F.col("skipped") > 0, "partial").otherwise("error"))


def newest_jobs(jobs: DataFrame, limit: int) -> DataFrame:
    if limit < 0:
        raise ValueError("limit is negative")
    return jobs.orderBy(F.desc("updated_at"), F.desc("job")).limit(limit)


def newest_events(events: DataFrame, n: int = MAX_EVENTS) -> DataFrame:
    w = Window.partitionBy("job").orderBy(F.desc("event_id"))
    return events.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= n).drop("_at")


def expired(jobs: DataFrame, cutoff: Column) -> DataFrame:
    return jobs.where(F.col("status").isin(*TERMINAL_JOBS) & (F.col("completed_at") < cutoff))


def beyond_limit(jobs: DataFrame, limit: int = MAX_JOBS) -> DataFrame:
    """The oldest finished jobs that make the store larger than ``limit``. One row a job, and only the excess is ranked."""
    excess = max(0, jobs.count() - limit)
    return jobs.where(F.col("status").isin(*TERMINAL_JOBS)).orderBy("updated_at", "job").limit(excess)


def next_event_ids(events: DataFrame) -> DataFrame:
    """(job, next_id, n_events): the number that a job's next event gets, and how many it has."""
    return events.groupBy("job").agg((F.max("event_id") + 1).alias("next_id"), F.count("*").alias("n_events"))


def cursor(asked: Column, header: Column) -> Column:
    """Where a reader goes on: the larger of what it asks for and what its header (text) says; what is no number, or negative, counts as 0."""
    return F.greatest(asked, header.try_cast("long"), F.lit(0).cast("long"))


def refreshed(failed: DataFrame, built: DataFrame, key: str) -> DataFrame:
    """Failed items, queued again if they were built anew; those that are missing say so, and a caller refuses the retry."""
    found = built.select(key).distinct().withColumn("_built", F.lit(True))
    return failed.join(found, key, "left").withColumns({"state": F.lit("queued"), "missing": F.col("_built").isNull()}).drop("_built")


def missing(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """What is required, once each, and not present."""
    return required.select(key).distinct().join(present.select(key), key, "left_anti")


def surviving(children: DataFrame, parents: DataFrame) -> DataFrame:
    return children.join(parents.select("job"), "job", "left_semi")


def replay(events: DataFrame, cursor: Column, terminal: str = "done") -> DataFrame:
    """Events after the cursor, up to the first terminal one."""
    w = Window.partitionBy("job").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    later = events.where(F.col("event_id") > cursor)
    return later.withColumn("_done", F.coalesce(F.sum((F.col("kind") == terminal).cast("int")).over(w), F.lit(0))).where("_done = 0").drop("_done")


def latest(events: DataFrame, keys: list[str], order: str = "event_id") -> DataFrame:
    """Upsert: the last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return events.withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")


def merge_events(base: DataFrame, events: DataFrame, key: str, columns: list[str], order: str = "event_id") -> DataFrame:
    """Base rows with the last values that events have for them; unknown keys are appended."""
    last = events.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in columns])
    return base.join(last, key, "full_outer").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def recover(jobs: DataFrame, items: DataFrame, message: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """After a crash: unfinished jobs are interrupted, their unfinished items errors, and each gets a final event."""
    lost = ~F.col("status").isin(*TERMINAL_JOBS)
    open_jobs = jobs.where(lost).select("job")
    fixed_jobs = jobs.withColumn("status", F.when(lost, "interrupted").otherwise(F.col("status")))
    marked = items.join(open_jobs.withColumn("_lost", F.lit(True)), "job", "left")
    lost_item = F.coalesce("_lost", F.lit(False)) & ~F.col("state").isin(*TERMINAL_ITEMS)
    fixed_items = marked.withColumn("state", F.when(lost_item, "error").otherwise(F.col("state"))).drop("_lost")
    return fixed_jobs, fixed_items, jobs.where(lost).select("job", (F.col("latest_event_id") + 1).alias("event_id"), F.lit("done").alias("kind"), F.lit(message).alias("text"))


def cancel_rest(items: DataFrame) -> DataFrame:
    return items.withColumn("state", F.when(F.col("state").isin(*TERMINAL_ITEMS), F.col("state")).otherwise("cancelled"))


def retry_items(items: DataFrame) -> DataFrame:
    """Failed items, queued again."""
    return items.where(F.col("state").isin(*RETRYABLE)).withColumn("state", F.lit("queued"))


def monotone(rows: DataFrame, value: str, keys: list[str], order: str) -> DataFrame:
    """With the value never falling."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.max(value).over(w))


def current_only(updates: DataFrame, key: str = "job", generation: str = "generation") -> DataFrame:
    """Updates of each key's newest generation; those of older ones are late."""
    newest = updates.groupBy(key).agg(F.max(generation).alias("_g"))
    return updates.join(newest, key).where(F.col(generation) == F.col("_g")).drop("_g")


def client_view(events: DataFrame) -> DataFrame:
    """What a reader of the stream knows: its cursor, the finished items, the last message."""
    return events.groupBy("job").agg(F.max("event_id").alias("cursor"), F.count_distinct(F.when(F.col("state").isin(*TERMINAL_ITEMS), F.col("path"))).alias("completed"), F.max_by("kind", "event_id").alias("last_kind"))


def sse(event_id: Column, payload: Column) -> Column:
    return F.concat(F.lit("id: "), event_id.cast("string"), F.lit("\ndata: "), payload, F.lit("\n\n"))
