"""The job store: snapshots of jobs with their files and events, written by key as they arrive.

A job is one row, so that its state, files and events change together. Rows lie in folders by a hash of the job; a batch rewrites the
folders that it touches and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.operators.joblog import MAX_EVENTS

ITEM = "struct<path:string,state:string,progress:int>"
EVENT = "struct<event_id:bigint,at:timestamp,body:string>"
#: A snapshot; ``seq`` orders those of a job.
SNAPSHOT = f"job long, seq long, status string, active boolean, terminal boolean, created_at timestamp, updated_at timestamp, completed_at timestamp, latest_event_id long, payload string, items array<{ITEM}>, events array<{EVENT}>"
STORED = SNAPSHOT.replace("seq long, ", "")
BUCKETS = 64


def merged(stored: DataFrame, snapshots: DataFrame, most_events: int = MAX_EVENTS) -> DataFrame:
    """The store's rows after ``snapshots``: of each job the last one's state and files; it stays created when it was first, and its cursor never falls.

    An event replaces the one of its number; the newest ``most_events`` are kept. A job that has ended was completed when it last said so
    since it ended, or else when the first snapshot that says it had ended was updated. How snapshots are cut into batches makes no difference.
    """
    columns = [c.split()[0] for c in STORED.split(", ")]
    old = stored.select(*columns, F.lit(None).cast("long").alias("seq"))
    both = old.unionByName(snapshots.select(*columns, F.coalesce("seq", F.lit(0)).alias("seq")))
    order = F.struct(F.col("seq").isNotNull(), "seq", "updated_at")
    running = F.max(F.when(~F.coalesce("terminal", F.lit(False)), order)).over(Window.partitionBy("job"))
    both = both.withColumn("_since", F.coalesce(order > running, F.lit(True)))  # since it has ended
    last = lambda c: F.max_by(c, order).alias(c)
    first_known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order))
    last_known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order))
    jobs = both.groupBy("job").agg(
        last("status"), last("active"), last("terminal"), first_known("created_at").alias("created_at"), last_known("updated_at").alias("updated_at"),
        F.coalesce(F.max_by("completed_at", F.when(F.col("_since") & F.col("completed_at").isNotNull(), order)), F.min_by("updated_at", F.when(F.col("_since"), order))).alias("completed_at"), F.max("latest_event_id").alias("latest_event_id"), last("payload"), last("items"),
    )
    said = both.select("job", F.col("seq").isNotNull().alias("_new"), "seq", F.posexplode("events").alias("_at", "e"))
    one = said.groupBy("job", "e.event_id").agg(F.max_by("e", F.struct("_new", "seq", "_at")).alias("e"))
    events = one.groupBy("job").agg(F.sort_array(F.collect_list("e")).alias("events"))
    out = jobs.join(events, "job", "left").withColumn("events", F.coalesce("events", F.array().cast(f"array<{EVENT}>")))
    ended = F.coalesce("terminal", F.lit(False))
    cursor = F.greatest(F.coalesce("latest_event_id", F.lit(0)), F.coalesce(F.array_max(F.transform("events", lambda e: e["event_id"])), F.lit(0)))
    out = out.withColumns({
        "latest_event_id": cursor, "active": F.coalesce("active", F.lit(False)) & ~ended, "terminal": ended, "status": F.coalesce("status", F.lit("queued")),
        "completed_at": F.when(ended, F.col("completed_at")), "events": F.slice("events", F.greatest(F.lit(1), F.size("events") - (most_events - 1)), most_events),
    })
    return out.select(*columns)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The store's rows; none where nothing was saved yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/jobs")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], STORED)
    return spark.read.schema(f"{STORED}, bucket int").parquet(f"{path}/jobs").drop("bucket")


def save(batch: DataFrame, number: int, path: str, buckets: int = BUCKETS) -> None:
    """Snapshots of one micro-batch into the store at ``path``; a batch that was saved before changes nothing.

    The new rows of the folders that are touched are staged by the batch's number before any folder is replaced: a batch that is run again
    after a failure in the middle finds them and replaces the folders by the same rows.
    """
    spark = batch.sparkSession
    stage = f"{path}/stage/{number}"
    fs = lambda p: (spark._jvm.org.apache.hadoop.fs.Path(p), spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()))
    done, files = fs(f"{stage}/_SUCCESS")
    bucket = F.pmod(F.xxhash64("job"), F.lit(buckets)).cast("int")
    if not files.exists(done):
        batch = batch.where("job is not null").withColumn("bucket", bucket)
        touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]  # at most `buckets` numbers
        stored = read(spark, path).withColumn("bucket", bucket)
        new = merged(stored.where(F.col("bucket").isin(touched)).drop("bucket"), batch.drop("bucket"))
        new.withColumn("bucket", bucket).write.mode("overwrite").parquet(stage)
    if files.listStatus(fs(stage)[0]) and not spark.read.parquet(stage).isEmpty():
        rows = spark.read.schema(f"{STORED}, bucket int").parquet(stage).repartition("bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/jobs")
    for older in files.listStatus(fs(f"{path}/stage")[0]):  # the batches before are saved for good
        if int(older.getPath().getName()) < number:
            files.delete(older.getPath(), True)


def upsert(snapshots: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS):
    """A stream of snapshots into the store."""
    return snapshots.writeStream.foreachBatch(lambda batch, number: save(batch, number, path, buckets)).option("checkpointLocation", checkpoint)
