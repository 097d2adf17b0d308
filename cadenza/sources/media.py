"""Media files and what is known of them: discovery by path, probe results, sidecar documents, worker frames.

Decoding and recognition run outside Spark; here are the scans before them and the parsing behind them.
"""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import numbers as n
from cadenza.functions import text as t

# The accepted extensions and the language aliases.
VIDEO = ("mp4", "mkv", "mov", "avi", "webm")
AUDIO = ("mp3", "wav", "m4a", "flac", "ogg", "opus", "aac", "wma")
MAX_SIDECAR = 64 << 20
FRAME_PREFIX = "@frame "
PROBE_SCHEMA = (
    "streams array<struct<index int, codec_type string, codec_name string, sample_rate string, channels int, duration string,"
    " tags struct<language string, title string, DURATION string>>>, format struct<duration string, format_name string>"
)


def classify_paths(paths: DataFrame) -> DataFrame:
    """(path, length) with a verdict: accepted, or why not."""
    verdict = (
        F.when(F.lower("path").endswith(".asr.flac"), "intermediate")
        .when(~t.extension(F.col("path")).isin(*VIDEO, *AUDIO), "extension")
        .when(F.col("length") <= 0, "empty")
        .otherwise("accepted")
    )
    return paths.withColumn("verdict", verdict)


def discover(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, length, verdict) of a folder's files, in order of lower-cased path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length")
    return classify_paths(files).orderBy(F.lower("path"))


def discover_strict(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """As `discover`, but the first rejected file fails the query."""
    found = discover(spark, folder, recursive)
    return found.where(F.when(F.col("verdict") == "accepted", True).otherwise(F.raise_error(F.concat(F.lit("rejected: "), "path")).cast("boolean")))


def first_of_each(rows: DataFrame, key: Column, order: Column, last: bool = False) -> DataFrame:
    """First (or last) row of each key."""
    w = Window.partitionBy(key).orderBy(order.desc() if last else order)
    return rows.withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")


def audio_streams(probes: DataFrame) -> DataFrame:
    """(path, payload) JSON to one row per audio stream, ordinals from 0."""
    parsed = probes.withColumn("p", F.from_json("payload", PROBE_SCHEMA))
    rows = parsed.select("path", F.posexplode("p.streams").alias("at", "s")).where("s.codec_type = 'audio'")
    w = Window.partitionBy("path").orderBy("at")
    return rows.select(
        "path", (F.row_number().over(w) - 1).alias("ordinal"), F.col("s.index").alias("index"), F.col("s.codec_name").alias("codec_name"), F.col("s.sample_rate").try_cast("int").alias("sample_rate"), F.col("s.channels").alias("channels"),
        F.lower(F.col("s.tags.language")).alias("language"), F.col("s.tags.title").alias("title"),
        F.coalesce(n.parse_duration(F.col("s.duration")), n.parse_duration(F.col("s.tags.DURATION"))).alias("duration"),
    )


def container_durations(probes: DataFrame) -> DataFrame:
    """The container's duration, else its longest stream's, else 0."""
    longest = audio_streams(probes).groupBy("path").agg(F.max("duration").alias("longest"))
    own = probes.select("path", n.parse_duration(F.from_json("payload", PROBE_SCHEMA)["format"]["duration"]).alias("own"))
    return own.join(longest, "path", "left").select("path", F.coalesce("own", "longest", F.lit(0.0)).alias("duration"))


def choose_streams(streams: DataFrame, aliases: tuple[str, ...], ordinal: int | None = None) -> DataFrame:
    """One stream per path: the asked ordinal, else a match, else the first; with a warning where that was a guess."""
    title = F.exists(F.array(*[F.lit(a) for a in aliases if len(a) > 2]), lambda a: F.contains(F.lower(F.coalesce("title", F.lit(""))), a))
    match = (F.coalesce(F.lower(F.trim("language")).isin(*aliases), F.lit(False)) | title).cast("int")
    whole = Window.partitionBy("path")
    out = streams.withColumn("_m", match).withColumns({"_n": F.count("*").over(whole), "_k": F.sum("_m").over(whole)})
    asked = F.lit(False) if ordinal is None else F.col("ordinal") == ordinal
    w = whole.orderBy(asked.desc(), F.desc("_m"), "ordinal")
    warning = F.when(asked | (F.col("_k") == 1) | (F.col("_n") == 1), None).when(F.col("_k") > 1, "several match").otherwise("none matches")
    return out.withColumn("_at", F.row_number().over(w)).where("_at = 1").select("path", "ordinal", "language", "title", warning.alias("warning"))


def sidecars(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(path, too_large, document) of JSON sidecars; content of those beyond the cap is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    small = files.where(F.col("length") <= MAX_SIDECAR).select("path", F.lit(False).alias("too_large"), F.from_json(F.decode("content", "utf-8"), schema).alias("document"))
    large = files.where(F.col("length") > MAX_SIDECAR).select("path", F.lit(True).alias("too_large"), F.from_json(F.lit(None).cast("string"), schema).alias("document"))
    return small.unionByName(large)


def frames(lines: DataFrame, schema: str) -> DataFrame:
    """Prefixed JSON lines of (line); others are ignored."""
    return lines.where(F.col("line").startswith(FRAME_PREFIX)).select(F.from_json(F.expr(f"substring(line, {len(FRAME_PREFIX) + 1})"), schema).alias("frame"))


def encode_frame(payload: Column) -> Column:
    return F.concat(F.lit(FRAME_PREFIX), F.to_json(payload), F.lit("\n"))


def transcribe(audio: DataFrame, recogniser, schema: str) -> DataFrame:
    """Rows of ``audio`` through a recogniser: a callable from a batch (pandas) to transcript rows, made once per task by a factory."""

    def run(batches):
        model = recogniser()
        for batch in batches:
            yield model(batch)

    return audio.mapInPandas(run, schema)


def file_fingerprints(spark: SparkSession, path: str, inline: int = 64 << 20, chunk: int = 8 << 20) -> DataFrame:
    """(path, size, modified, sha256) of the files under ``path``, of any size; scans leave empty files out.

    Files of up to ``inline`` bytes are read by Spark's scan. Larger ones are dealt out by path, and tasks read them ``chunk`` bytes at a
    time, through the file system that the path names; it must be one that Arrow knows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    known = [F.col("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    small = files.where(F.col("length") <= inline).select(*known, F.sha2("content", 256).alias("sha256"))

    def digest(batches):
        import hashlib

        from pyarrow import fs

        for batch in batches:
            told = []
            for at in batch["path"]:
                system, name = fs.FileSystem.from_uri(re.sub("^file:/(?=[^/])", "file:///", quote(at, safe="/:")))
                sha = hashlib.sha256()
                with system.open_input_stream(name) as stream:
                    while part := stream.read(chunk):
                        sha.update(part)
                told.append(sha.hexdigest())
            yield batch.assign(sha256=told)

    large = files.where(F.col("length") > inline).select(*known).repartition("path")
    return small.unionByName(large.mapInPandas(digest, "path string, size long, modified timestamp, sha256 string"))
