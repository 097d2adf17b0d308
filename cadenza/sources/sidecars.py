"""Sidecar documents beside subtitles: written whole, read with care; and the report of a benchmark run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.sources.media import MAX_SIDECAR

#: Version of the document's layout.
VERSION = 4
FIELDS = ("source", "recognition_settings", "layout_settings", "probe", "selected_stream", "warning", "normalized_audio_duration", "transcript", "subtitle_layout")
#: Nulls are written: a reader tells a missing field from one that says nothing.
_JSON = {"ignoreNullFields": "false"}


def outputs(subtitle: Column, fmt: Column, sidecar: Column, audio: Column, keep_audio: Column) -> Column:
    """Paths of what a run leaves; the SRT's has a name of its own, as older readers look for it."""
    return F.struct(subtitle.alias("subtitle"), F.when(fmt == "srt", subtitle).alias("srt"), sidecar.alias("sidecar"), F.when(keep_audio, audio).alias("audio"))


def payload(started: Column, finished: Column, fmt: Column, paths: Column, **fields: Column) -> Column:
    """The JSON of a finished run; ``fields`` are those of `FIELDS`, null where they are not given."""
    unknown = set(fields) - set(FIELDS)
    if unknown:
        raise ValueError(f"no fields of a sidecar: {sorted(unknown)}")
    own = [fields.get(name, F.lit(None).cast("string")).alias(name) for name in FIELDS]
    head = [F.lit(VERSION).alias("sidecar_schema_version"), F.lit("done").alias("status"), finished.alias("created_at"), started.alias("started_at"), finished.alias("finished_at")]
    tail = [fmt.alias("output_format"), paths["subtitle"].alias("subtitle_output"), paths["srt"].alias("srt_output"), paths.alias("outputs")]
    return F.to_json(F.struct(*head, *own, *tail), _JSON)


def read(content: Column, length: Column, most: int = MAX_SIDECAR) -> Column:
    """(document, too_large) of a file's bytes: the JSON object as a variant, or null for what is no UTF-8, no JSON or no object.

    What is longer than ``most`` is not looked at. A key that comes twice makes a document unreadable.
    """
    body = F.when(length <= most, F.try_validate_utf8(content.cast("string")))
    made = F.try_parse_json(body)
    return F.struct(F.when(F.startswith(F.schema_of_variant(made), F.lit("OBJECT<")), made).alias("document"), (length > most).alias("too_large"))


def transcript_text(segments: Column, text: Column, duration: Column) -> Column:
    """Segments that have content, or, where none has, the whole text as one segment over the recording; none without both."""
    real = F.filter(segments, lambda s: F.coalesce(s["text"].rlike(r"\S") & (s["end"] > s["start"]), F.lit(False)))
    whole = F.array(F.struct(F.lit(0.0).alias("start"), duration.alias("end"), F.trim(text).alias("text")))
    plain = F.transform(real, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.trim(s["text"]).alias("text")))
    return F.when(F.size(real) > 0, plain).otherwise(F.filter(whole, lambda s: F.coalesce(s["text"] != "", F.lit(False))))


def report(runs: DataFrame, metrics: DataFrame, key: str, duration: Column, wall: Column, error: Column) -> DataFrame:
    """Per run: state, error, events, durations, real-time factor, and, where nothing failed, the metrics of its subtitles; as JSON too."""
    names = [c for c in metrics.columns if c != key]
    rows = runs.withColumns({"media_duration_seconds": duration, "wall_seconds": F.round(wall, 3), "error": error, "_wall": wall})
    rows = rows.withColumn("rtf", F.when(F.col("media_duration_seconds") > 0, F.round(F.col("_wall") / F.col("media_duration_seconds"), 6)))
    rows = rows.join(metrics.select(key, F.struct(*names).alias("metrics")), key, "left")
    rows = rows.withColumn("metrics", F.when(F.col("error").isNull(), F.col("metrics")))
    fields = [c for c in (*runs.columns, "media_duration_seconds", "wall_seconds", "rtf", "error", "metrics")]
    fields = list(dict.fromkeys(fields))
    return rows.select(*fields, F.to_json(F.struct(*fields), _JSON).alias("report"))


def refused(files: DataFrame, key: str, most: int) -> DataFrame:
    """Per batch: how many files it has, and whether it is refused whole."""
    counts = files.groupBy(key).agg(F.count("*").alias("n_files"))
    return counts.withColumn("too_many", F.col("n_files") > most)
