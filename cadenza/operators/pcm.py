"""Samples of a recording in chunks: overlapping windows and the samples of segments, cut from chunks of any size.

Chunks are rows (rec, seq, body) of 16-bit little-endian samples, in order of ``seq``; a sample may lie across two chunks. What is wanted
are ranges of samples (rec, k, low, high); chunks and ranges meet by the stretches of bytes that both reach into, so that a long
recording is many tasks, and a range is put together from the parts that its chunks have of it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.operators.intervals import before

RATE, BYTES = 16_000, 2
#: Bytes of a stretch.
STRETCH = 1 << 20
#: Chunks are summed within groups of so many, then the groups.
GROUP = 1 << 10


def samples(seconds: Column, rate: int = RATE) -> Column:
    """Half to even."""
    return F.rint(seconds * rate).cast("long")


def placed(chunks: DataFrame) -> DataFrame:
    """Chunks with from and to, the bytes of the recording that they hold. Sums go in two levels: by numbers' thousands, then within these; empty chunks are left out."""
    rows = chunks.select("rec", "seq", "body", F.length("body").cast("long").alias("_n"), F.floor(F.col("seq") / GROUP).alias("_g")).where("_n > 0")
    groups = rows.groupBy("rec", "_g").agg(F.sum("_n").alias("_all"))
    groups = groups.withColumn("_before", F.coalesce(F.sum("_all").over(before(Window.partitionBy("rec").orderBy("_g"))), F.lit(0))).drop("_all")
    within = F.coalesce(F.sum("_n").over(before(Window.partitionBy("rec", "_g").orderBy("seq"))), F.lit(0))
    rows = rows.join(groups, ["rec", "_g"]).withColumn("from", F.col("_before") + within)
    return rows.select("rec", "seq", "body", "from", (F.col("from") + F.col("_n")).alias("to"))


def sizes(chunks: DataFrame) -> DataFrame:
    """(rec, bytes) of recordings that have any; a byte too many for whole samples is an error."""
    rows = chunks.groupBy("rec").agg(F.sum(F.length("body")).alias("bytes")).where("bytes > 0")
    return rows.withColumn("bytes", F.when(F.col("bytes") % BYTES == 0, F.col("bytes")).otherwise(F.raise_error(F.lit("the last sample is cut")).cast("long")))


def window_ranges(lengths: DataFrame, window: float, overlap: float, rate: int = RATE) -> DataFrame:
    """(rec, bytes) to ranges (rec, k, low, high, offset, duration, is_final). A tail that is only overlap makes no window."""
    if not (window > 0 and 0 <= overlap < window and rate > 0):
        raise ValueError("the overlap must be shorter than the window")
    size = max(1, round(window * rate))
    step = size - round(overlap * rate)
    if step <= 0:
        raise ValueError("the overlap must be shorter than the window")
    total = (F.col("bytes") / BYTES).cast("long")
    last = F.greatest(F.lit(0), F.ceil((total - size) / step)).cast("long")
    rows = lengths.withColumns({"_total": total, "_last": last}).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
    low = F.col("k") * step
    high = F.least(low + size, F.col("_total"))
    return rows.select("rec", "k", low.alias("low"), high.alias("high"), (low / rate).alias("offset"), ((high - low) / rate).alias("duration"), (F.col("k") == F.col("_last")).alias("is_final"))


def segment_ranges(segments: DataFrame, rate: int = RATE) -> DataFrame:
    """Segments (rec, seg, start, end) to ranges (rec, k, low, high); nothing lies before 0, and what isn't an interval is empty."""
    low = F.greatest(F.lit(0), samples(F.col("start"), rate))
    return segments.select("rec", F.col("seg").alias("k"), low.alias("low"), F.greatest(low, samples(F.col("end"), rate)).alias("high"))


def cut(chunks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Ranges (rec, k, low, high, ..) with body, the samples that the recording has of them; empty where it has none."""
    stretch = lambda a, b: F.sequence(F.floor(a / STRETCH), F.floor((b - 1) / STRETCH))
    held = placed(chunks).withColumn("_s", F.explode(stretch(F.col("from"), F.col("to"))))
    asked = ranges.select("rec", "k", (F.col("low") * BYTES).alias("_low"), (F.col("high") * BYTES).alias("_high")).where("_low < _high")
    asked = asked.withColumn("_s", F.explode(stretch(F.col("_low"), F.col("_high"))))
    both = held.join(asked, ["rec", "_s"]).where((F.col("from") < F.col("_high")) & (F.col("_low") < F.col("to")))
    first = F.greatest(F.col("from"), F.col("_low"))
    both = both.where(F.floor(first / STRETCH) == F.col("_s"))  # a chunk and a range meet in one stretch
    part = F.substring("body", (first - F.col("from") + 1).cast("int"), (F.least(F.col("to"), F.col("_high")) - first).cast("int"))
    parts = both.groupBy("rec", "k").agg(F.array_sort(F.collect_list(F.struct(first.alias("at"), part.alias("part")))).alias("_p"))
    body = F.aggregate("_p", F.lit("").cast("binary"), lambda acc, p: F.concat(acc, p["part"]))
    return ranges.join(parts.select("rec", "k", body.alias("body")), ["rec", "k"], "left").withColumn("body", F.coalesce("body", F.lit("").cast("binary")))


def windows(chunks: DataFrame, window: float, overlap: float, rate: int = RATE) -> DataFrame:
    """Chunks to windows (rec, k, offset, duration, is_final, body)."""
    return cut(chunks, window_ranges(sizes(chunks), window, overlap, rate)).select("rec", "k", "offset", "duration", "is_final", "body")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decoded(body: pd.Series) -> pd.Series:
    """Samples from -1 to 1."""
    return body.map(lambda x: None if x is None else np.frombuffer(x, "<i2").astype(np.float32) / 32768)
