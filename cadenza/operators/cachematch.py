"""Reuse of stored results: fingerprints, matches by priority, output names without collisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import text as t


def collisions(paths: DataFrame, fmt: str = "srt") -> DataFrame:
    """(path) to path, output and collides: sources whose outputs would differ in case only get a hash of their path in the name."""
    out = paths.withColumn("plain", t.output_name(F.col("path"), fmt))
    w = Window.partitionBy(F.lower("plain"))
    out = out.withColumn("collides", F.count("*").over(w) > 1)
    digest = F.substring(F.sha2(F.lower("path"), 256), 1, 12)
    named = F.concat(F.regexp_replace("plain", r"\.[^./\\]*$", ""), F.lit("-"), digest, F.lit("."), t.extension(F.col("plain")))
    return out.select("path", F.when(F.col("collides"), named).otherwise(F.col("plain")).alias("output"), "collides")


def common_parent(paths: DataFrame, *by: str) -> DataFrame:
    """Per group (``by``; one row without): the longest folder that all paths share. The least and the greatest path decide."""
    parts = F.split("path", "/")
    ends = paths.groupBy(*by).agg(F.min(parts).alias("_a"), F.max(parts).alias("_b"))
    same = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size("_a"), F.size("_b")) - 1)), lambda k: (k < F.size("_a")) & (k < F.size("_b")) & (F.slice("_a", 1, k) == F.slice("_b", 1, k)))
    return ends.select(*by, F.array_join(F.slice("_a", 1, F.coalesce(F.array_max(same), F.lit(0))), "/").alias("parent"))


def match(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Per wanted row (item, recognition, layout, fmt) what the store (item, recognition, layout, fmt, status) allows: cached, rebuild or compute.

    A stored result of the same format comes before one of another.
    """
    s = stored.where("status = 'done'").select("item", F.col("recognition").alias("s_recognition"), F.col("layout").alias("s_layout"), F.col("fmt").alias("s_fmt"))
    joined = wanted.join(s, "item", "left").where("s_fmt is null or s_recognition <=> recognition or s_fmt = fmt")
    full = (F.col("s_recognition") == F.col("recognition")) & (F.col("s_layout") == F.col("layout")) & (F.col("s_fmt") == F.col("fmt"))
    half = F.col("s_recognition") == F.col("recognition")
    rank = F.when(full, 0).when(half & (F.col("s_fmt") == F.col("fmt")), 1).when(half, 2).otherwise(3)
    w = Window.partitionBy("item").orderBy("_rank", "s_fmt")
    best = joined.withColumn("_rank", rank).withColumn("_at", F.row_number().over(w)).where("_at = 1")
    found = best.select("item", F.when(F.col("_rank") == 0, "cached").when(F.col("_rank") < 3, "rebuild").otherwise("compute").alias("decision"))
    return wanted.select("item").join(found, "item", "left").select("item", F.coalesce("decision", F.lit("compute")).alias("decision"))
