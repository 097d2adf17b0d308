"""Mixing sources to target weights over a time-varying curriculum, in DataFrame functions only.

A source's weight at training time t (0 to 1) is its target times 1 + slope * (2 t - 1); the integral over the whole training is
the target, and up to t it is target * (t + slope * (t^2 - t)). A document that begins after u of its source's demand is due at the
t where that integral reaches u, which is a quadratic equation. Documents are then sorted by range of position.

A source's documents stand in hashed order, and the mix runs through them again and again until the target is met: pass k of a
document covers the words from k * source_size + its offset, and is due where the demand reaches these. The last document taken is
cut at the target, so that every source's taken words equal its target, rounded down.

A running sum over one source would put a hot source into one task. Offsets are therefore summed in two levels: buckets of each
source's hash range first, rows within a bucket second.

Edge cases: null or blank texts have size 0, take nothing and have no position; null sources are one source, the last; a table
without words has targets 0; repeated rows are separate documents; rows without an id are placed by their text (in ``take`` by number). Columns of the input beyond
the three used pass through only in ``take``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import hex_int, numbered, table, unused, word_count

WEIGHTS = (1, 2, 3)
SLOPES = (-0.5, 0.0, 0.5)
MAX_EPOCHS = 3
#: Hash ranges that each source is cut into at least, and rows that a range of a source may hold at most, in the mean.
BUCKETS, BUCKET_ROWS = 1024, 10_000


def _cycle(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(rank, F.lit(len(values))) + 1).cast("int"))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(no_source, source_key, source_size) to the same with target and slope.

    Sharing out the excess by weight again and again ends at min(cap, level * weight) for one level. With the sources in order of
    cap / weight, the level follows from running sums: the first source from which on nobody is capped sets it. One row a source:
    these windows see as many rows as there are sources.
    """
    by_name = Window.orderBy("no_source", "source_key")
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumns({"weight": _cycle(weights, F.col("rank")), "slope": _cycle(slopes, F.col("rank")), "cap": F.col("source_size") * max_epochs})
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    ranked = ranked.withColumn("at", level).withColumn("free", F.col("at") * F.col("weight") <= F.col("cap"))
    level = F.first(F.when(F.col("free"), F.col("at")), ignorenulls=True).over(whole)
    return ranked.select("no_source", "source_key", "source_size", "slope", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"))


def passes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple = WEIGHTS, slopes: tuple = SLOPES, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per document: id, size, source_size, target and passes, an array of (position, words taken) of those that take from it."""
    sizes = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).isNull().alias("no_source"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source_key"),
        word_count(F.col(text_col)).alias("size"), hex_int(F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("/"), F.md5(F.coalesce(text_col, F.lit("")))))), 1, 8).alias("h"),
    )
    n = max(BUCKETS, math.ceil(docs.count() / BUCKET_ROWS))
    sizes = sizes.withColumn("bucket", F.shiftright(F.col("h") * n, 32))
    key = ["no_source", "source_key"]
    buckets = sizes.groupBy(*key, "bucket").agg(F.sum("size").alias("words"))
    within = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("before", F.coalesce(F.sum("words").over(within), F.lit(0))).drop("words")
    sources = targets(buckets.groupBy(*key).agg(F.sum("words").alias("source_size")), weights, slopes, max_epochs)
    offsets = offsets.join(sources, key)
    rows = Window.partitionBy(*key, "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    due = sizes.join(offsets, [*key, "bucket"]).withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(rows), F.lit(0)))

    def one(k: int) -> Column:
        start = F.col("start") + k * F.col("source_size")
        u, a = start / F.col("target"), F.col("slope")
        position = 2 * u / ((1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * u))
        return F.struct(position.alias("position"), F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - start)).cast("long").alias("words"))

    taken = F.filter(F.array(*[one(k) for k in range(max_epochs)]), lambda x: x["words"] > 0)
    return due.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("passes"))


def schedule(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """Per document: id, size, source_size, target, taken, copies (passes that take from it) and position (of the first, or null)."""
    made, own = passes(docs, id_col, **how), F.col("passes")
    taken = F.aggregate(own, F.lit(0).cast("long"), lambda acc, x: acc + x["words"])
    return made.select(id_col, "size", "source_size", "target", taken.alias("taken"), F.size(own).alias("copies"), F.get(own, F.lit(0))["position"].alias("position"))


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th word; whole if it has no more."""
    body = F.regexp_replace(text, r"^[\x20\x09-\x0D]+", "")
    parts = F.split(body, r"[\x20\x09-\x0D]+", n + 1)
    kept = F.substring(body, F.lit(1), F.length(body) - F.length(F.element_at(parts, -1)))
    return F.when(F.size(parts) > n, F.regexp_replace(kept, r"[\x20\x09-\x0D]+\z", "")).otherwise(text)


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The mix itself: every document as often as the schedule takes it, each pass at its own position; columns as they were.

    Of a source's last document, the text is cut after the words taken. Rows whose id is null or repeated are numbered, so that each is
    taken as often as its own place in its source says.
    """
    number = unused(docs, "_number")
    rows, _ = numbered(docs, id_col, text_col, number)
    made = passes(rows, number, text_col=text_col, **how).where(F.size("passes") > 0)
    last = F.element_at("passes", -1)["words"]
    marked = F.transform("passes", lambda x, k: F.struct(x["position"].alias("position"), k.alias("copy"), F.when((k == F.size("passes") - 1) & (last < F.col("size")), last.cast("int")).alias("cut")))
    key, own, one = (unused(docs, x) for x in ("_id", "_passes", "_pass"))
    plan = made.select(F.col(number).alias(key), marked.alias(own))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    mixed = rows.join(plan, F.col(number) == F.col(key)).select(*columns, F.explode(own).alias(one))
    text = F.when(F.col(f"{one}.cut").isNull(), F.col(text_col)).otherwise(first_words(F.col(text_col), F.col(f"{one}.cut")))
    return mixed.withColumn(text_col, text).sort(f"{one}.position", f"{one}.copy").select(*columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).sort("position", "doc_id")


OP6_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, (1 + rank % 3)::DOUBLE AS weight, (rank % 3 - 1) * 0.5::DOUBLE AS slope, 3 * source_size AS cap FROM sources),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
            / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM weighed),
level AS (SELECT arg_min(lvl, struct_pack(a := cap / weight, b := rank)) AS level FROM levels WHERE lvl * weight <= cap),
goals AS (SELECT source, source_size, slope::DOUBLE AS slope, least(cap::DOUBLE, level * weight) AS target FROM weighed, level),
due AS (
  SELECT doc_id, size, source_size, target, slope,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
took AS (
  SELECT *, greatest(0, least(size, floor(target)::BIGINT - start)) AS a, greatest(0, least(size, floor(target)::BIGINT - start - source_size)) AS b,
         greatest(0, least(size, floor(target)::BIGINT - start - 2 * source_size)) AS c FROM due)
SELECT doc_id, size, source_size, target, a + b + c AS taken, (a > 0)::INT + (b > 0)::INT + (c > 0)::INT AS copies,
       CASE WHEN a > 0 THEN 2 * (start / target) / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * (start / target))) END AS position
FROM took
"""
