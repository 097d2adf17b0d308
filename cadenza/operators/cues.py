"""The whole layout: a table of segments to subtitle cues with diagnostics, as one plan that is dealt by recording once.

Segments become words, words sentences, sentences lines, lines cues, and cues get their times: the target schedule where it is
feasible for the whole recording, else boundaries between neighbours. What a recording is told about itself (how many segments were
reconciled, how many anchors moved) travels beside its rows, so that nothing is joined back.

A recording is an hour or a day of speech, whose words fit a task; sentences and runs of lines are the rows that Python sees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import numbers as n
from cadenza.functions import text as t
from cadenza.operators import layout, reconcile, spoken

# The shortest cue, and what counts as equal.
SHORTEST, SLACK = 0.001, 1e-9


def _rec():
    return Window.partitionBy("rec")


def with_text(segments: DataFrame) -> DataFrame:
    """Segments that have a text, or words to make one of."""
    words = F.coalesce("words", F.array().cast(f"array<{reconcile.WORD}>"))
    clean = lambda w: t.collapse_space(F.coalesce(w["text"], F.lit("")))
    own, said = F.nullif(t.collapse_space(F.col("text")), F.lit("")), F.filter(F.transform(words, clean), lambda x: x != "")
    # words are looked at where there is no text, and not made twice elsewhere
    return segments.where(own.isNotNull() | F.exists(words, lambda w: clean(w) != "")).withColumn("text", F.coalesce(own, t.join_glued(said)))


def with_times(segments: DataFrame) -> DataFrame:
    """Segments (rec, seg, start, end, words, duration): where any of a recording isn't an interval within it, all share its time equally and lose their words."""
    start, end, duration = F.col("start"), F.col("end"), F.col("duration")
    valid = F.coalesce(n.valid_interval(start, end), F.lit(False))
    usable = F.bool_and(valid & F.coalesce(end <= duration + SLACK, F.lit(True))).over(_rec())
    count = F.count("*").over(_rec())
    horizon = F.greatest(F.coalesce(F.nullif(duration, F.lit(0.0)), F.max(F.when(valid, end)).over(_rec()), count.cast("double")), F.lit(SHORTEST))
    out = segments.withColumns({"_usable": usable, "_horizon": horizon, "_n": count, "_i": F.row_number().over(_rec().orderBy("seg")) - 1})
    share = lambda k: F.col("_horizon") * k / F.col("_n")
    new = {"start": share(F.col("_i")), "end": share(F.col("_i") + 1), "words": F.array().cast(out.schema["words"].dataType)}
    return out.withColumns({c: F.when(F.col("_usable"), F.col(c)).otherwise(x) for c, x in new.items()}).drop("_usable", "_horizon", "_n", "_i")


def duration_parts(text: Column, length: Column, longest: float) -> Column:
    """Parts of a text that lasts ``length`` seconds, of ``longest`` at most at an even pace, cut at the last space or behind the last hyphen.

    Null where there is no fitting place to cut, for less than two parts, and for null.
    """

    parts = t.bound(t.collapse_space(text), lambda said: t.bound(F.length(said) * F.lit(longest) / length + SLACK, lambda most: layout.cut_greedily(said, most)))
    return t.bound(F.when(text.isNotNull(), parts), lambda p: F.when(F.size(p) > 1, p))


def in_parts(parts: Column, start: Column, end: Column) -> Column:
    """(start, end, text) of parts that share a time by their characters and the spaces between."""

    def shared(own: Column) -> Column:
        last = lambda k: k == F.size(own) - 1
        return t.bound(F.transform(own, lambda p, k: F.greatest(F.lit(1), t.visible_length(p) + F.when(last(k) | F.rtrim(p).endswith("-"), 0).otherwise(1))), lambda weights: spans(own, weights))

    def spans(own: Column, weights: Column) -> Column:
        return t.bound(t.running_sums(weights), lambda upto: F.transform(own, lambda p, k: placed(own, upto, p, k)))

    def placed(own: Column, upto: Column, part: Column, k: Column) -> Column:
        at = lambda n: start + (end - start) * F.coalesce(F.get(upto, n), F.lit(0)) / F.element_at(upto, -1)
        return F.struct(at(k - 1).alias("start"), F.when(k == F.size(own) - 1, end).otherwise(at(k)).alias("end"), part.alias("text"))

    return F.when(F.size(parts) > 0, t.bound(parts, shared))


def split_long_words(words: DataFrame, longest: float) -> DataFrame:
    """Words (.., start, end, text) with part: those over ``longest`` seconds in several rows, by characters; one that can't be cut keeps its end and loses the silence before it."""
    start, end, length = F.col("start"), F.col("end"), F.col("end") - F.col("start")
    long = length > longest + SLACK
    rest = [c for c in words.columns if c not in ("start", "end", "text")]
    whole = F.array(F.struct(F.when(long, F.greatest(F.lit(0.0), end - longest)).otherwise(start).alias("start"), end.alias("end"), F.col("text").alias("text")))
    rows = words.withColumn("_parts", duration_parts(F.when(long, F.col("text")), length, longest))
    pieces = F.when(F.col("_parts").isNull(), whole).otherwise(in_parts(F.col("_parts"), start, end))
    return rows.select(*rest, F.posexplode(pieces).alias("part", "_w")).select(*rest, "part", "_w.*")


def build(segments: DataFrame, durations: DataFrame | None = None, width: int = 42, gap: int = 8, max_lines: int = 2, cps: float = 17.0, least: float = 0.8, longest: float = 7.0, pause: float = 0.8) -> DataFrame:
    """Segments (rec, seg, start, end, text, words) to cues (rec, ix, tick_start, tick_end, cue_text, drifts, told), in milliseconds.

    ``durations`` (rec, duration) bounds recordings. Those without any text have no cues. ``told`` holds the counters of `diagnostics`.
    """
    rows = segments.select("rec", "seg", "start", "end", "text", "words")
    rows = rows.withColumn("duration", F.lit(None).cast("double")) if durations is None else rows.join(durations.select("rec", F.col("duration").cast("double")), "rec", "left")
    return spoken.timed_cues(with_times(with_text(rows)), width, gap, max_lines, cps, least, longest, pause)


def diagnostics(cues: DataFrame, width: int = 42, gap: int = 8, cps: float = 17.0, longest: float = 7.0) -> DataFrame:
    """What `build` made to one row a recording: how its words were got, what was moved, and how the cues look."""
    d = F.col("tick_end") - F.col("tick_start")
    speed = t.visible_length(F.col("cue_text")) * 1000.0 / d
    sizes = F.transform(F.split("cue_text", "\n"), lambda x: F.length(x))
    rows = cues.withColumns({"_d": d, "_speed": speed, "_sizes": sizes})
    counted = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    wide = counted(F.transform("_sizes", lambda x: (x > width + gap).cast("int")))
    made = rows.groupBy("rec").agg(
        F.first("told").alias("_told"), F.sum(F.coalesce(F.size("drifts"), F.lit(0))).alias("adjusted_boundaries"),
        F.coalesce(F.rint(F.max(F.array_max("drifts")) * 1000), F.lit(0.0)).cast("long").alias("max_boundary_drift_ms"),
        F.count_if((F.col("_speed") > cps) & ~n.close(F.col("_speed"), F.lit(cps))).alias("reading_speed_target_exceeded_cues"), F.round(F.max("_speed"), 6).alias("max_actual_cps"),
        F.count_if(F.col("_d") > round(longest * 1000)).alias("duration_target_exceeded_cues"), F.max("_d").alias("max_actual_duration_ms"),
        F.sum(wide).alias("line_length_target_exceeded_lines"), F.max(F.array_max("_sizes")).cast("long").alias("max_actual_line_length"),
    )
    return made.select("rec", "_told.*", *[c for c in made.columns if c not in ("rec", "_told")])
