"""Operators on ordered intervals. Every table has a recording (``rec``), an order within it (``ix``), and start and end.

The sequential sweeps are windows over running sums and maxima, in closed form; they shuffle by recording once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order(rec: str = "rec", ix: str = "ix"):
    return Window.partitionBy(rec).orderBy(ix)


def before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def upto(w):
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def onward(w):
    return w.rowsBetween(Window.currentRow, Window.unboundedFollowing)


def overlaps(df: DataFrame) -> DataFrame:
    """With overlaps: does it start before the one before it ends."""
    return df.withColumn("overlaps", F.coalesce(F.col("start") < F.lag("end").over(in_order()), F.lit(False)))


def pause_blocks(df: DataFrame, pause) -> DataFrame:
    """With block: a new one after each gap of at least ``pause``."""
    gap = F.col("start") - F.lag("end").over(in_order())
    return df.withColumn("_new", F.coalesce((gap >= pause).cast("int"), F.lit(0))).withColumn("block", F.sum("_new").over(upto(in_order()))).drop("_new")


def islands_after(df: DataFrame, closes: Column, name: str = "island") -> DataFrame:
    """With an island number: a row that ``closes`` is its island's last."""
    return df.withColumn("_c", closes.cast("int")).withColumn(name, F.coalesce(F.sum("_c").over(before(in_order())), F.lit(0))).drop("_c")


def islands_from(df: DataFrame, opens: Column, name: str = "island") -> DataFrame:
    """With an island number: a row that ``opens`` is its island's first."""
    return df.withColumn("_o", opens.cast("int")).withColumn(name, F.sum("_o").over(upto(in_order()))).drop("_o")


def clamp_overlaps(df: DataFrame, by_start: bool = True) -> DataFrame:
    """Starts moved to the largest end before them; what ends no later than that, or isn't an interval, is dropped.

    A dropped row never raises that end, so that it is a running maximum over the rows that are intervals.
    """
    w = Window.partitionBy("rec").orderBy("start", "end", "ix") if by_start else in_order()
    carry = F.coalesce(F.max(F.when(F.col("end") > F.col("start"), F.col("end"))).over(before(w)), F.lit(0))
    out = df.withColumn("_from", F.greatest("start", carry))
    return out.where((F.col("end") > F.col("_from")) & (F.col("end") > F.col("start"))).withColumn("start", F.col("_from")).drop("_from")


def quantise(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """With tick_start and tick_end: no start before the last end, no interval shorter than a tick.

    end_i = i + max over j <= i of max(b_j, a_j + 1) - j, and start_i = max(a_i, end_(i-1), 0).
    """
    w = in_order()
    i = F.row_number().over(w) - 1
    out = df.withColumns({"_a": start, "_i": i}).withColumn("_b", F.greatest(end, F.col("_a") + 1) - F.col("_i"))
    out = out.withColumn("tick_end", F.col("_i") + F.max("_b").over(upto(w)))
    return out.withColumn("tick_start", F.greatest("_a", F.coalesce(F.lag("tick_end").over(w), F.lit(0)), F.lit(0))).drop("_a", "_b", "_i")


def allot(df: DataFrame, weight: Column, start: Column, end: Column) -> DataFrame:
    """With start and end: each row's share of the time from ``start`` to ``end`` by weight; the last end is exact."""
    w = in_order()
    out = df.withColumns({"_w": weight, "_s": start, "_e": end}).withColumns({"_at": F.sum("_w").over(upto(w)), "_all": F.sum("_w").over(Window.partitionBy("rec"))})
    span = F.col("_e") - F.col("_s")
    begin = F.col("_s") + span * (F.col("_at") - F.col("_w")) / F.col("_all")
    stop = F.when(F.col("_at") == F.col("_all"), F.col("_e")).otherwise(F.col("_s") + span * F.col("_at") / F.col("_all"))
    return out.withColumns({"start": begin, "end": stop}).drop("_w", "_s", "_e", "_at", "_all")


def retime_equally(df: DataFrame, total: Column, usable: Column) -> DataFrame:
    """Equal shares of ``total`` for all rows of a recording where any interval isn't ``usable``."""
    whole = Window.partitionBy("rec")
    i, n = F.row_number().over(in_order()) - 1, F.count("*").over(whole)
    fine = F.bool_and(usable).over(whole)
    return df.withColumns({"start": F.when(fine, F.col("start")).otherwise(total * i / n), "end": F.when(fine, F.col("end")).otherwise(total * (i + 1) / n)})


def floor_groups(df: DataFrame, groups: Column) -> DataFrame:
    """With group: n rows cut at floor(k n / m) for m groups."""
    r, n = F.row_number().over(in_order()) - 1, F.count("*").over(Window.partitionBy("rec"))
    m = F.least(groups, n)
    return df.withColumn("group", F.floor(((r + 1) * m - 1) / n).cast("long"))


def schedule(df: DataFrame) -> DataFrame:
    """From duration, preferred, lower and upper starts: at (the start given) and feasible (for the whole recording).

    With D the durations before a row and M = min over rows from it on of upper - D, the latest start is M + D, and the start is
    D + max(0, max over rows up to it of min(max(preferred, lower) - D, M)).
    """
    w, whole = in_order(), Window.partitionBy("rec")
    out = df.withColumn("_d", F.coalesce(F.sum("duration").over(before(w)), F.lit(0)))
    out = out.withColumn("_m", F.min(F.col("upper") - F.col("_d")).over(onward(w)))
    out = out.withColumn("_p", F.least(F.greatest("preferred", "lower") - F.col("_d"), F.col("_m")))
    out = out.withColumn("_early", F.col("_d") + F.greatest(F.lit(0), F.max(F.col("lower") - F.col("_d")).over(upto(w))))
    out = out.withColumn("at", F.col("_d") + F.greatest(F.lit(0), F.max("_p").over(upto(w))))
    return out.withColumn("feasible", F.bool_and(F.col("_m") + F.col("_d") >= F.col("_early")).over(whole)).drop("_d", "_m", "_p", "_early")


def midpoint_schedule(df: DataFrame, least) -> DataFrame:
    """Boundaries at the middle between one's end and the next one's start, at least ``least`` apart: with start and end replaced."""
    w = in_order()
    i = F.row_number().over(w) - 1
    edge = (F.col("end") + F.lead("start").over(w)) / 2
    out = df.withColumns({"_i": i, "_edge": F.coalesce(edge, F.col("end"))})
    out = out.withColumn("_stop", (F.col("_i") + 1) * least + F.max(F.greatest(F.col("_edge"), F.lit(0)) - (F.col("_i") + 1) * least).over(upto(w)))
    out = out.withColumn("_stop", F.greatest("_stop", (F.col("_i") + 1) * least))
    return out.withColumns({"start": F.coalesce(F.lag("_stop").over(w), F.least(F.greatest(F.col("start"), F.lit(0)), F.col("_stop") - least)), "end": F.col("_stop")}).drop("_i", "_edge", "_stop")


def block_limits(df: DataFrame) -> DataFrame:
    """With floor and deadline: the end of the block before, and the start of the next one, for rows that have a block."""
    edges = df.groupBy("rec", "block").agg(F.min("start").alias("_first"), F.max("end").alias("_last"))
    w = Window.partitionBy("rec").orderBy("block")
    edges = edges.withColumns({"floor": F.coalesce(F.lag("_last").over(w), F.lit(0)), "deadline": F.lead("_first").over(w)}).drop("_first", "_last")
    return df.join(edges, ["rec", "block"])


def windows(length: Column, window, overlap) -> Column:
    """How many overlapping windows cover ``length``; what is only overlap makes no window of its own."""
    return F.greatest(F.lit(1), F.ceil((length - window) / F.lit(float(window - overlap))) + 1).cast("long")


def plan_windows(df: DataFrame, length: str, window, overlap) -> DataFrame:
    """One row per window: k, offset, duration, is_final."""
    step = window - overlap
    out = df.withColumn("_n", windows(F.col(length), window, overlap)).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    offset = F.col("k") * step
    return out.withColumns({"offset": offset, "duration": F.least(F.lit(window), F.col(length) - offset), "is_final": F.col("k") == F.col("_n") - 1}).drop("_n")


def owner(middle: Column, count: Column, window, overlap) -> Column:
    """The window that commits what has its middle there: each owns the stretch between the middles of its overlaps. No join."""
    step = window - overlap
    return F.least(count - 1, F.greatest(F.lit(0).cast("long"), F.floor((middle - F.lit(overlap / 2)) / F.lit(float(step))).cast("long")))


def near_boundaries(df: DataFrame, middle: Column, length: Column, step, radius) -> DataFrame:
    """One row per boundary (a multiple of ``step`` below ``length``) within ``radius`` of the middle: an equi-join's worth of rows."""
    low = F.greatest(F.lit(1).cast("long"), F.ceil((middle - radius) / F.lit(float(step))).cast("long"))
    high = F.least(F.floor((middle + radius) / F.lit(float(step))), F.ceil(length / F.lit(float(step))) - 1).cast("long")
    return df.withColumn("boundary", F.explode(F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<bigint>"))))


def interpolated(df: DataFrame, x: str, anchors: DataFrame) -> DataFrame:
    """With y: ``x`` carried through the recording's anchors (rec, x, y), linear between the last at or below it and the next.

    Rows and anchors stand in one order; each row sees the anchor before it and the one after. One shuffle, no pairs.
    """
    point = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    marks = anchors.select("rec", F.col("x").cast("double").alias("_x"), F.lit(0).alias("_row"), F.lit(None).cast(df.schema.simpleString()).alias("_it"), point.alias("_anchor"))
    rows = df.select("rec", F.col(x).cast("double").alias("_x"), F.lit(1).alias("_row"), F.struct(*df.columns).alias("_it"), F.lit(None).cast("struct<x:double,y:double>").alias("_anchor"))
    w = Window.partitionBy("rec").orderBy("_x", "_row", "_anchor")
    both = rows.unionByName(marks).withColumns({"_l": F.last("_anchor", ignorenulls=True).over(upto(w)), "_r": F.first("_anchor", ignorenulls=True).over(onward(w))}).where("_row = 1")
    left, right = F.col("_l"), F.col("_r")
    y = F.when(right.isNull(), left["y"]).when(left.isNull(), right["y"]).otherwise(left["y"] + (F.col("_x") - left["x"]) * (right["y"] - left["y"]) / (right["x"] - left["x"]))
    return both.select("_it.*", y.alias("y"))


def first_holder(points: DataFrame, at: str, held: DataFrame, closed: bool) -> DataFrame:
    """Points with holder: the ``ix`` of the first of the intervals (rec, ix, start, end, in order of their starts) that holds the point, or null.

    The first interval that ends later than a point holds it, or nobody does; it is one that ends later than all before it. These
    and the points are put in one order, and each point sees the next. ``closed``: an interval holds its end too.
    """
    longest = held.withColumn("_before", F.max("end").over(before(in_order()))).where("end is not null and (_before is null or end > _before)")
    nobody = "struct<ix:bigint,start:double>"
    longest = longest.select("rec", F.col("end").cast("double").alias("_at"), F.lit(2 if closed else 0).alias("_kind"), F.lit(None).cast(points.schema.simpleString()).alias("_it"), F.struct("ix", F.col("start").cast("double").alias("start")).alias("_next"))
    asking = points.select("rec", F.col(at).cast("double").alias("_at"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_it"), F.lit(None).cast(nobody).alias("_next"))
    following = F.first("_next", ignorenulls=True).over(onward(Window.partitionBy("rec").orderBy("_at", "_kind")))
    seen = asking.unionByName(longest).withColumn("_next", following).where("_kind = 1")
    return seen.select("_it.*", F.when(F.col("_at") >= F.col("_next.start"), F.col("_next.ix")).alias("holder"))


def fix_stretched(df: DataFrame, longest, needed: Column) -> DataFrame:
    """Words longer than ``longest`` get min(longest, needed), anchored at their end, or at the next start if that lies inside."""
    following = F.lead("start").over(in_order())
    inside = following.isNotNull() & (following > F.col("start")) & (following < F.col("end"))
    stop = F.when(inside, following).otherwise(F.col("end"))
    long = F.col("end") - F.col("start") > longest
    start = F.greatest(F.lit(0), stop - F.least(F.lit(longest), needed))
    return df.withColumns({"start": F.when(long, start).otherwise(F.col("start")), "end": F.when(long, stop).otherwise(F.col("end"))})


def boundary_drifts(df: DataFrame) -> DataFrame:
    """How far each scheduled boundary (at_end, next at_start) lies outside the raw gap (end, next start), within blocks."""
    w = Window.partitionBy("rec", "block").orderBy("ix")
    following, scheduled = F.lead("start").over(w), F.lead("at_start").over(w)
    low, high = F.least(F.col("end"), following), F.greatest(F.col("end"), following)
    outside = lambda x: F.greatest(low - x, x - high, F.lit(0))
    return df.withColumn("drift", F.when(following.isNotNull(), F.greatest(outside(F.col("at_end")), outside(scheduled))))
