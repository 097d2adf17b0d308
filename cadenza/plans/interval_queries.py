"""Queries on ordered intervals, windows, joins by time and schedules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions import numbers as n
from cadenza.operators import intervals as iv
from cadenza.plans.base import IV, intervals, query, table

MIN = 60_000_000


@query("wn1_overlaps", f'WITH {IV} SELECT rec, ix, coalesce(start < lag("end") OVER (PARTITION BY rec ORDER BY ix), false) AS overlaps FROM iv')
def wn1(spark, sf):
    return iv.overlaps(intervals(spark, sf)).select("rec", "ix", "overlaps")


_BLOCKS = f"""{IV}, fl AS (SELECT *, coalesce((start - lag("end") OVER (PARTITION BY rec ORDER BY ix) >= {600 * MIN})::INT, 0) AS new FROM iv),
bl AS (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY ix ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM fl)"""


def _blocks(spark, sf):
    return iv.pause_blocks(intervals(spark, sf), 600 * MIN)


@query("wn2_pause_blocks", f'WITH {_BLOCKS} SELECT rec, block, count(*) AS n_rows, min(start) AS first_start, max("end") AS last_end FROM bl GROUP BY rec, block')
def wn2(spark, sf):
    return _blocks(spark, sf).groupBy("rec", "block").agg(F.count("*").alias("n_rows"), F.min("start").alias("first_start"), F.max("end").alias("last_end"))


@query("wn4_subwords", f"""WITH {IV}, tk AS (SELECT rec, ix, start, "end", CASE WHEN event_id % 3 = 0 OR ix = 0 THEN ' ' || text ELSE text END AS tok FROM iv),
gr AS (SELECT *, sum(starts_with(tok, ' ')::INT) OVER (PARTITION BY rec ORDER BY ix ROWS UNBOUNDED PRECEDING)::BIGINT AS word FROM tk)
SELECT rec, word, min(start) AS start, greatest(max("end"), min(start) + 1000) AS "end", ltrim(string_agg(tok, '' ORDER BY ix)) AS text FROM gr GROUP BY rec, word""")
def wn4(spark, sf):
    rows = intervals(spark, sf).withColumn("tok", F.when((F.col("event_id") % 3 == 0) | (F.col("ix") == 0), F.concat(F.lit(" "), "text")).otherwise(F.col("text")))
    rows = iv.islands_from(rows, F.startswith("tok", F.lit(" ")), "word")
    parts = F.array_sort(F.collect_list(F.struct("ix", "tok")))
    return rows.groupBy("rec", "word").agg(F.min("start").alias("start"), F.greatest(F.max("end"), F.min("start") + 1000).alias("end"), F.ltrim(F.array_join(F.transform(parts, lambda x: x["tok"]), "")).alias("text"))


@query("wn5_hyphen_merge", f"""WITH {IV}, tk AS (SELECT rec, ix, CASE WHEN event_id % 5 = 0 THEN '-' || 'то' WHEN event_id % 7 = 0 THEN text || '-' ELSE text END AS tok FROM iv),
fl AS (SELECT *, (NOT (regexp_matches(tok, '^-(то|ка)$') OR coalesce(lag(tok) OVER (PARTITION BY rec ORDER BY ix) LIKE '%-', false)))::INT AS opens FROM tk),
gr AS (SELECT *, sum(opens) OVER (PARTITION BY rec ORDER BY ix ROWS UNBOUNDED PRECEDING)::BIGINT AS word FROM fl)
SELECT rec, word, string_agg(tok, '' ORDER BY ix) AS text FROM gr GROUP BY rec, word""")
def wn5(spark, sf):
    from cadenza.functions.text import is_hyphen_suffix

    tok = F.when(F.col("event_id") % 5 == 0, "-то").when(F.col("event_id") % 7 == 0, F.concat("text", F.lit("-"))).otherwise(F.col("text"))
    rows = intervals(spark, sf).withColumn("tok", tok)
    joined = is_hyphen_suffix(F.col("tok")) | F.coalesce(F.lag("tok").over(iv.in_order()).endswith("-"), F.lit(False))
    rows = iv.islands_from(rows.withColumn("j", ~joined), F.col("j"), "word")
    return rows.groupBy("rec", "word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", "tok"))), lambda x: x["tok"]), "").alias("text"))


_TICKS = f"""{IV}, tk AS (SELECT rec, ix, start // 1000 AS a, "end" // 1000 AS b FROM iv),
te AS (SELECT *, ix + max(greatest(b, a + 1) - ix) OVER (PARTITION BY rec ORDER BY ix ROWS UNBOUNDED PRECEDING) AS tick_end FROM tk),
qu AS (SELECT rec, ix, greatest(a, coalesce(lag(tick_end) OVER (PARTITION BY rec ORDER BY ix), 0), 0) AS tick_start, tick_end FROM te)"""


@query("wn6_quantise", f"WITH {_TICKS} SELECT * FROM qu")
def wn6(spark, sf):
    q = iv.quantise(intervals(spark, sf), F.expr("start div 1000"), F.expr("`end` div 1000"))
    return q.select("rec", "ix", "tick_start", "tick_end")


@query("wn7_canonical_seconds", f"WITH {_TICKS} SELECT rec, ix, tick_start / 1000 AS start_s, tick_end / 1000 AS end_s FROM qu")
def wn7(spark, sf):
    return wn6(spark, sf).select("rec", "ix", (F.col("tick_start") / 1000).alias("start_s"), (F.col("tick_end") / 1000).alias("end_s"))


def _clamp_sql(order: str) -> str:
    return f"""WITH {IV}, ca AS (SELECT rec, ix, "end", greatest(start, coalesce(max(CASE WHEN "end" > start THEN "end" END) OVER (PARTITION BY rec ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS start, "end" > start AS ok FROM iv)
SELECT rec, ix, start, "end" FROM ca WHERE "end" > start AND ok"""


@query("wn8_clamp_sorted", _clamp_sql('start, "end", ix'))
def wn8(spark, sf):
    return iv.clamp_overlaps(intervals(spark, sf)).select("rec", "ix", "start", "end")


@query("wn10_clamp_in_order", _clamp_sql("ix"))
def wn10(spark, sf):
    return iv.clamp_overlaps(intervals(spark, sf), by_start=False).select("rec", "ix", "start", "end")


@query("wn13_allot", f"""WITH {IV}, w AS (SELECT rec, ix, length(text) AS w, sum(length(text)) OVER (PARTITION BY rec ORDER BY ix ROWS UNBOUNDED PRECEDING)::BIGINT AS pos, sum(length(text)) OVER (PARTITION BY rec)::BIGINT AS total FROM iv)
SELECT rec, ix, 10.0::DOUBLE + 90.0::DOUBLE * (pos - w) / total AS start, CASE WHEN pos = total THEN 100.0::DOUBLE ELSE 10.0::DOUBLE + 90.0::DOUBLE * pos / total END AS "end" FROM w""")
def wn13(spark, sf):
    return iv.allot(intervals(spark, sf).drop("start", "end"), F.length("text"), F.lit(10.0), F.lit(100.0)).select("rec", "ix", "start", "end")


@query("wn15_retime_equally", f"""WITH {IV}, b AS (SELECT *, bool_and("end" > start) OVER (PARTITION BY rec) AND rec % 2 = 0 AS fine, row_number() OVER (PARTITION BY rec ORDER BY ix) - 1 AS i, count(*) OVER (PARTITION BY rec) AS n FROM iv)
SELECT rec, ix, CASE WHEN fine THEN start::DOUBLE ELSE 1000000.0::DOUBLE * i / n END AS start, CASE WHEN fine THEN "end"::DOUBLE ELSE 1000000.0::DOUBLE * (i + 1) / n END AS "end" FROM b""")
def wn15(spark, sf):
    rows = intervals(spark, sf).withColumns({"start": F.col("start").cast("double"), "end": F.col("end").cast("double")})
    usable = n.valid_interval(F.col("start"), F.col("end")) & (F.col("rec") % 2 == 0)
    return iv.retime_equally(rows, F.lit(1000000.0), usable).select("rec", "ix", "start", "end")


@query("wn16_fix_stretched", f"""WITH {IV}, nx AS (SELECT *, lead(start) OVER (PARTITION BY rec ORDER BY ix) AS following FROM iv),
s AS (SELECT *, CASE WHEN following > start AND following < "end" THEN following ELSE "end" END AS stop, "end" - start > {200 * MIN} AS long FROM nx)
SELECT rec, ix, CASE WHEN long THEN greatest(0, stop - least({200 * MIN}, length(text) * {10 * MIN})) ELSE start END AS start, CASE WHEN long THEN stop ELSE "end" END AS "end" FROM s""")
def wn16(spark, sf):
    return iv.fix_stretched(intervals(spark, sf), 200 * MIN, F.length("text").cast("long") * (10 * MIN)).select("rec", "ix", "start", "end")


_SCHEDULE = f"""{IV}, du AS (SELECT rec, ix, start, "end", least("end" - start, {300 * MIN}) AS d FROM iv),
dd AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY rec ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pre, start - {60 * MIN} AS lower, start + {600 * MIN} AS upper FROM du),
mm AS (SELECT *, min(upper - pre) OVER (PARTITION BY rec ORDER BY ix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM dd),
pp AS (SELECT *, pre + greatest(0, max(lower - pre) OVER w) AS early, pre + greatest(0, max(least(greatest(start, lower) - pre, m)) OVER w) AS "at" FROM mm WINDOW w AS (PARTITION BY rec ORDER BY ix ROWS UNBOUNDED PRECEDING)),
sc AS (SELECT rec, ix, start, "end", d, "at", bool_and(m + pre >= early) OVER (PARTITION BY rec) AS feasible FROM pp)"""


def _scheduled(spark, sf):
    rows = intervals(spark, sf).withColumns({"duration": F.least(F.col("end") - F.col("start"), F.lit(300 * MIN)), "preferred": F.col("start"), "lower": F.col("start") - 60 * MIN, "upper": F.col("start") + 600 * MIN})
    return iv.schedule(rows)


@query("wn18_schedule", f'WITH {_SCHEDULE} SELECT rec, ix, "at", feasible FROM sc')
def wn18(spark, sf):
    return _scheduled(spark, sf).select("rec", "ix", "at", "feasible")


_MID = """md AS (SELECT rec, ix, start, "end", ix + 1 AS k, coalesce(("end" + lead(start) OVER (PARTITION BY rec ORDER BY ix)) / 2, "end") AS edge FROM iv),
ms AS (SELECT *, greatest(k * 1000 + max(greatest(edge, 0) - k * 1000) OVER (PARTITION BY rec ORDER BY ix ROWS UNBOUNDED PRECEDING), k * 1000) AS stop FROM md),
mo AS (SELECT rec, ix, coalesce(lag(stop) OVER (PARTITION BY rec ORDER BY ix), least(greatest(start, 0), stop - 1000)) AS start, stop AS "end" FROM ms)"""


@query("wn21_midpoint_schedule", f"WITH {IV}, {_MID} SELECT * FROM mo")
def wn21(spark, sf):
    return iv.midpoint_schedule(intervals(spark, sf), 1000).select("rec", "ix", "start", "end")


@query("wn29_schedule_or_fallback", f"""WITH {_SCHEDULE}, {_MID}
SELECT sc.rec, sc.ix, CASE WHEN feasible THEN "at"::DOUBLE ELSE mo.start END AS start, CASE WHEN feasible THEN ("at" + d)::DOUBLE ELSE mo."end" END AS "end" FROM sc JOIN mo USING (rec, ix)""")
def wn29(spark, sf):
    plan = _scheduled(spark, sf)
    rest = iv.midpoint_schedule(plan, 1000)
    return rest.select("rec", "ix", F.when(F.col("feasible"), F.col("at").cast("double")).otherwise(F.col("start")).alias("start"), F.when(F.col("feasible"), (F.col("at") + F.col("duration")).cast("double")).otherwise(F.col("end")).alias("end"))


@query("wn19_block_limits", f"""WITH {_BLOCKS}, e AS (SELECT rec, block, min(start) AS f, max("end") AS l FROM bl GROUP BY rec, block),
l2 AS (SELECT rec, block, coalesce(lag(l) OVER w, 0) AS floor, lead(f) OVER w AS deadline FROM e WINDOW w AS (PARTITION BY rec ORDER BY block)) SELECT bl.rec, ix, floor, deadline FROM bl JOIN l2 USING (rec, block)""")
def wn19(spark, sf):
    return iv.block_limits(_blocks(spark, sf)).select("rec", "ix", "floor", "deadline")


@query("ag17_boundary_drift", f"""WITH {_SCHEDULE}, nb AS (SELECT rec, ix, coalesce((start - lag("end") OVER (PARTITION BY rec ORDER BY ix) >= {600 * MIN})::INT, 0) AS new FROM iv),
bk AS (SELECT rec, ix, sum(new) OVER (PARTITION BY rec ORDER BY ix ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM nb),
j AS (SELECT sc.rec, sc.ix, sc.start, sc."end", "at", "at" + d AS at_end, block, lead(sc.start) OVER w AS nx, lead("at") OVER w AS nat FROM sc JOIN bk USING (rec, ix) WINDOW w AS (PARTITION BY sc.rec, block ORDER BY sc.ix)),
k AS (SELECT rec, greatest(least("end", nx) - at_end, at_end - greatest("end", nx), least("end", nx) - nat, nat - greatest("end", nx), 0) AS drift FROM j WHERE nx IS NOT NULL)
SELECT rec, count(*) FILTER (drift > 0) AS adjusted, max(drift) // 1000 AS max_drift_ms FROM k GROUP BY rec""")
def ag17(spark, sf):
    rows = iv.pause_blocks(_scheduled(spark, sf), 600 * MIN).withColumns({"at_start": F.col("at"), "at_end": F.col("at") + F.col("duration")})
    return iv.boundary_drifts(rows).where("drift is not null").groupBy("rec").agg(F.count_if(F.col("drift") > 0).alias("adjusted"), F.expr("max(drift) div 1000").alias("max_drift_ms"))


@query("wn22_even_schedule", f"WITH {IV} SELECT rec, ix, 3600.0::DOUBLE * ix / count(*) OVER (PARTITION BY rec) AS start, 3600.0::DOUBLE * (ix + 1) / count(*) OVER (PARTITION BY rec) AS \"end\" FROM iv")
def wn22(spark, sf):
    rows = intervals(spark, sf).withColumns({"start": F.lit(0.0), "end": F.lit(0.0)})
    return iv.retime_equally(rows, F.lit(3600.0), F.lit(False)).select("rec", "ix", "start", "end")


@query("wn23_floor_groups", f'WITH {IV}, n AS (SELECT *, count(*) OVER (PARTITION BY rec) AS n FROM iv) SELECT rec, floor(((ix + 1) * least(7, n) - 1) / n)::BIGINT AS "group", count(*) AS n_rows, min(start) AS start, max("end") AS "end" FROM n GROUP BY 1, 2')
def wn23(spark, sf):
    rows = iv.floor_groups(intervals(spark, sf), F.lit(7))
    return rows.groupBy("rec", "group").agg(F.count("*").alias("n_rows"), F.min("start").alias("start"), F.max("end").alias("end"))


@query("wn34_span_offsets", f'WITH {IV} SELECT rec, ix, coalesce(sum(length(text)) OVER (PARTITION BY rec ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "at", sum(length(text)) OVER (PARTITION BY rec ORDER BY ix ROWS UNBOUNDED PRECEDING)::BIGINT AS until FROM iv')
def wn34(spark, sf):
    w = iv.in_order()
    return intervals(spark, sf).select("rec", "ix", F.coalesce(F.sum(F.length("text")).over(iv.before(w)), F.lit(0)).alias("at"), F.sum(F.length("text")).over(iv.upto(w)).alias("until"))


@query("wn35_source_word_sweep", f'WITH {IV} SELECT rec, ix, greatest(start, coalesce(lag(least("end", {40000 * MIN})) OVER (PARTITION BY rec ORDER BY ix), 0)) AS start, least("end", {40000 * MIN}) AS "end" FROM iv')
def wn35(spark, sf):
    stop = F.least("end", F.lit(40000 * MIN))
    return intervals(spark, sf).select("rec", "ix", F.greatest(F.col("start"), F.coalesce(F.lag(stop).over(iv.in_order()), F.lit(0))).alias("start"), stop.alias("end"))


_WIN, _OVER = 3000 * MIN, 20 * MIN
_STEP = _WIN - _OVER
_PLAN = f"""{IV}, le AS (SELECT rec, max("end") AS length FROM iv GROUP BY rec), nw AS (SELECT *, greatest(1, ceil((length - {_WIN}) / {float(_STEP)}) + 1)::BIGINT AS n FROM le)"""


def _lengths(spark, sf):
    return intervals(spark, sf).groupBy("rec").agg(F.max("end").alias("length"))


@query("sm2_window_plan", f"WITH {_PLAN}, k AS (SELECT *, unnest(range(n)) AS k FROM nw) SELECT rec, k, k * {_STEP} AS \"offset\", least({_WIN}, length - k * {_STEP}) AS duration, k = n - 1 AS is_final FROM k")
def sm2(spark, sf):
    return iv.plan_windows(_lengths(spark, sf), "length", _WIN, _OVER).select("rec", "k", "offset", "duration", "is_final")


@query("sm3_commit_ownership", f"""WITH {_PLAN} SELECT rec, least(n - 1, greatest(0, floor(((start + "end") / 2 - {_OVER / 2}) / {float(_STEP)})::BIGINT)) AS k, count(*) AS n_rows FROM iv JOIN nw USING (rec) GROUP BY 1, 2""")
def sm3(spark, sf):
    rows = intervals(spark, sf).join(_lengths(spark, sf), "rec")
    k = iv.owner((F.col("start") + F.col("end")) / 2, iv.windows(F.col("length"), _WIN, _OVER), _WIN, _OVER)
    return rows.groupBy("rec", k.alias("k")).agg(F.count("*").alias("n_rows"))


@query("pf10_commit_half_open", f"""WITH {_PLAN}, k AS (SELECT rec, n, unnest(range(n)) AS k FROM nw)
SELECT rec, k, count(*) AS n_rows FROM iv JOIN k USING (rec) WHERE (start + "end") / 2 >= CASE WHEN k = 0 THEN 0 ELSE k * {_STEP} + {_OVER / 2} END AND ((start + "end") / 2 < (k + 1) * {_STEP} + {_OVER / 2} OR k = n - 1) GROUP BY rec, k""")
def pf10(spark, sf):
    return sm3(spark, sf)


@query("pf11_commit_closed", f"""WITH {_PLAN}, k AS (SELECT rec, n, unnest(range(n)) AS k FROM nw)
SELECT rec, ix, k FROM iv JOIN k USING (rec) WHERE (start + "end") / 2 >= CASE WHEN k = 0 THEN 0 ELSE k * {_STEP} + {_OVER / 2} END AND ((start + "end") / 2 <= (k + 1) * {_STEP} + {_OVER / 2} OR k = n - 1)""")
def pf11(spark, sf):
    """Closed at both ends: a middle on a boundary belongs to both windows."""
    rows = intervals(spark, sf).join(_lengths(spark, sf), "rec").withColumn("mid", (F.col("start") + F.col("end")) / 2)
    rows = rows.withColumn("n", iv.windows(F.col("length"), _WIN, _OVER)).withColumn("k", iv.owner(F.col("mid"), F.col("n"), _WIN, _OVER))
    tie = (F.col("k") > 0) & (F.col("mid") == F.col("k") * _STEP + _OVER / 2)
    return rows.select("rec", "ix", F.explode(F.when(tie, F.array(F.col("k") - 1, F.col("k"))).otherwise(F.array("k"))).alias("k"))


@query("jn6_band_join", f"""WITH {_PLAN}, b AS (SELECT rec, unnest(range(1, greatest(1, ceil(length / {float(_STEP)})::BIGINT))) AS boundary FROM nw)
SELECT rec, boundary, count(*) AS n_rows FROM iv JOIN b USING (rec) WHERE abs((start + "end") / 2 - boundary * {_STEP}::DOUBLE) <= {40 * MIN} GROUP BY rec, boundary""")
def jn6(spark, sf):
    rows = intervals(spark, sf).join(_lengths(spark, sf), "rec").withColumn("mid", (F.col("start") + F.col("end")) / 2)
    return iv.near_boundaries(rows, F.col("mid"), F.col("length"), _STEP, 40 * MIN).groupBy("rec", "boundary").agg(F.count("*").alias("n_rows"))


@query("jn5_range_join", f"""WITH {_BLOCKS}, sg AS (SELECT rec, block, min(start) AS f, max("end") AS l FROM bl GROUP BY rec, block)
SELECT iv.rec, iv.ix, min(block) AS block FROM iv LEFT JOIN sg ON sg.rec = iv.rec AND (iv.start + iv."end") / 2 BETWEEN f AND l AND block % 3 <> 1 GROUP BY 1, 2""")
def jn5(spark, sf):
    """Middles to the first segment that holds them; the rest have none."""
    segments = _blocks(spark, sf).groupBy("rec", F.col("block").alias("ix")).agg(F.min("start").alias("start"), F.max("end").alias("end")).where("ix % 3 <> 1")
    rows = intervals(spark, sf).select("rec", "ix", ((F.col("start") + F.col("end")) / 2).alias("mid"))
    return iv.first_holder(rows, "mid", segments, closed=True).select("rec", "ix", F.col("holder").alias("block"))


_ANCHORS = f"{IV}, an AS (SELECT rec, start AS x, ix * 1000 AS y FROM iv WHERE ix % 50 = 0)"


@query("jn7_asof_interpolate", f"""WITH {_ANCHORS}, l AS (SELECT iv.rec, ix, start, max(x) AS lx FROM iv JOIN an ON an.rec = iv.rec AND x <= start GROUP BY 1, 2, 3),
r AS (SELECT iv.rec, ix, min(x) AS rx FROM iv JOIN an ON an.rec = iv.rec AND x > start GROUP BY 1, 2)
SELECT l.rec, l.ix, CASE WHEN rx IS NULL THEN a.y::DOUBLE ELSE a.y + (l.start - a.x) * (b.y - a.y) / (b.x - a.x) END AS y FROM l LEFT JOIN r USING (rec, ix) JOIN (SELECT rec, x, max(y) AS y FROM an GROUP BY 1, 2) a ON a.rec = l.rec AND a.x = lx LEFT JOIN (SELECT rec, x, min(y) AS y FROM an GROUP BY 1, 2) b ON b.rec = l.rec AND b.x = rx""")
def jn7(spark, sf):
    rows = intervals(spark, sf)
    anchors = rows.where("ix % 50 = 0").select("rec", F.col("start").alias("x"), (F.col("ix") * 1000).alias("y"))
    return iv.interpolated(rows.select("rec", "ix", "start"), "start", anchors).select("rec", "ix", "y")


_HELD = f"""WITH {IV} SELECT a.rec, a.ix, min(b.ix) AS holder FROM iv a LEFT JOIN iv b ON b.rec = a.rec AND a."end" >= b.start AND a."end" < b."end" GROUP BY 1, 2"""


@query("jn8_point_in_interval", _HELD)
def jn8(spark, sf):
    """Every row's end to the first of all intervals that holds it, or null."""
    rows = intervals(spark, sf).select("rec", "ix", "start", "end")
    return iv.first_holder(rows, "end", rows, closed=False).select("rec", "ix", "holder")



@query("pf1_valid_intervals", f'WITH {IV} SELECT rec, count(*) FILTER (start >= 0 AND "end" > start) AS n_valid, count(*) AS n_rows FROM iv GROUP BY rec')
def pf1(spark, sf):
    ok = n.valid_interval(F.col("start").cast("double"), F.col("end").cast("double"))
    return intervals(spark, sf).groupBy("rec").agg(F.count_if(ok).alias("n_valid"), F.count("*").alias("n_rows"))


@query("pf5_monotone_words", f'WITH {IV}, p AS (SELECT rec, start >= coalesce(lag("end") OVER (PARTITION BY rec ORDER BY ix), 0) - 1 AND "end" > start AS ok FROM iv) SELECT rec, bool_and(ok) AS monotone, count(*) FILTER (NOT ok) AS n_bad FROM p GROUP BY rec')
def pf5(spark, sf):
    ok = (F.col("start") >= F.coalesce(F.lag("end").over(iv.in_order()), F.lit(0)) - 1) & (F.col("end") > F.col("start"))
    return intervals(spark, sf).withColumn("ok", ok).groupBy("rec").agg(F.bool_and("ok").alias("monotone"), F.count_if(~F.col("ok")).alias("n_bad"))


@query("pf14_clip_to_range", f'WITH {IV} SELECT rec, ix, greatest(start, {1000 * MIN}) AS start, least("end", {20000 * MIN}) AS "end" FROM iv WHERE least("end", {20000 * MIN}) > greatest(start, {1000 * MIN})')
def pf14(spark, sf):
    rows = intervals(spark, sf).withColumns({"start": F.greatest("start", F.lit(1000 * MIN)), "end": F.least("end", F.lit(20000 * MIN))})
    return rows.where(F.col("end") > F.col("start")).select("rec", "ix", "start", "end")


@query("dt1_utc_text", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS \"at\", epoch_us(ts) AS micros FROM events")
def dt1(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select("event_id", n.utc_text(ts).alias("at"), F.unix_micros(ts).alias("micros"))
