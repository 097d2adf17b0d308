"""Queries of checks, repairs and small projections, and of text reconciled with timed words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import numbers as n
from cadenza.functions import text as t
from cadenza.operators import checks, reconcile, stream
from cadenza.operators import joblog as jobs
from cadenza.plans.base import CT, EV, IT, IV, LN, intervals, job_events, lines, query, table
from cadenza.sources import media

SECOND = 1_000_000
_FIELDS = "start := start / 1e6, \"end\" := \"end\" / 1e6, text := CASE WHEN event_id % 13 = 0 THEN ' ' ELSE text END, probability := CASE WHEN event_id % 7 > 0 THEN (event_id % 11) / 10 END"
#: Eight intervals make a segment.
SG = f"""{IV}, sg AS (SELECT rec, ix // 8 AS seg, min(start) / 1e6 AS start, max("end") / 1e6 AS "end", trim(string_agg(text, ' ' ORDER BY ix)) AS text, list(struct_pack({_FIELDS}) ORDER BY ix) AS words FROM iv GROUP BY 1, 2)"""
DURATION = "(rec % 7 + 1) * 100000.0"
_WORD_OK = "x.start >= 0 AND x.\"end\" > x.start AND x.\"end\" <= {d} + 0.25 AND trim(x.text) <> ''"


def words_of(spark, sf):
    """Events as timed words in seconds."""
    blank, p = F.when(F.col("event_id") % 13 == 0, " ").otherwise(F.col("text")), F.when(F.col("event_id") % 7 > 0, F.col("event_id") % 11 / 10)
    return intervals(spark, sf).select("rec", "ix", "event_id", (F.col("start") / 1e6).alias("start"), (F.col("end") / 1e6).alias("end"), blank.alias("text"), p.alias("probability"), F.col("text").alias("kind"))


def segments_of(spark, sf):
    parts = F.array_sort(F.collect_list(F.struct("ix", "start", "end", "text", "probability", "kind")))
    rows = words_of(spark, sf).groupBy("rec", F.expr("ix div 8").alias("seg")).agg(F.min("start").alias("start"), F.max("end").alias("end"), parts.alias("p"))
    words = F.transform("p", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), x["probability"].alias("probability")))
    return rows.select("rec", "seg", "start", "end", F.array_join(F.transform("p", lambda x: x["kind"]), " ").alias("text"), words.alias("words"))


def duration():
    return (F.col("rec") % 7 + 1) * 100000.0


@query("pf2_valid_words", f"WITH {SG}, w AS (SELECT rec, unnest(words) AS x FROM sg) SELECT rec, count(*) FILTER ({_WORD_OK.format(d=DURATION)}) AS n_valid, count(*) AS n_words FROM w GROUP BY rec")
def pf2(spark, sf):
    ok = checks.word_is_valid(F.struct("start", "end", "text", "probability"), duration())
    return words_of(spark, sf).groupBy("rec").agg(F.count_if(ok).alias("n_valid"), F.count("*").alias("n_words"))


_SEGMENT_OK = f'start >= 0 AND "end" > start AND "end" <= {DURATION} + 0.25 AND text <> \'\' AND len(list_filter(words, lambda x: NOT ({_WORD_OK.format(d=DURATION)}))) = 0'


@query("pf3_valid_segments", f"WITH {SG} SELECT rec, seg, {_SEGMENT_OK} AS valid FROM sg")
def pf3(spark, sf):
    return segments_of(spark, sf).select("rec", "seg", checks.segment_is_valid(F.struct("start", "end", "text", "words"), duration()).alias("valid"))


@query("pf6_source_words", f"""WITH {IV}, w AS (SELECT rec * 100000 + ix // 4 AS rec, ix, start / 1e6 AS a, "end" / 1e6 AS b FROM iv), r AS (SELECT *, min(a) OVER (PARTITION BY rec) AS s, max(b) OVER (PARTITION BY rec) - 20 AS e, lag(b) OVER (PARTITION BY rec ORDER BY ix) AS p FROM w)
SELECT rec, bool_and(a >= 0 AND b > a AND a >= coalesce(p, s) - 0.05 AND a >= s - 0.05 AND b <= e + 0.05) AS usable FROM r GROUP BY rec""")
def pf6(spark, sf):
    rows = words_of(spark, sf).withColumn("rec", F.col("rec") * 100000 + F.expr("ix div 4"))
    whole = Window.partitionBy("rec")
    rows = rows.withColumns({"s": F.min("start").over(whole), "e": F.max("end").over(whole) - 20})
    return checks.source_words_are_valid(rows, F.col("s"), F.col("e"))


@query("pf12_commit_final", f"""WITH {IV} SELECT rec, ix, (start + "end") / 2 >= {60000 * SECOND} AND (rec % 2 = 0 OR (start + "end") / 2 < {1200000 * SECOND}) AS committed FROM iv""")
def pf12(spark, sf):
    middle = (F.col("start") + F.col("end")) / 2
    return intervals(spark, sf).select("rec", "ix", checks.commits(middle, F.lit(1000 * 60 * SECOND), F.lit(20000 * 60 * SECOND), F.col("rec") % 2 == 0).alias("committed"))


@query("pf13_commit_segments", f"""WITH {SG}, s AS (SELECT rec, seg, start, "end", text, CASE WHEN seg % 3 = 0 THEN words[1:0] ELSE words END AS words FROM sg),
o AS (SELECT *, list_filter(words, lambda x: (x.start + x."end") / 2 >= 60000 AND (x.start + x."end") / 2 < 300000 AND x."end" > x.start) AS own FROM s),
k AS (SELECT rec, seg, CASE WHEN len(words) > 0 THEN own[1].start ELSE start END AS start, CASE WHEN len(words) > 0 THEN own[-1]."end" ELSE "end" END AS "end", CASE WHEN len(words) > 0 THEN trim(array_to_string(list_transform(own, lambda x: x.text), '')) ELSE trim(text) END AS text, len(own) AS n_words
 FROM o WHERE CASE WHEN len(words) > 0 THEN len(own) > 0 ELSE (start + "end") / 2 >= 60000 AND (start + "end") / 2 < 300000 AND "end" > start END) SELECT * FROM k WHERE text <> ''""")
def pf13(spark, sf):
    rows = segments_of(spark, sf).withColumn("words", F.when(F.col("seg") % 3 == 0, F.slice("words", 1, 0)).otherwise(F.col("words")))
    made = checks.committed_segments(rows, F.lit(60000.0), F.lit(300000.0))
    return made.select("rec", "seg", "start", "end", "text", F.size("words").cast("long").alias("n_words"))


@query("pf18_pending_items", f"WITH {EV} SELECT DISTINCT job, path, path || '.srt' AS output, 'queued' AS state, 0 AS progress FROM ev")
def pf18(spark, sf):
    rows = job_events(spark, sf).select("job", "path").distinct()
    return rows.select("job", "path", F.concat("path", F.lit(".srt")).alias("output"), F.lit("queued").alias("state"), F.lit(0).alias("progress"))


@query("pf19_job_summary", f"WITH {CT}, e AS (SELECT job, max(event_id) AS latest, min(pos) AS created_at, max(pos) AS updated_at FROM ev GROUP BY job) SELECT job, status, total, done, cached, skipped, failed, cancelled, succeeded, created_at, updated_at, latest + 1 AS next_event_id, latest AS n_events, status = 'ok' AS clean FROM st JOIN e USING (job)")
def pf19(spark, sf):
    from cadenza.plans.job_queries import _status

    ends = job_events(spark, sf).groupBy("job").agg(F.max("event_id").alias("latest"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))
    counts = ["total", "done", "cached", "skipped", "failed", "cancelled", "succeeded"]
    return _status(spark, sf).join(ends, "job").select("job", "status", *counts, "created_at", "updated_at", (F.col("latest") + 1).alias("next_event_id"), F.col("latest").alias("n_events"), (F.col("status") == "ok").alias("clean"))


@query("pf21_normal_state", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN CASE event_type WHEN 'error' THEN 'error' ELSE 'queued' END WHEN 2 THEN 'queued' ELSE 'error' END AS state FROM events")
def pf21(spark, sf):
    given = F.get(F.array(F.lit(" Done "), F.col("event_type"), F.lit(None).cast("string"), F.lit("ERROR")), (F.col("event_id") % 4).cast("int"))
    return table(spark, sf, "events").select("event_id", checks.normal_state(given).alias("state"))


@query("pf23_card_classes", "SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'queued' WHEN count(l_orderkey) FILTER (l_returnflag <> 'R') >= 2 AND count(l_orderkey) FILTER (l_linestatus = 'F') >= 2 THEN 'candidate' ELSE 'queued' END AS state FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey")
def pf23(spark, sf):
    files = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") != "R").alias("outputs"), F.count_if(F.col("l_linestatus") == "F").alias("sidecars"))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(files, "o_orderkey", "left").fillna(0, ["outputs", "sidecars"])
    return rows.select("o_orderkey", checks.classify_card(F.col("o_custkey") % 5 == 0, F.col("outputs"), F.col("sidecars"), F.lit(2)).alias("state"))


@query("pf24_cache_admission", f"""WITH {LN}, c AS (SELECT rec, ix, length(line) > 50 AS wide, ix % 17 = 5 AS fast FROM ln), b AS (SELECT rec, bool_or(wide) AS wide, bool_or(fast) AS fast FROM c GROUP BY rec)
SELECT rec, rec % 4 <> 1 AND rec % 5 <> 2 AND rec % 6 <> 3 AND NOT fast AND (NOT wide OR rec % 2 = 0) AS admitted FROM b""")
def pf24(spark, sf):
    """Rules that a text breaks, gathered, then the admission of its cached result."""
    rules = F.array_compact(F.array(F.when(F.length("line") > 50, "width"), F.when(F.col("ix") % 17 == 5, "speed")))
    broken = F.array_distinct(F.flatten(F.collect_list(rules)))
    rows, r = lines(spark, sf).groupBy("rec").agg(broken.alias("broken")), F.col("rec")
    return rows.select("rec", checks.admits_cache(r % 4 != 1, r % 5 != 2, r % 6 != 3, F.col("broken"), r % 2 == 0).alias("admitted"))


@query("pf25_reset_items", f"WITH {IT} SELECT job, path, CASE WHEN state IN ('error', 'cancelled', 'interrupted') THEN 'queued' ELSE state END AS state, CASE WHEN state NOT IN ('error', 'cancelled', 'interrupted') THEN path || '.srt' END AS output FROM it")
def pf25(spark, sf):
    from cadenza.plans.job_queries import _items

    again = F.col("state").isin("error", "cancelled", "interrupted")
    return _items(spark, sf).select("job", "path", F.when(again, "queued").otherwise(F.col("state")).alias("state"), F.when(~again, F.concat("path", F.lit(".srt"))).alias("output"))


_BARE = "CASE WHEN seg % 3 = 0 THEN words[1:0] ELSE words END"


@query("pf26_one_segment", f"""WITH {SG}, s AS (SELECT rec, seg, {_BARE} AS words, CASE WHEN seg % 6 = 0 THEN ' ' ELSE text || ' ' END AS text, "end" AS d FROM sg)
SELECT rec, seg, CASE WHEN len(words) > 0 THEN list_min(list_transform(words, lambda x: x.start)) ELSE 0 END AS start, CASE WHEN len(words) > 0 THEN list_max(list_transform(words, lambda x: x."end")) ELSE d END AS "end", trim(text) AS text FROM s WHERE len(words) > 0 OR trim(text) <> ''""")
def pf26(spark, sf):
    rows = segments_of(spark, sf).withColumns({"words": F.when(F.col("seg") % 3 == 0, F.slice("words", 1, 0)).otherwise(F.col("words")), "text": F.when(F.col("seg") % 6 == 0, " ").otherwise(F.concat("text", F.lit(" ")))})
    made = rows.select("rec", "seg", F.explode(checks.one_segment(F.col("text"), F.col("words"), F.col("end"))).alias("s"))
    return made.select("rec", "seg", "s.start", "s.end", "s.text")


@query("pf27_clean_tokens", f"""WITH {SG}, u AS (SELECT rec, seg, start, "end", unnest(words) AS x FROM sg) SELECT rec, seg, x.start + 5 AS at, x.text AS token FROM u WHERE x.text <> '' AND x."end" > x.start AND x.start + 5 >= start AND x."end" + 5 <= "end" """)
def pf27(spark, sf):
    kept = checks.cleaned_tokens(F.col("words"), F.lit(5.0), F.col("start"), F.col("end"))
    return segments_of(spark, sf).select("rec", "seg", F.explode(kept).alias("x")).select("rec", "seg", F.col("x.start").alias("at"), F.col("x.text").alias("token"))


@query("jn3_retry_refresh", "WITH f AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag <> 'R') SELECT o_orderkey, 'queued' AS state, l_orderkey IS NULL AS missing FROM f LEFT JOIN b ON l_orderkey = o_orderkey")
def jn3(spark, sf):
    """Failed items met with those built anew; an item that isn't among them is named, so that a caller can refuse the retry."""
    failed = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    built = table(spark, sf, "lineitem").where("l_returnflag != 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return jobs.refreshed(failed, built, "o_orderkey")


@query("ag4_next_event_id", f"WITH {EV} SELECT job, max(event_id) + 1 AS next_id, count(*) AS n_events FROM ev GROUP BY job")
def ag4(spark, sf):
    return jobs.next_event_ids(job_events(spark, sf))


_MEMORY = f"{EV}, j AS (SELECT job, max(pos) AS completed, job % 10 = 0 AS active FROM ev GROUP BY job), a AS (SELECT * FROM j WHERE active OR completed + 300 >= 1000), r AS (SELECT *, row_number() OVER (PARTITION BY active ORDER BY completed DESC, job DESC) AS k, count(*) FILTER (active) OVER () AS n_active FROM a)"


@query("so7_memory_ttl", f"WITH {_MEMORY} SELECT job, active FROM r WHERE active OR k <= greatest(0, 16 - n_active)")
def so7(spark, sf):
    """Finished jobs older than the time to live go, then the oldest finished ones beyond 16 jobs in all; active ones stay."""
    jobs = job_events(spark, sf).groupBy("job").agg(F.max("at").alias("completed")).withColumn("active", F.col("job") % 10 == 0)
    alive = jobs.where("active or completed + 300 >= 1000")
    room = F.broadcast(alive.agg(F.greatest(F.lit(0), 16 - F.count_if("active")).cast("int").alias("room")))  # one row
    newest = alive.where("not active").orderBy(F.desc("completed"), F.desc("job")).limit(16)
    newest = newest.withColumn("k", F.row_number().over(Window.orderBy(F.desc("completed"), F.desc("job"))))  # of 16 rows
    return alive.where("active").select("job", "active").unionByName(newest.join(room, F.col("k") <= F.col("room")).select("job", "active"))


@query("se5_required_missing", "SELECT DISTINCT o_custkey AS required FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def se5(spark, sf):
    present = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("required"))
    return jobs.missing(table(spark, sf, "orders").select(F.col("o_custkey").alias("required")), present, "required")


@query("sm6_cursor", "SELECT event_id, greatest(CASE WHEN event_id % 3 > 0 THEN event_id % 50 END, CASE WHEN event_id % 5 > 0 AND event_id % 7 > 0 THEN event_id % 40 END, 0) AS cursor FROM events")
def sm6(spark, sf):
    """The larger of the query's and the header's cursor; a header that is no number counts as none."""
    e = F.col("event_id")
    header = F.when(e % 7 == 0, "x").when(e % 5 > 0, (e % 40).cast("string"))
    return table(spark, sf, "events").select("event_id", jobs.cursor(F.when(e % 3 > 0, e % 50), header).alias("cursor"))


@query("dt2_epoch", "SELECT event_id, strftime(make_timestamp(epoch_us(ts)), '%Y-%m-%dT%H:%M:%S.%fZ') AS text, epoch_us(ts) AS micros, CASE WHEN event_id % 4 > 0 THEN epoch_us(ts) END AS parsed FROM events")
def dt2(spark, sf):
    """Epoch to text and back; text that is no time gives null."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    shown = n.utc_text(F.timestamp_micros(micros))
    given = F.when(F.col("event_id") % 4 > 0, shown).otherwise(F.concat(F.lit("on "), shown))
    return table(spark, sf, "events").select("event_id", shown.alias("text"), micros.alias("micros"), F.unix_micros(F.try_to_timestamp(given)).alias("parsed"))


@query("ar2_flatten_words", f"""WITH {SG}, u AS (SELECT rec, unnest(words) AS x FROM sg) SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY x.start, x."end", x.text) AS k, x.start AS start, x.text AS text FROM u WHERE x.start >= 0 AND x."end" > x.start AND trim(x.text) <> ''""")
def ar2(spark, sf):
    """Segments' words in one list, those that are valid, in order."""
    return checks.flat_words(segments_of(spark, sf)).select("rec", "k", "start", "text")


@query("js2_field_access", "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, coalesce(props::JSON ->> '$.text', event_type) AS text FROM events")
def js2(spark, sf):
    """A field of a mapping, or a default where it has none."""
    k, text = (t.json_field(F.col("props"), name) for name in ("k", "text"))
    return table(spark, sf, "events").select("event_id", n.optional_int(k).alias("k"), F.coalesce(text, "event_type").alias("text"))


@query("nm9_optional_numbers", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN NULL WHEN 2 THEN event_id % 100 ELSE NULL END AS number, CASE WHEN event_id % 3 > 0 THEN event_type END AS text FROM events")
def nm9(spark, sf):
    e = F.col("event_id")
    given = F.get(F.array(e.cast("string"), F.lit("n/a"), F.concat(F.lit(" "), (e % 100).cast("string"), F.lit(" ")), F.lit("")), (e % 4).cast("int"))
    text = F.when(e % 3 > 0, F.concat(F.lit(" "), "event_type")).otherwise("  ")
    return table(spark, sf, "events").select("event_id", n.optional_int(given).alias("number"), t.optional_text(text).alias("text"))


@query("nm10_milliseconds", "SELECT event_id, CASE WHEN event_id % 9 > 0 THEN round_even(value * 1000, 0)::BIGINT END AS ms FROM events")
def nm10(spark, sf):
    return table(spark, sf, "events").select("event_id", checks.milliseconds(F.when(F.col("event_id") % 9 > 0, F.col("value")).otherwise(1e300)).alias("ms"))


@query("cf4_runtime_signature", "SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN lower(c_mktsegment) || '/' || c_nationkey END AS signature FROM customer")
def cf4(spark, sf):
    parts = F.concat(F.lit(" "), "c_mktsegment"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_nationkey").cast("string")).otherwise(" ")
    return table(spark, sf, "customer").select("c_custkey", checks.signature(*parts).alias("signature"))


@query("wn20_float_overlaps", f"""WITH {IV}, d AS (SELECT rec, ix, (ix - 1) AS _, start / 1e6 AS a, "end" / 1e6 AS b, (row_number() OVER (PARTITION BY rec ORDER BY ix) - 1) * 1e-9::DOUBLE AS i FROM iv),
s AS (SELECT *, i + max(greatest(b, a + 1e-9::DOUBLE) - i) OVER (PARTITION BY rec ORDER BY ix ROWS UNBOUNDED PRECEDING) AS stop FROM d)
SELECT rec, ix, round(greatest(a, coalesce(lag(stop) OVER (PARTITION BY rec ORDER BY ix), 0)), 6) AS start, round(stop, 6) AS "end" FROM s""")
def wn20(spark, sf):
    made = checks.remove_float_overlaps(words_of(spark, sf).select("rec", "ix", "start", "end"))
    return made.select("rec", "ix", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


_PARTS = "(length(line) // 30 + 1)"


@query("wn24_text_parts", rf"""WITH {LN}, w AS (SELECT rec, ix, {_PARTS} AS m, list_filter(regexp_split_to_array(line, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM ln), c AS (SELECT *, array_to_string(w, '') AS c, range(m) AS k FROM w)
SELECT rec, ix, CASE WHEN len(w) >= m THEN list_transform(k, lambda i: array_to_string(w[(i * len(w)) // m + 1:((i + 1) * len(w)) // m], ' ')) WHEN length(c) >= m THEN list_transform(k, lambda i: substr(c, (i * length(c)) // m + 1, ((i + 1) * length(c)) // m - (i * length(c)) // m)) END AS parts FROM c""")
def wn24(spark, sf):
    parts = F.expr("cast(length(line) div 30 + 1 as int)")
    return lines(spark, sf).select("rec", "ix", checks.proportional_parts(F.col("line"), parts).alias("parts"))


#: Lines of one or several words; some are long vocalisations with short ones behind them.
_VOCAL = f"""{IV}, v AS (SELECT rec, ix, ix * 10.0::DOUBLE AS start, ix * 10.0::DOUBLE + CASE WHEN ix % 5 = 1 THEN 9.99::DOUBLE WHEN ix % 5 IN (2, 3) THEN 0.04::DOUBLE ELSE 3.0::DOUBLE END AS "end",
 CASE WHEN ix % 5 = 1 THEN 'а-а-а' WHEN ix % 5 IN (2, 3) THEN 'о-о-о-' || text || CASE WHEN ix % 2 = 0 THEN '-' ELSE '' END ELSE text END AS text, CASE WHEN event_id % 9 = 0 THEN 2 ELSE 1 END AS n_words FROM iv),
g AS (SELECT rec, ix, CASE WHEN ix % 5 = 2 THEN start - 0.005::DOUBLE WHEN ix % 5 = 3 THEN start - 9.96::DOUBLE ELSE start END AS start, CASE WHEN ix % 5 = 2 THEN "end" - 0.005::DOUBLE WHEN ix % 5 = 3 THEN "end" - 9.96::DOUBLE ELSE "end" END AS "end", text, n_words FROM v)"""


@query("wn17_vocalisations", f"""WITH {_VOCAL}, s AS (SELECT *, n_words = 1 AND length(text) - length(replace(text, '-', '')) >= 2 AS one, lag("end") OVER (PARTITION BY rec ORDER BY ix) AS p FROM g),
f AS (SELECT *, coalesce(one AND "end" - start <= 0.05 AND start - p <= 0.05, false) AS follows, one AND "end" - start > 7 AS heads FROM s),
r AS (SELECT *, sum((NOT follows)::INT) OVER (PARTITION BY rec ORDER BY ix ROWS UNBOUNDED PRECEDING) AS run FROM f),
w AS (SELECT *, row_number() OVER (PARTITION BY rec, run ORDER BY ix) AS k, count(*) OVER (PARTITION BY rec, run) AS n, first(heads) OVER (PARTITION BY rec, run ORDER BY ix) AS led FROM r),
x AS (SELECT *, greatest(1, length(text) + CASE WHEN k = n OR text LIKE '%-' THEN 0 ELSE 1 END) AS wt FROM w),
y AS (SELECT *, coalesce(sum(wt) OVER (PARTITION BY rec, run ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c, sum(wt) OVER (PARTITION BY rec, run) AS t, min(start) OVER (PARTITION BY rec, run) AS a, last("end") OVER (PARTITION BY rec, run ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b FROM x)
SELECT rec, ix, text, led AND n > 1 AS retimed, round(CASE WHEN led AND n > 1 THEN a + (b - a) * c / t ELSE start END, 6) AS start, round(CASE WHEN led AND n > 1 AND k < n THEN a + (b - a) * (c + wt) / t ELSE "end" END, 6) AS "end" FROM y""")
def wn17(spark, sf):
    i, late = F.col("ix"), F.col("ix") % 5
    begin = i * 10.0 - F.when(late == 2, 0.005).when(late == 3, 9.96).otherwise(0.0)
    text = F.when(late == 1, "а-а-а").when(late.isin(2, 3), F.concat(F.lit("о-о-о-"), "text", F.when(i % 2 == 0, "-").otherwise(""))).otherwise(F.col("text"))
    rows = intervals(spark, sf).select("rec", "ix", begin.alias("start"), (begin + F.when(late == 1, 9.99).when(late.isin(2, 3), 0.04).otherwise(3.0)).alias("end"), text.alias("text"), F.when(F.col("event_id") % 9 == 0, 2).otherwise(1).alias("n_words"))
    made = reconcile.retime_vocalisations(rows, 7.0)
    return made.select("rec", "ix", "text", "retimed", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


#: Segments of lines: words half a second each, in some of them one or two far ahead of the rest and unsure.
def line_segments(spark, sf):
    apart, at = F.col("ix") % 4, F.col("ix") * 1000.0  # 1 and 2: so many words stand ahead
    ahead = apart.isin(1, 2)
    ordered = lines(spark, sf).sortWithinPartitions("rec", "ix")  # while they are lines, so that what goes by recording needn't sort their words
    rows = ordered.withColumns({"_w": F.array_remove(F.split("line", r"\s+"), ""), "_at": at, "_lead": F.when(ahead, apart).otherwise(0).cast("int"), "_gap": F.when(ahead, 5.0).otherwise(0.0)})
    begin = lambda i: F.col("_at") + i * 0.5 + F.when(i < F.col("_lead"), 0.0).otherwise(F.col("_gap"))
    made = F.transform("_w", lambda w, i: F.struct(begin(i).alias("start"), (begin(i) + 0.45).alias("end"), w.alias("text"), F.when(i < F.col("_lead"), 0.25).otherwise(0.5 + (i % 5) / 8).alias("probability")))
    return rows.select("rec", F.col("ix").alias("seg"), F.col("_at").alias("start"), (F.col("_at") + F.size("_w") * 0.5 + 6).alias("end"), F.col("line").alias("text"), made.alias("words"))


_TIDY = rf"regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]', '', 'g')"
_ISLAND = rf"""{LN}, w AS (SELECT rec, ix AS seg, line, ix % 4 AS a, list_filter(regexp_split_to_array(line, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM ln),
p AS (SELECT *, list_transform(range(len(w)), lambda i: CASE WHEN i < a AND a < 3 THEN 0.25 ELSE 0.5 + (i % 5) / 8 END) AS p, list_transform(range(len(w)), lambda i: i * 0.5 + CASE WHEN NOT (i < a AND a < 3) AND a IN (1, 2) THEN 5.0 ELSE 0.0 END) AS s FROM w),
c AS (SELECT *, unnest([1, 2]) AS n FROM p)"""


@query("pf22_leading_island", f"""WITH {_ISLAND}, h AS (SELECT rec, seg, n FROM c WHERE len(w) >= n + 4 AND s[n + 1] - s[n] - 0.45 >= 3 AND length(array_to_string(w[1:n], ' ')) <= 12 AND NOT regexp_matches(w[n], '[.!?…]["''»”’)]*$')
 AND list_avg(p[1:n]) + 0.05 < list_avg(p[n + 1:n + 4])) SELECT p.rec, p.seg, min(n) AS size FROM p LEFT JOIN h ON h.rec = p.rec AND h.seg = p.seg GROUP BY 1, 2""")
def pf22(spark, sf):
    size = reconcile.island_size(F.col("words"), F.col("start"), F.col("text"))
    return line_segments(spark, sf).select("rec", "seg", size.cast("long").alias("size"))


def mixed_segments(spark, sf):
    """Segments of every kind: text with words that say the same, other words, no words, no text, words out of order."""
    kind = F.col("seg") % 7
    words = F.when(kind == 1, F.reverse("words")).when(kind == 3, F.slice("words", 1, 0)).when(kind == 5, F.transform("words", lambda w: w.withField("text", F.md5(w["text"].cast("binary"))))).otherwise(F.col("words"))
    return line_segments(spark, sf).withColumns({"words": words, "text": F.when(kind == 2, "").otherwise(F.col("text"))})


@query("wn36_prepare_words")
def wn36(spark, sf):
    """Segments of every kind, prepared."""
    return stream.prepare(mixed_segments(spark, sf))


@query("wn31_reconcile")
def wn31(spark, sf):
    """The units of every text with the times of its words, hyphens joined over segments."""
    return stream.reconciled_words(mixed_segments(spark, sf))


@query("st8_alignment_words")
def st8(spark, sf):
    made = reconcile.with_tidy_words(line_segments(spark, sf)).select("rec", "seg", F.posexplode("words").alias("k", "w"))
    return made.select("rec", "seg", "k", "w.*")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("ag21_file_digests")
def ag21(spark, sf):
    """Size and digest of every file of the tables."""
    made = [media.file_fingerprints(spark, f"{sf}/{name}.parquet").select(F.lit(name).alias("table"), "size", "sha256") for name in TABLES]
    return reduce(DataFrame.unionByName, made)
