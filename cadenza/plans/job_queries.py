"""Queries on job logs, caches, paths, probes and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import text as t
from cadenza.operators import cachematch, joblog
from cadenza.plans.base import CT, EV, IT, job_events, query, table
from cadenza.sources import media


def _items(spark, sf):
    return joblog.latest(job_events(spark, sf), ["job", "path"]).select("job", "path", "state")


def _status(spark, sf):
    return joblog.job_status(joblog.item_counts(_items(spark, sf)))


@query("jn4_event_upsert", f"WITH {IT} SELECT * FROM it")
def jn4(spark, sf):
    return _items(spark, sf)


@query("jn4_merge_events", f"WITH {EV}, b AS (SELECT DISTINCT conv_id AS k FROM conversations WHERE conv_id % 2 = 0), l AS (SELECT job AS k, arg_max(state, event_id) AS state FROM ev GROUP BY job) SELECT k, coalesce(l.state, 'queued') AS state FROM b FULL OUTER JOIN l USING (k)")
def jn4_merge(spark, sf):
    base = table(spark, sf, "conversations").where("conv_id % 2 = 0").select(F.col("conv_id").alias("k"), F.lit("queued").alias("state")).distinct()
    return joblog.merge_events(base, job_events(spark, sf).select(F.col("job").alias("k"), "event_id", "state"), "k", ["state"])


@query("ag1_item_counts", f"WITH {CT} SELECT * FROM ct")
def ag1(spark, sf):
    return joblog.item_counts(_items(spark, sf))


@query("ag2_declared_total", f"WITH {CT} SELECT job, greatest(total, job % 5) AS total, done FROM ct")
def ag2(spark, sf):
    return joblog.item_counts(_items(spark, sf), F.col("job") % 5).select("job", "total", "done")


@query("ag3_job_status", f"WITH {CT} SELECT * FROM st")
def ag3(spark, sf):
    return _status(spark, sf)


@query("ag5_batch_summary", f"WITH {CT} SELECT count(*) AS n_jobs, count(*) FILTER (status = 'ok') AS n_ok, CASE WHEN count(*) FILTER (status = 'error') > 0 THEN 2 ELSE 0 END AS exit_code FROM st")
def ag5(spark, sf):
    return _status(spark, sf).agg(F.count("*").alias("n_jobs"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.when(F.count_if(F.col("status") == "error") > 0, 2).otherwise(0).alias("exit_code"))


@query("ag6_state_counts", f"WITH {IT} SELECT state, count(*) AS n FROM it GROUP BY state")
def ag6(spark, sf):
    return _items(spark, sf).groupBy("state").agg(F.count("*").alias("n"))


def _jobs(spark, sf):
    ends = job_events(spark, sf).groupBy("job").agg(F.max("at").alias("updated_at"), F.max("event_id").alias("latest_event_id"))
    return _status(spark, sf).select("job", "status").join(ends, "job").withColumn("completed_at", F.col("updated_at")).withColumn("status", F.when(F.col("job") % 10 == 0, "running").otherwise(F.col("status")))


JB = CT + ", jb AS (SELECT st.job, CASE WHEN st.job % 10 = 0 THEN 'running' ELSE status END AS status, e.updated_at, e.latest_event_id, e.updated_at AS completed_at FROM st JOIN (SELECT job, max(pos) AS updated_at, max(event_id) AS latest_event_id FROM ev GROUP BY job) e USING (job))"
_FINAL = "('ok', 'partial', 'error', 'cancelled', 'interrupted')"


@query("so3_newest_jobs", f"WITH {JB} SELECT * FROM jb ORDER BY updated_at DESC, job DESC LIMIT 25")
def so3(spark, sf):
    return joblog.newest_jobs(_jobs(spark, sf), 25)


@query("so4_newest_events", f"WITH {EV} SELECT job, event_id, kind FROM ev QUALIFY row_number() OVER (PARTITION BY job ORDER BY event_id DESC) <= 3")
def so4(spark, sf):
    return joblog.newest_events(job_events(spark, sf), 3).select("job", "event_id", "kind")


@query("so5_beyond_limit", f"WITH {JB} SELECT job, status, updated_at FROM jb WHERE status IN {_FINAL} ORDER BY updated_at, job LIMIT (SELECT greatest(0, count(*) - 16) FROM jb)")
def so5(spark, sf):
    return joblog.beyond_limit(_jobs(spark, sf)).select("job", "status", "updated_at")


@query("so6_expired", f"WITH {JB} SELECT job, completed_at FROM jb WHERE status IN {_FINAL} AND completed_at < 500")
def so6(spark, sf):
    return joblog.expired(_jobs(spark, sf), F.lit(500)).select("job", "completed_at")


@query("so9_page", f"WITH {JB} SELECT job, status FROM jb ORDER BY job LIMIT 200 OFFSET 50")
def so9(spark, sf):
    return _jobs(spark, sf).orderBy("job").offset(50).limit(200).select("job", "status")


@query("so12_current_job", f"WITH {JB} SELECT job, status FROM jb ORDER BY status = 'running' DESC, updated_at DESC, job DESC LIMIT 1")
def so12(spark, sf):
    return _jobs(spark, sf).orderBy((F.col("status") == "running").desc(), F.desc("updated_at"), F.desc("job")).limit(1).select("job", "status")


@query("jn13_anti_retention", f"WITH {EV} SELECT job, event_id FROM ev WHERE (job, event_id) NOT IN (SELECT (job, event_id) FROM ev QUALIFY row_number() OVER (PARTITION BY job ORDER BY event_id DESC) <= 3)")
def jn13(spark, sf):
    events = job_events(spark, sf).select("job", "event_id")
    return events.join(joblog.newest_events(events, 3), ["job", "event_id"], "left_anti")


@query("jn14_cascade", f"WITH {JB} SELECT job, event_id FROM ev WHERE job IN (SELECT job FROM jb WHERE status <> 'error')")
def jn14(spark, sf):
    return joblog.surviving(job_events(spark, sf), _jobs(spark, sf).where("status <> 'error'")).select("job", "event_id")


@query("sc14_point_read", f"WITH {JB} SELECT jb.job, status, list(event_id ORDER BY event_id) AS events FROM jb JOIN ev USING (job) WHERE jb.job < 20 GROUP BY jb.job, status")
def sc14(spark, sf):
    events = job_events(spark, sf).where("job < 20").groupBy("job").agg(F.sort_array(F.collect_list("event_id")).alias("events"))
    return _jobs(spark, sf).where("job < 20").select("job", "status").join(events, "job")


@query("sk9_sse_frames", f"WITH {EV} SELECT job, event_id, 'id: ' || event_id || chr(10) || 'data: ' || '{{\"kind\":\"' || kind || '\"}}' || chr(10) || chr(10) AS frame FROM ev".replace("{{", "{").replace("}}", "}"))
def sk9(spark, sf):
    return job_events(spark, sf).select("job", "event_id", joblog.sse(F.col("event_id"), F.to_json(F.struct("kind"))).alias("frame"))


@query("sm5_replay", f"WITH {EV}, l AS (SELECT * FROM ev WHERE event_id > 1), d AS (SELECT *, coalesce(sum((kind = 'assistant')::INT) OVER (PARTITION BY job ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM l) SELECT job, event_id, kind FROM d WHERE x = 0")
def sm5(spark, sf):
    return joblog.replay(job_events(spark, sf), F.lit(1), "assistant").select("job", "event_id", "kind")


@query("sm7_late_updates", f"WITH {EV}, g AS (SELECT *, event_id // 3 AS generation FROM ev) SELECT job, event_id, generation FROM g QUALIFY generation = max(generation) OVER (PARTITION BY job)")
def sm7(spark, sf):
    return joblog.current_only(job_events(spark, sf).withColumn("generation", F.expr("event_id div 3"))).select("job", "event_id", "generation")


@query("sm9_recover_jobs", f"WITH {JB} SELECT job, CASE WHEN status IN {_FINAL} THEN status ELSE 'interrupted' END AS status FROM jb")
def sm9_jobs(spark, sf):
    return joblog.recover(_jobs(spark, sf), _items(spark, sf), "restart")[0].select("job", "status")


@query("sm9_recover_items", f"WITH {JB} SELECT it.job, path, CASE WHEN jb.status NOT IN {_FINAL} AND state NOT IN ('done', 'cached', 'skipped', 'error', 'cancelled', 'interrupted') THEN 'error' ELSE state END AS state FROM it JOIN jb USING (job)")
def sm9_items(spark, sf):
    return joblog.recover(_jobs(spark, sf), _items(spark, sf), "restart")[1].select("job", "path", "state")


@query("sm9_recover_events", f"WITH {JB} SELECT job, latest_event_id + 1 AS event_id, 'done' AS kind, 'restart' AS text FROM jb WHERE status NOT IN {_FINAL}")
def sm9_events(spark, sf):
    return joblog.recover(_jobs(spark, sf), _items(spark, sf), "restart")[2]


@query("sm11_cancel_rest", f"WITH {IT} SELECT job, path, CASE WHEN state IN ('done', 'cached', 'skipped', 'error', 'cancelled', 'interrupted') THEN state ELSE 'cancelled' END AS state FROM it")
def sm11(spark, sf):
    return joblog.cancel_rest(_items(spark, sf))


@query("sm12_rebuild_state", f"WITH {EV} SELECT job, max(event_id) AS latest_event_id, arg_max(kind, event_id) AS last_kind, count(*) AS n_events FROM ev GROUP BY job")
def sm12(spark, sf):
    return job_events(spark, sf).groupBy("job").agg(F.max("event_id").alias("latest_event_id"), F.max_by("kind", "event_id").alias("last_kind"), F.count("*").alias("n_events"))


@query("sm14_client_view", f"WITH {EV} SELECT job, max(event_id) AS cursor, count(DISTINCT CASE WHEN state IN ('done', 'cached', 'skipped', 'error', 'cancelled', 'interrupted') THEN path END) AS completed, arg_max(kind, event_id) AS last_kind FROM ev GROUP BY job")
def sm14(spark, sf):
    return joblog.client_view(job_events(spark, sf))


@query("pf17_retry_items", f"WITH {IT} SELECT job, path, 'queued' AS state FROM it WHERE state IN ('error', 'cancelled', 'interrupted')")
def pf17(spark, sf):
    return joblog.retry_items(_items(spark, sf))


@query("wn32_monotone", f"WITH {EV} SELECT job, event_id, max(length(text)) OVER (PARTITION BY job ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS progress FROM ev")
def wn32(spark, sf):
    return joblog.monotone(job_events(spark, sf).withColumn("progress", F.length("text")), "progress", ["job"], "event_id").select("job", "event_id", "progress")


_URL = "pg AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages)"


def _paths(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"))


@query("st20_paths", rf"WITH {_URL} SELECT page_id, lower(regexp_extract(path, '\.([^./\\]+)$', 1)) AS extension, regexp_replace(regexp_extract(path, '([^/\\]+)$', 1), '\.[^.]*$', '') AS stem, regexp_replace(path, '\.[^./\\]*$', '') || '.vtt.vtt' AS output FROM pg")
def st20(spark, sf):
    p = F.col("path")
    return _paths(spark, sf).select("page_id", t.extension(p).alias("extension"), t.stem(p).alias("stem"), t.output_name(p, "vtt").alias("output"))


@query("ag22_collisions", r"""WITH p AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/]+)', 1) || '/' || regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) || '/a.' || CASE WHEN page_id % 2 = 0 THEN 'mp4' ELSE 'mkv' END AS path FROM pages),
o AS (SELECT path, regexp_replace(path, '\.[^./\\]*$', '') || '.srt' AS plain FROM p), c AS (SELECT *, count(*) OVER (PARTITION BY lower(plain)) > 1 AS collides FROM o)
SELECT path, CASE WHEN collides THEN regexp_replace(plain, '\.[^./\\]*$', '') || '-' || substr(sha256(lower(path)), 1, 12) || '.srt' ELSE plain END AS output, collides FROM c""")
def ag22(spark, sf):
    part = lambda p: F.regexp_extract("url", p, 1)
    path = F.concat(part("^[a-z]+://([^/]+)"), F.lit("/"), part("^[a-z]+://[^/]+/([^/?#]*)"), F.lit("/a."), F.when(F.col("page_id") % 2 == 0, "mp4").otherwise("mkv"))
    return cachematch.collisions(table(spark, sf, "pages").select(path.alias("path")).distinct())


@query("ag23_common_parent", r"""WITH h AS (SELECT 'root/' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, 'root/' || regexp_replace(url, '^([a-z]+)://([^?#]*).*$', '\2') AS path FROM pages),
s AS (SELECT host, string_split(regexp_replace(path, '/[^/]*$', ''), '/') AS parts FROM h), k AS (SELECT host, parts, unnest(range(1, len(parts) + 1)) AS k FROM s),
f AS (SELECT host, k, count(*) AS n, count(DISTINCT parts[1:k]) AS d, min(parts[1:k]) AS a FROM k GROUP BY host, k), c AS (SELECT host, count(*) AS n FROM s GROUP BY host)
SELECT c.host, coalesce(array_to_string(max_by(a, k) FILTER (d = 1 AND f.n = c.n), '/'), '') AS parent FROM c LEFT JOIN f USING (host) GROUP BY c.host""")
def ag23(spark, sf):
    """The deepest folder that holds all paths of a host."""
    path = F.concat(F.lit("root/"), F.regexp_replace("url", r"^([a-z]+)://([^?#]*).*$", "$2"))
    host = F.concat(F.lit("root/"), F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1))
    return cachematch.common_parent(table(spark, sf, "pages").select(host.alias("host"), path.alias("path")), "host")


_MATCH = """w AS (SELECT o_orderkey AS item, o_custkey % 7 AS recognition, o_custkey % 3 AS layout, 'srt' AS fmt FROM orders),
s AS (SELECT l_orderkey AS item, (l_partkey % 7) AS recognition, l_suppkey % 3 AS layout, CASE WHEN l_linenumber % 2 = 0 THEN 'vtt' ELSE 'srt' END AS fmt FROM lineitem WHERE l_returnflag <> 'R'),
j AS (SELECT w.item, CASE WHEN s.recognition = w.recognition AND s.layout = w.layout AND s.fmt = w.fmt THEN 0 WHEN s.recognition = w.recognition THEN 1 ELSE 3 END AS r FROM w LEFT JOIN s USING (item))"""


@query("jn11_cache_decision", f"WITH {_MATCH} SELECT item, CASE min(r) WHEN 0 THEN 'cached' WHEN 1 THEN 'rebuild' ELSE 'compute' END AS decision FROM j GROUP BY item")
def jn11(spark, sf):
    wanted = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item"), (F.col("o_custkey") % 7).alias("recognition"), (F.col("o_custkey") % 3).alias("layout"), F.lit("srt").alias("fmt"))
    stored = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("item"), (F.col("l_partkey") % 7).alias("recognition"), (F.col("l_suppkey") % 3).alias("layout"), F.when(F.col("l_linenumber") % 2 == 0, "vtt").otherwise("srt").alias("fmt"), F.when(F.col("l_returnflag") != "R", "done").otherwise("failed").alias("status")
    )
    return cachematch.match(wanted, stored)


@query("cf_fingerprints", "SELECT c_custkey, sha256('{\"c_mktsegment\":\"' || c_mktsegment || '\",\"c_nationkey\":' || c_nationkey || '}') AS fingerprint, substr(sha256(c_name), 1, 12) AS short FROM customer")
def cf(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", t.fingerprint(F.col("c_mktsegment"), F.col("c_nationkey")).alias("fingerprint"), F.substring(F.sha2("c_name", 256), 1, 12).alias("short"))


@query("jn10_fingerprint_match", "SELECT a.c_custkey, count(b.c_custkey) AS n_same FROM customer a LEFT JOIN customer b ON sha256(a.c_mktsegment || '/' || a.c_nationkey) = sha256(b.c_mktsegment || '/' || b.c_nationkey) AND a.c_custkey <> b.c_custkey GROUP BY 1")
def jn10(spark, sf):
    """Rows with the same fingerprint, counted by group: no pairs are made."""
    rows = table(spark, sf, "customer").select("c_custkey", t.fingerprint(F.col("c_mktsegment"), F.col("c_nationkey")).alias("f"))
    return rows.join(rows.groupBy("f").count(), "f").select("c_custkey", (F.col("count") - 1).alias("n_same"))


_PROBE = "'{\"streams\":[{\"index\":0,\"codec_type\":\"video\"},{\"index\":1,\"codec_type\":\"audio\",\"sample_rate\":\"48000\",\"channels\":2,\"tags\":{\"language\":\"' || {l} || '\"}},{\"index\":2,\"codec_type\":\"audio\",\"sample_rate\":\"x\",\"duration\":\"' || {d} || '\",\"tags\":{\"language\":\"en\",\"title\":\"English\"}}],\"format\":{\"duration\":\"N/A\"}}'"


def _probes(spark, sf):
    parts = [x.strip("'") for x in _PROBE.replace("{d}", "{l}").split(" || {l} || ")]
    lang = F.when(F.col("c_custkey") % 3 == 0, "en").when(F.col("c_custkey") % 3 == 1, "ru").otherwise("de")
    return table(spark, sf, "customer").select(F.col("c_name").alias("path"), F.concat(F.lit(parts[0]), lang, F.lit(parts[1]), F.col("c_nationkey").cast("string"), F.lit(parts[2])).alias("payload"))


_STREAMS = "c AS (SELECT c_name AS path, CASE c_custkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ru' ELSE 'de' END AS l, c_nationkey AS d FROM customer)"


@query("sc5_probe_streams", f"""WITH {_STREAMS} SELECT path, 0 AS ordinal, 1 AS "index", 48000 AS sample_rate, 2 AS channels, l AS language, NULL AS title, NULL::DOUBLE AS duration FROM c
UNION ALL SELECT path, 1, 2, NULL, NULL, 'en', 'English', d::DOUBLE FROM c""")
def sc5(spark, sf):
    return media.audio_streams(_probes(spark, sf)).drop("codec_name")


@query("sc5_container_duration", f"WITH {_STREAMS} SELECT path, d::DOUBLE AS duration FROM c")
def sc5_duration(spark, sf):
    return media.container_durations(_probes(spark, sf))


@query("so8_choose_stream", f"WITH {_STREAMS} SELECT path, CASE l WHEN 'en' THEN 0 ELSE 1 END AS ordinal, 'en' AS language, CASE l WHEN 'en' THEN NULL ELSE 'English' END AS title, CASE l WHEN 'en' THEN 'several match' END AS warning FROM c")
def so8(spark, sf):
    return media.choose_streams(media.audio_streams(_probes(spark, sf)), ("en", "eng", "english"))


@query("sc1_classify_paths", "SELECT c_name AS path, CASE c_custkey % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'extension' WHEN 2 THEN 'intermediate' ELSE 'empty' END AS verdict FROM customer")
def sc1(spark, sf):
    k = F.col("c_custkey") % 4
    rows = table(spark, sf, "customer").select("c_name", F.concat("c_name", F.when(k == 1, ".txt").when(k == 2, ".ASR.flac").otherwise(".MP3")).alias("path"), F.when(k == 3, 0).otherwise(10).alias("length"))
    return media.classify_paths(rows).select(F.col("c_name").alias("path"), "verdict")


@query("sc4_selection", "SELECT lower(c_mktsegment) AS key, min(c_custkey) AS c_custkey FROM customer GROUP BY 1 ORDER BY 1 LIMIT 10000")
def sc4(spark, sf):
    rows = table(spark, sf, "customer").withColumn("key", F.lower("c_mktsegment"))
    return media.first_of_each(rows, F.col("key"), F.col("c_custkey")).orderBy("key").limit(10000).select("key", "c_custkey")


@query("se3_last_wins", "SELECT c_nationkey, max(c_custkey) AS c_custkey FROM customer GROUP BY 1")
def se3(spark, sf):
    return media.first_of_each(table(spark, sf, "customer"), F.col("c_nationkey"), F.col("c_custkey"), last=True).select("c_nationkey", "c_custkey")


@query("sc15_frames", "SELECT event_id, (props::JSON ->> '$.k')::INT AS k FROM events WHERE event_id % 2 = 0")
def sc15(spark, sf):
    k = F.from_json("props", "k int")["k"]
    line = F.when(F.col("event_id") % 2 == 0, media.encode_frame(F.struct("event_id", k.alias("k")))).otherwise(F.concat(F.lit("log "), "props"))
    return media.frames(table(spark, sf, "events").select(line.alias("line")), "event_id long, k int").select("frame.*")


@query("jn1_failures", "SELECT c_custkey, c_name, min(s_suppkey) AS first_failure, count(s_suppkey) AS n_failures FROM customer LEFT JOIN supplier ON lower(replace(s_name, 'Supplier', 'customer')) = lower(c_name) GROUP BY 1, 2")
def jn1(spark, sf):
    """Failures to items by the folded path: names that differ in case meet."""
    failures = table(spark, sf, "supplier").select("s_suppkey", F.lower(F.regexp_replace("s_name", "Supplier", "customer")).alias("key"))
    joined = table(spark, sf, "customer").select("c_custkey", "c_name", F.lower("c_name").alias("key")).join(failures, "key", "left")
    return joined.groupBy("c_custkey", "c_name").agg(F.min("s_suppkey").alias("first_failure"), F.count("s_suppkey").alias("n_failures"))


@query("jn2_initial_items", "SELECT c_custkey, coalesce(o.k, -1) AS first_order, CASE WHEN o.k IS NULL THEN 'queued' ELSE o.s END AS state FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS k, arg_min(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def jn2(spark, sf):
    given = media.first_of_each(table(spark, sf, "orders"), F.col("o_custkey"), F.col("o_orderkey")).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return table(spark, sf, "customer").select("c_custkey").join(given, "c_custkey", "left").select("c_custkey", F.coalesce("o_orderkey", F.lit(-1)).alias("first_order"), F.coalesce("o_orderstatus", F.lit("queued")).alias("state"))


@query("jn15_missing_bytes", "SELECT o_orderpriority, count(*) FILTER (c_custkey IS NULL OR c_acctbal < 0) AS n_missing, sum(CASE WHEN c_custkey IS NULL OR c_acctbal < 0 THEN o_orderkey ELSE 0 END)::BIGINT AS bytes FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def jn15(spark, sf):
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"), "left")
    missing = F.col("c_custkey").isNull() | (F.col("c_acctbal") < 0)
    return joined.groupBy("o_orderpriority").agg(F.count_if(missing).alias("n_missing"), F.sum(F.when(missing, F.col("o_orderkey")).otherwise(0)).alias("bytes"))


@query("jn16_alias_lookup", "SELECT lang, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' END AS name, count(*) AS n FROM documents GROUP BY 1, 2")
def jn16(spark, sf):
    names = F.create_map(*[F.lit(x) for x in ("en", "English", "de", "German", "fr", "French", "es", "Spanish")])
    return table(spark, sf, "documents").groupBy("lang", names[F.col("lang")].alias("name")).agg(F.count("*").alias("n"))


@query("se1_union_sorted", "SELECT 'customer' AS kind, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_name FROM supplier")
def se1(spark, sf):
    a = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"))
    return a.unionByName(table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"))).orderBy(F.lower("name"))


@query("se4_difference", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def se4(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("ag19_distinct_sum", "SELECT l_orderkey, sum(l_quantity) AS quantity FROM (SELECT DISTINCT l_orderkey, l_partkey, l_quantity FROM lineitem) GROUP BY 1")
def ag19(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").distinct()
    return rows.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"))


@query("ag24_real_time_factor", "SELECT o_orderkey, o_totalprice / greatest(1, o_custkey) AS rtf FROM orders")
def ag24(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / F.greatest(F.lit(1), F.col("o_custkey"))).alias("rtf"))


@query("ag25_transcripts", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text, bool_or(length(text) > 0) AS any_text, count(*) AS n_segments FROM conversations GROUP BY conv_id")
def ag25(spark, sf):
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"), F.bool_or(F.length("text") > 0).alias("any_text"), F.count("*").alias("n_segments"))
