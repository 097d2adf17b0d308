"""Queries on texts, numbers, formats and quality metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions import numbers as n
from cadenza.functions import text as t
from cadenza.operators import layout, reconcile
from cadenza.operators.intervals import in_order
from cadenza.operators.tally import token_counts
from cadenza.plans.base import CU, LN, cues, lines, query, table, texts
from cadenza.sources import subtitles as s

TOK = r"[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*"


@query("st_line_scalars", rf"""WITH {LN} SELECT rec, ix, length(line) AS n_chars, regexp_replace(replace(replace(lower(line), 'ß', 'ss'), 'ё', 'е'), '[^\p{{L}}\p{{N}}]', '', 'g') AS compact,
 trim(regexp_replace(line, '[\s\x{{00A0}}]+', ' ', 'g')) AS clean, regexp_matches(line, '[.!?…]["''»”’)]*$') AS sentence_end, length(line) - length(replace(line, '-', '')) >= 2 AS vocalisation,
 right(line, 20) AS tail, regexp_replace(lower(line), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') AS bare FROM ln""")
def st_lines(spark, sf):
    c = F.col("line")
    return lines(spark, sf).select("rec", "ix", F.length(c).alias("n_chars"), t.compact(c).alias("compact"), t.collapse_space(c).alias("clean"), t.ends_sentence(c).alias("sentence_end"), t.is_vocalisation(c).alias("vocalisation"), t.tail(c, 20).alias("tail"), t.bare_token(c).alias("bare"))


@query("st_text_lengths", r"SELECT doc_id, length(regexp_replace(text, '\r\n|[\n\r]', ' ', 'g')) AS visible, length(array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(x)), ' ')) AS stripped FROM documents")
def st_lengths(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.visible_length(F.col("text")).alias("visible"), t.stripped_visible_length(F.col("text")).alias("stripped"))


_GRAMS = rf"tk AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOK}') AS w FROM documents), gr AS (SELECT doc_id, len(w) AS n_tokens, list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], chr(31))) AS g FROM tk)"


@query("ag14_repeated_ngrams", f"WITH {_GRAMS} SELECT doc_id, n_tokens, len(g) - len(list_distinct(g)) AS repeated_5grams FROM gr")
def ag14(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", t.tokens(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").alias("n_tokens"), t.repeated_ngrams(F.col("w"), 5).alias("repeated_5grams"))


@query("st4_tokens", rf"SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TOK}')) AS token, count(*) AS n FROM documents GROUP BY 1, 2")
def st4(spark, sf):
    return token_counts(table(spark, sf, "documents"))


AG15_SQL = f"""WITH {CU}, {_GRAMS}, pv AS (SELECT *, lag(tick_end) OVER (PARTITION BY rec ORDER BY ix) AS prev, tick_end - tick_start AS d FROM cu),
ag AS (SELECT rec, count(*) AS cue_count, count(*) FILTER (tick_start < prev) AS overlap_count, count(*) FILTER (length(trim(cue_text)) * 1000 > 17 * d) AS reading_speed_violations,
 count(*) FILTER (d < 800) AS short_cue_count, count(*) FILTER (d > 7000) AS long_cue_count, count(*) FILTER (length(cue_text) > 50) AS long_line_count, count(*) FILTER (tick_start >= 300000) AS cues_after_300_seconds,
 max(tick_end) AS last_end, sum(d)::BIGINT AS covered FROM pv GROUP BY rec)
SELECT ag.rec AS doc_id, cue_count, overlap_count, reading_speed_violations, short_cue_count, long_cue_count, long_line_count, cues_after_300_seconds, n_tokens, len(g) - len(list_distinct(g)) AS repeated_5gram_occurrences,
 last_end / 1000 AS last_cue_end_seconds, covered / (last_end + 2000) AS speech_coverage_ratio, 2.0::DOUBLE AS tail_gap_seconds FROM ag JOIN gr ON gr.doc_id = ag.rec"""


@query("ag15_quality_report", AG15_SQL)
def ag15(spark, sf):
    """Structural report per document: cues from its lines, repeats from its words; the recording lasts two seconds longer than the cues."""
    w, d = in_order(), F.col("tick_end") - F.col("tick_start")
    rows = cues(spark, sf).withColumns({"_prev": F.lag("tick_end").over(w), "_d": d})
    report = rows.groupBy("rec").agg(
        F.count("*").alias("cue_count"), F.count_if(F.col("tick_start") < F.col("_prev")).alias("overlap_count"), F.count_if(t.stripped_visible_length(F.col("cue_text")) * 1000 > 17 * F.col("_d")).alias("reading_speed_violations"),
        F.count_if(F.col("_d") < 800).alias("short_cue_count"), F.count_if(F.col("_d") > 7000).alias("long_cue_count"), F.count_if(F.length("cue_text") > 50).alias("long_line_count"), F.count_if(F.col("tick_start") >= 300000).alias("cues_after_300_seconds"),
        F.max("tick_end").alias("_last"), F.sum("_d").alias("_covered"),
    )
    report = report.select(F.col("rec").alias("doc_id"), *[c for c in report.columns if c != "rec" and c[0] != "_"], (F.col("_last") / 1000).alias("last_cue_end_seconds"), (F.col("_covered") / (F.col("_last") + 2000)).alias("speech_coverage_ratio"), F.lit(2.0).alias("tail_gap_seconds"))
    grams = ag14(spark, sf).withColumnRenamed("repeated_5grams", "repeated_5gram_occurrences")
    return report.join(grams, "doc_id")


@query("ag16_presentation", f"WITH {CU}, c AS (SELECT rec, length(cue_text) * 1000.0::DOUBLE / (tick_end - tick_start) AS cps, tick_end - tick_start AS d FROM cu WHERE tick_end > tick_start) SELECT rec, max(cps) AS max_actual_cps, count(*) FILTER (cps > 17 AND abs(cps - 17) > 1e-9 * greatest(cps, 17)) AS speed_exceeded, max(d) AS max_actual_duration_ms, count(*) FILTER (d > 7000) AS duration_exceeded FROM c GROUP BY rec")
def ag16(spark, sf):
    d = F.col("tick_end") - F.col("tick_start")
    rows = cues(spark, sf).where(d > 0).withColumns({"cps": F.length("cue_text") * 1000.0 / d, "d": d})
    fast = (F.col("cps") > 17) & ~n.close(F.col("cps"), F.lit(17.0))
    return rows.groupBy("rec").agg(F.max("cps").alias("max_actual_cps"), F.count_if(fast).alias("speed_exceeded"), F.max("d").alias("max_actual_duration_ms"), F.count_if(F.col("d") > 7000).alias("duration_exceeded"))


_CLOCK = "printf('%02d:%02d:%02d{s}%03d', x // 3600000, x // 60000 % 60, x // 1000 % 60, x % 1000)"


def _clock(col: str, sep: str) -> str:
    return _CLOCK.replace("{s}", sep).replace("x", col)


_SRT = f"sr AS (SELECT rec, string_agg((ix + 1) || chr(10) || {_clock('tick_start', ',')} || ' --> ' || {_clock('tick_end', ',')} || chr(10) || cue_text, chr(10) || chr(10) ORDER BY ix) || chr(10) AS text FROM cu GROUP BY rec)"


@query("sk1_render_srt", f"WITH {CU}, {_SRT} SELECT rec, text FROM sr")
def sk1(spark, sf):
    return s.render_srt(cues(spark, sf))


@query("sk2_render_vtt", f"WITH {CU} SELECT rec, 'WEBVTT' || chr(10) || chr(10) || string_agg({_clock('tick_start', '.')} || ' --> ' || {_clock('tick_end', '.')} || chr(10) || replace(replace(replace(cue_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10) || chr(10) ORDER BY ix) || chr(10) AS text FROM cu GROUP BY rec")
def sk2(spark, sf):
    return s.render_vtt(cues(spark, sf))


_ASSCLOCK = "printf('%d:%02d:%02d.%02d', x // 360000, x // 6000 % 60, x // 100 % 60, x % 100)"
_CS = ", cs AS (SELECT rec, ix, tick_start // 10 AS a, tick_end // 10 AS b, cue_text FROM cu)"


#: Guards doubled, backslashes guarded, braces and line breaks behind backslashes.
_ASSTEXT = "replace(replace(replace(replace(replace(x, chr(8288), chr(8288) || chr(8288)), chr(92), chr(92) || chr(8288)), chr(123), chr(92) || chr(123)), chr(125), chr(92) || chr(125)), chr(10), chr(92) || 'N')"


def _centi(spark, sf):
    return cues(spark, sf).withColumns({"tick_start": F.expr("tick_start div 10"), "tick_end": F.expr("tick_end div 10")})


@query("sk3_render_ass_events", CU.join(["WITH ", _CS]) + f" SELECT rec, ix, 'Dialogue: 0,' || {_ASSCLOCK.replace('x', 'a')} || ',' || {_ASSCLOCK.replace('x', 'b')} || ',Default,,0,0,0,,' || {_ASSTEXT.replace('x', 'cue_text')} AS line FROM cs")
def sk3(spark, sf):
    files = s.render_ass(_centi(spark, sf))
    rows = files.select("rec", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.startswith("line", F.lit("Dialogue: ")))
    return rows.select("rec", (F.row_number().over(Window.partitionBy("rec").orderBy("at")) - 1).cast("long").alias("ix"), "line")


@query("sc10_parse_srt", f'WITH {CU} SELECT rec, ix, ix + 1 AS "index", tick_start, tick_end, cue_text FROM cu')
def sc10(spark, sf):
    """What `sk1_render_srt` wrote, read again: the cues come back."""
    return s.parse_srt(sk1(spark, sf)).withColumn("ix", F.col("ix").cast("long"))


@query("sc11_parse_vtt", f'WITH {CU} SELECT rec, ix, ix + 1 AS "index", tick_start, tick_end, cue_text FROM cu')
def sc11(spark, sf):
    return s.parse_vtt(sk2(spark, sf)).withColumn("ix", F.col("ix").cast("long"))


@query("sc12_parse_ass", "WITH " + CU + _CS + ' SELECT rec, ix, ix + 1 AS "index", a AS tick_start, b AS tick_end, cue_text FROM cs')
def sc12(spark, sf):
    return s.parse_ass(s.render_ass(_centi(spark, sf)))


@query("sc13_ass_fields", "WITH " + CU + _CS + f" SELECT rec, 'Dialogue' AS event_type, '0' AS layer, {_ASSCLOCK.replace('x', 'a')} AS start_text, {_ASSCLOCK.replace('x', 'b')} AS end_text, 'Default' AS style, '0' AS margin_l, '' AS effect FROM cs")
def sc13(spark, sf):
    return s.parse_ass_events(s.render_ass(_centi(spark, sf))).select("rec", "event_type", "layer", "start_text", "end_text", "style", "margin_l", "effect")


@query("pf7_cue_violations", f"""WITH {CU}, pv AS (SELECT *, lag(tick_end) OVER (PARTITION BY rec ORDER BY ix) AS prev, (tick_end - tick_start) / 1000 AS sec FROM cu),
r AS (SELECT rec, ix, unnest(list_filter([CASE WHEN tick_end <= tick_start THEN 'interval' END, CASE WHEN length(cue_text) > 50 THEN 'width' END, CASE WHEN tick_start < prev THEN 'overlap' END,
 CASE WHEN sec > 0 AND length(cue_text) / sec > 17 AND NOT abs(length(cue_text) / sec - 17) <= greatest(1e-9 * greatest(length(cue_text) / sec, 17), 1e-9) THEN 'speed' END], lambda x: x IS NOT NULL)) AS rule FROM pv) SELECT * FROM r""")
def pf7(spark, sf):
    return s.violations(cues(spark, sf).withColumn("index", F.col("ix") + 1))


@query("pf9_structural", f"WITH {CU}, pv AS (SELECT rec, tick_end > tick_start AND tick_start >= coalesce(lag(tick_end) OVER (PARTITION BY rec ORDER BY ix), 0) AS ok FROM cu) SELECT rec, bool_and(ok) AS structural FROM pv GROUP BY rec")
def pf9(spark, sf):
    return s.is_structural(cues(spark, sf))


@query("wn3_sentences", f"""WITH {LN}, fl AS (SELECT *, regexp_matches(line, '[.!?…]["''»”’)]*$')::INT AS c FROM ln), isl AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY rec ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sentence FROM fl)
SELECT rec, sentence, count(*) AS n_lines, string_agg(line, ' ' ORDER BY ix) AS text FROM isl GROUP BY rec, sentence""")
def wn3(spark, sf):
    from cadenza.operators.intervals import islands_after

    rows = islands_after(lines(spark, sf), t.ends_sentence(F.col("line")), "sentence")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ix", "line"))), lambda x: x["line"])
    return rows.groupBy("rec", "sentence").agg(F.count("*").alias("n_lines"), F.array_join(ordered, " ").alias("text"))


@query("wn33_renumber", f"WITH {CU} SELECT rec, ix, row_number() OVER (PARTITION BY rec ORDER BY tick_start DESC, ix) AS number FROM cu")
def wn33(spark, sf):
    return cues(spark, sf).select("rec", "ix", F.row_number().over(Window.partitionBy("rec").orderBy(F.desc("tick_start"), "ix")).cast("long").alias("number"))


@query("nm_ticks_and_clocks", f"WITH v AS (SELECT event_id, value FROM events), x AS (SELECT event_id, value, (floor(value) * 1000 + round_even((value - floor(value)) * 1000, 0))::BIGINT AS ms FROM v) SELECT event_id, ms, {_clock('ms', ',')} AS clock, ms AS parsed, greatest(0.8, value / 17) + 0.002 AS display, 20 + (0.65 * least(100, greatest(0, value)))::DOUBLE >= 40 AS advanced FROM x")
def nm_ticks(spark, sf):
    ms = n.ticks(F.col("value"))
    clock = n.clock(ms)
    return table(spark, sf, "events").select("event_id", ms.alias("ms"), clock.alias("clock"), n.parse_clock(clock).alias("parsed"), n.required_display(F.col("value")).alias("display"), (20 + 0.65 * n.clamp(F.col("value"), 0.0, 100.0) >= 40).alias("advanced"))


@query("nm11_human_bytes", "SELECT o_orderkey, CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576) ELSE printf('%.1f GB', b / 1073741824) END AS size, greatest(1048576, ceil(b * 0.1)::BIGINT) AS reserve FROM (SELECT o_orderkey, floor(o_totalprice * 10000)::DOUBLE AS b FROM orders)")
def nm11(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * 10000).cast("double").alias("b"))
    return rows.select("o_orderkey", n.human_bytes(F.col("b")).alias("size"), n.size_reserve(F.col("b")).alias("reserve"))


@query("nm4_parse_duration", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id // 3600 * 3600.0 + event_id // 60 % 60 * 60 + event_id % 60 WHEN 1 THEN value WHEN 2 THEN (event_id // 7)::DOUBLE WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE NULL END::DOUBLE AS seconds FROM events""")
def nm4(spark, sf):
    """Clocks, numbers, numbers between blanks, N/A, negative numbers and too few parts."""
    e = F.col("event_id")
    part = lambda c: c.cast("long").cast("string")
    clock = F.concat(part(F.floor(e / 3600)), F.lit(":"), part(F.floor(e / 60) % 60), F.lit(":"), part(e % 60))
    shapes = [clock, F.col("value").cast("string"), F.concat(F.lit("  "), part(F.floor(e / 7)), F.lit(" ")), F.lit("N/A"), F.concat(F.lit("-"), part(e)), F.concat(part(e), F.lit(":5"))]
    return table(spark, sf, "events").select("event_id", n.parse_duration(F.get(F.array(*shapes), (e % 6).cast("int"))).alias("seconds"))


@query("st17_vtt_escape", "SELECT event_id, replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, x AS back FROM (SELECT event_id, '<' || event_type || '> & ' || props AS x FROM events)")
def st17(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.concat(F.lit("<"), "event_type", F.lit("> & "), "props").alias("x"))
    return rows.select("event_id", t.vtt_escape(F.col("x")).alias("escaped"), t.vtt_unescape(t.vtt_escape(F.col("x"))).alias("back"))


@query("st21_duration_label", "SELECT event_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS label FROM (SELECT event_id, floor(value * 37 + 0.5)::BIGINT AS s FROM events)")
def st21(spark, sf):
    return table(spark, sf, "events").select("event_id", t.duration_label(F.col("value") * 37).alias("label"))


@query("js1_json_fields", "SELECT event_id, (props::JSON ->> '$.k')::INT AS k, '{\"event_id\":' || event_id || ',\"k\":' || (props::JSON ->> '$.k') || '}' AS encoded FROM events")
def js1(spark, sf):
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf, "events").select("event_id", k.alias("k"), F.to_json(F.struct("event_id", k.alias("k"))).alias("encoded"))


@query("mp_map_defaults", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type ELSE '?' END AS kind, CASE event_id % 5 WHEN 0 THEN 'user ' || user_id ELSE 'none' END AS lang, 2 AS n_keys, (event_id % 3 = 0)::INT + (event_id % 5 = 0)::INT AS n_given FROM events")
def mp(spark, sf):
    """Defaults filled where a known key isn't given, unknown keys dropped; which keys an event gives varies."""
    e = F.col("event_id")
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    given = F.map_from_entries(F.array_compact(F.array(F.when(e % 3 == 0, pair("kind", F.col("event_type"))), F.when(e % 5 == 0, pair("lang", F.concat(F.lit("user "), F.col("user_id").cast("string")))), F.when(e % 2 == 0, pair("junk", F.lit("x"))))))
    known = F.map_filter(given, lambda k, _: k.isin("kind", "lang"))
    defaults = F.map_filter(F.create_map(F.lit("kind"), F.lit("?"), F.lit("lang"), F.lit("none")), lambda k, _: ~F.map_contains_key(known, k))
    both = F.map_concat(defaults, known)
    return table(spark, sf, "events").select("event_id", both["kind"].alias("kind"), both["lang"].alias("lang"), F.size(both).alias("n_keys"), F.size(known).alias("n_given"))


_CLOSERS = r"[.,!?;:%…)\]}»”]"
_JOINED = rf"""WITH {LN}, w AS (SELECT rec, ix, list_filter(regexp_split_to_array(line, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM ln),
a AS (SELECT rec, ix, list_filter(flatten(list_transform(w, lambda x: CASE WHEN regexp_full_match(x, '{_CLOSERS}*') THEN [x] ELSE [regexp_replace(x, '{_CLOSERS}+$', ''), regexp_extract(x, '{_CLOSERS}+$')] END)), lambda x: x <> '') AS w FROM w)
SELECT rec, ix, ltrim(array_to_string(list_transform(w, lambda x: CASE WHEN regexp_full_match(x, '{_CLOSERS}+') THEN x ELSE ' ' || x END), ''), ' ') AS text FROM a"""


@query("ag11_join_words", _JOINED)
def ag11(spark, sf):
    """Every line's words, with the closing marks at their ends as words of their own, joined again."""
    apart = F.regexp_replace("line", rf"(?<=\S)(?<!{_CLOSERS})({_CLOSERS}+)(?=\s|$)", " $1")
    return lines(spark, sf).select("rec", "ix", t.join_words(F.filter(F.split(apart, r"\s+"), lambda x: x != "")).alias("text"))



def _words(spark, sf):
    """Lines' words as timed words: half a second each."""
    rows = texts(spark, sf).select("rec", F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("ix", "text"))
    rows = rows.withColumns({"ix": F.col("ix").cast("long"), "start": F.col("ix") * 0.5, "end": F.col("ix") * 0.5 + 0.45})
    from cadenza.operators.intervals import islands_after

    return islands_after(rows, t.ends_sentence(F.col("text")), "sentence").select("rec", "sentence", "ix", "start", "end", "text")


@query("wn26_pack_lines")
def wn26(spark, sf):
    return layout.pack_lines(_words(spark, sf))


@query("wn27_group_cues")
def wn27(spark, sf):
    return layout.group_cues(wn26(spark, sf))


@query("wn25_greedy_groups")
def wn25(spark, sf):
    return layout.greedy_groups(_words(spark, sf).drop("sentence"), 180.0).groupBy("rec", "group").agg(F.count("*").alias("n_words"), F.min("start").alias("start"), F.max("end").alias("end"))


@query("wn9_boundary_repeats")
def wn9(spark, sf):
    """Every twentieth word comes twice, as where two windows overlap; the second is dropped."""
    words = _words(spark, sf).drop("sentence")
    twice = words.unionByName(words.where("ix % 20 = 19").withColumn("start", F.col("start") + 0.1)).withColumn("ix", F.col("ix") * 2 + (F.col("start") * 2 != F.floor(F.col("start") * 2)).cast("long"))
    return layout.drop_boundary_repeats(twice)


@query("wn11_fill_and_sweep")
def wn11(spark, sf):
    words = _words(spark, sf).drop("sentence")
    return layout.fill_and_sweep(words.withColumns({"start": F.when(F.col("ix") % 9 != 4, F.col("start")), "end": F.when(F.col("ix") % 11 != 7, F.col("end"))}))


@query("st7_display_units")
def st7(spark, sf):
    return lines(spark, sf).select("rec", "ix", reconcile.display_units_of("line").alias("units"))


@query("st9_split_embedded", rf"""WITH {LN} SELECT rec, ix, regexp_replace(line, '([.!?…]["''»”’)]*)([A-ZА-ЯЁ«“"(\[])', '\1 \2', 'g') AS text FROM ln""")
def st9(spark, sf):
    return lines(spark, sf).select("rec", "ix", t.split_embedded_sentences(F.col("line")).alias("text"))


@query("st18_ass_escape", f"""WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN chr(92) || event_type || chr(92) || 'N' || chr(8288) WHEN 2 THEN event_type || chr(10) || chr(8288) || chr(92) || chr(92) || props ELSE event_type END AS x FROM events)
SELECT event_id, {_ASSTEXT} AS escaped, x AS back, CASE WHEN event_id % 4 = 3 THEN x END AS raw FROM x""")
def st18(spark, sf):
    """Texts with every mark that is escaped, escaped and read back; unescaped, those that aren't escapes give null."""
    x = F.get(F.array(F.col("props"), F.concat(F.lit("\\"), "event_type", F.lit("\\N" + t.GUARD)), F.concat("event_type", F.lit("\n" + t.GUARD + "\\\\"), "props"), F.col("event_type")), (F.col("event_id") % 4).cast("int"))
    rows = table(spark, sf, "events").select("event_id", x.alias("x"))
    escaped = t.ass_escape(F.col("x"))
    return rows.select("event_id", escaped.alias("escaped"), t.ass_unescape(escaped).alias("back"), t.ass_unescape(F.col("x")).alias("raw"))


@query("ud3_similarity")
def ud3(spark, sf):
    """Each line against the next: similar ones could share their timing."""
    rows = lines(spark, sf).withColumn("following", F.lead("line").over(in_order())).where("following is not null")
    return rows.select("rec", "ix", layout.alignment("line", "following").alias("found")).select("rec", "ix", "found.ratio", "found.anchors")




@query("ag7_language", "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) SELECT source, first(lang ORDER BY n DESC, lang) AS main, string_agg(lang, ',' ORDER BY lang) AS langs FROM c GROUP BY source")
def ag7(spark, sf):
    """Most frequent language, the first by name on a tie, and all of them in order."""
    counts = table(spark, sf, "documents").groupBy("source", "lang").count()
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "lang")))
    return counts.groupBy("source").agg(ranked[0]["lang"].alias("main"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))
