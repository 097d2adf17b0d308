"""Timed-text files: SRT, WebVTT and ASS texts to cue rows and back, and the checks on them.

A file is one row (``rec``, ``text``); parsing gives one row per block with a null ``start`` where the block is malformed, so that
nothing is lost and a validator can name it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import numbers as n
from cadenza.functions import text as t
from cadenza.operators.intervals import in_order

ASS_HEADER = (
    "[Script Info]\nScriptType: v4.00+\nWrapStyle: 0\nScaledBorderAndShadow: yes\n\n[V4+ Styles]\nFormat: Name, Fontname, Fontsize\nStyle: Default,Arial,48\n\n"
    "[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
)
ASS_FIELDS = ("layer", "start_text", "end_text", "style", "actor", "margin_l", "margin_r", "margin_v", "effect", "event_text")
ASS_PATTERN = r"^(Dialogue|Comment): (\d+),([^,]*),([^,]*),([^,]*),([^,]*),(\d+),(\d+),(\d+),([^,]*),(.*)$"


def _blocks(files: DataFrame, skip: int = 0) -> DataFrame:
    """(rec, ix, lines) of the blocks between blank lines, from block ``skip`` on."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "^\ufeff", ""), r"\r\n?", "\n"), r"^\s+|\s+$", "")
    parts = files.select("rec", F.posexplode(F.split(plain, r"\n[ \t]*\n+")).alias("ix", "block"))
    return parts.where((F.col("ix") >= skip) & (F.col("block") != "")).select("rec", (F.col("ix") - skip).alias("ix"), F.split("block", "\n").alias("lines"))


def _timed(blocks: DataFrame, separator: str, first: Column, number: Column) -> DataFrame:
    """Rows of blocks whose time line is ``lines[first]``."""
    times = F.split(F.get("lines", first), " --> ")
    start, end = (n.parse_clock(F.get(times, F.lit(k)), separator) for k in (0, 1))
    body = F.array_join(F.expr("slice(lines, _first + 2, greatest(size(lines), 1))"), "\n")
    out = blocks.withColumns({"_first": first, "index": number, "tick_start": start, "tick_end": end})
    return out.withColumn("cue_text", body).select("rec", "ix", "index", "tick_start", "tick_end", "cue_text")


def parse_srt(files: DataFrame) -> DataFrame:
    return _timed(_blocks(files), ",", F.lit(1), F.get("lines", F.lit(0)).try_cast("long"))


def parse_vtt(files: DataFrame) -> DataFrame:
    """Blocks after the header; a number before the time line is optional, and the text is unescaped."""
    blocks = _blocks(files, 1)
    named = ~F.get("lines", F.lit(0)).contains("-->")
    number = F.when(named, F.get("lines", F.lit(0)).try_cast("long")).otherwise(F.col("ix") + 1).cast("long")
    return _timed(blocks, ".", F.when(named, 1).otherwise(0), number).withColumn("cue_text", t.vtt_unescape(F.col("cue_text")))


def parse_ass_events(files: DataFrame) -> DataFrame:
    """The eleven fields of every event line."""
    lines = files.select("rec", F.posexplode(F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n")).alias("ix", "line"))
    lines = lines.where(F.col("line").rlike(ASS_PATTERN))
    fields = {name: F.regexp_extract("line", ASS_PATTERN, k + 2) for k, name in enumerate(ASS_FIELDS)}
    return lines.select("rec", "ix", F.regexp_extract("line", ASS_PATTERN, 1).alias("event_type"), *[c.alias(name) for name, c in fields.items()])


def parse_ass(files: DataFrame) -> DataFrame:
    events = parse_ass_events(files).where("event_type = 'Dialogue'")
    number = F.row_number().over(in_order()).cast("long")
    start, end = (n.parse_clock(F.concat(F.lit("0"), F.col(c)), ".", 2) for c in ("start_text", "end_text"))
    return events.select("rec", (number - 1).alias("ix"), number.alias("index"), start.alias("tick_start"), end.alias("tick_end"), t.ass_unescape(F.col("event_text")).alias("cue_text"))


def _whole(rows: DataFrame, piece: Column, head: str, separator: str, foot: str) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("ix", piece.alias("piece"))))
    return rows.groupBy("rec").agg(parts.alias("parts")).select("rec", F.concat(F.lit(head), F.array_join(F.transform("parts", lambda x: x["piece"]), separator), F.lit(foot)).alias("text"))


def render_srt(cues: DataFrame) -> DataFrame:
    """Cues (rec, ix, tick_start, tick_end, cue_text) in milliseconds to files."""
    number = (F.col("ix") + 1).cast("string")
    piece = F.concat(number, F.lit("\n"), n.clock(F.col("tick_start")), F.lit(" --> "), n.clock(F.col("tick_end")), F.lit("\n"), "cue_text")
    return _whole(cues, piece, "", "\n\n", "\n")


def render_vtt(cues: DataFrame) -> DataFrame:
    piece = F.concat(n.clock(F.col("tick_start"), separator="."), F.lit(" --> "), n.clock(F.col("tick_end"), separator="."), F.lit("\n"), t.vtt_escape(F.col("cue_text")))
    return _whole(cues, piece, "WEBVTT\n\n", "\n\n", "\n")


def render_ass(cues: DataFrame) -> DataFrame:
    """Cues in hundredths."""
    piece = F.concat(F.lit("Dialogue: 0,"), n.ass_clock(F.col("tick_start")), F.lit(","), n.ass_clock(F.col("tick_end")), F.lit(",Default,,0,0,0,,"), t.ass_escape(F.col("cue_text")))
    return _whole(cues, piece, ASS_HEADER, "\n", "\n")


RENDERERS = {"srt": render_srt, "vtt": render_vtt, "ass": render_ass}
PARSERS = {"srt": parse_srt, "vtt": parse_vtt, "ass": parse_ass}


def render(cues: DataFrame, fmt: str) -> DataFrame:
    return RENDERERS[fmt](cues)


def violations(cues: DataFrame, width: int = 42, gap: int = 8, max_lines: int = 2, max_cps: float = 17.0, per_second: int = 1000) -> DataFrame:
    """One row per cue and rule that it breaks; a cue whose markup or escapes can't be read has no text."""
    w = in_order()
    lines = F.split("cue_text", "\n")
    seconds = (F.col("tick_end") - F.col("tick_start")) / per_second
    cps = t.visible_length(F.col("cue_text")) / seconds
    rules = {
        "numbering": F.col("index").isNull() | (F.col("index") != F.row_number().over(w)),
        "interval": F.col("tick_start").isNull() | F.col("tick_end").isNull() | (F.col("tick_end") <= F.col("tick_start")),
        "lines": (F.size(lines) > max_lines) | F.exists(lines, lambda x: ~x.rlike(r"\S")),
        "text": F.col("cue_text").isNull(),
        "width": F.exists(lines, lambda x: F.length(x) > width + gap),
        "overlap": F.col("tick_start") < F.lag("tick_end").over(w),
        "speed": (seconds > 0) & (cps > max_cps) & ~n.close(cps, F.lit(max_cps)),
    }
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return cues.withColumn("_broken", broken).select("rec", "ix", F.explode("_broken").alias("rule"))


def is_structural(cues: DataFrame) -> DataFrame:
    """Per recording: are all intervals positive and in order."""
    ok = (F.col("tick_end") > F.col("tick_start")) & (F.col("tick_start") >= F.coalesce(F.lag("tick_end").over(Window.partitionBy("rec").orderBy("ix")), F.lit(0)))
    return cues.withColumn("_ok", F.coalesce(ok, F.lit(False))).groupBy("rec").agg(F.bool_and("_ok").alias("structural"))
