"""Operators on literal inputs."""

from datetime import datetime

from pyspark.sql import functions as F

from cadenza.functions import numbers, text
from cadenza.operators import intervals, layout
from cadenza.sources import subtitles
from cadenza.streaming import joblog as stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_ticks_round_half_to_even(spark):
    found = [one(spark, numbers.ticks(F.lit(x))) for x in (0.0005, 0.0015, 1.2344, 2.9996)]
    assert found == [0, 2, 1234, 3000]


def test_clock_round_trip(spark):
    clock = one(spark, numbers.clock(F.lit(360_000_123).cast("long")))
    assert clock == "100:00:00,123"
    assert one(spark, numbers.parse_clock(F.lit(clock))) == 360_000_123
    assert one(spark, numbers.parse_clock(F.lit("0:61:00,000"))) is None


def test_human_bytes_round_as_printf(spark):
    sizes = [256.0, 768.0, 1280.0, 1792.0, 1024.0 * 99.75, 0.25, 0.75, 0.35, 2.45, 999.95, 1023.96, 1048576 * 7.25, 1048576 * 7.35, 2.0**30 * 5.75, 0.25 + 2**-54, 0.05, 0.95, 0.0]
    found = spark.createDataFrame([(x,) for x in sizes], "n double").select("n", numbers.human_bytes(F.col("n")).alias("size")).collect()
    steps = lambda x: next((x / 1024**k, u) for k, u in enumerate(("B", "KB", "MB", "GB")) if x < 1024 ** (k + 1))
    assert [r.size for r in found] == ["%.1f %s" % steps(r.n) for r in found]


def test_repeated_ngrams(spark):
    words = F.split(F.lit("a b c a b c a b"), " ")
    assert one(spark, text.repeated_ngrams(words, 3)) == 3
    assert one(spark, text.repeated_ngrams(words, 9)) == 0


def test_vtt_escape_is_strict(spark):
    assert one(spark, text.vtt_unescape(text.vtt_escape(F.lit("a <b> & c")))) == "a <b> & c"
    assert one(spark, text.vtt_unescape(F.lit("a &nbsp; b"))) is None


def test_windows_suppress_a_tail_of_overlap(spark):
    rows = intervals.plan_windows(spark.createDataFrame([(1, 1.9), (2, 1.0), (3, 0.5)], "rec long, length double"), "length", 1.0, 0.2)
    found = [(r.rec, round(r.offset, 3), round(r.duration, 3), r.is_final) for r in rows.orderBy("rec", "k").collect()]
    assert found == [(1, 0.0, 1.0, False), (1, 0.8, 1.0, False), (1, 1.6, 0.3, True), (2, 0.0, 1.0, True), (3, 0.0, 0.5, True)]


def test_clamp_keeps_the_running_end(spark):
    df = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 3, 4), (1, 2, 4, 9), (1, 3, 9, 9)], "rec long, ix long, start long, end long")
    assert [(r.ix, r.start, r.end) for r in intervals.clamp_overlaps(df).orderBy("ix").collect()] == [(0, 0, 5), (2, 5, 9)]


def test_quantise_matches_a_sequential_sweep(spark):
    import random

    rng = random.Random(3)
    raw = [(r, i, rng.randrange(50), rng.randrange(50)) for r in range(20) for i in range(15)]
    df = spark.createDataFrame(raw, "rec long, ix long, start long, end long")
    found = {(r.rec, r.ix): (r.tick_start, r.tick_end) for r in intervals.quantise(df, F.col("start"), F.col("end")).collect()}
    for rec in range(20):
        last = 0
        for _, ix, a, b in raw[rec * 15 : rec * 15 + 15]:
            start = max(a, last, 0)
            last = max(b, start + 1)
            assert found[rec, ix] == (start, last)


def test_display_units():
    assert layout.display_units("« Да - сказал он , и ушёл") == ["«Да", "— сказал", "он,", "и", "ушёл"]
    assert layout.display_units("кто -то пришёл !") == ["кто-то", "пришёл!"]
    assert layout.display_units("") == []


def test_line_breaks_prefer_few_even_lines():
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    cuts = layout.line_breaks(words, 30, 5)
    lines = [" ".join(words[a:b]) for a, b in zip([0, *cuts], cuts)]
    assert " ".join(lines) == " ".join(words) and len(lines) == 2 and max(map(len, lines)) <= 35


def test_layout_is_lossless_and_ordered(spark):
    words = [(1, k // 9, k, k * 0.4, k * 0.4 + 0.3, f"word{k}" + ("." if k % 9 == 8 else "")) for k in range(60)]
    df = spark.createDataFrame(words, "rec long, sentence long, ix long, start double, end double, text string")
    cues = layout.group_cues(layout.pack_lines(df)).orderBy("ix").collect()
    assert " ".join(" ".join(c.cue_text.split()) for c in cues) == " ".join(w[5] for w in words)
    assert all(1 <= len(c.cue_text.split("\n")) <= 2 for c in cues)
    assert all(a.end <= b.start for a, b in zip(cues, cues[1:]))


def test_boundary_repeats_are_dropped(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 1.0, "so"), (1, 1, 0.5, 1.2, "So"), (1, 2, 0.9, 1.5, "it")], "rec long, ix long, start double, end double, text string")
    assert [(r.text, r.start) for r in layout.drop_boundary_repeats(df).orderBy("ix").collect()] == [("so", 0.0), ("it", 1.0)]


def test_malformed_blocks_are_kept(spark):
    files = spark.createDataFrame([(1, "1\n00:00:01,000 --> 00:00:02,000\nhi\n\nx\nbad\ntext\n")], "rec long, text string")
    cues = subtitles.parse_srt(files)
    assert [(r["index"], r.tick_start) for r in cues.orderBy("ix").collect()] == [(1, 1000), (None, None)]
    assert {r.rule for r in subtitles.violations(cues).where("ix = 1").collect()} >= {"numbering", "interval"}


def test_stream_numbers_and_closes_jobs(spark, tmp_path):
    at = datetime(2024, 1, 1)
    events = [(1, k, kind, f"p{k % 2}", state, at) for k, (kind, state) in enumerate([("file", "queued"), ("file", "done"), ("done", "done"), ("file", "done")])]
    df = spark.createDataFrame(events, "job long, at long, kind string, path string, state string, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = stream.fold(source).writeStream.format("memory").queryName("folded").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    found = [(r.event_id, r.kind, r.finished, r.closed) for r in spark.table("folded").orderBy("event_id").collect()]
    assert found == [(1, "file", 0, False), (2, "file", 1, False), (3, "done", 2, True)]
