"""Text and timed words brought together, against plain versions written from the rules."""

import math
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from cadenza.functions import text as t
from cadenza.operators import layout, reconcile

rng = random.Random(9)
PIECES = ["да", "нет", "что", "-то", "-", "—", ",", ".", "!", "«", "»", "(", ")", '"', "'", "-ка.", "Сло-", "во", "-Ну", "Мир.Да", "е2", "...", '."', "ё"]


def plain_units(tokens):
    """One token at a time, with a list of the marks that wait."""
    units, waiting = [], []
    for token in tokens:
        dash = token in ("-", "—")
        closing = token != "" and set(token) <= set(".,!?;:%…)]}»”\"'’") and (set(token) <= set(".,!?;:%…)]}»”") or bool(set(token) & set(".!?…")))
        opening = token != "" and set(token) <= set("([{«“")
        particle = re.fullmatch(r"-(то|либо|нибудь|ка|таки|де|с)\W*", token, re.I)
        if dash:
            waiting.append("—")
        elif closing and waiting or opening:
            waiting.append(token)
        elif closing and units:
            units[-1] += token
        elif particle and "—" not in waiting:
            if units:
                units[-1] += token
            else:
                units.append(token)
        else:
            word = "— " + token[1:] if token[0] == "-" and len(token) > 1 else token
            front = ""
            for w in waiting:
                front = (front.rstrip(" ") + " " if w == "—" and front else front) + ("— " if w == "—" else w)
            units.append((front + word).rstrip())
            waiting = []
    if waiting:
        front = ""
        for w in waiting:
            front = (front.rstrip(" ") + " " if w == "—" and front else front) + ("— " if w == "—" else w)
        if units:
            units[-1] += " " + front.rstrip()
        else:
            units.append(front.rstrip())
    return units


def test_display_units():
    assert reconcile.display_units(", да") == [",", "да"]
    assert reconcile.display_units("— Да, — сказал он .Привет!Мир « тест »") == ["— Да,", "— сказал", "он.", "Привет!", "Мир", "«тест»"]
    for _ in range(2000):
        tokens = [rng.choice(PIECES) for _ in range(rng.randrange(9))]
        text = " ".join(tokens)
        apart = re.sub(r"([.!?…][\"'»”’)]*)(?=[A-ZА-ЯЁ«“\"(\[])", r"\1 ", text).split()
        assert reconcile.display_units(text) == plain_units(apart), text


def timed(texts, start=0.0):
    out, at = [], start
    for k, text in enumerate(texts):
        out.append({"start": at, "end": at + 0.4, "text": text, "probability": None if k % 5 == 4 else k / 10})
        at += rng.choice([0.4, 0.5, 1.0])
    return out


def test_tidy_words_keep_time_and_text():
    for _ in range(500):
        words = timed([rng.choice(PIECES) for _ in range(rng.randrange(1, 9))])
        made = reconcile.tidy_words(words)
        assert min(w["start"] for w in made) == words[0]["start"] and max(w["end"] for w in made) == words[-1]["end"]
        letters = lambda own: "".join(c for w in own for c in w["text"] if c.isalnum())
        assert letters(made) == letters(words)
    glued = reconcile.tidy_words([{"start": 0.0, "end": 1.0, "text": "При-", "probability": 0.5}, {"start": 1.0, "end": 2.0, "text": "вет", "probability": 0.7}])
    assert glued == [{"start": 0.0, "end": 2.0, "text": "При-вет", "probability": 0.6}]


def plain_reconcile(text, words):
    """Scans over anchors and words instead of look-ups."""
    units = reconcile.display_units(text)
    source, target = "".join(map(reconcile.compact, units)), "".join(reconcile.compact(w["text"]) for w in words)
    points = {(0, 0), (len(source), len(target))}
    for a, b, n in SequenceMatcher(None, source, target, autojunk=False).get_matching_blocks():
        points |= {(a, b), (a + n, b + n)} if n else set()
    points = sorted(points)

    def place(x):
        for (x0, y0), (x1, y1) in zip(points, points[1:]):
            if x <= x1:
                return y1 if x1 == x0 else y0 + (x - x0) / (x1 - x0) * (y1 - y0)
        return points[-1][1]

    spans, at = [], 0
    for w in words:
        n = len(reconcile.compact(w["text"]))
        if n:
            spans.append((at, at + n, w))
        at += n

    def when(y, is_end):
        if not spans:
            return words[-1]["end"] if is_end else words[0]["start"]
        if y <= 0:
            return spans[0][2]["start"]
        if y >= spans[-1][1]:
            return spans[-1][2]["end"]
        for k, (a, b, w) in enumerate(spans):
            if y < b or is_end and math.isclose(y, b):
                if not is_end and math.isclose(y, b) and k + 1 < len(spans):
                    return spans[k + 1][2]["start"]
                return w["start"] + min(1, max(0, (y - a) / (b - a))) * (w["end"] - w["start"])

    out, cursor, last = [], 0, words[0]["start"]
    for unit in units:
        a, cursor = place(cursor), cursor + len(reconcile.compact(unit))
        b = place(cursor)
        last = max(last, when(a, False))
        sure = next((w["probability"] for x, y, w in spans if x <= (a + b) / 2 <= y), None)
        out.append((last, max(last + 0.001, when(b, True)), unit, sure))
    return out


def test_reconcile():
    for _ in range(500):
        tokens = [rng.choice(PIECES) for _ in range(rng.randrange(1, 10))]
        said = [x for x in tokens if rng.random() > 0.2] or ["да"]
        words = timed([x[::-1] if rng.random() < 0.2 else x for x in said])
        found = [(w["start"], w["end"], w["text"], w["probability"]) for w in reconcile.reconcile(" ".join(tokens), words)]
        assert found == plain_reconcile(" ".join(tokens), words)


def test_prepare_takes_three_ways(spark):
    words = [(0.0, 0.4, "да", 0.5), (0.5, 0.9, "нет", 0.6)]
    early = [(0.0, 0.4, "а", 0.1), (5.0, 5.4, "б", 0.9), (5.5, 5.9, "в", 0.9), (6.0, 6.4, "г", 0.9), (6.5, 7.0, "д", 0.9)]
    rows = [(1, 0, 0.0, 2.0, "Да, нет!", words), (1, 1, 2.0, 4.0, "совсем другое", words[::-1]), (1, 2, 0.0, 2.0, "qqqq www", words), (1, 3, 0.0, 2.0, "", words), (1, 4, 0.0, 2.0, None, None), (1, 5, 0.0, 8.0, "а б в г д", early)]
    df = spark.createDataFrame(rows, f"rec long, seg long, start double, end double, text string, words array<{reconcile.WORD}>")
    found = {r.seg: r for r in reconcile.prepare(df).collect()}
    assert [found[k].how for k in range(6)] == ["reconciled", "spread", "spread", "words", "none", "reconciled"]
    assert [w.text for w in found[0].words] == ["Да,", "нет!"] and [found[k].retimed for k in (0, 5)] == [False, True]
    assert [(w.start, w.text) for w in found[5].words][0] == (4.6, "а")


@pytest.mark.parametrize("longest", [0.5, 2.0, 30.0])
def test_split_by_duration(longest):
    for _ in range(300):
        text = "".join(rng.choice("аб -") for _ in range(rng.randrange(1, 30)))
        start = rng.random() * 5
        end = start + rng.random() * 20 + 0.01
        made = reconcile.split_long(start, end, text, None, longest)
        assert made[-1]["end"] == end
        if len(made) > 1:
            assert made[0]["start"] == start and "".join("".join(w["text"].split()) for w in made) == "".join(text.split())
            most = len(" ".join(text.split())) * longest / (end - start)
            assert all(len(w["text"]) <= most + 1e-6 for w in made)
            assert all(a["end"] == b["start"] for a, b in zip(made, made[1:]))
        elif end - start > longest + 1e-9:
            assert made[0]["start"] == pytest.approx(max(0, end - longest))


def test_split_by_capacity(spark):
    fixed = [("a" * 60, ["a" * 60]), ("ab cd-" + "e" * 60, ["ab cd-" + "e" * 60])]  # nothing to cut at: whole
    made = [w for w, _ in fixed] + ["".join(rng.choice("ab -") for _ in range(rng.randrange(1, 80))) for _ in range(300)]
    df = spark.createDataFrame([(k, w) for k, w in enumerate(made)], "k int, w string")
    found = [(r.w, r.parts) for r in df.select("k", "w", layout.split_capacity(F.col("w"), 12).alias("parts")).orderBy("k").collect()]
    assert found[:2] == fixed
    for word, parts in found:
        assert all(len(p) <= 12 for p in parts) or parts == [word.strip()]
        assert "".join("".join(parts).split()) == "".join(word.split())


def test_ass_text_comes_back(spark):
    marks = "\\{}⁠\nN a"
    made = [(k, "".join(rng.choice(marks) for _ in range(rng.randrange(12)))) for k in range(400)]
    df = spark.createDataFrame(made, "id long, x string")
    for r in df.select("x", t.ass_unescape(t.ass_escape(F.col("x"))).alias("back")).collect():
        assert r.back == r.x
    bad = spark.createDataFrame([("{",), ("a\\",), ("⁠",), ("\\n",), ("ok",)], "x string")
    assert [r[0] for r in bad.select(t.ass_unescape(F.col("x"))).collect()] == [None, None, None, None, "ok"]


def test_first_holder_and_interpolation(spark):
    from cadenza.operators import intervals as iv

    spans = sorted((rng.randrange(50), k) for k in range(60))
    held = [(1, k, float(a), float(a + rng.randrange(1, 20))) for k, (a, _) in enumerate(spans)]
    points = [(1, k, rng.randrange(140) / 2) for k in range(200)]
    h, p = spark.createDataFrame(held, "rec long, ix long, start double, end double"), spark.createDataFrame(points, "rec long, k long, at double")
    for closed in (False, True):
        found = {r.k: r.holder for r in iv.first_holder(p, "at", h, closed).collect()}
        assert found == {k: next((i for _, i, a, b in held if a <= x and (x <= b if closed else x < b)), None) for _, k, x in points}
    anchors = sorted({(float(rng.randrange(40)), float(rng.randrange(9))) for _ in range(12)})
    a = spark.createDataFrame([(1, *x) for x in anchors], "rec long, x double, y double")
    for r in iv.interpolated(p, "at", a).collect():
        left, right = [x for x in anchors if x[0] <= r.at], [x for x in anchors if x[0] > r.at]
        want = left[-1][1] if not right else right[0][1] if not left else left[-1][1] + (r.at - left[-1][0]) * (right[0][1] - left[-1][1]) / (right[0][0] - left[-1][0])
        assert r.y == pytest.approx(want)


def test_file_fingerprints(spark, tmp_path):
    import hashlib

    from cadenza.sources.media import file_fingerprints

    made = {"a.bin": b"", "b.bin": b"x" * 5000}
    (tmp_path / "deep").mkdir()
    for name, body in made.items():
        (tmp_path / "deep" / name).write_bytes(body)
    found = {r.path.rsplit("/", 1)[1]: (r.size, r.sha256) for r in file_fingerprints(spark, str(tmp_path)).collect()}
    assert found == {name: (len(body), hashlib.sha256(body).hexdigest()) for name, body in made.items() if body}


def test_files_from_elsewhere(spark):
    """Byte order marks, line ends of every kind, missing numbers and broken time lines."""
    from cadenza.sources.subtitles import parse_ass_events, parse_srt, parse_vtt

    srt = "\ufeff1\r\n00:00:01,000 --> 00:00:02,500\r\nline one\r\nline two\r\n\r\n\r\n2\r\n00:00:03,000 -> 00:00:04,000\r\nbroken\r\n\r\nx\r\n00:00:05,000 --> 00:00:06,000\r\nno number"
    df = spark.createDataFrame([(1, srt), (2, srt.replace("\r\n", "\r")), (3, srt.replace("\r\n", "\n"))], "rec long, text string")
    for rec in (1, 2, 3):
        found = sorted(tuple(r)[1:] for r in parse_srt(df.where(f"rec = {rec}")).collect())
        assert found == [(0, 1, 1000, 2500, "line one\nline two"), (1, 2, None, None, "broken"), (2, None, 5000, 6000, "no number")]
    vtt = "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\na &amp; b\n\n7\n00:00:03.000 --> 00:00:04.000\nc <i>d</i>\n"
    found = sorted(tuple(r)[1:] for r in parse_vtt(spark.createDataFrame([(1, vtt)], "rec long, text string")).collect())
    assert found == [(0, 1, 1000, 2000, "a & b"), (1, 7, 3000, 4000, None)]
    ass = "[Events]\r\nDialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,a, b\\\\Nc\r\nDialogue: x\r\nComment: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,note"
    events = parse_ass_events(spark.createDataFrame([(1, ass.replace("\\\\", "\\"))], "rec long, text string")).collect()
    assert [(e.event_type, e.event_text) for e in events] == [("Dialogue", "a, b\\Nc"), ("Comment", "note")]
