"""Matching blocks against difflib, and what grows with the size of a text and not with its square."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from cadenza.functions import blocks, text
from cadenza.operators import checks, layout
from cadenza.plans import registry


def test_blocks_are_those_of_difflib():
    rng = random.Random(11)
    for _ in range(3000):
        letters = rng.choice(("a", "ab", "abcdef", "abcdefghijklmnop"))
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        b = list(a) if rng.random() < 0.5 else [rng.choice(letters) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(3)] = rng.choice(letters) * rng.randrange(3)
        b = "".join(b)
        matcher = SequenceMatcher(None, a, b, autojunk=False)
        found = blocks.matching_blocks(a, b)
        assert found == [tuple(m) for m in matcher.get_matching_blocks() if m.size]
        assert blocks.ratio(found, a, b) == matcher.ratio()


def test_running_sums(spark):
    sizes = (0, 1, 15, 16, 17, 32, 33, 300)
    rows = spark.createDataFrame([([(7 * k + n) % 5 for k in range(n)],) for n in sizes], "x array<int>")
    for r in rows.select("x", text.running_sums(F.col("x")).alias("sums")).collect():
        assert r.sums == [sum(r.x[: k + 1]) for k in range(len(r.x))]


def test_parts_of_a_very_long_line(spark):
    words = [f"w{k % 97}" for k in range(20000)]
    rows = spark.createDataFrame([(" ".join(words), 5000), ("abcdefghij klm", 4), ("ab c", 4), ("", 1)], "line string, m int")
    found = [r.p for r in rows.select(checks.proportional_parts(F.col("line"), F.col("m")).alias("p")).collect()]
    assert found == [[" ".join(words[4 * k : 4 * k + 4]) for k in range(5000)], ["abc", "def", "ghi", "jklm"], None, None]


def test_whole_texts_are_dealt_and_words_stay(spark, sf_dir):
    """An exchange below the words; sweeps stream and build no frame per recording. (Twice for wn9, which reads words twice; wn25 counts small groups after.)"""
    for name in ("wn9_boundary_repeats", "wn11_fill_and_sweep", "wn25_greedy_groups", "wn26_pack_lines", "st_line_scalars", "wn30_retime_leading"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == (2 if name[:4] in ("wn9_", "wn25") else 1) and "FlatMapGroups" not in plan, name
        assert plan.index("Generate posexplode") < plan.rindex("Exchange"), name


def test_lines_of_plain_words_break_as_others_do():
    """Units of one token each go another way, with the same ends."""
    rng = random.Random(12)
    words = ("a", "и", "word,", "на", "longerword", "x—", "в", "end;", "supercalifragilistic" * 3, "но", "для")
    for _ in range(500):
        own = [rng.choice(words) for _ in range(rng.randrange(1, 14))]
        best = [(0, 0, 0, 0), *[None] * len(own)]
        came = [0] * (len(own) + 1)
        for start in range(len(own)):
            for end in range(start + 1, len(own) + 1):
                size = len(" ".join(own[start:end]))
                if size > 24 and end > start + 1:
                    break
                cost = layout.SHORT_LINE.get(end - start, 0)
                if end < len(own):
                    weak, good = layout.plain(own[end - 1]) in layout.WEAK_ENDS, own[end - 1].endswith(layout.GOOD_ENDS)
                    cost += layout.WEAK_END if weak else 0 if good else layout.CONJUNCTION if own[end] in layout.CONJUNCTIONS else layout.PLAIN
                a, b, c, d = best[start]
                rank = (a + 1, b + cost, c + max(0, size - 20), d + size * size)
                if best[end] is None or rank < best[end]:
                    best[end], came[end] = rank, start
        assert layout._plain_line_breaks(own, 20, 4) == layout.line_breaks(own, 20, 4) == layout._way(came)
