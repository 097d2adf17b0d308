"""Folds and dynamic programs over recordings against plain versions at random inputs."""

import itertools
import random

import pytest

from cadenza.operators import layout

rng = random.Random(12)


def words_of(n_recs=6):
    rows = []
    for rec in range(n_recs):
        at = 0.0
        for ix in range(rng.randrange(1, 60)):
            at += rng.choice([0.0, 0.3, 0.5, 9.0])
            rows.append((rec, ix, at if rng.random() > 0.1 else None, at + rng.choice([0.1, 0.4, 0.8]) if rng.random() > 0.1 else None, rng.choice(["да", "Да", "нет", " ", "и"])))
    return rows


FIELDS = "rec long, ix long, start double, end double, text string"


def by_rec(rows):
    return [(rec, list(own)) for rec, own in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[1])), key=lambda r: r[0])]


def test_fill_and_sweep(spark):
    rows = words_of()
    want = []
    for _, own in by_rec(rows):
        end = 0.0
        for rec, ix, start, stop, text in own:
            start = end if start is None else max(start, end)
            stop = start + 0.001 if stop is None else stop
            if stop > start and text.strip():
                want.append((rec, ix, start, stop, text))
                end = stop
    found = layout.fill_and_sweep(spark.createDataFrame(rows, FIELDS)).collect()
    assert sorted(map(tuple, found)) == sorted(want)


def test_boundary_repeats(spark):
    rows = [r for r in words_of() if r[2] is not None and r[3] is not None]
    want = []
    for _, own in by_rec(rows):
        kept = []
        for rec, ix, start, stop, text in own:
            if kept and start < kept[-1][3]:
                if text.casefold() == kept[-1][4].casefold() or stop <= kept[-1][3]:
                    continue
                start = kept[-1][3]
            kept.append((rec, ix, start, stop, text))
        want += kept
    found = layout.drop_boundary_repeats(spark.createDataFrame(rows, FIELDS)).collect()
    assert sorted(map(tuple, found)) == sorted(want)


@pytest.mark.parametrize("longest", [1.0, 7.5, 1000.0])
def test_greedy_groups(spark, longest):
    rows = [r for r in words_of() if r[2] is not None and r[3] is not None]
    want = {}
    for rec, own in by_rec(rows):
        groups = []
        for _, ix, start, stop, _ in own:
            if not groups or stop - groups[-1][0] > longest:
                groups.append([start])
            want[rec, ix] = len(groups) - 1
    found = {(r.rec, r.ix): r.group for r in layout.greedy_groups(spark.createDataFrame(rows, FIELDS), longest).collect()}
    assert found == want


def cost_of(words, cuts, width):
    """Lines, penalty, overflow and raggedness of one way to break a sentence; lines are judged by the tokens of their text."""
    around = ".,!?…;:—-\"'«»“”’()[]{}"
    lines, penalty, over, ragged, at = 0, 0, 0, 0, 0
    for cut in cuts:
        text = layout.join_units(words[at:cut])
        tokens = text.split()
        lines, over, ragged = lines + 1, over + max(0, len(text) - width), ragged + len(text) ** 2
        penalty += layout.SHORT_LINE.get(len(tokens), 0)
        if cut < len(words):
            if tokens[-1].casefold().strip(around) in layout.WEAK_ENDS:
                penalty += layout.WEAK_END
            elif not text.endswith(layout.GOOD_ENDS):
                penalty += layout.CONJUNCTION if words[cut].casefold().strip(around) in layout.CONJUNCTIONS else layout.PLAIN
        at = cut
    return lines, penalty, over, ragged


def test_line_breaks_are_the_best_of_all():
    for _ in range(150):
        words = [rng.choice(["и", "в", "слово", "длинное-", "но,", "оченьдлинноеслово", "да", "— и", "— слово", "(но)"]) for _ in range(rng.randrange(1, 9))]
        width, gap = 12, 3
        ways = []
        for k in range(len(words)):
            for inner in itertools.combinations(range(1, len(words)), k):
                cuts = [*inner, len(words)]
                sizes = [(len(layout.join_units(words[a:b])), b - a) for a, b in zip([0, *cuts], cuts)]
                if all(n <= width + gap or m == 1 for n, m in sizes):
                    ways.append(cost_of(words, cuts, width))
        assert cost_of(words, layout.line_breaks(words, width, gap), width) == min(ways)


def test_cue_breaks_are_the_best_of_all():
    for _ in range(150):
        n = rng.randrange(1, 8)
        starts, at = [], 0.0
        for _ in range(n):
            starts.append(at)
            at += rng.choice([1.0, 1.2, 3.0])
        ends, sentences, sizes = [s + 1 for s in starts], sorted(rng.randrange(3) for _ in range(n)), [rng.randrange(1, 5) for _ in range(n)]

        def cost(cuts):
            cues, orphans, crossings, single, a = 0, 0, 0, 0, 0
            for b in cuts:
                if b - a > 2 or any(sentences[k] != sentences[k - 1] and starts[k] - ends[k - 1] >= 0.5 for k in range(b - 1, b) if k > a):
                    return None
                cues, crossings = cues + 1, crossings + (sentences[a] != sentences[b - 1])
                if b == a + 1:
                    orphans, single = orphans + layout.ORPHAN.get(sizes[a], 0), single - a
                a = b
            return cues, orphans, crossings, single

        ways = [cost([*inner, n]) for k in range(n) for inner in itertools.combinations(range(1, n), k)]
        assert cost(layout.cue_breaks(starts, ends, sentences, sizes, 2, 0.7)) == min(w for w in ways if w is not None)


def test_pack_lines_of_any_batches(spark):
    rows = [(rec, s, s * 100 + k, float(k), k + 0.4, rng.choice(["слово", "и", "да,", "конец."])) for rec in range(3) for s in range(5) for k in range(rng.randrange(1, 40))]
    df = spark.createDataFrame(rows, "rec long, sentence long, ix long, start double, end double, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = sorted(map(tuple, layout.pack_lines(df, 20, 4).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for (rec, s), own in itertools.groupby(sorted(rows), key=lambda r: r[:2]):
        own, at = list(own), 0
        texts = [r[5] for r in own]
        for k, cut in enumerate(layout.line_breaks(texts, 20, 4)):
            want.append((rec, s, k, own[at][3], max(r[4] for r in own[at:cut]), layout.join_units(texts[at:cut]), cut - at, cut == len(texts)))
            at = cut
    assert found == sorted(want)
