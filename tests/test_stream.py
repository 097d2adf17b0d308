"""Words of segments and recordings as columns, against the same rules row by row."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import reconcile, stream

SEGMENT = f"rec long, seg long, start double, end double, text string, words array<{reconcile.WORD}>"
SAID = ["да", "нет,", "Слово.", "ёж", "straße", "Мир.Да", "-то", "-", "—", "сло-", "«так»", "...", " ", "\t", "", None, "два слова", "a\x1cb", "x y", "9", "İo", " "]


def some(r, n):
    rows = []
    for k in range(n):
        plain = r.random() < 0.5
        at, words = 1.0 + k, []
        for _ in range(r.randrange(9)):
            at += r.choice([0.0, 0.1, 4.0])
            words.append((at, at + 0.3, r.choice(SAID[:5] if plain else SAID), r.choice([0.1, 0.5, 0.9, 0.9, None, float("nan")])))
            at += r.choice([0.3, 0.3 - 5e-10])
        text = " ".join(w[2] or "" for w in words)
        start, end = 1.0 + k, max(at, 1.1 + k)
        kind = r.randrange(12)
        words = {0: words[::-1], 1: None, 2: [], 3: [(a, b, (x or "")[::-1], p) for a, b, x, p in words], 4: [*words, None], 5: [(None, b, x, p) for _, b, x, p in words]}.get(kind, words)
        text = {6: "", 7: None, 8: f"  {text}\n\x85{text} ", 9: text + "."}.get(kind, text)
        start, end = {10: (start, r.choice([None, float("nan"), float("inf"), start])), 11: (r.choice([None, float("nan"), -1.0]), end)}.get(kind, (start, end)) if r.random() < 0.4 else (start, end)
        rows.append((k // 7, k, start, end, text, words))
    return rows


def same(a, b):
    """Equal rows; what is no number equals itself."""
    return repr(sorted(map(repr, a))) == repr(sorted(map(repr, b)))


@pytest.mark.parametrize("words", [5, 100_000])
def test_prepared_words_are_those_of_segments(spark, monkeypatch, words):
    monkeypatch.setattr(stream, "WORDS", words)
    df = spark.createDataFrame(some(random.Random(words), 1500), SEGMENT)
    made = reconcile.prepare(df)
    want = made.select("rec", "seg", "how", "retimed", F.posexplode("words").alias("k", "w")).select("rec", "seg", "how", "retimed", "k", "w.*")
    found = stream.prepare(df)
    assert found.columns == want.columns
    assert same(found.collect(), want.collect())
    ways = {r.how: r.n for r in found.groupBy("how").agg(F.count_distinct("seg").alias("n")).collect()}
    assert set(ways) == {"reconciled", "spread", "words"} and min(ways.values()) > 30
    assert found.where("retimed").count() > 0
    order = F.row_number().over(reconcile.Window.partitionBy("rec").orderBy("seg", "k"))
    plain = reconcile.merged_hyphens(want.where("how = 'reconciled'").select("rec", order.alias("ix"), "start", "end", "text", "probability"))
    joined = stream.reconciled_words(df)
    assert joined.columns == plain.columns
    assert same(joined.collect(), plain.collect())
    assert joined.where("text like '%-то'").count() > 0


def test_words_are_not_dealt_anew(spark, sf_dir):
    """Whole texts are dealt once; neither words nor their segments are dealt or cut to rows on the way."""
    from cadenza.plans import registry

    for name in ("wn36_prepare_words", "wn31_reconcile"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("\n")
        assert sum("Exchange" in x for x in plan) == 1, name
        assert sum("Generate" in x for x in plan) == 1, name  # the lines
        assert not any("Aggregate" in x or "ArrowEvalPython" in x for x in plan), name


def test_lines_begin_where_sentences_break_best():
    from cadenza.operators import layout, spoken

    r = random.Random(3)
    pool = ["да", "и", "нет,", "слово", "длинноеслово", "Правда", "в", "—", "«так»", "сверх" * 12, "два-три", "ну;", "но", "о-", "— Да", "a", "по"]
    for width, gap, own in ((42, 8, pool), (20, 4, pool[:9]), (42, 8, ["a", "в"]), (9, 1, pool[:7])):
        sentences = [[r.choice(own) for _ in range(r.choice([1, 2, 5, 12, 40, 700 if k == 50 else 9]))] for k in range(200)]
        said = [w for s in sentences for w in s]
        first = [k == 0 for s in sentences for k in range(len(s))]
        n = len(said)
        words = stream.Words(spoken.np.zeros(n, int), spoken.np.zeros(n), spoken.np.zeros(n), stream.Tokens.of(said), spoken.np.zeros(n))
        want, at = [], 0
        for s in sentences:
            want += [at, *[at + cut for cut in layout.line_breaks(s, width, gap)[:-1]]]
            at += len(s)
        assert spoken.np.flatnonzero(spoken.line_starts(words, spoken.np.array(first), width, gap)).tolist() == want
    for _ in range(300):
        n = r.randrange(1, 30)
        sentences, sizes = sorted(r.randrange(9) for _ in range(n)), [r.randrange(1, 6) for _ in range(n)]
        assert spoken.cue_ends(sentences, sizes) == layout.cue_breaks([0.0] * n, [0.0] * n, sentences, sizes, 2, 0.7)


def test_long_words_are_cut_as_by_columns(spark):
    from cadenza.operators import layout, spoken

    r = random.Random(4)
    made = ["".join(r.choice("ab - x") for _ in range(r.randrange(1, 70))) for _ in range(400)]
    df = spark.createDataFrame([(w,) for w in made], "w string")
    for most in (1, 12, 50):
        for w, parts in df.select("w", layout.split_capacity(F.col("w"), most)).collect():
            assert spoken.capacity_parts(w, most) == parts, w


def test_layout_deals_no_words(spark, sf_dir):
    """Texts are dealt, and what is made of whole recordings; words and lines are no rows on the way."""
    from cadenza.plans import registry

    for name in ("wn28_layout", "wn28_diagnostics"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("\n")
        assert sum("Exchange" in x for x in plan) <= 2, name
        assert sum("Generate" in x for x in plan) == 1, name
        assert not any("Sort [" in x and "seg#" in x for x in plan), name  # lines were sorted before they had words
        assert sum("MapInArrow" in x for x in plan) == 1 and not any("ArrowEvalPython" in x for x in plan), name
