"""Source divergence against SQL over all cells and a version in plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from cadenza.llm import divergence
from tests.conftest import rows

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(docs, least):
    """(lang, source, part, item, value, rank) over every group and every kept term."""
    counts, having, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in docs:
        lang, source, text = lang or "", source or "", text or ""
        terms = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        having[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        sources = sorted(s for g, s in groups if g == lang)
        kept = sorted(t for t, n in having[lang].items() if n >= least)
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[: 10 if part == "term" else None], 1)]
    return sorted(out)


@pytest.mark.parametrize("held", [1, 1 << 18])
def test_against_plain_python(spark, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD", held)
    r = random.Random(2)
    vocabulary = [f"w{chr(97 + k)}" for k in range(26)] + ["É", "é", "naïve", "x\x80y", "Straße", "K", "日本"]  # K: the Kelvin sign is no ASCII letter
    docs = [(r.choice(["en", "de", None]), r.choice(["a", "b", "c", "ä", None, "B"]), r.choice(["", " 1-2 "]).join(r.choice([".", " ", "_"]) + r.choice([t, t.upper()]) for t in r.choices(vocabulary, range(1, 34), k=r.randrange(40)))) for _ in range(150)]
    docs += [("en", "a", None), ("en", "empty", ""), ("fr", "x", "rare"), ("fr", "y", ""), ("it", "alone", None)] + [("en", "b", "One one ONE two")] * 7
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "lang string, source string, text string, term int, n int, docs int")
    got = sorted(tuple(x[c] for c in ("lang", "source", "part", "item", "value", "rank")) for x in divergence.audit(df, least_docs=4).collect())
    want = brute(docs, 4)
    assert got == want
    assert {x[0] for x in want} == {"", "de", "en", "fr"} and any(x[2] == "pair" and x[4] == 0 for x in want)
    assert divergence.audit(df.limit(0)).collect() == []


def test_columns_are_shared(spark):
    """Terms with one column are one vector."""
    docs = [("en", s, "alpha beta gamma delta") for s in "ab" for _ in range(6)] + [("en", "a", "delta")]
    df = spark.createDataFrame(docs, "lang string, source string, text string")
    counts = divergence.term_counts(df).where("term != ''").withColumn("p", divergence.F.col("n")).withColumn("p0", divergence.F.lit(0).cast("long"))
    assert sorted(x.many for x in divergence.vectors(counts).collect()) == [1, 3]


def test_sums_beyond_a_long(spark):
    """Counts whose product with the parts does not fit 64 bits."""
    df = spark.createDataFrame([(4 * 10**12, 7 * 10**13, 100)], "n long, total long, kept long")
    assert df.select(divergence.share(*(divergence.F.col(c) for c in df.columns)).alias("p")).first().p == 1 + 10**9 * (4 * 10**12 + 2) // (7 * 10**13 + 200)


def test_sql_agrees(spark, duck, sf_dir):
    assert rows(divergence.op13_divergence(spark, sf_dir)) == rows(duck.sql(divergence.OP13_SQL))
