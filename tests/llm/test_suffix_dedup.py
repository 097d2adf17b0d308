"""Suffix dedup past every block's, batch's and task's edge."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cadenza.llm import suffix_dedup as sd
from tests.llm.test_llm import brute_removals, words


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_runs_are_sorted_out_alike_in_any_batches(size):
    """Passes 1 and 2: groups that go on over many batches."""
    r = random.Random(2)
    rows = []
    for gram in range(40):
        kinds = [sd.FIRST] * r.choice([1, 1, 2, 9]) + [sd.MANY] * r.choice([0, 0, 1, 3])
        rows += sorted((gram, k, r.randrange(3), r.randrange(50), r.randrange(1000)) for k in kinds)
    rows += [(7, sd.OPEN, 1, 2, 3), (7, sd.REPEAT, 1, 2, 900)]
    place = lambda lo, kind: int(sd._place(np.int64(lo), np.int64(lo), kind))
    whole = [(g, s, d, place(lo, k)) for g, k, s, d, lo in rows]

    def brute():
        out = []
        for gram in range(40):
            own = [(s, d, lo) for g, k, s, d, lo in rows if g == gram and k == sd.FIRST]
            several = len({s for s, _, _ in own}) > 1 or any(g == gram and k == sd.MANY for g, k, *_ in rows)
            seen = set()
            for s, d, lo in own:
                if s in seen:
                    out.append((d, lo, sd.REPEAT))
                elif several:
                    out.append((d, lo, sd.OPEN))
                seen.add(s)
        return sorted(out + [(2, 3, sd.OPEN), (2, 900, sd.REPEAT)])

    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*whole[at : at + size], strict=True)], sd._RUN) for at in range(0, len(whole), size)]
    found = [(r["did"], r["lo"], r["kind"]) for b in sd._ranges(batches) for r in b.to_pylist()]
    assert sorted(found) == brute()


def test_runs_over_block_edges(monkeypatch):
    """However a text is cut into blocks, its windows are covered once, and equal windows have equal strings."""
    body = (" ".join(words(300, 7)) + " ").encode() * 3
    whole = {}
    for g, _, lo, hi in sd.runs(body):
        whole |= {w: v for v, a, b in zip(g, lo, hi, strict=True) for w in range(a, b + 1)}
    monkeypatch.setattr(sd, "BLOCK", 64)
    for g, _, lo, hi in sd.runs(body):
        for v, a, b in zip(g, lo, hi, strict=True):
            assert all(whole[w] == v for w in range(a, b + 1))
    assert sorted(whole) == list(range(len(body) - 99))


def test_texts_longer_than_a_block(spark):
    """Half a megabyte is a block; batches of three rows make every group go on in the next one."""
    r = random.Random(3)
    long = bytes(r.choice(b"abcdefgh ") for _ in range(sd.BLOCK + 3000)).decode()
    made = {1: long, 2: long[sd.BLOCK - 700 : sd.BLOCK + 900], 3: "x" * 150 + long[5:400] + "y" * 150, 4: long[100:350] * 5}
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        found = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in sd.removals(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == dict(zip(sorted(made), brute_removals([made[k] for k in sorted(made)]), strict=True))
