"""SimHash near-duplicates against a brute-force version of fingerprints and links."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from cadenza.llm import simhash
from tests.llm.test_llm import words

SPACE = re.compile("[^\x20\x09-\x0d]+")


def brute_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = SPACE.findall(lower)
    if not found:
        return 0
    shingles = [" ".join(found[k : k + 4]) for k in range(max(1, len(found) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(by_id):
    """{id: fingerprint} to {id: smallest id that links lead to}."""
    fps = sorted(set(by_id.values()))
    at, own = np.array(fps, np.uint64), np.arange(len(fps))
    for k in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(at[:k] ^ at[k]) <= 4):
            a, b = own[k], own[j]
            if a != b:
                own[own == max(a, b)] = min(a, b)
    part = dict(zip(fps, own.tolist(), strict=True))
    least = {}
    for i in sorted(by_id):
        least.setdefault(part[by_id[i]], i)
    return {i: (f"{fp:016x}", least[part[fp]]) for i, fp in by_id.items()}


def found(df):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}


def test_sets_of_positions_cover():
    sets = simhash.covering()
    assert len(sets) == 20
    assert all(any(set(s) <= set(four) for s in sets) for four in combinations(range(8), 4))


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_documents(spark, sf):
    df = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    want = brute_components({r.doc_id: brute_fingerprint(r.text) for r in df.select("doc_id", "text").collect()})
    assert found(df) == want
    assert len({c for _, c in want.values()}) < len(want)


@pytest.mark.parametrize("chunk", [1, 40, 4000])
def test_fingerprints_in_parts(monkeypatch, chunk):
    texts = ["", " \n", "Ab", "a b C", "a b c d", " ".join(words(300, 1)), "x" * 90 + "\x0bÄ é \x1c \x85 " + "y " * 50, "\ta " * 700]
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    assert [simhash.fingerprint(t.encode()) for t in texts] == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("long, centres", [(64, 8), (3, 2), (10**9, 2), (2, 1000)])
def test_dense_groups(spark, monkeypatch, long, centres):
    """Clouds of fingerprints around few centres: lists are split, stars take rounds, no link is lost."""
    monkeypatch.setattr(simhash, "LONG", long)
    monkeypatch.setattr(simhash, "CENTRES", centres)
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(30)} | {0, 2**64 - 1}
    for hub in list(fps)[:4]:
        for _ in range(60):
            fps.add(hub ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 9))))
    signed = [x - 2**64 if x >> 63 else x for x in sorted(fps)]
    entries = spark.createDataFrame([(x,) for x in signed], "fp long")
    labels = {row.node: row.component for row in simhash._components(simhash._index(entries), 4).collect()}
    want = brute_components(dict(enumerate(sorted(fps))))
    groups = {}
    for k, fp in enumerate(signed):
        groups.setdefault(labels.get(fp, fp), []).append(k)
    assert sorted(min(g) for g in groups.values() for _ in g) == sorted(c for _, c in want.values())


def test_edges(spark):
    base = words(200, 9)
    rows = [(5, None, 1), (3, "", 2), (4, " \t", 3), (None, " ".join(base), 4), (9, " ".join(base), 5), (9, " ".join(base), 6), (7, "one", 7), (8, "ONE", 8), (10, " ".join(base[:-1]), 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long").withColumn("component", df_one()).withColumn("token", df_one())
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    one = f"{xxhash.xxh64(b'one', seed=42).intdigest():016x}"
    assert [x for x in got if x[1] == "0" * 16] == [(3, "0" * 16, 3), (4, "0" * 16, 3), (5, "0" * 16, 3)]
    assert [x for x in got if x[1] == one] == [(7, one, 7), (8, one, 7)]
    assert sorted((x[0] or 0, x[2]) for x in got if x[1] == f"{brute_fingerprint(' '.join(base)):016x}") == [(0, 9), (9, 9), (9, 9)]
    assert simhash.near_duplicates(df.limit(0)).collect() == []
    by_name = simhash.near_duplicates(df.selectExpr("cast(doc_id as string) as doc_id", "text")).collect()
    assert {r.component_id for r in by_name if r.fingerprint == one} == {"7"}
    only_null = spark.createDataFrame([(None, "a b c d e")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(only_null).collect()] == [None]
    with pytest.raises(ValueError):
        simhash.near_duplicates(df, bits=5)


def df_one():
    from pyspark.sql import functions as F

    return F.lit(1)
