"""The n-gram join on what its hashes, orders and blocks must stand."""

import random

import numpy as np
import pytest

from cadenza.llm import ngram_join
from tests.llm.test_llm import brute_components, words


def found(spark, made):
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    return {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.similar(df).collect()}


def test_structured_words_stay_apart(spark):
    """The Thue-Morse word and its complement have one polynomial hash modulo any power of two up to the 55th."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    made = {1: word, 2: word.translate(str.maketrans("ab", "ba")), 3: word}
    assert found(spark, made) == {1: (1, 1), 2: (1, 2), 3: (1, 1)}


def test_pages_of_one_template_are_not_paired(spark):
    """Shared words are late in the order, so that no list is held: the rows of the join don't grow with the square of the pages."""
    shared = words(90, 70)
    r = random.Random(4)
    made = {k: " ".join(shared[:45] + [f"u{r.randrange(10**9)}" for _ in range(12)] + shared[45:]) for k in range(300)}
    assert found(spark, made) == brute_components(made)
    df = spark.createDataFrame(list(made.items()), "did long, text string").selectExpr("did", "cast(text as binary) as text")
    sets = [ngram_join.shingles(t.encode()) for t in made.values()]
    tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
    often = tokens[counts > 2]
    live = ngram_join._live(df, 0, often, np.arange(len(often)), {}, 80).collect()
    assert not any(ngram_join.holds(r.n, r.most) for r in live)


def test_orders_and_sizes_at_random(spark):
    """Sets that share passages of very many sets, in all sizes around the threshold."""
    r = random.Random(11)
    passages = [words(r.randrange(10, 40), 500 + k) for k in range(6)]
    made = {}
    for k in range(160):
        parts = r.sample(passages, r.randrange(1, 4)) + [words(r.randrange(0, 12), 900 + k)]
        r.shuffle(parts)
        made[k] = " ".join(w for p in parts for w in p)
    assert found(spark, made) == brute_components(made)


@pytest.mark.parametrize("chunk", [16, 300])
def test_texts_longer_than_a_chunk(monkeypatch, chunk):
    text = " ".join(words(500, 3)).encode() + b" " + b"x" * 700 + b" \n y " + "é ".encode() * 200
    whole = ngram_join.shingles(text)
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    assert (ngram_join.shingles(text) == whole).all()


def test_classes_with_one_key_are_named_apart(spark):
    rows = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 7, 2), (4, 8, 5)], "did long, key long, rest long")
    named, renamed = ngram_join._named_apart(rows)
    keys = {r.did: r.key for r in named.collect()}
    assert keys[1] == 7 and keys[4] == 8 and keys[2] == keys[3] not in (7, 8) and renamed == {(7, 2): keys[2]}
