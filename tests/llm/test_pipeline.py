"""The pipeline's first and last stages against what they must do with whole tables."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import mixing, ngram_join, packing, quality
from tests.llm.test_llm import brute_components

SF = "/root/testdata/sf0.001"


def test_classifier_stage_keeps_what_its_scores_say(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in corpus_pipeline.classify(spark, docs, SF).collect()}
    scores = quality.score(docs, quality.fit(docs, labels)).collect()
    assert kept == {r.doc_id for r in scores if r.keep}
    good = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    assert len(good & kept) > 0.9 * len(good)


def test_one_of_each_of_repeated_and_null_ids(spark):
    """Rows are told apart where their ids don't."""
    a, b, c = ("w1 w2 w3 w4 w5 w6 w7", "x1 x2 x3 x4 x5 x6 x7", "y1 y2 y3")
    rows = [(1, a), (1, a), (1, b), (2, b), (None, a), (None, c), (None, c), (3, ""), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in ngram_join.one_of_each(df).collect())
    assert kept == sorted([(False, 1, a), (False, 1, b), (True, 0, c), (False, 3, ""), (False, 3, ""), (False, 4, "")])


def test_one_of_each_leaves_one_of_a_component(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = brute_components({r.doc_id: r.text or "" for r in docs.collect()})
    assert {r.doc_id for r in ngram_join.one_of_each(docs).collect()} == {d for d, (n, c) in found.items() if c == d or not n}


def test_mixing_stage_takes_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = mixing.schedule(docs.select("doc_id", "text", "source")).collect()
    wanted = {(r.source_size, r.target): int(r.target) for r in plan}
    words = corpus_pipeline.mix_sources(spark, docs, SF).withColumn("n", F.size(F.filter(F.split("text", r"[ \t-\r]+"), lambda x: x != "")))
    taken = {r.source: r.n for r in words.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    assert sorted(taken.values()) == sorted(v for v in wanted.values() if v)


def test_packing_stage_holds_every_token(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tokenizer, pieces = packing.load_tokenizer(), defaultdict(list)
    for r in corpus_pipeline.pack(spark, docs, SF).collect():
        pieces[r.doc_id].append((r.start, r.length))
    for r in docs.collect():
        ends = np.cumsum([n for _, n in sorted(pieces[r.doc_id])]).tolist()
        assert [s for s, _ in sorted(pieces[r.doc_id])] == [0, *ends[:-1]] and ends[-1] == len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
