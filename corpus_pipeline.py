"""A training corpus from raw documents: classify, join near copies, cut repeats, mix sources, pack.

Every stage takes (spark, docs, sf_dir), works on all that the one before it kept, and but for the last returns the columns of
documents. `run` writes each stage's rows as Parquet to the folder that the cluster shares and reads them for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import mixing, ngram_join, packing, quality, suffix_dedup
from cadenza.llm.common import table, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably good and not toxic, by classifiers fitted on the labelled ones among them."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that similarity links lead between, the one with the smallest id; documents without words stay."""
    return ngram_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that begin earlier too; n_chars follows, where there is one."""
    out = suffix_dedup.dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and in the order, that the curriculum takes them; n_chars follows, where there is one."""
    out = mixing.take(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", one_of_each),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: The classifier, tokenizer and packing can't be said in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
