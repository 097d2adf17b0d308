"""Counts of tokens per document."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: As `text.TOKEN`: a word character here is a letter, a number or the low line.
TOKEN = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
#: Rows of a batch that is given out, at least; a document's rows stay together.
ROWS = 50_000


def token_counts(documents: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, token, n): how often a document has each of its lower-cased tokens; rows with one id are one document.

    Texts are dealt and sorted by document while they are whole, and stream by; what is held is a document's distinct tokens and a batch.
    Tokens are counted where they are cut, so that neither they nor their counts are dealt.
    """
    dealt = documents.where(F.col("text").isNotNull()).select("doc_id", F.lower("text").alias("text")).repartition("doc_id").sortWithinPartitions("doc_id")
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_kind, ids, sizes, tokens, counts = None, [], [], [], []

        def made() -> pa.RecordBatch:
            each = pa.array(ids, id_kind).take(pa.array(np.repeat(np.arange(len(ids)), sizes)))
            out = pa.RecordBatch.from_arrays([each, pa.array(tokens, pa.string()), pa.array(counts, pa.int64())], names=["doc_id", "token", "n"])
            for x in (ids, sizes, tokens, counts):
                x.clear()
            return out

        def ended(at, tally: Counter) -> None:
            ids.append(at)
            sizes.append(len(tally))
            tokens.extend(tally)
            counts.extend(tally.values())

        at, tally = None, None
        for batch in batches:
            id_kind = batch.schema.field("doc_id").type
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if tally is None or doc != at:
                    if tally is not None:
                        ended(at, tally)
                    at, tally = doc, Counter()
                    if len(tokens) >= ROWS:
                        yield made()
                tally.update(TOKEN.findall(text))
        if tally is not None:
            ended(at, tally)
            yield made()

    return dealt.mapInArrow(run, f"doc_id {kind}, token string, n long")
