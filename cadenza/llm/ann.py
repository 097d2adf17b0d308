"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut into two halves, each half is quantised by its own k-means, and a vector lies in the cell of its two centroids. A
query walks through the cells in order of summed distance to both centroids, with a heap, until the cells that it has seen hold its
budget of vectors; these are reranked by exact distance in double precision.

* Centroids are fitted on at most `TRAIN` vectors, chosen by hash; every vector is indexed.
* Equal vectors are one entry with their smallest ids: of a vector that stands in a third of all rows no more than k + 1 rows can
  be among a query's k nearest. A cell that still holds many entries is cut into blocks.
* The budget is measured: for at most `PROBES` queries, chosen by hash, the exact neighbours are found over all entries, and the
  budget is the least that finds `RECALL` of them.

Queries are joined with blocks of entries, not with entries: a task keeps one block and lets the queries that visit it pass by.

Edge cases: vectors that are null, zero, of another length than the most common one, or hold null or non-finite components take no
part, nor do null ids; rows that repeat an id count once per different vector; with k candidates or fewer, all are returned; an empty
table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import table, written

TRAIN, PROBES, RECALL = 20_000, 128, 0.94
#: Entries per cell that the number of centroids aims at, centroids of a half at most, entries of a block, least budget.
CELL, CENTROIDS, BLOCK, LEAST = 8, 512, 4096, 64
ROUNDS = 12
#: Visits of a query to a block that are sent on together.
VISITS = 2048


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = nearest(x, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([squares(x[at : at + 4096], centres).argmin(1) for at in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray):
    """Cells (i, j) in order of first[i] + second[j], with how many entries have been seen with each; empty cells are passed over."""
    by_i, by_j = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[by_i].tolist(), second[by_j].tolist()
    by_i, by_j = by_i.tolist(), by_j.tolist()
    heap, seen, total = [(a[0] + b[0], 0, 0)], {(0, 0)}, 0
    while heap:
        _, x, y = heapq.heappop(heap)
        i, j = by_i[x], by_j[y]
        if n := int(counts[i, j]):
            total += n
            yield i, j, total
        for step in ((x + 1, y), (x, y + 1)):
            if step[0] < len(a) and step[1] < len(b) and step not in seen:
                seen.add(step)
                heapq.heappush(heap, (a[step[0]] + b[step[1]], *step))


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec) of the rows that take part."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & whole)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.when(x == 0, 0).otherwise(x).cast("double")).alias("vec"))


def entries(rows: DataFrame, k: int) -> DataFrame:
    """One row per different vector: vec and its k + 1 smallest ids."""
    by_vector = Window.partitionBy("vec").orderBy("id")
    least = rows.distinct().withColumn("at", F.row_number().over(by_vector)).where(F.col("at") <= k + 1)
    return least.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def search(vectors: DataFrame, queries, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, recall: float = RECALL) -> DataFrame:
    """``queries``: which rows of (id, vec) ask. Returns query_id, rank, <id_col>, score for each one's k nearest other rows."""
    spark = vectors.sparkSession
    rows = valid(vectors, id_col, vector_col)
    lengths = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    out_fields = f"query_id long, rank int, `{id_col}` long, score double"
    if lengths is None:
        return spark.createDataFrame([], out_fields)
    dim = lengths["dim"]
    rows = rows.where(F.size("vec") == dim)
    different = written(entries(rows, k))
    n = different.count()
    sample = different.orderBy(F.xxhash64("vec")).limit(TRAIN).select("vec").toPandas()["vec"]
    train = np.array(sample.tolist(), np.float64)
    half, size = (dim + 1) // 2, max(1, min(CENTROIDS, math.ceil(math.sqrt(n / CELL))))
    books = kmeans(train[:, :half], size), kmeans(train[:, half:], size) if dim > 1 else np.zeros((1, 0))
    shape = len(books[0]), len(books[1])

    def assign(batches):
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nearest(x[:, :half], books[0]).astype(np.int32)), pa.array(nearest(x[:, half:], books[1]).astype(np.int32))], ["vec", "ids", "i", "j"])

    index = written(different.mapInArrow(assign, "vec array<double>, ids array<long>, i int, j int"))
    counts = np.zeros(shape, np.int64)
    for r in index.groupBy("i", "j").count().toLocalIterator():  # at most CENTROIDS squared rows
        counts[r["i"], r["j"]] = r["count"]
    asking = rows.where(queries)
    budget = _budget(index, asking, books, counts, dim, half, k, recall)
    salts = np.maximum(1, -(-counts.sum(1) // BLOCK))
    first_block = np.concatenate([[0], np.cumsum(salts)])
    stored = index.select(
        (F.element_at(F.lit(first_block[:-1].tolist()), F.col("i") + 1) + F.pmod(F.xxhash64("vec"), F.element_at(F.lit(salts.tolist()), F.col("i") + 1))).cast("long").alias("block"),
        F.lit(0).alias("asks"), F.col("ids")[0].alias("id"), "vec", "ids", F.array("j").alias("js"),
    )
    fields = "block long, asks int, id long, vec array<double>, ids array<long>, js array<int>"

    def visit(batches):
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int32())]

        def sent(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "asks", "id", "vec", "ids", "js"])

        rows: list[tuple] = []
        for batch in batches:
            keys = batch.column(0).to_pylist()
            x = _matrix(batch.column(1), dim)
            first, second = squares(x[:, :half], books[0]), squares(x[:, half:], books[1])
            for at, key in enumerate(keys):
                cells: dict[int, list[int]] = {}
                for i, j, total in walk(first[at], second[at], counts):
                    cells.setdefault(i, []).append(j)
                    if total >= budget:
                        break
                for i, js in cells.items():
                    for block in range(first_block[i], first_block[i + 1]):
                        rows.append((block, 1, key, x[at], None, js))
                        if len(rows) == VISITS:
                            yield sent(rows)
                            rows = []
        if rows:
            yield sent(rows)

    def rerank(batches):
        block, held, js, owners = None, None, None, None
        for batch in batches:
            names, asks, keys = (batch.column(c).to_pylist() for c in range(3))
            x = _matrix(batch.column(3), dim)
            found = []
            for at, (name, ask, key) in enumerate(zip(names, asks, keys, strict=True)):
                if name != block:
                    block, held, js, owners = name, [], [], []
                if not ask:
                    held.append(x[at])
                    js.append(batch.column(5)[at].as_py()[0])
                    owners.append(batch.column(4)[at].as_py())
                elif len(held):
                    if isinstance(held, list):
                        held, js = np.array(held), np.array(js)
                    mine = np.flatnonzero(np.isin(js, batch.column(5)[at].as_py()))
                    found += [(key, other, d) for d, other in best(x[at], held, mine, owners, key, k)]
                    continue
                if isinstance(held, np.ndarray):
                    raise AssertionError("entries come before queries")
            cols = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "id", "score"])

    asked = asking.select("id", "vec").distinct().mapInArrow(visit, fields)
    near = stored.unionByName(asked).repartition("block").sortWithinPartitions("block", "asks").mapInArrow(rerank, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = near.groupBy("query_id", "id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def best(query: np.ndarray, held: np.ndarray, mine: np.ndarray, owners: list[list[int]], key: int, k: int) -> list[tuple[float, int]]:
    """(distance, id) of the k nearest rows among the entries ``mine``, without the query's own row."""
    far = np.sqrt(((held[mine] - query) ** 2).sum(1))
    if len(far) > k + 1:
        limit = np.partition(far, k)[k]  # one more than k: the query's own row may be among them
        mine, far = mine[far <= limit], far[far <= limit]
    return sorted((d, other) for d, m in zip(far.tolist(), mine.tolist(), strict=True) for other in owners[m] if other != key)[:k]


def _budget(index: DataFrame, asking: DataFrame, books: tuple, counts: np.ndarray, dim: int, half: int, k: int, recall: float) -> int:
    """Entries that a query has to see so that ``recall`` of the probes' true neighbours are among them."""
    probes = asking.orderBy(F.xxhash64("id"), "id").limit(PROBES).toPandas()
    if not len(probes):
        return LEAST
    ids, x = probes["id"].tolist(), np.array(probes["vec"].tolist(), np.float64)

    def exact(batches):
        for batch in batches:
            held, owners = _matrix(batch.column(0), dim), batch.column(1).to_pylist()
            cells = np.stack([batch.column(2).to_numpy(), batch.column(3).to_numpy()], 1)
            place = {o: m for m, own in enumerate(owners) for o in own}
            rows = [(at, d, other, *cells[place[other]].tolist()) for at, key in enumerate(ids) for d, other in best(x[at], held, np.arange(len(held)), owners, key, k)]
            cols = zip(*rows, strict=True) if rows else [()] * 5
            kinds = (pa.int32(), pa.float64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], ["probe", "score", "id", "i", "j"])

    order = Window.partitionBy("probe").orderBy("score", "id")
    true = index.mapInArrow(exact, "probe int, score double, id long, i int, j int").withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).toPandas()
    first, second = squares(x[:, :half], books[0]), squares(x[:, half:], books[1])
    needed = []
    for probe, own in true.groupby("probe"):
        seen = {(i, j): total for i, j, total in walk(first[probe], second[probe], counts)}
        needed += [seen[cell] for cell in zip(own["i"], own["j"], strict=True)]
    return max(LEAST, int(np.quantile(needed, recall, method="higher"))) if needed else LEAST


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
