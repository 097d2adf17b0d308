"""Connected components by contraction: every node hooks to its smallest neighbour, edges are renamed, until none is left.

Each round at least halves the nodes that still have edges, and only joins and minima by key are used, so that a star with very many
leaves is no problem: minima are pre-aggregated and joins on a hot key are split. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to rows (node, component), one per node that has an edge; the component is its smallest node."""
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    labels = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")))
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = ends.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("node"), F.least("a", "to").alias("to"))
        hooks = written(hooks)
        by_b = hooks.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        renamed = edges.join(hooks.withColumnRenamed("node", "a"), "a").join(by_b, "b").select(F.least("to", "to_b").alias("a"), F.greatest("to", "to_b").alias("b"))
        moved = labels.join(hooks.select(F.col("node").alias("component"), "to"), "component", "left")
        new = written(moved.select("node", F.coalesce("to", "component").alias("component"))), written(renamed.where("a < b").distinct())
        discard(labels, edges, hooks)
        labels, edges = new
    discard(edges)
    return labels
