"""Connected components by repeated contraction, all in joins and aggregates.

Every round each node hooks on to its smallest neighbour, the resulting forest is
flattened by pointer doubling, and the edges are rewritten to the roots; duplicates
and loops fall away.  The number of groups at least halves each round, so the rounds
grow with the logarithm of the number of nodes.  Minima and distinct rows are
combined before each shuffle, so a node with very many edges costs one row a task
there; the plain joins on it are between tables, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesieve.llm.base import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node with an edge to another the smallest node it reaches.

    ``edges`` has two long columns; direction, repeats, loops and null ends do not matter.
    Nodes without edges are not returned.  An empty table gives an empty result.
    """
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    pairs = materialise(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not pairs.isEmpty():
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up")), "parents")
        while True:
            over = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = materialise(parent.join(over, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "parents")
            parent = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = parent.select("node", F.col("up").alias("component"))
        else:
            step = parent.select(F.col("node").alias("component"), "up")
            labels = materialise(labels.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        ends = parent.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        pairs = pairs.join(ends, "a").select("ra", "b")
        pairs = pairs.join(ends.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b").where("ra <> rb")
        pairs = materialise(pairs.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if labels is None:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
