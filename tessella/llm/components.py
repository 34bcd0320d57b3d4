"""Connected components by contraction, entirely in DataFrames.

Each round every vertex takes the least of itself and its neighbours as parent, parents
are followed twice, and edges are rewritten to their ends' parents.  Edges inside one
component vanish, so a star or a clique takes one round; a path of n edges takes about
log n.  Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import drop_since, mark, materialize


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) of every vertex of edges (a, b); root is the least vertex reachable."""
    spark, point = edges.sparkSession, mark()
    left = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        both = left.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(left.select(F.col("b").alias("v"), F.col("a").alias("w")))
        parent = materialize(both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("p")), "parents")
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("q"))
        jumped = materialize(parent.join(up, "p").select("v", F.col("q").alias("p")), "jumped")
        if labels is None:
            labels = jumped.select(F.col("v").alias("vertex"), F.col("p").alias("root"))
        else:
            step = jumped.select(F.col("v").alias("root"), "p")
            labels = materialize(labels.join(step, "root", "left").select("vertex", F.coalesce("p", "root").alias("root")), "labels")
        a = jumped.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        b = jumped.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        left = left.join(a, "a").join(b, "b").filter("pa <> pb")
        left = materialize(left.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        drop_since(spark, point, left, labels)  # only the edges left and the labels are read again
        if left.isEmpty():
            return labels
