"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``(node, component)`` for links ``(a, b)`` of longs; a component is its smallest node.

    Each round every node points to its smallest neighbour, pointers are followed to
    their ends, and the links are rewritten between the ends, until none is left. Links
    of a node with itself give nothing; without links the result is empty.
    """
    scratch = scratch or Scratch(links.sparkSession)
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    edges = scratch.keep(both.union(both.select("v", "u").toDF("u", "v")).distinct())
    labels = scratch.keep(edges.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node")))
    while not edges.isEmpty():
        parent = scratch.keep(edges.groupBy("u").agg(F.min("v").alias("p")).where("p < u"))
        while True:
            up = parent.toDF("u2", "p2")
            jumped = scratch.keep(parent.join(up, parent.p == up.u2, "left").select("u", F.coalesce("p2", "p").alias("p"), F.col("p2").isNotNull().alias("moved")))
            done = jumped.where("moved").isEmpty()
            parent = jumped.select("u", "p")
            if done:
                break
        labels = scratch.keep(labels.join(parent, labels.component == parent.u, "left").select("node", F.coalesce("p", "component").alias("component")))
        of_u, of_v = parent.toDF("u1", "p1"), parent.toDF("v2", "p2")
        edges = edges.join(of_u, edges.u == of_u.u1, "left").join(of_v, edges.v == of_v.v2, "left")
        edges = edges.select(F.coalesce("p1", "u").alias("u"), F.coalesce("p2", "v").alias("v")).where("u <> v")
        edges = scratch.keep(edges.distinct())
    return labels
