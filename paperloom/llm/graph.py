"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.plans.scratch import cut


def _roots(hooks: DataFrame) -> DataFrame:
    """Follows ``hi -> to`` to its end; ``to`` is always smaller, so there are no circles."""
    while True:
        ahead = hooks.select(F.col("hi").alias("to"), F.col("to").alias("far"))
        jumped = hooks.join(ahead, "to", "left").select("hi", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved"))
        jumped = cut(jumped, "jumped")
        if jumped.where("moved").isEmpty():
            return jumped.drop("moved")
        hooks = jumped.drop("moved")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge to another; the component is its smallest node.

    A round hooks each node to its smallest smaller neighbour, contracts the trees
    and keeps the edges between them; edges within a tree are gone.  Null ends and
    loops are ignored, repeated edges count once, no edges give no rows.
    """
    ends = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    left = cut(ends.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("lo") < F.col("hi"))).distinct(), "edges")
    labels = left.select(F.explode(F.array("lo", "hi")).alias("node")).distinct().select("node", F.col("node").alias("component"))
    while not left.isEmpty():
        to = _roots(left.groupBy("hi").agg(F.min("lo").alias("to")))
        moved = lambda df, c: df.join(to.select(F.col("hi").alias(c), F.col("to").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")  # noqa: B023
        labels = cut(moved(labels, "component"), "labels")
        left = moved(moved(left, "lo"), "hi").select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"))
        left = cut(left.where("lo < hi").distinct(), "edges")
    return labels
