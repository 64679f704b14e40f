"""Connected components by contraction.

In each round every component hooks itself to its smallest neighbour if that is smaller, pointer
jumping flattens the hooks, and the links between what is left form the next, smaller graph. Every
component with a link is merged, so their number at least halves in a round. The smallest node of
a component is its name.

Links are only grouped with partial minima and joined, so a node with any number of links is no
bottleneck, and only the emptiness of a table reaches the driver. Each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` of each node of ``links`` (``a, b``)."""
    left = materialize(links.filter("a <> b").select("a", "b").distinct(), "links")
    labels = None
    while labels is None or not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        hooks = materialize(hooks.select("node", F.least("node", "near").alias("root")), "hooks")
        while True:
            above = hooks.select(F.col("node").alias("root"), F.col("root").alias("top"))
            higher = materialize(hooks.join(above, "root").select("node", "top", "root"), "jump")
            hooks = higher.select("node", F.col("top").alias("root"))
            if higher.filter("top <> root").isEmpty():
                break
        if labels is None:
            labels = hooks.withColumnRenamed("root", "component")
        else:
            step = hooks.select(F.col("node").alias("component"), "root")
            labels = labels.join(step, "component", "left").select(
                "node", F.coalesce("root", "component").alias("component")
            )
        labels = materialize(labels, "labels")
        one = hooks.select(F.col("node").alias("a"), F.col("root").alias("x"))
        two = hooks.select(F.col("node").alias("b"), F.col("root").alias("y"))
        left = left.join(one, "a").join(two, "b").filter("x <> y")
        left = materialize(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return labels
