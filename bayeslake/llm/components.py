"""Connected components of a graph given as a table of links.

Each round hooks every vertex to its least neighbour, follows the pointers to
their roots, doubling the way with every step, and contracts the graph. A root
that no one hooked to has a smaller neighbour in the next round, so two rounds
at least halve the vertices, and rounds and steps grow with the logarithm of
their number. Nothing of the graph reaches the driver; hubs
are joined on, never grouped into lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every vertex that has a link to another one;
    component is the least id reachable. Loops and repeated links do not
    matter; rows with a NULL end are no links."""
    x, y = F.col(a), F.col(b)
    rest = stored(links.where(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct(), "links")
    labels = None
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("up"))
        hook = stored(hook, "hooks")
        up, moving = hook, True
        while moving:
            step = (up.join(up.select(F.col("id").alias("up"), F.col("up").alias("top")), "up")
                    .select("id", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            step = stored(step, "pointers")
            up, moving = step.select("id", "up"), not step.where("moved").isEmpty()
        if labels is None:
            labels = up.withColumnRenamed("up", "component")
        else:
            labels = (labels.join(up.withColumnRenamed("id", "component"), "component", "left")
                      .select("id", F.coalesce("up", "component").alias("component")))
        labels = stored(labels, "labels")
        moved = (rest.join(up.select(F.col("id").alias("a"), F.col("up").alias("a2")), "a")
                 .join(up.select(F.col("id").alias("b"), F.col("up").alias("b2")), "b")
                 .where(F.col("a2") != F.col("b2"))
                 .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
        rest = stored(moved, "links")
    if labels is None:
        return rest.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
