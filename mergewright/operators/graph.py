"""Connected components of an edge list, without collecting it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut as _cut
from ..plans.tables import drop


def connected_components(edges: DataFrame, left: str = "left_id", right: str = "right_id", cut: Callable[[DataFrame], DataFrame] = _cut) -> DataFrame:
    """edges -> node, root: every node of an edge with the smallest node of its component.

    Each round hooks every node to its smallest neighbour, follows the hooks four steps on, and contracts the edges to what is
    left between the roots; the minima are pre-aggregated, so a node with very many edges costs no more than others. The edges are computed once.
    Every table of a round is cut and deleted with the next, and its size falls geometrically. Edges with a null end are ignored; a loop makes its
    node a component. Nodes are of any type that has an order."""
    both = cut(edges.select(F.col(left).alias("x"), F.col(right).alias("y")).where("x is not null and y is not null"))
    labels = cut(both.select(F.explode(F.array("x", "y")).alias("node")).distinct().select("node", F.col("node").alias("root")))
    e = cut(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct())
    drop(both)
    while e.take(1):
        first = cut(e.groupBy(F.col("b").alias("child")).agg(F.min("a").alias("parent")))
        hook = first
        for _ in range(2):
            up = hook.select(F.col("child").alias("c2"), F.col("parent").alias("p2"))
            hook = hook.join(up, F.col("parent") == F.col("c2"), "left").select("child", F.coalesce("p2", "parent").alias("parent"))
        hook = cut(hook)
        to = lambda df, c, h: df.join(hook.select(F.col("child").alias(h), F.col("parent").alias(h + "p")), F.col(c) == F.col(h), "left").withColumn(c, F.coalesce(h + "p", c)).drop(h, h + "p")  # noqa: B023, E731
        ends = to(to(e, "a", "h1"), "b", "h2")
        old = (e, labels, first, hook)
        e = cut(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
        labels = cut(to(labels, "root", "h3"))
        drop(*old)
    drop(e)
    return labels
