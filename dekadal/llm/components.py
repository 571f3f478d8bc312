"""Connected components of an edge table, with labels that only ever fall and are followed to their own labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import saved


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (x, y); component is the least node that links reach.

    Each round takes the least label among the neighbours and then that label's own label, so long paths shorten by
    half a round, until no label falls any more. Rounds are written to the shared folder, which cuts the lineage. Hubs are
    no hot keys: minima combine before they are shuffled, and the joins are plain ones, which the adaptive skew join can
    split. No edges, no rows; an edge to itself counts for nothing; null ends are links to nothing.
    """
    both = saved(edges.select("x", "y").union(edges.select("y", "x")).where("x <> y").distinct(), "cc-edges")
    labels = saved(both.groupBy(F.col("x").alias("node")).agg(F.least(F.first("x"), F.min("y")).alias("component")), "cc-labels")
    while True:
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("component").alias("near"))
        step = labels.join(near, F.col("node") == F.col("x")).select("node", "component", F.least("component", "near").alias("low"))
        far = labels.select(F.col("node").alias("low"), F.col("component").alias("jump"))
        low = F.least("low", "jump")
        moved = saved(step.join(far, "low").select("node", low.alias("component"), (low < F.col("component")).alias("changed")), "cc-labels")
        labels = moved.select("node", "component")
        if moved.where("changed").isEmpty():
            return labels
