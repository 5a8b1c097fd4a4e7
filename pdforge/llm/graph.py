"""Connected components of an edge table, in DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pdforge.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over ``edges`` (a, b), for ids that have an edge.

    Each round takes the smallest label among the neighbours and then the label of the label; a hub with very many
    neighbours is a partial minimum per task and a join that Spark may split.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("l")), "cc-labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("l").alias("m"))
        step = stored(labels.join(near, F.col("id") == F.col("a")).select("id", F.least("l", "m").alias("l"),
                                                                          (F.col("m") < F.col("l")).alias("moved")), "cc-step")
        hop = step.select(F.col("id").alias("_i"), F.col("l").alias("_l"))
        labels = stored(step.join(hop, F.col("l") == F.col("_i")).select("id", F.least("l", "_l").alias("l"), "moved"), "cc-labels")
        if labels.where("moved").isEmpty():
            return labels.select("id", F.col("l").alias("component"))
