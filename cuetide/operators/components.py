"""Connected components of links, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def components(links: DataFrame, group: str, a: str = "a", b: str = "b") -> DataFrame:
    """``group, id, component``: every node of ``links`` with the least node that it reaches within its group.

    Each round a node takes the least label around it, then the label that this label has (pointer jumping), so
    rounds are about the logarithm of a component's length. A hub's neighbours are reduced map-side before the
    shuffle, and each round is a written table.
    """
    both = links.select(group, F.col(a).alias("x"), F.col(b).alias("y")).unionAll(links.select(group, b, a)).where("x <> y").distinct()
    both = written(both, "links")
    labels = written(both.groupBy(group, "x").agg(F.least(F.min("y"), F.col("x")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("x", "y"), [group, "y"]).groupBy(group, "x").agg(F.min("label").alias("near"))
        step = labels.join(near, [group, "x"]).select(group, "x", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = step.select(F.col(group), F.col("x").alias("at"), F.col("label").alias("far"))
        step = step.join(jump.withColumnRenamed("at", "label"), [group, "label"], "left")
        labels = written(step.select(group, "x", F.least("label", "far").alias("label"), "was"), "labels")
        if not labels.where("label <> was").limit(1).count():
            return labels.select(group, F.col("x").alias("id"), F.col("label").alias("component"))
        labels = labels.drop("was")
