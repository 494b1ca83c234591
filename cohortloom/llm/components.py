"""Connected components of an edge table, by least labels that hook onto one another, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.sources.store import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """node, component for every end of ``edges`` (columns a, b, integers): the least node reachable, itself included."""
    pairs = checkpointed(edges.where("a <> b").selectExpr("a AS node", "b AS other").unionAll(edges.where("a <> b").selectExpr("b", "a")).distinct())
    labels = checkpointed(pairs.groupBy("node").agg(F.least(F.min("node"), F.min("other")).alias("label")))
    while True:
        # Every edge whose ends disagree tells the lower label to its end and to the label that end has so far.
        far = labels.select(F.col("node").alias("other"), F.col("label").alias("far"))
        met = pairs.join(far, "other").join(labels, "node").where("far < label")
        told = checkpointed(met.select(F.explode(F.array("node", "label")).alias("node"), "far").groupBy("node").agg(F.min("far").alias("far")))
        if not told.limit(1).count():
            return labels.withColumnRenamed("label", "component")
        nearer = labels.join(told, "node", "left").select("node", F.least("label", "far").alias("label"))
        jump = nearer.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = checkpointed(nearer.join(jump, "label", "left").select("node", F.least("label", "further").alias("label")))
