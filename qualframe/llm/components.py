"""Connected components of an edge table, by spreading the least label and jumping along labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualframe.llm.scratch import store


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the least node of the component; edges (a, b) of any orderable type.

    Each round stores its labels; rounds follow the logarithm of the longest path between two nodes.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct()
    both = store(both, "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    labels = store(labels.select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("to")).agg(F.min("label").alias("near"))
        spread = labels.join(near, F.col("node") == F.col("to")).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        far = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        jumped = spread.join(far, F.col("label") == F.col("via")).select(
            "node", F.least("label", "far").alias("label"), (F.col("old") != F.least("label", "far")).alias("changed")
        )
        done = store(jumped, "labels")
        labels = done.select("node", "label")
        if not done.filter("changed").head(1):
            return labels
