"""Connected components as DataFrame iterations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of ``edges`` (a, b): label is the least vertex reachable.

    Each round takes the least label among the neighbours and then jumps to that label's own label, so long chains
    shorten quickly; rounds are written to the shared folder, and only a count of changes reaches the driver.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        heard = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, labels["v"] == heard["a"]).select("v", "label", F.least("label", "heard").alias("next"))
        jump = labels.select(F.col("v").alias("next"), F.col("label").alias("far"))
        found = cut(nearer.join(jump, "next", "left").select("v", F.least("next", F.coalesce("far", "next")).alias("new"), "label"), "labels")
        drop(labels)
        labels = found.select("v", F.col("new").alias("label"))
        labels.cut_path = found.cut_path
        if found.filter("new <> label").limit(1).count() == 0:
            drop(both)
            return labels
