"""Connected components of a link table, wholly as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); label is the component's smallest node.

    Each round takes the smallest label among neighbours, then follows labels once
    (pointer jumping), so rounds grow with the logarithm of the diameter. Every round is
    a written table: links and labels are both shuffled for their join, so a node with
    very many links is a skewed side that adaptive execution splits.
    """
    both = written(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        heard = both.join(labels, both["a"] == labels["node"]).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("heard"))
        near = written(labels.join(heard, "node").select("node", F.least("label", "heard").alias("label"), F.col("label").alias("old")), "near")
        far = near.select(F.col("node").alias("at"), F.col("label").alias("next"))
        jumped = written(near.join(far, near["label"] == far["at"]).select("node", F.least("label", "next").alias("label"), "old"), "jumped")
        if jumped.where("label <> old").isEmpty():
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")
