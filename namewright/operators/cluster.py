"""Clustering (C rows), relational where semantics allow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.sources.shared import written


def connected(links: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, node, label): components of a link table within groups; label is the smallest node.

    Each round takes the smallest label among neighbours and then the label's label, so
    rounds grow with the logarithm of the diameter; every round is a written table.
    """
    both = written(links.select(*by, F.col(a).alias("a"), F.col(b).alias("b")).unionAll(links.select(*by, F.col(b).alias("a"), F.col(a).alias("b"))).distinct(), "links")
    labels = written(both.groupBy(*by, F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "a"), [*by, "a"]).groupBy(*by, F.col("b").alias("node")).agg(F.min("label").alias("heard"))
        step = written(labels.join(near, [*by, "node"]).select(*by, "node", F.least("label", "heard").alias("label"), F.col("label").alias("old")), "near")
        far = step.select(*by, F.col("node").alias("label"), F.col("label").alias("next"))
        done = written(step.join(far, [*by, "label"]).select(*by, "node", F.least("label", "next").alias("label"), "old"), "jumped")
        if done.where("label <> old").isEmpty():
            return done.select(*by, "node", "label")
        labels = done.select(*by, "node", "label")


def dbscan(points: DataFrame, distances: DataFrame, by: list[str], key: str, eps: float = 0.2, least: int = 4) -> DataFrame:
    """DBSCAN on a distance table (by, a, b, d) with both directions; label -1 is noise.

    A point with ``least`` neighbours within ``eps``, itself included, is core; clusters
    are components of core points; a border point joins its smallest core's cluster. The
    label is the smallest core key of the cluster.
    """
    near = written(distances.where((F.col("d") <= eps) & (F.col("a") != F.col("b"))).select(*by, "a", "b"), "near-pairs")
    core = near.groupBy(*by, "a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") + 1 >= least).select(*by, F.col("a").alias("node"))
    core = written(core, "core")
    links = near.join(core.withColumnRenamed("node", "a"), [*by, "a"]).join(core.withColumnRenamed("node", "b"), [*by, "b"])
    labels = connected(links.unionByName(core.select(*by, F.col("node").alias("a"), F.col("node").alias("b"))), by, "a", "b")
    border = near.join(labels.withColumnRenamed("node", "b"), [*by, "b"]).groupBy(*by, F.col("a").alias(key)).agg(F.min_by("label", "b").alias("border"))
    out = points.select(*by, key).join(labels.withColumnRenamed("node", key), [*by, key], "left").join(border, [*by, key], "left")
    return out.select(*by, key, F.coalesce("label", "border", F.lit(-1)).alias("label"))


def attach_outliers(labels: DataFrame, scores: DataFrame, by: list[str], key: str, least: float = 1.5) -> DataFrame:
    """Each outlier joins the cluster of its best scored member if the score is high enough, else a cluster of its own.

    ``scores`` is (by, a, b, score) with the outlier as a. A cluster of its own is named
    -(key + 2), which no cluster label uses.
    """
    members = labels.where("label <> -1").select(*by, F.col(key).alias("b"), F.col("label").alias("to"))
    outliers = labels.where("label = -1").select(*by, F.col(key).alias("a"))
    best = scores.join(outliers, [*by, "a"]).join(members, [*by, "b"]).groupBy(*by, "a").agg(F.max("score").alias("score"), F.min_by("to", F.struct((-F.col("score")).alias("s"), F.col("b").alias("b"))).alias("to"))
    joined = labels.join(best.withColumnRenamed("a", key), [*by, key], "left")
    own = -(F.col(key) + 2)
    return joined.select(*by, key, F.when(F.col("label") != -1, F.col("label")).when(F.col("score") >= least, F.col("to")).otherwise(own).alias("label"))


def relabel_in_order(labels: DataFrame, scores: DataFrame, by: list[str], key: str, least: float = 1.5) -> DataFrame:
    """For outlier pairs of high score, in order of (a, b), b takes the label that a has then; the last writer wins.

    The last writer of b is its largest a. What a hands on came from the largest partner
    below a, the last to write to it before its turn, and so on down to a row without a
    smaller partner, which hands on its own label. These chains are followed by doubling,
    so rounds grow with the logarithm of their length and no block is held by a task.
    """
    known = labels.select(*by, key)
    pairs = scores.where((F.col("score") >= least) & (F.col("a") != F.col("b"))).select(*by, "a", "b")
    pairs = written(pairs.join(known.withColumnRenamed(key, "a"), [*by, "a"], "left_semi").join(known.withColumnRenamed(key, "b"), [*by, "b"], "left_semi"), "outlier-pairs")
    chain = written(pairs.where("a < b").groupBy(*by, F.col("b").alias("node")).agg(F.max("a").alias("to")), "writers")
    while True:
        far = chain.select(*by, F.col("node").alias("to"), F.col("to").alias("next"))
        step = written(chain.join(far, [*by, "to"], "left").select(*by, "node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "writers")
        chain = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    last = pairs.groupBy(*by, F.col("b").alias(key)).agg(F.max("a").alias("node")).join(chain, [*by, "node"], "left")
    last = last.select(*by, key, F.coalesce("to", "node").alias("giver"))
    given = last.join(labels.select(*by, F.col(key).alias("giver"), F.col("label").alias("given")), [*by, "giver"]).select(*by, key, "given")
    return labels.join(given, [*by, key], "left").withColumn("label", F.coalesce("given", "label")).select(*labels.columns)


def clusters(labels: DataFrame, by: list[str], key: str) -> DataFrame:
    """Members of each cluster."""
    return labels.groupBy(*by, "label").agg(F.sort_array(F.collect_list(key)).alias("members"))
