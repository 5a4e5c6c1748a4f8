"""Evaluation metrics from grouped counts (E rows); no self-join over members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namewright.operators.ranking import running


def pairs_of(n: Column) -> Column:
    return n * (n - 1) / 2


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def over(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def pairwise(df: DataFrame, name: str, truth: str, pred: str) -> DataFrame:
    """Pairwise precision, recall and F1 per name, from contingency counts; all 0 if no pair is right."""
    cell = df.groupBy(name, truth, pred).agg(F.count(F.lit(1)).alias("n"))
    tp = cell.groupBy(name).agg(F.sum(pairs_of(F.col("n"))).alias("tp"))
    side = lambda c, out: cell.groupBy(name, c).agg(F.sum("n").alias("n")).groupBy(name).agg(F.sum(pairs_of(F.col("n"))).alias(out))
    out = tp.join(side(pred, "pp"), name).join(side(truth, "tt"), name)
    p, r = over(F.col("tp"), F.col("pp")), over(F.col("tp"), F.col("tt"))
    return out.select(name, p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def weighted(truth: DataFrame, pred: DataFrame, aid: str, pid: str) -> DataFrame:
    """Precision and recall of assignments, weighted by each person's share of true papers."""
    both = truth.join(pred, [aid, pid]).groupBy(aid).agg(F.count(F.lit(1)).alias("hit"))
    t, p = truth.groupBy(aid).agg(F.count(F.lit(1)).alias("t")), pred.groupBy(aid).agg(F.count(F.lit(1)).alias("p"))
    rows = t.join(p, aid, "left").join(both, aid, "left").fillna(0, ["p", "hit"])
    rows = rows.groupBy().agg(F.sum("t").alias("total"), F.sum(F.col("t") * over(F.col("hit"), F.col("p"))).alias("wp"), F.sum("hit").alias("wr"))
    p_, r_ = F.col("wp") / F.col("total"), F.col("wr") / F.col("total")
    return rows.select(p_.alias("precision"), r_.alias("recall"), f1(p_, r_).alias("f1"))


def macro(truth: DataFrame, pred: DataFrame, aid: str, pid: str) -> DataFrame:
    """Per person overlap / truth and overlap / prediction; the F score is symmetric in the two."""
    both = truth.join(pred, [aid, pid]).groupBy(aid).agg(F.count(F.lit(1)).alias("hit"))
    t, p = truth.groupBy(aid).agg(F.count(F.lit(1)).alias("t")), pred.groupBy(aid).agg(F.count(F.lit(1)).alias("p"))
    rows = t.join(p, aid, "full").join(both, aid, "left").fillna(0, ["t", "p", "hit"])
    of_t, of_p = F.col("hit") / (F.col("t") + 1e-20), F.col("hit") / (F.col("p") + 1e-20)
    rows = rows.select(of_t.alias("a"), of_p.alias("b"), (2 * of_t * of_p / (of_t + of_p + 1e-20)).alias("f"))
    return rows.agg(F.avg("a").alias("of_truth"), F.avg("b").alias("of_prediction"), F.avg("f").alias("f1"))


def hits_mrr(df: DataFrame, slot: str, score: str, tie: str, positive: Column) -> DataFrame:
    """Hits at 1, 3 and 5 and mean reciprocal rank of each slot's positive."""
    rank = F.row_number().over(Window.partitionBy(slot).orderBy(F.desc(score), tie))
    return of_ranks(df.withColumn("rank", rank).where(positive))


def of_ranks(found: DataFrame) -> DataFrame:
    """E04 from the positives' ranks."""
    return found.agg(*[F.avg((F.col("rank") <= k).cast("int")).alias(f"hits_{k}") for k in (1, 3, 5)], F.avg(1 / F.col("rank")).alias("mrr"))


def auc_ap(df: DataFrame, profile: str, label: str, score: str, tie: str) -> DataFrame:
    """AUC (average ranks for ties) and average precision per profile, averaged with weight = positives.

    ``label`` 1 marks what the score should rank high. Profiles with one class are left out.
    A profile may be of any size: places are running counts over ranges of the order.
    """
    placed = running(df.select(profile, label, score, tie), [profile], [F.desc(score), tie], {"place": F.lit(1).cast("bigint"), "seen": F.col(label).cast("bigint")})
    # Equal scores share the mean of their ranks from below, n + 1 less the mean of their places.
    same = placed.groupBy(profile, score).agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"), (F.max("place") - (F.count(F.lit(1)) - 1) / 2).alias("mean_place"), F.sum(F.when(F.col(label) == 1, F.col("seen") / F.col("place"))).alias("ap")
    )
    per = same.groupBy(profile).agg(
        F.sum("pos").alias("pos"), (F.sum("n") - F.sum("pos")).alias("neg"), ((F.sum("n") + 1) * F.sum("pos") - F.sum(F.col("pos") * F.col("mean_place"))).alias("rs"), (F.sum("ap") / F.sum("pos")).alias("ap")
    ).where("pos > 0 and neg > 0")
    auc = (F.col("rs") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg"))
    return per.agg((F.sum(auc * F.col("pos")) / F.sum("pos")).alias("auc"), (F.sum(F.col("ap") * F.col("pos")) / F.sum("pos")).alias("ap"))


def accuracy_f1(df: DataFrame, profile: str, label: str, score: str, cut: float = 0.5) -> DataFrame:
    """Accuracy and F1 at a threshold per profile, averaged with weight = positives."""
    hit = (F.col(score) >= cut).cast("int")
    per = df.groupBy(profile).agg(
        F.avg((hit == F.col(label)).cast("int")).alias("acc"), F.sum(hit * F.col(label)).alias("tp"), F.sum(hit).alias("pp"), F.sum(label).alias("pos")
    )
    f = F.when(F.col("pp") + F.col("pos") == 0, 0.0).otherwise(2 * F.col("tp") / (F.col("pp") + F.col("pos")))
    return per.where("pos > 0").agg((F.sum(F.col("acc") * F.col("pos")) / F.sum("pos")).alias("accuracy"), (F.sum(f * F.col("pos")) / F.sum("pos")).alias("f1"))


def incomplete(truth: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side alone, with the side; empty if a prediction is complete."""
    t, p = truth.select(*keys).distinct(), pred.select(*keys).distinct()
    return t.join(p, keys, "left_anti").withColumn("only_in", F.lit("truth")).unionAll(p.join(t, keys, "left_anti").withColumn("only_in", F.lit("prediction")))


def require_complete(truth: DataFrame, pred: DataFrame, keys: list[str]) -> None:
    """Raises if a key is missing on either side."""
    if bad := incomplete(truth, pred, keys).take(1):
        raise ValueError(f"prediction and truth differ, first at {bad[0].asDict()}")
