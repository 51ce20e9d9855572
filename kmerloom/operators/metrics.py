"""Ranking metrics by group: ROC and precision-recall, with ties.

Rows are counted per distinct score first; running counts over the scores of a
group go through slots of its quantiles, so no task holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.plans.ranks import by_quantile, running_sums


def _cutoffs(scored: DataFrame, group: str) -> DataFrame:
    y = F.col("label").cast("int")
    return scored.where("score is not null and label is not null").groupBy(group, "score").agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def _running(scored: DataFrame, group: str) -> DataFrame:
    """group, score, pos, neg at each distinct score; pos_above, neg_above: those of higher scores."""
    c = by_quantile(_cutoffs(scored, group), "score", group).withColumn("_slot", -F.col("_slot"))
    return running_sums(c, "_slot", [F.col("score").desc()], {"pos_above": "pos", "neg_above": "neg"}, [group]).drop("_slot")


def auroc(scored: DataFrame, group: str = "fold") -> DataFrame:
    """(group, score, label 0/1) -> group, auroc: the rank sum with average ranks; null without both classes."""
    p, n = F.sum("pos"), F.sum("neg")
    # a negative loses against the positives above it and draws with those of its score
    won = F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2))
    return _running(scored, group).groupBy(group).agg(F.when((p > 0) & (n > 0), won / (p * n)).alias("auroc"))


def curve(scored: DataFrame, group: str = "fold") -> DataFrame:
    """group, score, tpr, fpr, precision at each distinct cutoff (score or higher is positive)."""
    c = _running(scored, group)
    totals = c.groupBy(group).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).withColumnRenamed(group, "_g")
    c = c.join(totals, F.col(group).eqNullSafe(F.col("_g")))
    tp, fp = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg")
    share = lambda a, b: F.when(F.col(b) > 0, a / F.col(b))
    return c.select(group, "score", share(tp, "p").alias("tpr"), share(fp, "n").alias("fpr"), (tp / (tp + fp)).alias("precision"))


def auprc(scored: DataFrame, group: str = "fold") -> DataFrame:
    """group, auprc: the sum over cutoffs of the recall gained times the precision there; null without positives."""
    tp, fp = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg")
    area = F.sum(F.col("pos") * tp / (tp + fp))
    return _running(scored, group).groupBy(group).agg(F.when(F.sum("pos") > 0, area / F.sum("pos")).alias("auprc"))


def best_setting(table: DataFrame, by: str = "auroc", index: str = "idx") -> DataFrame:
    """The row of the highest value; the first on ties."""
    return table.orderBy(F.col(by).desc(), index).limit(1)
