"""Ranking metrics, set matching and classification measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from orrery.functions.text import jaccard
from orrery.operators.fusion import rank_gain
from orrery.operators.stats import placed

DEPTHS = (1, 5, 10, 50)


def first_gold_rank(rankings: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """``by``, gold_rank: the smallest rank of a gold tag (fact, gold); null where absent."""
    rows = rankings.join(gold, "fact")
    return rows.groupBy(*by).agg(F.min(F.when(F.col("tag") == F.col("gold"), F.col("rank"))).alias("gold_rank"))


def rank_metrics(gold_rank: Column, depths=DEPTHS) -> list[Column]:
    """n, accuracy, mrr and recall at each depth as means over rows; absent gold counts 0."""
    hit = lambda k: F.avg(F.when(gold_rank <= k, 1.0).otherwise(0.0))
    return [F.count("*").alias("n"), F.round(hit(1), 6).alias("accuracy"), F.round(F.avg(rank_gain(gold_rank)), 6).alias("mrr"), *[F.round(hit(k), 6).alias(f"recall_at_{k}") for k in depths]]


def precision_recall(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset matching on ``keys``: tp, gold, predicted, precision, recall, f1; empty denominators give 0."""
    g = gold.groupBy(*keys).agg(F.count("*").alias("g"))
    p = predicted.groupBy(*keys).agg(F.count("*").alias("p"))
    both = g.join(p, keys, "full_outer").select(F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("p", F.lit(0)).alias("p"))
    sums = both.agg(F.coalesce(F.sum(F.least("g", "p")), F.lit(0)).alias("tp"), F.coalesce(F.sum("g"), F.lit(0)).alias("gold"), F.coalesce(F.sum("p"), F.lit(0)).alias("predicted"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rates = sums.withColumn("precision", zero(F.try_divide("tp", "predicted"))).withColumn("recall", zero(F.try_divide("tp", "gold")))
    return rates.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def confusion(fired: Column, truth: Column) -> list[Column]:
    """Counts and rates of a signal (null: abstains) against the truth."""
    count = lambda c: F.count(F.when(c, 1))
    tp, fp, fn = count(fired & truth), count(fired & ~truth), count(truth & (fired.isNull() | ~fired))
    issued, n, pos = count(fired), F.count("*"), count(truth)
    precision, recall = F.try_divide(tp, issued), F.try_divide(tp, pos)
    return [
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), issued.alias("issued"),
        F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(F.try_divide(2 * tp, issued + pos), 6).alias("f1"),
        F.round(F.try_divide(pos, n), 6).alias("base_rate"), F.round(F.try_divide(precision, F.try_divide(pos, n)), 6).alias("lift"), F.round(F.try_divide(count(fired.isNotNull()), n), 6).alias("coverage"),
    ]


def auroc(rows: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve by the rank sum with middle ranks for ties; null for one class.

    Equal scores are counted before they are ordered, so the windows hold one row
    for each distinct score.
    """
    pos = F.sum(F.col(label).cast("long"))
    binned = rows.groupBy(*by, score).agg(F.count("*").alias("n"), pos.alias("p"))
    w = W.partitionBy(*by).orderBy(score)
    mid = F.sum("n").over(w) - F.col("n") + (F.col("n") + 1) / 2.0
    sums = binned.withColumn("mid", mid).groupBy(*by).agg(F.sum(F.col("p") * F.col("mid")).alias("s"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.select(*by, F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2.0, F.nullif((F.col("p") * (F.col("n") - F.col("p"))).cast("double"), F.lit(0.0))).alias("auroc"))


def average_precision(rows: DataFrame, by: list[str], score: str, label: str, order: str) -> DataFrame:
    """Mean precision at each positive, by falling score; ``order`` breaks ties; null without positives.

    A positive's precision is its place among positives over its place among all, so
    ranges are ordered by many tasks.
    """
    all_ = rows.select(*by, (-F.col(score)).alias("_down"), order, F.col(label).cast("boolean").alias("_y"))
    hits = placed(all_, by, ["_down", order], "_r").where("_y")
    mean = placed(hits, by, ["_down", order], "_h").groupBy(*by).agg(F.avg(F.col("_h") / F.col("_r")).alias("average_precision"))
    return rows.select(*by).distinct().join(mean, by, "left")


def pairwise_jaccard(lists: DataFrame) -> DataFrame:
    """fact, mean_jaccard over all pairs of a fact's lists (fact, list, tags)."""
    a, b = lists.alias("a"), lists.alias("b")
    pairs = a.join(b, (F.col("a.fact") == F.col("b.fact")) & (F.col("a.list") < F.col("b.list")))
    return pairs.groupBy(F.col("a.fact").alias("fact")).agg(F.avg(jaccard(F.col("a.tags"), F.col("b.tags"), 0.0)).alias("mean_jaccard"))


def novelty(rounds: DataFrame, by: str, order: str, tokens: str) -> DataFrame:
    """``by``, ``order``, novelty: one minus the greatest Jaccard similarity with any earlier round, 1 for the first."""
    a, b = rounds.alias("a"), rounds.alias("b")
    sim = jaccard(F.col(f"a.{tokens}"), F.col(f"b.{tokens}"), 1.0)
    pairs = a.join(b, (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col(f"b.{order}") < F.col(f"a.{order}")), "left")
    return pairs.groupBy(F.col(f"a.{by}").alias(by), F.col(f"a.{order}").alias(order)).agg((1 - F.coalesce(F.max(F.when(F.col(f"b.{by}").isNotNull(), sim)), F.lit(0.0))).alias("novelty"))
