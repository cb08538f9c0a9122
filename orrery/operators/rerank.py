"""Agreement scores of verdicts, and re-ranking with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from orrery.operators.retrieval import minmax, ranked


def agreement(verdicts: DataFrame, policy: str = "drop", weights: DataFrame | None = None) -> DataFrame:
    """fact, hyp, tag, agree from (fact, hyp, tag, dimension, verdict); null verdicts abstain.

    "drop": share among the rulings, null without any; "negative": abstentions count
    0; "neutral": they count one half; "strict": like negative, over all dimensions;
    "weighted": rulings weighted by ``weights`` (dimension[, fact, hyp], weight).
    """
    v = F.col("verdict").cast("double")
    by = ["fact", "hyp", "tag"]
    if policy == "weighted":
        on = [c for c in ("fact", "hyp", "dimension") if c in weights.columns]
        rows = verdicts.join(weights, on)
        w = F.when(v.isNotNull(), F.col("weight"))
        return rows.groupBy(*by).agg(F.try_divide(F.sum(w * v), F.sum(w)).alias("agree"))
    return verdicts.groupBy(*by).agg(_mean(policy).alias("agree"))


def _mean(policy: str) -> Column:
    v = F.col("verdict").cast("double")
    return F.avg({"drop": v, "negative": F.coalesce(v, F.lit(0.0)), "strict": F.coalesce(v, F.lit(0.0)), "neutral": F.coalesce(v, F.lit(0.5))}[policy])


def agreements(verdicts: DataFrame, policies: list[str]) -> DataFrame:
    """policy, fact, hyp, tag, agree of several policies, none of them "weighted", from one aggregate."""
    each = verdicts.groupBy("fact", "hyp", "tag").agg(*[_mean(p).alias(p) for p in policies])
    one = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.col(p).alias("agree")) for p in policies])).alias("p")
    return each.select("fact", "hyp", "tag", one).select("p.policy", "fact", "hyp", "tag", "p.agree")


def hybrid_verdicts(model: DataFrame, symbolic: DataFrame) -> DataFrame:
    """The model's verdict where it rules, else the symbolic one."""
    by = ["fact", "hyp", "tag", "dimension"]
    return symbolic.withColumnRenamed("verdict", "s").join(model.withColumnRenamed("verdict", "m"), by, "full_outer").select(*by, F.coalesce("m", "s").alias("verdict"))


def variance_weights(verdicts: DataFrame) -> DataFrame:
    """fact, hyp, dimension, weight: the population variance of the rulings of each
    dimension in its window; equal weights where none varies."""
    by = W.partitionBy("fact", "hyp")
    rows = verdicts.groupBy("fact", "hyp", "dimension").agg(F.coalesce(F.var_pop(F.col("verdict").cast("double")), F.lit(0.0)).alias("v"))
    return rows.withColumn("weight", F.when(F.max("v").over(by) > 0, F.col("v")).otherwise(F.lit(1.0))).drop("v")


def consensus(pool: DataFrame, agree: DataFrame, hyps: DataFrame, fill: str = "zero") -> DataFrame:
    """``pool`` (fact, tag, ...) with consensus, the mean agreement over a fact's
    hypotheses (fact, hyp); candidates without a score get 0 or, with ``fill``
    "mean", the mean of their hypothesis' scores."""
    grid = pool.select("fact", "tag").join(hyps, "fact").join(agree, ["fact", "hyp", "tag"], "left")
    mean = F.avg("agree").over(W.partitionBy("fact", "hyp")) if fill == "mean" else F.lit(0.0)
    filled = grid.withColumn("agree", F.coalesce("agree", mean, F.lit(0.0)))
    return pool.join(filled.groupBy("fact", "tag").agg(F.avg("agree").alias("consensus")), ["fact", "tag"])


def blend(pool: DataFrame, beta, tied: float = 0.0) -> DataFrame:
    """final = scaled base score + beta * consensus; order by it, then by tag."""
    rows = pool.withColumn("norm", minmax(F.col("score"), ["fact"], tied)).withColumn("final", F.col("norm") + F.lit(beta) * F.col("consensus"))
    return ranked(rows, ["fact"], [F.desc(F.round("final", 9)), F.col("tag")])


def rerank_share(pool: DataFrame, beta: float) -> DataFrame:
    """How far the consensus can move candidates against the base score; null for a flat base."""
    spread = lambda c: F.max(c) - F.min(c)
    return pool.groupBy("fact").agg(F.try_divide(beta * spread("consensus"), F.nullif(spread("score"), F.lit(0.0))).alias("share"))
