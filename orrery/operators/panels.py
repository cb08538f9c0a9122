"""Panels that tell how well rulings support what is right, with intervals over resampled contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orrery.operators.metrics import auroc, average_precision
from orrery.operators.resample import auroc_draws, bounds, numbered, resampled
from orrery.session import staged

DRAWS = 2000


def _resampled_sums(rows: DataFrame, context: str, sums: list[str], draws: int) -> DataFrame:
    """draw and ``sums`` over resampled contexts."""
    per = rows.groupBy(context).agg(*[F.sum(c).alias(c) for c in sums])
    return resampled(per.join(numbered(rows, context), context).select("at", *sums), sums, draws)


def _interval(samples: DataFrame, name: str) -> DataFrame:
    """One row: mean and bounds of ``statistic`` over the draws that have one."""
    return samples.agg(F.round(F.avg("statistic"), 6).alias(f"{name}_mean"), *bounds("statistic", name))


def support_panel(calls: DataFrame, draws: int = DRAWS) -> DataFrame:
    """One row: how much more rulings support gold candidates than others of the same calls.

    ``calls``: context, gold_yes, gold_all, other_yes, other_all (how many rulings of a call
    are there and support).  Rates are over all rulings; paired gaps over calls that rule on
    both; the gap's interval is over contexts drawn with replacement, since calls of one
    context are alike.
    """
    calls = staged(calls.select("context", "gold_yes", "gold_all", "other_yes", "other_all"), "calls")
    gold, other = F.try_divide(F.sum("gold_yes"), F.sum("gold_all")), F.try_divide(F.sum("other_yes"), F.sum("other_all"))
    pair = F.when((F.col("gold_all") > 0) & (F.col("other_all") > 0), F.col("gold_yes") / F.col("gold_all") - F.col("other_yes") / F.col("other_all"))
    one = calls.withColumn("pair", pair).agg(
        F.count("*").alias("calls"), F.coalesce(F.sum("gold_all"), F.lit(0)).alias("gold_judgements"), F.coalesce(F.sum("other_all"), F.lit(0)).alias("other_judgements"),
        F.round(gold, 6).alias("gold_support"), F.round(other, 6).alias("other_support"), F.round(gold - other, 6).alias("gap"),
        F.count("pair").alias("paired"), F.round(F.avg("pair"), 6).alias("paired_gap"), F.round(F.avg(F.when(F.col("pair").isNotNull(), F.when(F.col("pair") > 0, 100.0).otherwise(0.0))), 3).alias("favouring"),
    )
    drawn = _resampled_sums(calls, "context", ["gold_yes", "gold_all", "other_yes", "other_all"], draws)
    ratio = lambda a, b: F.try_divide(F.col(a), F.nullif(F.col(b), F.lit(0)))
    return one.crossJoin(_interval(drawn.withColumn("statistic", ratio("gold_yes", "gold_all") - ratio("other_yes", "other_all")), "gap"))  # one row each


def calibration_panel(observed: DataFrame, draws: int = DRAWS) -> DataFrame:
    """One row: whether low support tells that a hypothesis is wrong.

    ``observed``: context, key (one for each row), support (0 to 1, null where rulings
    abstain), wrong.  AUROC and average precision rank by 1 less support; intervals
    of the difference in support and of the area over one half are over contexts drawn
    with replacement, of draws that have both kinds.
    """
    rows = staged(observed.select("context", "key", "support", "wrong"), "observed")
    judged = rows.where("support is not null").withColumn("doubt", 1 - F.col("support"))
    share = lambda c: F.try_divide(F.count(F.when(c, 1)), F.count("*"))
    mean = lambda c: F.avg(F.when(c, F.col("support")))
    wrong, ruled = F.col("wrong"), F.col("support").isNotNull()
    one = rows.agg(
        F.count("*").alias("n"), F.count("support").alias("judged"), F.round(share(ruled), 6).alias("ruled_share"), F.round(share(wrong), 6).alias("wrong_share"),
        F.round(F.try_divide(F.count(F.when(wrong & ruled, 1)), F.count("support")), 6).alias("wrong_share_judged"),
        F.round(mean(wrong), 6).alias("support_when_wrong"), F.round(mean(~wrong), 6).alias("support_when_right"), F.round(mean(wrong) - mean(~wrong), 6).alias("difference"),
    )
    all_ = judged.withColumn("all", F.lit(1))
    areas = auroc(all_, ["all"], "doubt", "wrong").join(average_precision(all_, ["all"], "doubt", "wrong", "key"), "all").agg(F.round(F.max("auroc"), 6).alias("auroc"), F.round(F.max("average_precision"), 6).alias("average_precision"))
    sums = judged.withColumns({"sw": F.when(wrong, F.col("support")).otherwise(0.0), "nw": wrong.cast("long"), "sr": F.when(wrong, 0.0).otherwise(F.col("support")), "nr": (~wrong).cast("long")})
    drawn = _resampled_sums(sums, "context", ["sw", "nw", "sr", "nr"], draws)
    part = lambda a, b: F.try_divide(F.col(a), F.nullif(F.col(b), F.lit(0)))
    difference = _interval(drawn.withColumn("statistic", part("sw", "nw") - part("sr", "nr")), "difference")
    area = _interval(auroc_draws(judged, "context", "doubt", "wrong", draws).withColumn("statistic", F.col("auroc") - 0.5), "area")
    return one.crossJoin(areas).crossJoin(difference).crossJoin(area)  # one row each
