"""Ablations: configurations by hypotheses, renderings and aggregation under several fusions, each against a baseline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from orrery.operators.arms import METRICS, by_modality, resampled_groups
from orrery.operators.fusion import fused_ranking
from orrery.operators.resample import bounds
from orrery.session import staged


@dataclass(frozen=True)
class Ablation:
    """What of a fact's rankings a configuration uses: of the lists of ``hyps`` those in ``renderings``, of all
    hypotheses or, with aggregation "select", of the one whose list scores highest."""

    name: str
    hyps: tuple[int, ...]
    renderings: tuple[int, ...] = (0,)
    aggregation: str = "fuse"


VARIANTS = ("sum", "mean")


def ablation_ranks(rankings: DataFrame, scores: DataFrame, gold: DataFrame, configs: list[Ablation], kappa: int = 60) -> DataFrame:
    """config, variant, fact, rank: the first gold rank (null where absent) of every configuration, fused by the
    sum of reciprocal ranks over its lists and by their mean over the lists that hold a tag.

    ``rankings``: fact, hyp, rendering, tag, rank; ``scores``: fact, hyp, score, by which "select" chooses, of equals
    the first hypothesis; ``gold``: fact, gold.  Every row is copied once for each
    configuration that uses it, and both fusions come from one aggregate.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c.name).alias("config"), F.array(*map(F.lit, c.hyps)).alias("hyps"), F.array(*map(F.lit, c.renderings)).alias("renderings"), F.lit(c.aggregation == "select").alias("one")) for c in configs]))
    used = rankings.withColumn("_c", each).select("*", "_c.*").drop("_c").where(F.array_contains("hyps", F.col("hyp")) & F.array_contains("renderings", F.col("rendering")))
    order = F.struct(F.round("score", 12), -F.col("hyp"))
    lists = used.where("one").select("config", "fact", "hyp").distinct().join(scores, ["fact", "hyp"]).groupBy("config", "fact").agg(F.max_by("hyp", order).alias("_best"))
    used = used.join(lists, ["config", "fact"], "left").where(~F.col("one") | (F.col("hyp") == F.col("_best")))
    part, key = 1.0 / (kappa + F.col("rank")), ["config", "fact"]
    place = F.col("hyp") * 1000 + F.col("rendering")
    sums = used.groupBy(*key, "tag").agg(F.sum(part).alias("sum"), F.avg(part).alias("mean"), F.min(place).alias("first_list"), F.min("rank").alias("best_rank"))
    both = sums.withColumn("_v", F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("rrf")) for v in VARIANTS]))).select(*key, "tag", "first_list", "best_rank", "_v.*")
    placed = fused_ranking(both, by=["config", "variant", "fact"]).join(gold, "fact", "left")
    return placed.groupBy("config", "variant", "fact").agg(F.min(F.when(F.col("tag") == F.col("gold"), F.col("rank"))).alias("rank"))


def ablation_table(ranks: DataFrame, baseline: str, context: Column, modality: Column, draws: int) -> DataFrame:
    """config, variant, modality, metric: facts, value and its interval; difference to the baseline of the same
    variant and its interval; how many facts improved, stayed and got worse.

    Intervals are over contexts drawn with replacement, the same draws for all rows of a modality.
    """
    values = F.array(*[F.struct(F.lit(m).alias("metric"), f(F.col("rank")).alias("value")) for m, f in METRICS.items()])
    each = ranks.select("config", "variant", "fact", context.alias("context"), modality.alias("_m"), F.explode(values).alias("v")).select("config", "variant", "fact", "context", "_m", "v.*")
    base = each.where(F.col("config") == baseline).select("variant", "fact", "metric", F.col("value").alias("base"))
    rows = by_modality(each.join(base, ["variant", "fact", "metric"]), F.col("_m")).withColumn("change", F.col("value") - F.col("base"))
    key = ["config", "variant", "modality", "metric"]
    both = rows.withColumn("_k", F.explode(F.array(F.struct(F.lit("value").alias("what"), F.col("value").alias("x")), F.struct(F.lit("difference").alias("what"), F.col("change").alias("x")))))
    per = staged(both.groupBy(*key, "_k.what", "context").agg(F.sum("_k.x").alias("total"), F.count("*").alias("n")), "contexts")
    drawn = None
    for (name,) in sorted((r[0],) for r in per.select("modality").distinct().collect()):  # a few
        one = resampled_groups(per.where(F.col("modality") == name), [*key, "what"], "context", draws)
        drawn = one if drawn is None else drawn.unionByName(one)
    count = lambda c: F.count(F.when(c, 1))
    change = F.round("change", 12)
    out = rows.groupBy(*key).agg(F.count("*").alias("facts"), F.avg("value").alias("value"), F.avg("change").alias("difference"), count(change > 0).alias("improved"), count(change == 0).alias("unchanged"), count(change < 0).alias("degraded"))
    if drawn is None:
        return out.where("false")
    for what in ("value", "difference"):
        out = out.join(drawn.where(F.col("what") == what).groupBy(*key).agg(*bounds("statistic", what)), key)
    return out
