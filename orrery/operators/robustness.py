"""Grids of retrievers: kind, method and coverage weight over one lexical and one dense search, with intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orrery.functions.text import coverage
from orrery.operators.arms import METRICS, by_modality, resampled_groups
from orrery.operators.resample import bounds
from orrery.operators.retrieval import minmax, ranked
from orrery.session import staged

KINDS = ("lexical", "dense", "hybrid")


def variant_ranks(lexical: DataFrame, dense: DataFrame, asked: DataFrame, labels: DataFrame, weights: list[float], k: int, kappa: int = 60) -> DataFrame:
    """kind, method, weight, query, doc, rank of every variant, the first ``k`` of each.

    ``lexical`` and ``dense``: query, rendering, doc, score, rank, searched without coverage;
    ``asked``: query, rendering, tokens; ``labels``: doc, label.  Hybrid scores sum 1 / (kappa
    + rank) over both sides.  Scores are scaled within a ranking (1 where all are
    alike), and coverage, computed once for each pair, is added by its weight, for hybrids
    after the fusion.  Method "onepass" takes rendering 0 alone; "rounds" fuses the
    rankings of all renderings.  Every variant comes from the same two searches.
    """
    own = lambda df, kind: df.select("query", "rendering", "doc", "score", F.lit(kind).alias("kind"))
    part = 1.0 / (kappa + F.col("rank"))
    sides = lexical.select("query", "rendering", "doc", part.alias("p")).unionByName(dense.select("query", "rendering", "doc", part.alias("p")))
    hybrid = sides.groupBy("query", "rendering", "doc").agg(F.sum("p").alias("score")).withColumn("kind", F.lit("hybrid"))
    pool = own(lexical, "lexical").unionByName(own(dense, "dense")).unionByName(hybrid.select("query", "rendering", "doc", "score", "kind"))
    pairs = sides.select("query", "rendering", "doc").distinct().join(asked, ["query", "rendering"]).join(labels, "doc")
    covered = pairs.select("query", "rendering", "doc", coverage(F.col("label"), F.col("tokens")).alias("label_coverage"), coverage(F.col("tokens"), F.col("label")).alias("query_coverage"))
    key = ["kind", "query", "rendering"]
    rows = pool.withColumn("norm", minmax(F.round("score", 12), key, 1.0)).join(covered, ["query", "rendering", "doc"])
    each = rows.withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    both = F.col("label_coverage") + F.col("query_coverage")
    # Without a weight the order of the search stays.
    chain = [F.when(F.col("weight") > 0, F.round(c, 9)).otherwise(0.0).desc() for c in ("label_coverage", "query_coverage")]
    order = [F.desc(F.round(F.col("norm") + F.col("weight") * both, 9)), *chain, F.desc(F.round("score", 12)), F.col("doc")]
    single = ranked(each, [*key, "weight"], order, k).select("kind", "weight", "query", "rendering", "doc", "rank")
    single = staged(single, "variants")
    onepass = single.where("rendering = 0").select("kind", F.lit("onepass").alias("method"), "weight", "query", "doc", "rank")
    fused = single.groupBy("kind", "weight", "query", "doc").agg(F.sum(part).alias("rrf"))
    rounds = ranked(fused, ["kind", "weight", "query"], [F.desc(F.round("rrf", 12)), F.col("doc")], k)
    return onepass.unionByName(rounds.select("kind", F.lit("rounds").alias("method"), "weight", "query", "doc", "rank"))


def grid_metrics(ranks: DataFrame, gold: DataFrame, facts: DataFrame, context: Column, modality: Column, draws: int) -> DataFrame:
    """kind, method, weight, modality, metric: n, value and its interval over contexts drawn with replacement.

    ``ranks``: as ``variant_ranks`` gives them; ``gold``: query, doc (any of several); ``facts``: one row for
    each query with what ``context`` and ``modality`` need.  A query without a gold document among its results counts 0.
    """
    key = ["kind", "method", "weight"]
    variants = ranks.select(*key).distinct()
    every = facts.select("query", context.alias("context"), modality.alias("_m")).join(F.broadcast(variants))  # variants are a few
    first = ranks.join(gold, ["query", "doc"]).groupBy(*key, "query").agg(F.min("rank").alias("rank"))
    values = F.array(*[F.struct(F.lit(m).alias("metric"), f(F.col("rank")).alias("value")) for m, f in METRICS.items()])
    rows = by_modality(every.join(first, [*key, "query"], "left"), F.col("_m")).withColumn("v", F.explode(values)).select(*key, "modality", "context", "v.metric", "v.value")
    full = [*key, "modality", "metric"]
    per = staged(rows.groupBy(*full, "context").agg(F.sum("value").alias("total"), F.count("*").alias("n")), "contexts")
    out = None
    for (name,) in sorted((r[0],) for r in per.select("modality").distinct().collect()):  # a few
        part = resampled_groups(per.where(F.col("modality") == name), full, "context", draws)
        out = part if out is None else out.unionByName(part)
    means = per.groupBy(*full).agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("value"))
    if out is None:
        return means.where("false")
    return means.join(out.groupBy(*full).agg(*bounds("statistic", "ci")), full)
