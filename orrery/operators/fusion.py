"""Fusion of rankings: (fact, list, tag, rank[, score]) in, one row for each fact and tag out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orrery.functions.text import squeeze, with_prefix
from orrery.operators.retrieval import minmax, ranked

KAPPA = 60
# Keys of a model's answer that name candidates, by what they hold.
RANKED_KEYS = {"selected": ("selected_index", "selected_tag"), "indices": ("ranked_indices", "ranking", "ranked_candidate_indices"), "tags": ("ranked_tags", "tags")}


def rrf(rankings: DataFrame, mode: str = "sum", kappa: int = KAPPA, by: list[str] | None = None) -> DataFrame:
    """Reciprocal-rank fusion.

    ``mode``: "sum" over lists; "mean" over the lists that hold the tag; "lists" over
    all lists of the fact.  Rows without a tag or with ranks under 1 are dropped;
    best_rank, first_list and best_list (where the best rank stands, the first of
    equals) stay as metadata.
    """
    by = by or ["fact"]
    rows = rankings.where(F.col("tag").isNotNull() & (F.col("rank") > 0))
    total = {"sum": F.sum, "mean": F.avg, "lists": F.sum}[mode](1.0 / (kappa + F.col("rank"))).alias("rrf")
    out = rows.groupBy(*by, "tag").agg(total, F.min("rank").alias("best_rank"), F.min("list").alias("first_list"), F.min(F.struct("rank", "list"))["list"].alias("best_list"), F.count("*").alias("hits"))
    if mode == "lists":
        n = rows.groupBy(*by).agg(F.countDistinct("list").alias("n_lists"))
        out = out.join(n, by).withColumn("rrf", F.col("rrf") / F.col("n_lists")).drop("n_lists")
    return out


def fused_ranking(fused: DataFrame, k: int | None = None, score: str = "rrf", by: list[str] | None = None) -> DataFrame:
    """Order: score, then the list seen first, then the best rank, then the tag."""
    return ranked(fused, by or ["fact"], [F.desc(F.round(score, 12)), F.col("first_list"), F.col("best_rank"), F.col("tag")], k)


def nested_rrf(rankings: DataFrame, kappa: int = KAPPA) -> DataFrame:
    """Fuses the renderings of each hypothesis, then the hypotheses; ``rankings`` has hyp and list."""
    inner = fused_ranking(rrf(rankings, kappa=kappa, by=["fact", "hyp"]), by=["fact", "hyp"])
    return rrf(inner.select("fact", F.col("hyp").alias("list"), "tag", "rank"), kappa=kappa)


def combsum(rankings: DataFrame) -> DataFrame:
    """Sum of the scores scaled within each list."""
    scaled = rankings.withColumn("scaled", minmax(F.col("score"), ["fact", "list"], 1.0))
    return scaled.groupBy("fact", "tag").agg(F.sum("scaled").alias("combsum"), F.min("list").alias("first_list"), F.min("rank").alias("best_rank"))


def selected_list(list_scores: DataFrame) -> DataFrame:
    """fact, list: the list of the highest score, of equals the first."""
    return list_scores.groupBy("fact").agg(F.max_by("list", F.struct(F.round("score", 12), -F.col("list"))).alias("list"))


def selection(rankings: DataFrame, chosen: DataFrame, union: bool) -> DataFrame:
    """The chosen list's ranking; with ``union`` followed by the other tags by their best rank elsewhere."""
    own = rankings.join(chosen, ["fact", "list"]).select("fact", "tag", F.lit(0).alias("part"), F.col("rank").alias("key"))
    if union:
        other = rankings.groupBy("fact", "tag").agg(F.min("rank").alias("key")).join(own.select("fact", "tag"), ["fact", "tag"], "left_anti")
        own = own.unionByName(other.select("fact", "tag", F.lit(1).alias("part"), "key"))
    return ranked(own, ["fact"], [F.col("part"), F.col("key"), F.col("tag")])


def coverage_ceiling(rankings: DataFrame) -> DataFrame:
    """The union of all lists, list after list, each tag where it stands first."""
    first = rankings.groupBy("fact", "tag").agg(F.min(F.struct("list", "rank")).alias("at"))
    return ranked(first.select("fact", "tag", "at.*").withColumnRenamed("rank", "list_rank"), ["fact"], [F.col("list"), F.col("list_rank"), F.col("tag")])


def composite(candidates: DataFrame, named: DataFrame) -> DataFrame:
    """Tags that a model named, in its order, before the remaining candidates.

    ``named``: fact, tag, priority, pos (repeated tags count where they stand first).
    """
    first = named.groupBy("fact", "tag").agg(F.min(F.struct("priority", "pos")).alias("at"))
    rows = candidates.select("fact", "tag", "rank").withColumnRenamed("rank", "candidate_rank").join(first, ["fact", "tag"], "left")
    return ranked(rows, ["fact"], [F.col("at").isNull(), F.col("at.priority"), F.col("at.pos"), F.col("candidate_rank"), F.col("tag")]).drop("at")


def rank_gain(rank: Column, mode: str = "reciprocal") -> Column:
    """Reward of a rank: 1/rank or 1/log2(rank + 1); 0 where absent."""
    gain = 1.0 / rank if mode == "reciprocal" else 1.0 / F.log2(rank + 1)
    return F.coalesce(gain, F.lit(0.0))


def null_search(rankings: DataFrame, beta: float, kappa: int = KAPPA) -> DataFrame:
    """Rounds fused by reciprocal rank plus ``beta`` times the consensus at the tag's best
    rank, of equal ranks the earlier round's; ties by the first round, the best rank, the tag.

    ``rankings``: fact, list (the round), tag, rank, consensus.
    """
    rows = rankings.where(F.col("tag").isNotNull() & (F.col("rank") > 0))
    at = F.min(F.struct("rank", "list", "consensus"))
    fused = rows.groupBy("fact", "tag").agg(F.sum(1.0 / (kappa + F.col("rank"))).alias("rrf"), F.min("list").alias("first_list"), at["rank"].alias("best_rank"), at["consensus"].alias("consensus"))
    return fused_ranking(fused.withColumn("final", F.col("rrf") + beta * F.col("consensus")), score="final")


def config_grid(rankings: DataFrame, configs: DataFrame, consensus: DataFrame, kappa: int = KAPPA) -> DataFrame:
    """config, fact, tag, rank for every row of ``configs`` (config, lists, mode, beta): the lists
    that a configuration uses, summed or averaged over those that hold the tag, scaled
    within the fact, plus ``beta`` times the tag's consensus (fact, tag, consensus; none counts 0).

    Configurations are a small table; those of the same lists share one fusion.
    """
    used = rankings.join(F.broadcast(configs.select("lists").distinct()), F.array_contains("lists", F.col("list")))
    keys = ["config", "fact"]
    part = 1.0 / (kappa + F.col("rank"))
    fused = used.groupBy("fact", "tag", "lists").agg(F.sum(part).alias("total"), F.avg(part).alias("mean"), F.min("list").alias("first_list"), F.min("rank").alias("best_rank"))
    fused = fused.join(F.broadcast(configs), "lists").drop("lists")
    fused = fused.withColumn("score", F.when(F.col("mode") == "mean", F.col("mean")).otherwise(F.col("total"))).join(consensus, ["fact", "tag"], "left")
    final = minmax(F.round("score", 12), keys, 1.0) + F.col("beta") * F.coalesce("consensus", F.lit(0.0))
    return fused_ranking(fused.withColumn("final", final), score="final", by=keys)


def named_candidates(answers: DataFrame, candidates: DataFrame, prefix: str = "") -> DataFrame:
    """fact, tag, priority, pos for ``composite`` from a model's answers (fact, answer in JSON).

    A selected index or tag comes first, then ranked indices, then ranked tags; indices are
    candidates' ranks, what is no candidate counts for nothing.  The keys
    are those that ``RANKED_KEYS`` lists.  Tags are squeezed and get ``prefix`` where they lack it.
    """
    a = F.col("answer")
    texts = lambda key: F.from_json(F.get_json_object(a, f"$.{key}"), "array<string>")
    parts = []
    for priority, keys in RANKED_KEYS.items():
        for k, key in enumerate(keys):
            one = F.array(F.get_json_object(a, f"$.{key}")) if priority == "selected" else texts(key)
            parts.append(answers.select("fact", F.lit(priority).alias("what"), F.lit(key).alias("key"), F.lit(k).alias("nth"), F.posexplode(one).alias("at", "named")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    plain = lambda c: with_prefix(squeeze(c), prefix)
    by_rank, by_tag = (F.col("key") == "selected_index") | (F.col("what") == "indices"), plain(F.col("named")) == plain(F.col("tag").cast("string"))
    met = rows.join(candidates.select("fact", "tag", F.col("rank").alias("candidate")), "fact").where(F.when(by_rank, F.col("named").try_cast("int") == F.col("candidate")).otherwise(by_tag))
    selected = F.col("what") == "selected"
    first = met.where(selected).groupBy("fact").agg(F.min(F.struct("nth", "tag"))["tag"].alias("tag")).withColumn("priority", F.lit(0)).withColumn("pos", F.lit(0).cast("long"))
    priority = F.when(F.col("what") == "indices", 1).otherwise(2)
    return first.unionByName(met.where(~selected).select("fact", "tag", priority.alias("priority"), (F.col("nth") * 1_000_000 + F.col("at")).cast("long").alias("pos")))
