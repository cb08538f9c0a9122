"""Episodes of rounds: directives that feedback admits, where a controller stops, delayed rewards and replays under other settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from orrery.functions.text import jaccard
from orrery.operators.retrieval import ranked
from orrery.operators.stats import draw

# The dimensions and the modes of directives, each in their order, and the operators and stop reasons of logs.
DIMENSIONS = ("FAMILY", "ROLE", "EVENT", "QUALIFIER", "SCOPE", "TEMPORAL")
MODES = ("REFINE", "CHANGE_STRATEGY", "BRANCH", "PERTURB")
REFINE_PREFIX, CHANGE_STRATEGY, PERTURB = "O_refine_", "O_change_strategy", "O_perturb"
NO_DIRECTIVE, REVISION_FAILED, GATE, BUDGET = "no_admissible_directive", "revision_parse_failed", "novelty_gate_exhaustion", "budget_exhausted"
#: The log holds no further round although nothing stops the episode.
LOG_ENDED = "log_ended"


@dataclass(frozen=True)
class Settings:
    """How a controller stops and what a round earns; a name for grids of them."""

    name: str = "default"
    budget: int = 4  # rounds, the first included
    gate: bool = False
    threshold: float = 0.02  # of query novelty
    rejections: int = 1  # that end an episode
    alpha: float = 0.5  # share of the gain in a reward, the rest is the contrast with the replay


def slate(contradicted: Column, unresolved: Column, mismatch: Column, limit: int = 6, perturb: bool = True) -> Column:
    """Array of (mode, operator, dimension), at most ``limit``: refine each contradicted
    dimension, change the strategy on a mismatch, branch on each unresolved one, and
    perturb, which the limit never crowds out."""
    known = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.upper(F.trim(x)))
    bad, open_ = known(contradicted), known(unresolved)
    every = F.array(*[F.lit(d) for d in DIMENSIONS])

    def directive(mode: str, operator: Column, dimension: Column) -> Column:
        return F.struct(F.lit(mode).alias("mode"), operator.alias("operator"), dimension.alias("dimension"))

    on = lambda mode: (lambda d: directive(mode, F.concat(F.lit(REFINE_PREFIX), F.lower(d)), d))
    refine = F.transform(F.filter(every, lambda d: F.array_contains(bad, d)), on(MODES[0]))
    branch = F.transform(F.filter(every, lambda d: F.array_contains(open_, d) & ~F.array_contains(bad, d)), on(MODES[2]))
    change = F.filter(F.array(directive(MODES[1], F.lit(CHANGE_STRATEGY), F.lit(""))), lambda _: F.coalesce(mismatch, F.lit(False)))
    last = F.array(directive(MODES[3], F.lit(PERTURB), F.lit("")))
    out = F.concat(refine, change, branch, last) if perturb else F.concat(refine, change, branch)
    cut = F.concat(F.slice(out, 1, limit - 1), last) if perturb else F.slice(out, 1, limit)
    return F.when(F.size(out) > limit, cut).otherwise(out)


def choose(slates: Column, scores: Column, random_by: list[Column] | None = None) -> tuple[Column, Column]:
    """(selected, runner-up) of a slate by the scores (a map from operators, 0 where it has
    none), of equals the mode of higher priority, then the first; with ``random_by``
    the selected one is drawn by these keys.  Null where there is none."""
    place = lambda d: F.array_position(F.array(*[F.lit(m) for m in MODES]), d["mode"])
    keyed = F.transform(slates, lambda d, i: F.struct(F.coalesce(F.try_element_at(scores, d["operator"]), F.lit(0.0)).alias("score"), (-place(d)).alias("p"), (-i).alias("i"), d.alias("d")))
    best = F.array_max(keyed) if random_by is None else F.get(keyed, F.when(F.size(slates) > 0, draw(F.size(slates), *random_by)).cast("int"))
    rest = F.array_max(F.filter(keyed, lambda x: x["i"] != best["i"]))
    return best["d"], rest["d"]


def query_novelty(rounds: DataFrame) -> DataFrame:
    """``rounds`` (episode, round, query tokens) with novelty: 1 less the largest Jaccard
    similarity to a query of an earlier round; 1 for the first and for empty queries."""
    own = rounds.select("episode", "round", "query")
    before = own.select("episode", F.col("round").alias("_r"), F.col("query").alias("_q"))
    most = own.join(before, "episode").where(F.col("_r") < F.col("round")).groupBy("episode", "round").agg(F.max(jaccard(F.col("query"), F.col("_q"), 0.0)).alias("_m"))
    met = rounds.join(most, ["episode", "round"], "left")
    return met.withColumn("novelty", F.when(F.size("query") == 0, 1.0).otherwise(F.round(1 - F.coalesce("_m", F.lit(0.0)), 6))).drop("_m")


def utility(rank: Column) -> Column:
    """1 / log2(rank + 1); 0 for a gold tag that is absent."""
    return F.when(rank > 0, 1 / F.log2(rank + 1.0)).otherwise(F.lit(0.0))


def replay(rounds: DataFrame, settings: list[Settings]) -> DataFrame:
    """The realized rounds of logged episodes under each of ``settings``, with setting,
    rejected (by the gate so far), stop_reason, last_round, gain, contrast and reward.

    ``rounds``: episode, round (1, 2, ...), query (tokens), slate, parsed, rank_after,
    replayed, rank_replay.  Round 1 is the start; a later one is not realized, and ends its
    episode, if its slate is empty, else if its revision could not be parsed, else if an
    armed gate rejects its query for the ``rejections``-th time.  What ends an
    episode is known from rounds that every setting has realized before, so the log of the
    longest run serves all settings of at most its budget.  Rewards look at gold
    ranks only after the stop: gain is the utility of the union after the round less
    before, contrast that less the replayed runner-up's (before the round where none was).
    """
    few = rounds.where(F.col("round") <= max(s.budget for s in settings))
    seen = query_novelty(few)
    each = F.array(*[F.struct(F.lit(s.name).alias("setting"), F.lit(s.budget).alias("budget"), F.lit(s.gate).alias("gate"), F.lit(float(s.threshold)).alias("threshold"), F.lit(s.rejections).alias("rejections"), F.lit(float(s.alpha)).alias("alpha")) for s in settings])
    rows = seen.withColumn("_s", F.explode(each)).select("*", "_s.*").drop("_s").where(F.col("round") <= F.col("budget"))
    so_far = W.partitionBy("setting", "episode").orderBy("round")  # at most a budget of rows
    whole = W.partitionBy("setting", "episode")
    late = F.col("round") > 1
    below = late & (F.size("slate") > 0) & F.col("parsed") & F.col("gate") & (F.col("novelty") < F.col("threshold"))
    rows = rows.withColumn("rejected", F.sum(below.cast("long")).over(so_far))
    event = (
        F.when(late & (F.size("slate") == 0), NO_DIRECTIVE).when(late & ~F.col("parsed"), REVISION_FAILED)
        .when(below & (F.col("rejected") >= F.col("rejections")), GATE)
    )
    rows = rows.withColumn("_event", event)
    stop = F.min(F.when(F.col("_event").isNotNull(), F.struct("round", "_event"))).over(whole)
    rows = rows.withColumn("_stop", stop).withColumn("_logged", F.max("round").over(whole))
    rows = rows.where(F.col("_stop").isNull() | (F.col("round") < F.col("_stop.round")))
    reason = F.coalesce(F.col("_stop._event"), F.when(F.col("_logged") >= F.col("budget"), BUDGET).otherwise(LOG_ENDED))
    after, before = utility(F.col("rank_after")), F.lag(utility(F.col("rank_after"))).over(so_far)
    other = F.when(F.col("replayed"), utility(F.col("rank_replay"))).otherwise(before)
    rows = rows.withColumn("stop_reason", reason).withColumn("last_round", F.max("round").over(whole))
    rows = rows.withColumn("gain", after - before).withColumn("contrast", F.when(before.isNotNull(), after - other))
    return rows.withColumn("reward", F.col("alpha") * F.col("gain") + (1 - F.col("alpha")) * F.col("contrast")).drop("_event", "_stop", "_logged")


def episodes(realized: DataFrame) -> DataFrame:
    """setting, episode, stop_reason, rounds, rejected, reward (of all rounds), rank and utility at the end."""
    return realized.groupBy("setting", "episode").agg(
        F.first("stop_reason").alias("stop_reason"), F.max("round").alias("rounds"), F.max("rejected").alias("rejected"), F.coalesce(F.sum("reward"), F.lit(0.0)).alias("reward"),
        F.max_by("rank_after", "round").alias("rank"), F.max_by(utility(F.col("rank_after")), "round").alias("utility"),
    )


def prefix_ranks(lists: DataFrame, gold: DataFrame, replays: DataFrame, kappa: int = 60) -> DataFrame:
    """episode, round, rank_after, rank_replay: first gold ranks in the fused union after
    each round, and in the union before it with the replay's list of that round.

    ``lists`` and ``replays``: episode, round, tag, rank; ``gold``: episode, gold.  Each list
    goes into the unions of its own and the later rounds.
    """
    last = lists.groupBy("episode").agg(F.max("round").alias("_last"))
    spread = lists.join(last, "episode").withColumn("at", F.explode(F.sequence(F.col("round"), F.col("_last"))))
    after = spread.select("episode", "at", F.lit("after").alias("which"), "tag", "rank")
    before = spread.where("at > round").select("episode", "at", F.lit("replay").alias("which"), "tag", "rank")
    turned = replays.select("episode", F.col("round").alias("at"), F.lit("replay").alias("which"), "tag", "rank")
    fused = after.unionByName(before).unionByName(turned).groupBy("episode", "at", "which", "tag").agg(F.sum(1.0 / (kappa + F.col("rank"))).alias("rrf"), F.min("rank").alias("best"))
    order = ranked(fused, ["episode", "at", "which"], [F.desc(F.round("rrf", 12)), F.col("best"), F.col("tag")])
    hits = order.join(gold.withColumnRenamed("gold", "tag"), ["episode", "tag"]).groupBy("episode", "at").agg(*[F.min(F.when(F.col("which") == w, F.col("rank"))).alias(f"rank_{w}") for w in ("after", "replay")])
    every = lists.select("episode", F.col("round").alias("at")).distinct()
    return every.join(hits, ["episode", "at"], "left").withColumnRenamed("at", "round")
