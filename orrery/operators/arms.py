"""Arms of specialised rankings: scores at every weight, the oracle, preferred slots, paired contrasts and what they decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from orrery.functions.text import jaccard
from orrery.operators.fusion import fused_ranking, rank_gain, rrf
from orrery.operators.resample import bounds, numbered
from orrery.operators.retrieval import minmax, ranked
from orrery.operators.stats import times_drawn
from orrery.operators.symbolic import tightest_level
from orrery.session import staged

#: The arm whose rank is the best of any slot alone.
ORACLE = "oracle"


def filtered_arm(slots: DataFrame, passes: DataFrame, arm: str) -> DataFrame:
    """arm, fact, slot: of a fact's slots those that pass (fact, slot, passes), or all where none does."""
    rows = slots.join(passes, ["fact", "slot"], "left").withColumn("passes", F.coalesce("passes", F.lit(False)))
    return tightest_level(rows, ["fact"], [F.col("passes"), F.lit(True)]).select(F.lit(arm).alias("arm"), "fact", "slot")


def arm_ranks(rankings: DataFrame, arms: DataFrame, agreement: DataFrame, gold: DataFrame, betas: list[float], k: int, kappa: int = 60) -> DataFrame:
    """arm, fact, beta, rank, share: the first gold rank (null where absent) of every arm at every weight.

    ``rankings``: fact, slot, tag, rank; ``arms``: arm, fact, slot; ``agreement``: fact, slot, tag,
    agree; ``gold``: fact, gold.  An arm fuses its slots' lists, keeps the first ``k``, scales
    them within the fact (0 where all are alike) and adds ``beta`` times the mean
    agreement over its slots, 0 where a slot does not rule; of equals the smaller tag.  ``share``
    is what the consensus can move: beta times its range over that plus the range of
    scaled scores, null for 0.  All weights share one fusion.
    """
    used = rankings.join(arms, ["fact", "slot"]).withColumnRenamed("slot", "list")
    key = ["arm", "fact"]
    pool = fused_ranking(rrf(used, kappa=kappa, by=key), k, by=key).withColumn("norm", minmax(F.round("rrf", 12), key, 0.0)).select(*key, "tag", "norm")
    told = arms.join(agreement, ["fact", "slot"]).groupBy(*key, "tag").agg(F.sum("agree").alias("told"))
    slots = arms.groupBy(*key).agg(F.count("*").alias("slots"))
    rows = pool.join(told, [*key, "tag"], "left").join(slots, key).withColumn("consensus", F.coalesce("told", F.lit(0.0)) / F.col("slots"))
    each = rows.withColumn("beta", F.explode(F.array(*[F.lit(float(b)) for b in betas])))
    at = [*key, "beta"]
    placed = ranked(each.withColumn("final", F.col("norm") + F.col("beta") * F.col("consensus")), at, [F.desc(F.round("final", 9)), F.col("tag")])
    hit = F.min(F.when(F.col("tag") == F.col("gold"), F.col("rank"))).alias("rank")
    spread = lambda c: F.max(c) - F.min(c)
    ranks = placed.join(gold, "fact", "left").groupBy(*at).agg(hit, (F.col("beta") * spread("consensus")).alias("_m"), spread("norm").alias("_n"))
    return ranks.select(*at, "rank", F.try_divide(F.col("_m"), F.nullif(F.col("_m") + F.col("_n"), F.lit(0.0))).alias("share"))


def _wide(t: pa.Table) -> dict:
    """Tags of facts, by fact and tag, with rank and agreement of each slot; slots of facts that are there and that pass."""
    fact, slot = t.column("fact").to_numpy(), t.column("slot").to_numpy()
    facts, at = np.unique(fact, return_inverse=True)
    slots, which = np.unique(slot, return_inverse=True)
    there, passes = np.zeros((len(slots), len(facts)), dtype=bool), np.zeros((len(slots), len(facts)), dtype=bool)
    there[which, at] = True
    ok = t.column("passes").fill_null(False).to_numpy()
    passes[which[ok], at[ok]] = True
    gold, known = np.zeros(len(facts), dtype=np.int64), np.zeros(len(facts), dtype=bool)
    known[at] = t.column("gold").is_valid().to_numpy()
    gold[at] = t.column("gold").fill_null(0).to_numpy()
    tagged = np.flatnonzero(t.column("tag").is_valid().to_numpy())
    at, which, tag = at[tagged], which[tagged], t.column("tag").fill_null(0).to_numpy()[tagged]
    order = np.lexsort((tag, at))
    at, which, tag, row = at[order], which[order], tag[order], tagged[order]
    entity = np.cumsum(np.append(True, (np.diff(at) != 0) | (np.diff(tag) != 0))[: len(at)]) - 1
    first = np.flatnonzero(np.diff(entity, prepend=-1))
    rank, agree = np.full((len(slots), len(first)), np.inf), np.zeros((len(slots), len(first)))
    ranks = t.column("rank").fill_null(0).to_numpy()[row].astype(np.float64)
    rank[which, entity] = np.where(ranks > 0, ranks, np.inf)
    agree[which, entity] = t.column("agree").fill_null(0.0).to_numpy()[row]
    return {"facts": facts, "slots": slots.tolist(), "there": there, "passes": passes, "gold": gold, "known": known, "at": at[first], "tag": tag[first], "rank": rank, "agree": agree}


def _arm(w: dict, member: np.ndarray, betas: list[float], k: int, kappa: int):
    """(places of facts, ranks of each weight, 0 where absent, shares of each weight, NaN where none) of an arm with slots ``member`` (slot, fact)."""
    use = member[:, w["at"]] & np.isfinite(w["rank"])
    held = np.flatnonzero(use.any(axis=0))
    if not len(held):
        return np.zeros(0, dtype=np.int64), np.zeros((len(betas), 0), dtype=np.int64), np.zeros((len(betas), 0))
    use, rank, fact, tag = use[:, held], w["rank"][:, held], w["at"][held], w["tag"][held]
    score = np.zeros(len(held))
    for u, r in zip(use, rank):
        score += np.where(u, 1.0 / (kappa + r), 0.0)
    score = np.round(score, 12)
    order = np.lexsort((np.where(use, rank, np.inf).min(axis=0), use.argmax(axis=0), -score, fact))  # tags are in order already
    start = np.searchsorted(fact, fact)  # facts stay in order
    order = order[np.arange(len(held)) - start < k]
    score, fact, tag, held = score[order], fact[order], tag[order], held[order]
    starts = np.flatnonzero(np.diff(fact, prepend=-1))
    own, size = fact[starts], np.diff(np.append(starts, len(fact)))
    low, high = np.minimum.reduceat(score, starts), np.maximum.reduceat(score, starts)
    width = np.repeat(high - low, size)
    norm = np.divide(score - np.repeat(low, size), width, out=np.zeros(len(score)), where=width > 0)
    told = np.zeros(len(score))
    for m, a in zip(member, w["agree"]):
        told += np.where(m[fact], a[held], 0.0)
    consensus = told / member.sum(axis=0)[fact]
    moved = np.maximum.reduceat(consensus, starts) - np.minimum.reduceat(consensus, starts)
    spread = np.maximum.reduceat(norm, starts) - np.minimum.reduceat(norm, starts)
    wanted = w["gold"][fact]
    hits = np.flatnonzero((tag == wanted) & w["known"][fact])
    place = np.full(len(own), -1)
    place[np.searchsorted(own, fact[hits])] = hits
    ranks, shares = [], []
    for beta in betas:
        final = np.round(norm + beta * consensus, 9)
        golden = np.repeat(final[place], size)
        ahead = (final > golden) | ((final == golden) & (tag < wanted))
        ranks.append(np.where(place >= 0, np.add.reduceat(ahead.astype(np.int64), starts) + 1, 0))
        m = beta * moved
        shares.append(np.divide(m, m + spread, out=np.full(len(own), np.nan), where=m + spread != 0))
    return own, np.array(ranks), np.array(shares)


def ranks_of_slots(rows: DataFrame, arms: dict[str, list[int]], filtered: str, betas: list[float], k: int, kappa: int = 60) -> DataFrame:
    """``arm_ranks`` of ``arms`` (of the slots that a fact has), of ``filtered`` (``filtered_arm``) and of each slot
    alone, named after it, and the oracle's (``with_oracle``), from one pass in which each task holds its part.

    ``rows``: fact, slot, tag, rank, agree (null where the slot does not rule), passes (true in one row of a slot that
    passes), gold; all rows of a fact are in one part, and a part fits a task (``session.dealt``).
    """
    schema = pa.schema([("arm", pa.string()), ("fact", pa.int64()), ("beta", pa.float64()), ("rank", pa.int64()), ("share", pa.float64())])

    def table(arm: str, facts: np.ndarray, ranks: np.ndarray, shares: np.ndarray):
        for beta, r, s in zip(betas, ranks, shares):
            names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(facts), dtype=np.int32)), pa.array([arm])).cast(pa.string())
            columns = [names, pa.array(facts), pa.array(np.full(len(facts), float(beta))), pa.array(r, mask=r == 0), pa.array(s, mask=np.isnan(s))]
            yield from pa.table(columns, schema=schema).to_batches()

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        w = _wide(pa.Table.from_batches(batches).combine_chunks())
        there, passes = w["there"], w["passes"] & w["there"]
        members = [(a, there & np.isin(w["slots"], own)[:, None]) for a, own in arms.items()]
        members.append((filtered, np.where(passes.any(axis=0), passes, there)))
        for arm, member in members:
            own, ranks, shares = _arm(w, member, betas, k, kappa)
            yield from table(arm, w["facts"][own], ranks, shares)
        best, known = np.full((len(betas), len(w["facts"])), np.iinfo(np.int64).max), np.zeros(len(w["facts"]), dtype=bool)
        for j, slot in enumerate(w["slots"]):
            own, ranks, shares = _arm(w, there & (np.arange(len(w["slots"])) == j)[:, None], betas, k, kappa)
            yield from table(str(slot), w["facts"][own], ranks, shares)
            known[own] = True
            best[:, own] = np.minimum(best[:, own], np.where(ranks > 0, ranks, np.iinfo(np.int64).max))
        best = np.where(best == np.iinfo(np.int64).max, 0, best)[:, known]
        yield from table(ORACLE, w["facts"][known], best, np.full(best.shape, np.nan))

    c = lambda name, kind: F.col(name).cast(kind).alias(name)
    plain = rows.where(F.col("fact").isNotNull() & F.col("slot").isNotNull()).select(c("fact", "long"), c("slot", "long"), c("tag", "long"), c("rank", "long"), c("agree", "double"), "passes", c("gold", "long"))
    return plain.mapInArrow(run, "arm string, fact long, beta double, rank long, share double")


def slot_heads(rows: DataFrame, top: int) -> DataFrame:
    """fact, slot, score, resolved, preferred, overlap: ``preferred_slots`` and ``slot_overlap`` of the first ``top`` of each slot's
    list, and how many of them the slot rules on.  ``rows``: fact, slot, tag, rank, agree."""
    heads = rows.where(F.col("rank") <= top).groupBy("fact", "slot").agg(F.coalesce(F.avg("agree"), F.lit(0.0)).alias("score"), F.count("agree").alias("resolved"), F.collect_set("tag").alias("tags"))
    facts = heads.groupBy("fact").agg(F.collect_list(F.struct("slot", "score", "resolved", "tags")).alias("_all"), F.min(F.struct(-F.round("score", 12), "slot"))["slot"].alias("_best"))
    each = facts.select("fact", "_all", "_best", F.explode("_all").alias("_s"))
    other = F.filter("_all", lambda x: x["slot"] != F.col("_s.slot"))
    alike = F.transform(other, lambda x: jaccard(F.col("_s.tags"), x["tags"], 0.0))
    mean = F.try_divide(F.aggregate(alike, F.lit(0.0), lambda a, x: a + x), F.size(alike))
    return each.select("fact", "_s.slot", "_s.score", "_s.resolved", (F.col("_s.slot") == F.col("_best")).alias("preferred"), mean.alias("overlap"))


def solo_arms(arms: DataFrame) -> DataFrame:
    """Each slot as an arm of its own, named after it."""
    return arms.select(F.col("slot").cast("string").alias("arm"), "fact", "slot").distinct()


def with_oracle(ranks: DataFrame, solo: DataFrame) -> DataFrame:
    """``ranks`` and the oracle's: the best rank of any slot alone."""
    best = solo.groupBy("fact", "beta").agg(F.min("rank").alias("rank"))
    return ranks.unionByName(best.select(F.lit(ORACLE).alias("arm"), "fact", "beta", "rank", F.lit(None).cast("double").alias("share")))


def preferred_slots(rankings: DataFrame, agreement: DataFrame, top: int) -> DataFrame:
    """fact, slot, score, preferred: the mean agreement over the first ``top`` of a slot's own list, and the slot where it is highest, of equals the first."""
    own = rankings.where(F.col("rank") <= top).join(agreement, ["fact", "slot", "tag"], "left").groupBy("fact", "slot").agg(F.coalesce(F.avg("agree"), F.lit(0.0)).alias("score"))
    best = own.groupBy("fact").agg(F.min(F.struct(-F.round("score", 12), "slot"))["slot"].alias("_best"))
    return own.join(best, "fact").select("fact", "slot", "score", (F.col("slot") == F.col("_best")).alias("preferred"))


def slot_overlap(rankings: DataFrame, depth: int) -> DataFrame:
    """fact, slot, overlap: the mean Jaccard similarity of a slot's first ``depth`` with those of the fact's other slots."""
    lists = rankings.where(F.col("rank") <= depth).groupBy("fact", "slot").agg(F.collect_set("tag").alias("tags"))
    other = lists.select("fact", F.col("slot").alias("_o"), F.col("tags").alias("_t"))
    pairs = lists.join(other, "fact").where(F.col("slot") != F.col("_o"))
    return pairs.groupBy("fact", "slot").agg(F.avg(jaccard(F.col("tags"), F.col("_t"), 0.0)).alias("overlap"))


METRICS = {"accuracy": lambda r: F.when(r <= 1, 1.0).otherwise(0.0), "mrr": rank_gain, "recall_at_10": lambda r: F.when(r <= 10, 1.0).otherwise(0.0)}


def by_modality(rows: DataFrame, modality: Column) -> DataFrame:
    """Each row for its modality and once more for all of them together."""
    return rows.withColumn("modality", F.explode(F.array(modality, F.lit("pooled"))))


def sweep(ranks: DataFrame, modality: Column) -> DataFrame:
    """arm, modality, beta: facts, the metrics and the mean share of those that have one."""
    rows = by_modality(ranks, modality)
    return rows.groupBy("arm", "modality", "beta").agg(F.count("*").alias("n"), *[F.avg(f(F.col("rank"))).alias(m) for m, f in METRICS.items()], F.avg("share").alias("share"))


def best_betas(swept: DataFrame, modality: str) -> DataFrame:
    """arm, beta: the weight of the highest recall at 10, then mean reciprocal rank, then the lower weight."""
    at = F.struct(F.round("recall_at_10", 9), F.round("mrr", 9), -F.col("beta"))
    return swept.where(F.col("modality") == modality).groupBy("arm").agg(F.max_by("beta", at).alias("beta"))


def contrasts(ranks: DataFrame, betas: DataFrame, pairs: list[tuple[str, str]], context: Column, modality: Column, draws: int, margin: float) -> DataFrame:
    """left, right, modality, metric, both values, mean, low, high, excludes_zero, equivalent: paired
    differences of facts, with intervals over contexts drawn with replacement.

    Two arms are equivalent if the mean differs from 0 by less than ``margin`` and the interval holds 0.
    """
    own = ranks.join(F.broadcast(betas), ["arm", "beta"]).select("arm", "fact", "rank", context.alias("context"), modality.alias("_m"))  # one weight for each arm
    named = sorted({a for pair in pairs for a in pair})
    facts = own.where(F.col("arm").isin(named)).groupBy("fact", "context", "_m").agg(*[F.max(F.when(F.col("arm") == a, F.struct("rank"))).alias(f"_{k}") for k, a in enumerate(named)])
    of = lambda a: F.col(f"_{named.index(a)}")
    met = [F.when(of(a).isNotNull() & of(b).isNotNull(), F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), of(a)["rank"].alias("l"), of(b)["rank"].alias("r"))) for a, b in pairs]
    both = by_modality(facts.select("context", "_m", F.explode(F.filter(F.array(*met), lambda p: p.isNotNull())).alias("p")).select("context", "_m", "p.*"), F.col("_m"))
    group = ["left", "right", "modality", "context"]
    value = lambda f, c: f(F.col(c))
    sums = both.groupBy(*group).agg(F.count("*").alias("n"), *[F.sum(x).alias(f"{m}_{n}") for m, f in METRICS.items() for n, x in (("l", value(f, "l")), ("r", value(f, "r")), ("d", value(f, "l") - value(f, "r")))])
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_d").alias("total"), F.col(f"{m}_l").alias("left_total"), F.col(f"{m}_r").alias("right_total")) for m in METRICS])).alias("v")
    key = ["left", "right", "modality", "metric"]
    per = staged(sums.select(*group, "n", each).select(*group, "n", "v.*"), "contexts")
    # Every contrast draws from its modality's contexts.
    samples = None
    for (kind,) in [(r[0],) for r in per.select("modality").distinct().collect()]:  # a few
        own_ = per.where(F.col("modality") == kind)
        met = resampled_groups(own_, key, "context", draws)
        samples = met if samples is None else samples.unionByName(met)
    mean = lambda c: F.sum(c) / F.sum("n")
    means = per.groupBy(*key).agg(F.sum("n").alias("facts"), mean("left_total").alias("left_value"), mean("right_total").alias("right_value"), mean("total").alias("mean"))
    if samples is None:
        return means.where("false")
    ends = samples.groupBy(*key).agg(*bounds("statistic", "ci"))
    out = means.join(ends, key)
    holds = (F.col("ci_low") <= 0) & (F.col("ci_high") >= 0)
    return out.withColumn("equivalent", (F.abs("mean") < margin) & holds)


def resampled_groups(per: DataFrame, key: list[str], context: str, draws: int) -> DataFrame:
    """``key``, draw, statistic: the ratio of sums (total, n) over the same draws of contexts for every group."""
    names = numbered(per, context)
    met = times_drawn(names.count(), draws, per.sparkSession).join(per.join(names, context), "at")
    return met.groupBy(*key, "draw").agg(F.try_divide(F.sum(F.col("times") * F.col("total")), F.sum(F.col("times") * F.col("n"))).alias("statistic"))


def abstention(resolved: DataFrame, baseline: str) -> DataFrame:
    """slot, mean, baseline, violates: the mean number of dimensions that a slot resolves (slot, resolved), and
    whether it resolves more than the baseline does, which means that it guesses."""
    mean = resolved.groupBy("slot").agg(F.avg("resolved").alias("mean"))
    base = mean.where(F.col("slot").cast("string") == baseline).select(F.col("mean").alias("baseline"))  # one row
    return mean.join(F.broadcast(base)).withColumn("violates", F.col("mean") > F.col("baseline"))


def decision(rows: DataFrame, left: str, right: str, modality: str) -> Column:
    """Aggregate over contrasts: adopt if the decisive contrast wins on recall at 10 or mean reciprocal rank
    with its interval over 0, report if one is positive, else keep."""
    own = (F.col("left") == left) & (F.col("right") == right) & (F.col("modality") == modality) & F.col("metric").isin("recall_at_10", "mrr")
    win = F.max((own & (F.col("mean") > 0) & (F.col("ci_low") > 0)).cast("int"))
    some = F.max((own & (F.col("mean") > 0)).cast("int"))
    return F.when(win == 1, "adopt").when(some == 1, "report").otherwise("keep")
