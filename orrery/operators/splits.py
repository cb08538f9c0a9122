"""Stratified splits: quotas by the largest deficit, eligible test rows, the best of several attempts, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orrery.operators.stats import placed
from orrery.session import staged

#: Weights of a split's penalties in its score.
SPLIT_WEIGHTS = {"test_size": 10.0, "train_size": 5.0, "stratum": 4.0, "presence": 2.0, "entities": 1.0}


def quotas(groups: DataFrame, target: int, by: list[str]) -> DataFrame:
    """``by``, stratum, quota: whole shares of ``target`` in proportion to weights, none above its cap.

    ``groups``: ``by``, stratum, weight, cap.  Every stratum with a cap gets one if the
    target allows; then always the one with the largest deficit to its share, of
    equals the heavier, then the later name.  Deficits of a stratum fall by one with each
    share, so the shares are the first of all (stratum, nth) in the order of their
    deficits, and no loop has to give them out.
    """
    open_ = groups.where((F.col("cap") > 0) & (F.col("weight") > 0))
    sums = open_.groupBy(*by).agg(F.least(F.sum("cap"), F.lit(target)).alias("_total"), F.sum("weight").alias("_weights"), F.count("*").alias("_n"))
    rows = open_.join(sums, by) if by else open_.crossJoin(sums)  # one row
    rows = rows.withColumn("_base", F.when(F.col("_total") >= F.col("_n"), 1).otherwise(0)).withColumn("_raw", F.col("weight") / F.col("_weights") * F.col("_total"))
    slot = rows.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.least("cap", "_total")))).where(F.col("_j") > F.col("_base"))
    slot = slot.select(*by, "stratum", "_total", "_n", "_base", (-F.round(F.col("_raw") - (F.col("_j") - 1), 9)).alias("_gap"), (-F.col("weight")).alias("_heavy"))
    # The later name first: each character is turned round.
    turned = slot.withColumn("_name", F.translate(F.hex(F.encode("stratum", "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"))
    turned = turned.withColumn("_name", F.concat("_name", F.lit("~")))
    nth = placed(turned, by, ["_gap", "_heavy", "_name"], "_nth").where(F.col("_nth") <= F.col("_total") - F.col("_base") * F.col("_n"))
    more = nth.groupBy(*by, "stratum").agg(F.count("*").alias("_more"))
    return rows.join(more, [*by, "stratum"], "left").select(*by, "stratum", (F.col("_base") + F.coalesce("_more", F.lit(0))).cast("long").alias("quota"))


def quota_sample(rows: DataFrame, group: str, order: list[Column], target: int, key: str) -> DataFrame:
    """``rows`` with chosen: ``target`` of them, from each group as many as ``quotas`` gives it, the first in ``order`` and ``key``."""
    sizes = rows.groupBy(F.col(group).alias("stratum")).agg(F.count("*").alias("weight")).withColumn("cap", F.col("weight"))
    share = quotas(sizes, target, []).select(F.col("stratum").alias(group), F.col("quota").alias("_quota"))
    names = [f"_o{k}" for k in range(len(order))]
    first = placed(rows.withColumns(dict(zip(names, order))), [group], [*names, key], "_place")
    return first.join(share, group, "left").withColumn("chosen", F.col("_place") <= F.coalesce("_quota", F.lit(0))).drop("_place", "_quota", *names)


def first_of_quota(rows: DataFrame, share: DataFrame, order: list[Column]) -> DataFrame:
    """The rows (attempt, stratum, key) of each stratum that come first in ``order``, as many as its quota."""
    names = [f"_o{k}" for k in range(len(order))]
    nth = placed(rows.withColumns(dict(zip(names, order))), ["attempt", "stratum"], [*names, "key"], "_nth")
    return nth.join(share, ["attempt", "stratum"]).where(F.col("_nth") <= F.col("quota")).select("attempt", "stratum", "key")


def _largest_difference(counts: DataFrame, name: str) -> DataFrame:
    """attempt, ``name``: the largest difference between the shares of ``what`` in train and in test (attempt, split, what, n)."""
    sides = counts.groupBy("attempt", "what").agg(*[F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(s) for s in ("train", "test")])
    total = counts.groupBy("attempt").agg(*[F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(f"_{s}") for s in ("train", "test")])
    share = lambda s: F.coalesce(F.try_divide(F.col(s), F.nullif(F.col(f"_{s}"), F.lit(0))), F.lit(0.0))
    return sides.join(total, "attempt").groupBy("attempt").agg(F.max(F.abs(share("train") - share("test"))).alias(name))


def split_attempts(samples: DataFrame, train: int, test: int, attempts: int, max_difference: float, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(members, report): attempt, key, split; and attempt, sizes, differences, checks, score, passed, chosen.

    ``samples``: key, context, concepts, kinds (distinct) and kind_counts along kinds.  The
    stratum of a sample is its kind that the fewest samples have.  Each attempt draws its
    train rows by quotas over strata in the order of a hash, then its test rows, by
    quotas capped by what is eligible: rows outside train, all of whose concepts and
    kinds train has.  The attempt with the least score is chosen, of equals the first.
    """
    base = staged(samples.select("key", "context", "concepts", "kinds", "kind_counts"), "samples")
    each = base.select("key", F.explode(F.arrays_zip("kinds", "kind_counts")).alias("x")).select("key", F.col("x.kinds").alias("kind"), F.col("x.kind_counts").alias("n"))
    often = each.groupBy("kind").agg(F.count("*").alias("often"))
    strata = each.join(often, "kind").groupBy("key").agg(F.min(F.struct("often", "kind"))["kind"].alias("stratum"))
    rows = staged(strata.withColumn("attempt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(attempts - 1).cast("long")))), "attempts")
    sizes = rows.groupBy("attempt", "stratum").agg(F.count("*").alias("weight"))
    by_hash = lambda name: [F.md5(F.concat_ws("-", F.lit(str(seed)), F.lit(name), F.col("attempt").cast("string"), F.col("key").cast("string")))]
    taken = staged(first_of_quota(rows, quotas(sizes.withColumn("cap", F.col("weight")), train, ["attempt"]), by_hash("train")), "train")
    part = F.array_union(F.transform("concepts", lambda c: F.concat(F.lit("c:"), c.cast("string"))), F.transform("kinds", lambda c: F.concat(F.lit("k:"), c.cast("string"))))
    needs = staged(base.select("key", F.explode(part).alias("part")), "parts")
    known = needs.join(taken.select("attempt", "key"), "key").select("attempt", "part").distinct()
    rest = rows.join(taken.select("attempt", "key"), ["attempt", "key"], "left_anti")
    has = needs.groupBy("key").agg(F.count("*").alias("needed"))
    met = needs.join(known, "part").groupBy("attempt", "key").agg(F.count("*").alias("met"))
    eligible = staged(rest.join(has, "key").join(met, ["attempt", "key"]).where("met = needed").select("attempt", "stratum", "key"), "eligible")
    caps = sizes.join(eligible.groupBy("attempt", "stratum").agg(F.count("*").alias("cap")), ["attempt", "stratum"])
    tested = first_of_quota(eligible, quotas(caps, test, ["attempt"]), by_hash("test"))
    members = staged(taken.withColumn("split", F.lit("train")).unionByName(tested.withColumn("split", F.lit("test"))), "members")
    n = members.groupBy("attempt").agg(*[F.count(F.when(F.col("split") == s, 1)).alias(s) for s in ("train", "test")])
    kinds = members.join(each, "key")
    differences = [
        _largest_difference(members.groupBy("attempt", "split", F.col("stratum").alias("what")).agg(F.count("*").alias("n")), "stratum_difference"),
        _largest_difference(kinds.groupBy("attempt", "split", F.col("kind").alias("what")).agg(F.count("*").alias("n")), "presence_difference"),
        _largest_difference(kinds.groupBy("attempt", "split", F.col("kind").alias("what")).agg(F.sum("n").alias("n")), "entity_difference"),
    ]
    context = members.join(base.select("key", "context"), "key").groupBy("attempt", "context").agg(F.countDistinct("split").alias("s")).groupBy("attempt").agg(F.count(F.when(F.col("s") > 1, 1)).alias("shared_contexts"))
    parts = members.join(needs, "key").groupBy("attempt", "part").agg(F.max((F.col("split") == "train").cast("int")).alias("t"))
    missing = parts.groupBy("attempt").agg(F.count(F.when(F.col("t") == 0, 1)).alias("missing_in_train"))
    report = n
    for d in (*differences, context, missing):
        report = report.join(d, "attempt")
    size = lambda s, target: F.abs(F.col(s) - target) / max(target, 1)
    w = SPLIT_WEIGHTS
    score = w["test_size"] * size("test", test) + w["train_size"] * size("train", train) + w["stratum"] * F.col("stratum_difference") + w["presence"] * F.col("presence_difference") + w["entities"] * F.col("entity_difference")
    passed = (F.col("shared_contexts") == 0) & (F.col("missing_in_train") == 0) & (F.round("stratum_difference", 9) <= max_difference)
    report = staged(report.withColumn("score", score).withColumn("passed", passed), "report")  # a row for each attempt
    best = report.agg(F.min(F.struct(F.round("score", 9), "attempt"))["attempt"].alias("_best"))
    return members, report.crossJoin(best).withColumn("chosen", F.col("attempt") == F.col("_best")).drop("_best")


def chosen_split(samples: DataFrame, members: DataFrame, report: DataFrame) -> DataFrame:
    """key, split of the chosen attempt: train, test, or unused.  Raises if that attempt fails its checks."""
    best = report.where("chosen").collect()  # one row
    if best and not best[0]["passed"]:
        raise ValueError(f"the best split fails its checks: {best[0].asDict()}")
    own = members.join(report.where("chosen").select("attempt"), "attempt", "left_semi").select("key", "split")
    return samples.select("key").join(own, "key", "left").withColumn("split", F.coalesce("split", F.lit("unused")))
