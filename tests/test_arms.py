"""Arms against a plain score of every fact."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orrery.operators import arms as ar


def data():
    r = random.Random(8)
    rankings = [(f, s, t, k) for f in range(30) for s in (1, 2, 3) if (f + s) % 7 for k, t in enumerate(r.sample(range(12), r.randint(1, 8)), 1)]
    agreement = [(f, s, t, r.choice([0.0, 0.5, 1.0])) for f, s, t, _ in rankings if r.random() < 0.8]
    gold = [(f, r.randrange(12)) for f in range(30)]
    passes = [(f, s, r.random() < 0.4) for f in range(30) for s in (1, 2, 3)]
    return rankings, agreement, gold, passes


def first_rank(rankings, agreement, gold, fact, slots, beta, k):
    lists = {s: [t for _, t in sorted((rank, t) for f, s2, t, rank in rankings if f == fact and s2 == s)] for s in slots}
    score, best, first = Counter(), {}, {}
    for s in sorted(lists):
        for n, t in enumerate(lists[s], 1):
            score[t] += 1 / (60 + n)
            best[t] = min(best.get(t, 99), n)
            first.setdefault(t, s)
    pool = sorted(score, key=lambda t: (-round(score[t], 12), first[t], best[t], t))[:k]
    values = [round(score[t], 12) for t in pool]
    norm = {t: (round(score[t], 12) - min(values)) / (max(values) - min(values)) if max(values) > min(values) else 0.0 for t in pool}
    told = {(s, t): a for f, s, t, a in agreement if f == fact}
    consensus = {t: sum(told.get((s, t), 0.0) for s in slots) / len(slots) for t in pool}
    order = sorted(pool, key=lambda t: (-round(norm[t] + beta * consensus[t], 9), t))
    spread = beta * (max(consensus.values()) - min(consensus.values()))
    total = spread + max(norm.values()) - min(norm.values())
    return (order.index(gold) + 1 if gold in order else None), (spread / total if total else None)


@pytest.fixture(scope="module")
def parts(spark):
    rankings, agreement, gold, passes = data()
    frames = (spark.createDataFrame(rankings, "fact long, slot int, tag long, rank long"), spark.createDataFrame(agreement, "fact long, slot int, tag long, agree double"), spark.createDataFrame(gold, "fact long, gold long"), spark.createDataFrame(passes, "fact long, slot int, passes boolean"))
    return data(), frames


def test_ranks_oracle_and_filter(spark, parts):
    (rankings, agreement, gold, passes), (r, a, g, p) = parts
    gold = dict(gold)
    slots = r.select("fact", "slot").distinct()
    arms = ar.filtered_arm(slots, p, "S3").unionByName(slots.select(F.lit("S2").alias("arm"), "fact", "slot"))
    solo = ar.arm_ranks(r, ar.solo_arms(slots), a, g, [0.0, 0.7], 5)
    got = {(x.arm, x.fact, x.beta): x for x in ar.with_oracle(ar.arm_ranks(r, arms, a, g, [0.0, 0.7], 5), solo).collect()}
    own = {f: sorted({s for f2, s, _, _ in rankings if f2 == f}) for f in range(30)}
    for f, slots_ in own.items():
        some = [s for s in slots_ if dict(((x, y), z) for x, y, z in passes)[f, s]] or slots_
        for beta in (0.0, 0.7):
            for arm, use in (("S2", slots_), ("S3", some)):
                rank, share = first_rank(rankings, agreement, gold[f], f, use, beta, 5)
                assert got[arm, f, beta].rank == rank and (got[arm, f, beta].share == pytest.approx(share))
            alone = [x for x in (first_rank(rankings, agreement, gold[f], f, [s], beta, 5)[0] for s in slots_) if x]
            assert got[ar.ORACLE, f, beta].rank == min(alone, default=None)


def test_preferred_and_overlap(spark, parts):
    (rankings, agreement, _, _), (r, a, _, _) = parts
    told = {(f, s, t): v for f, s, t, v in agreement}
    heads = {}
    for f, s, t, k in rankings:
        if k <= 3:
            heads.setdefault(f, {}).setdefault(s, []).append(t)
    pref = {(x.fact, x.slot): x for x in ar.preferred_slots(r, a, 3).collect()}
    over = {(x.fact, x.slot): x.overlap for x in ar.slot_overlap(r, 3).collect()}
    for f, slots in heads.items():
        score = {s: (lambda v: sum(v) / len(v) if v else 0.0)([told[f, s, t] for t in ts if (f, s, t) in told]) for s, ts in slots.items()}
        best = max(slots, key=lambda s: (round(score[s], 12), -s))
        for s, ts in slots.items():
            assert pref[f, s].score == pytest.approx(score[s]) and pref[f, s].preferred == (s == best)
            other = [len(set(ts) & set(us)) / len(set(ts) | set(us)) for o, us in slots.items() if o != s]
            assert over.get((f, s)) == (pytest.approx(sum(other) / len(other)) if other else None)


def test_contrasts_and_decision(spark):
    r = random.Random(1)
    ranks = [(arm, f, 0.5, r.choice(pool), None) for f in range(80) for arm, pool in (("good", [1, 1, 1, 2]), ("bad", [5, 20, None]), ("same", [5, 20, None]))]
    df = spark.createDataFrame(ranks, "arm string, fact long, beta double, rank long, share double")
    betas = df.select("arm", "beta").distinct()
    out = ar.contrasts(df, betas, [("good", "bad"), ("good", "good")], F.col("fact") % 9, F.lit("table"), 200, 0.05)
    rows = {(x.left, x.right, x.modality, x.metric): x for x in out.collect()}
    assert len(rows) == 2 * 2 * 3
    value = {"mrr": lambda k: 1 / k if k else 0.0, "accuracy": lambda k: float(k == 1), "recall_at_10": lambda k: float(bool(k) and k <= 10)}
    by = {(a, f): k for a, f, _, k, _ in ranks}
    for (left, right, _, metric), x in rows.items():
        diff = [value[metric](by[left, f]) - value[metric](by[right, f]) for f in range(80)]
        assert x["mean"] == pytest.approx(sum(diff) / 80) and x.ci_low <= x["mean"] + 1e-6 and x.ci_high >= x["mean"] - 1e-6
        assert x.equivalent == (left == right)
    assert out.agg(ar.decision(out, "good", "bad", "table").alias("d")).first().d == "adopt"
    assert out.agg(ar.decision(out, "good", "good", "table").alias("d")).first().d == "keep"
    swept = ar.sweep(df, F.lit("table"))
    assert {x.arm: x.beta for x in ar.best_betas(swept, "table").collect()} == {"good": 0.5, "bad": 0.5, "same": 0.5}


def test_abstention(spark):
    df = spark.createDataFrame([(1, 2), (1, 4), (2, 3), (2, 4), (3, 1)], "slot int, resolved int")
    got = {x.slot: (x["mean"], x.violates) for x in ar.abstention(df, "1").collect()}
    assert got == {1: (3.0, False), 2: (3.5, True), 3: (1.0, False)}


@pytest.mark.parametrize("n_parts", [1, 3])
def test_one_pass_over_parts_gives_the_ranks_heads_and_oracle_of_single_steps(spark, parts, n_parts):
    _, (r, a, g, _) = parts
    g = g.where("fact % 5 > 0")
    passes = r.groupBy("fact", "slot").agg((F.max("tag") > 10).alias("passes"))
    slots, betas = r.select("fact", "slot").distinct(), [0.0, 0.7]
    rows = r.join(a, ["fact", "slot", "tag"], "left").withColumn("passes", F.col("tag") > 10).unionByName(spark.createDataFrame([(99, 1, None, 1, None, None), (99, 2, 4, 1, 0.5, False), (None, 1, 3, 1, 0.5, True)], "fact long, slot int, tag long, rank long, agree double, passes boolean"))
    rows = rows.join(g, "fact", "left").repartition(n_parts, "fact")
    got = {(x.arm, x.fact, x.beta): (x["rank"], x.share and round(x.share, 9)) for x in ar.ranks_of_slots(rows, {"S1": [1, 2], "none": [7]}, "S3", betas, 5).collect()}
    own = r.unionByName(spark.createDataFrame([(99, 2, 4, 1)], "fact long, slot int, tag long, rank long"))
    told = a.unionByName(spark.createDataFrame([(99, 2, 4, 0.5)], "fact long, slot int, tag long, agree double"))
    two = slots.unionByName(spark.createDataFrame([(99, 1), (99, 2)], "fact long, slot int"))
    arms = two.where("slot < 3").select(F.lit("S1").alias("arm"), "fact", "slot").unionByName(ar.filtered_arm(two, passes, "S3"))
    solo = ar.arm_ranks(own, ar.solo_arms(two), told, g, betas, 5)
    want = ar.with_oracle(ar.arm_ranks(own, arms, told, g, betas, 5), solo).unionByName(solo)
    assert got == {(x.arm, x.fact, x.beta): (x["rank"], x.share and round(x.share, 9)) for x in want.collect()} and len(got) > 300
    heads = {(x.fact, x.slot): (x.preferred, round(x.score, 9), x.overlap and round(x.overlap, 9)) for x in ar.slot_heads(rows.where("fact < 99"), 3).collect()}
    both = ar.preferred_slots(r, a, 3).join(ar.slot_overlap(r, 3), ["fact", "slot"], "left")
    assert heads == {(x.fact, x.slot): (x.preferred, round(x.score, 9), x.overlap and round(x.overlap, 9)) for x in both.collect()}
