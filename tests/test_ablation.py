"""Configurations against plain fusions of every fact."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from orrery.operators import ablation as ab

CONFIGS = [ab.Ablation("one", (1,)), ab.Ablation("pick", (1, 2, 3), (0, 1), "select"), ab.Ablation("all", (1, 2, 3), (0, 1)), ab.Ablation("two", (2, 3), (1,))]


def made():
    r = random.Random(12)
    rankings = [(f, h, n, t, k) for f in range(25) for h in (1, 2, 3) for n in (0, 1) if r.random() < 0.9 for k, t in enumerate(r.sample(range(10), r.randint(1, 6)), 1)]
    scores = {(f, h): r.choice([1.0, 2.0, 3.0]) for f in range(25) for h in (1, 2, 3)}
    return rankings, scores, {f: r.randrange(10) for f in range(25)}


def first(lists, gold, variant):
    part, place, best = defaultdict(list), {}, {}
    for at in sorted(lists):
        for k, t in lists[at]:
            part[t].append(1 / (60 + k))
            place.setdefault(t, at)
            best[t] = min(best.get(t, 99), k)
    score = {t: sum(x) / (len(x) if variant == "mean" else 1) for t, x in part.items()}
    order = sorted(score, key=lambda t: (-round(score[t], 12), place[t], best[t], t))
    return order.index(gold) + 1 if gold in order else None


def test_ranks_and_table(spark):
    rankings, scores, gold = made()
    ranks = ab.ablation_ranks(
        spark.createDataFrame(rankings, "fact long, hyp int, rendering int, tag long, rank long"), spark.createDataFrame([(f, h, s) for (f, h), s in scores.items()], "fact long, hyp int, score double"), spark.createDataFrame(list(gold.items()), "fact long, gold long"), CONFIGS,
    ).cache()
    got = {(x.config, x.variant, x.fact): x["rank"] for x in ranks.collect()}
    want = {}
    for c in CONFIGS:
        for f in range(25):
            lists = defaultdict(list)
            for g, h, n, t, k in rankings:
                if g == f and h in c.hyps and n in c.renderings:
                    lists[h, n].append((k, t))
            if c.aggregation == "select" and lists:
                best = max({h for h, _ in lists}, key=lambda h: (scores[f, h], -h))
                lists = {at: x for at, x in lists.items() if at[0] == best}
            for v in ab.VARIANTS:
                if lists:
                    want[c.name, v, f] = first(lists, gold[f], v)
    assert got == want
    rows = {(x.config, x.variant, x.metric): x for x in ab.ablation_table(ranks, "one", F.col("fact") % 6, F.lit("text"), 80).where("modality = 'pooled'").collect()}
    gain = lambda k: 1 / k if k else 0.0
    for c in CONFIGS:
        for v in ab.VARIANTS:
            both = [(gain(want[c.name, v, f]), gain(want["one", v, f])) for f in range(25) if (c.name, v, f) in want and ("one", v, f) in want]
            x = rows[c.name, v, "mrr"]
            assert x.facts == len(both) and x.value == pytest.approx(sum(a for a, _ in both) / len(both)) and x.difference == pytest.approx(sum(a - b for a, b in both) / len(both), abs=1e-12)
            assert (x.improved, x.unchanged, x.degraded) == (sum(a > b for a, b in both), sum(a == b for a, b in both), sum(a < b for a, b in both))
            assert x.value_low <= x.value + 1e-6 and x.value <= x.value_high + 1e-6
    assert rows["one", "sum", "mrr"].difference == 0 and not rows["one", "sum", "mrr"].difference_excludes_zero
