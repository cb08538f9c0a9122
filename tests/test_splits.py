"""Quotas and splits against plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import splits as sp


def allocate(weights, target, caps):
    """One share at a time to the largest deficit."""
    groups = sorted(g for g in weights if weights[g] > 0 and caps.get(g, 0) > 0)
    target = min(target, sum(caps[g] for g in groups))
    out = {g: int(target >= len(groups)) for g in groups}
    raw = {g: weights[g] / sum(weights[x] for x in groups) * target for g in groups}
    while sum(out.values()) < target:
        best = max((g for g in groups if out[g] < caps[g]), key=lambda g: (round(raw[g] - out[g], 9), weights[g], g))
        out[best] += 1
    return out


def test_quotas(spark):
    r = random.Random(3)
    cases = {}
    for a in range(40):
        groups = {f"g{k}": r.choice([0, 1, 2, 5, 30]) for k in range(r.randint(1, 6))}
        cases[a] = (groups, {g: r.randint(0, n) if a % 2 else n for g, n in groups.items()})
    for target in (0, 1, 3, 12, 500):
        rows = [(a, g, n, caps[g]) for a, (groups, caps) in cases.items() for g, n in groups.items()]
        got = {}
        for x in sp.quotas(spark.createDataFrame(rows, "attempt long, stratum string, weight long, cap long"), target, ["attempt"]).collect():
            got.setdefault(x.attempt, {})[x.stratum] = x.quota
        for a, (groups, caps) in cases.items():
            assert got.get(a, {}) == allocate(groups, target, caps)


def test_split_keeps_its_promises(spark):
    r = random.Random(5)
    data = []
    for k in range(120):
        kinds = sorted(r.sample(["a", "b", "c", "rare"], r.choice([1, 2]) if k % 40 else 1))
        data.append((k, k // 2 if k < 4 else 1000 + k, [f"x{r.randrange(30)}" for _ in range(r.randint(0, 4))], kinds, [r.randint(1, 5) for _ in kinds]))
    samples = spark.createDataFrame(data, "key long, context long, concepts array<string>, kinds array<string>, kind_counts array<long>")
    members, report = sp.split_attempts(samples, 50, 15, 4, 0.9)
    by_key = {d[0]: d for d in data}
    rows = report.orderBy("attempt").collect()
    assert [x.attempt for x in rows if x.chosen] == [min((round(x.score, 9), x.attempt) for x in rows)[1]]
    for x in rows:
        side = {s: [m.key for m in members.where(F.col("attempt") == x.attempt).collect() if m.split == s] for s in ("train", "test")}
        assert (len(side["train"]), len(side["test"])) == (x.train, x.test) and not set(side["train"]) & set(side["test"])
        concepts = {c for k in side["train"] for c in by_key[k][2]}
        kinds = {c for k in side["train"] for c in by_key[k][3]}
        assert all(set(by_key[k][2]) <= concepts and set(by_key[k][3]) <= kinds for k in side["test"]) and x.missing_in_train == 0
        shared = {by_key[k][1] for k in side["train"]} & {by_key[k][1] for k in side["test"]}
        assert x.shared_contexts == len(shared)
        entity = {s: {} for s in side}
        for s in side:
            for k in side[s]:
                for kind, n in zip(by_key[k][3], by_key[k][4]):
                    entity[s][kind] = entity[s].get(kind, 0) + n
        share = lambda d, k: d.get(k, 0) / (sum(d.values()) or 1)
        assert x.entity_difference == pytest.approx(max(abs(share(entity["train"], k) - share(entity["test"], k)) for k in {*entity["train"], *entity["test"]}))
    best = [x for x in rows if x.chosen][0]
    if best.passed:
        split = {x.key: x.split for x in sp.chosen_split(samples, members, report).collect()}
        assert set(split) == set(by_key) and sum(s == "train" for s in split.values()) == best.train
    with pytest.raises(ValueError):
        sp.chosen_split(samples, members, report.withColumn("passed", F.lit(False)))
