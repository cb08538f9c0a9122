"""Episodes against a plain loop that plays them round by round."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orrery.operators import episodes as ep
from orrery.plans.episodes import SETTINGS, rounds

SCHEMA = "episode long, round long, query array<string>, slate array<struct<mode: string, operator: string, dimension: string>>, parsed boolean, rank_after long, replayed boolean, rank_replay long"


def gain(rank):
    return 1 / math.log2(rank + 1) if rank else 0.0


def novelty(query, issued):
    most = max((len(set(query) & set(q)) / len(set(query) | set(q)) for q in issued if set(query) | set(q)), default=0.0)
    return round(1 - most, 6) if query else 1.0


def play(log, s):
    """(stop reason, rejections, rewards) of one episode."""
    issued, rewards, rejected, before = [log[0]["query"]], [], 0, gain(log[0]["rank_after"])
    for r in range(2, s.budget + 1):
        if r > len(log):
            return ep.LOG_ENDED, rejected, rewards
        x = log[r - 1]
        if not x["slate"]:
            return ep.NO_DIRECTIVE, rejected, rewards
        if not x["parsed"]:
            return ep.REVISION_FAILED, rejected, rewards
        if s.gate and novelty(x["query"], issued) < s.threshold:
            rejected += 1
            if rejected >= s.rejections:
                return ep.GATE, rejected, rewards
        after = gain(x["rank_after"])
        other = gain(x["rank_replay"]) if x["replayed"] else before
        rewards.append(s.alpha * (after - before) + (1 - s.alpha) * (after - other))
        issued.append(x["query"])
        before = after
    return ep.BUDGET, rejected, rewards


def test_replay(spark):
    r = random.Random(4)
    logs = {}
    for e in range(150):
        logs[e] = [
            dict(query=[r.choice("abcdefgh") for _ in range(r.randint(0, 5))], slate=[("PERTURB", "O_perturb", "")] * r.choice([0, 1, 1, 1, 1, 2]), parsed=r.random() > 0.1, rank_after=r.choice([None, 1, 2, 7]), replayed=r.random() > 0.3, rank_replay=r.choice([None, 1, 3]))
            for _ in range(r.randint(1, 6))
        ]
        for x in logs[e]:
            x["query"] = sorted(set(x["query"]))
    rows = [(e, n, x["query"], x["slate"], x["parsed"], x["rank_after"], x["replayed"], x["rank_replay"]) for e, log in logs.items() for n, x in enumerate(log, 1)]
    settings = [ep.Settings("a"), ep.Settings("b", budget=2), ep.Settings("c", gate=True, threshold=0.6), ep.Settings("d", budget=6, gate=True, threshold=0.8, rejections=3, alpha=0.9)]
    got = {(x.setting, x.episode): x for x in ep.episodes(ep.replay(spark.createDataFrame(rows, SCHEMA), settings)).collect()}
    assert len(got) == len(logs) * len(settings)
    reasons = Counter()
    for s in settings:
        for e, log in logs.items():
            x = got[s.name, e]
            reason, rejected, rewards = play(log, s)
            # A rejection that ends the episode belongs to a round that was not realized.
            assert (x.stop_reason, x.rounds, x.rejected) == (reason, len(rewards) + 1, rejected - (reason == ep.GATE))
            assert x.reward == pytest.approx(sum(rewards)) and x.rank == log[len(rewards)]["rank_after"]
            reasons[reason] += 1
    assert set(reasons) == {ep.BUDGET, ep.GATE, ep.LOG_ENDED, ep.NO_DIRECTIVE, ep.REVISION_FAILED}


@pytest.mark.parametrize(
    "bad,open_,mismatch,limit,want",
    [
        ([" role", "EVENT"], ["SCOPE", "ROLE"], False, 6, ["REFINE ROLE", "REFINE EVENT", "BRANCH SCOPE", "PERTURB "]),
        (["FAMILY", "ROLE", "EVENT"], ["QUALIFIER", "SCOPE", "TEMPORAL"], True, 6, ["REFINE FAMILY", "REFINE ROLE", "REFINE EVENT", "CHANGE_STRATEGY ", "BRANCH QUALIFIER", "PERTURB "]),
        ([], [], None, 6, ["PERTURB "]),
        (None, ["TEMPORAL", "ELSE"], True, 2, ["CHANGE_STRATEGY ", "PERTURB "]),
    ],
)
def test_slate(spark, bad, open_, mismatch, limit, want):
    df = spark.createDataFrame([(bad, open_, mismatch)], "bad array<string>, open_ array<string>, mismatch boolean")
    got = df.select(ep.slate(F.col("bad"), F.col("open_"), F.col("mismatch"), limit).alias("s"), ep.slate(F.col("bad"), F.col("open_"), F.col("mismatch"), limit, perturb=False).alias("t")).first()
    assert [f"{d.mode} {d.dimension}" for d in got.s] == want and all(d.mode != "PERTURB" for d in got.t)


def test_choose(spark):
    df = spark.createDataFrame([(1, ["FAMILY", "ROLE"], {"O_refine_role": 0.5}), (2, ["FAMILY", "ROLE"], {"O_refine_role": -0.5, "O_perturb": 0.0}), (3, [], {})], "id int, bad array<string>, scores map<string, double>")
    slates = df.withColumn("s", ep.slate(F.col("bad"), F.array().cast("array<string>"), F.lit(False)))
    best, rest = ep.choose(F.col("s"), F.col("scores"))
    got = [tuple(r) for r in slates.select("id", best["operator"].alias("b"), rest["operator"].alias("r")).orderBy("id").collect()]
    assert got == [(1, "O_refine_role", "O_refine_family"), (2, "O_refine_family", "O_perturb"), (3, "O_perturb", None)]
    some, other = ep.choose(F.col("s"), F.col("scores"), [F.col("id")])
    for r in slates.select("s", some.alias("b"), other.alias("r")).collect():
        assert r.b in r.s and (r.r is None) == (len(r.s) == 1) and r.b != r.r


def test_logs_of_conversations(spark):
    log = rounds(spark, "/root/testdata/sf0.001").collect()
    for x in log:
        assert len(x.slate) <= 6 and (x.round == 1) == (not x.slate) and (x.runner_up is not None) == x.replayed
    reasons = {x.stop_reason for x in ep.replay(rounds(spark, "/root/testdata/sf0.01"), SETTINGS).collect()}
    assert len(reasons) >= 3
