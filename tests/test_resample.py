"""Bootstraps and percentiles against plain ones that make every draw anew."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import resample as rs

DRAWS = 60


def drawn(size, draws):
    pick = lambda d, s: int(hashlib.md5(f"{d}-{s}".encode()).hexdigest()[:8], 16) % size
    return [[pick(d, s) for s in range(size)] for d in range(draws)]


def area(scores, labels):
    up = [s for s, y in zip(scores, labels) if y]
    down = [s for s, y in zip(scores, labels) if not y]
    return sum((a > b) + (a == b) / 2 for a in up for b in down) / (len(up) * len(down)) if up and down else None


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    return [(f"c{r.randrange(9)}", r.choice([0.1, 0.5, 0.5, 0.9, round(r.random(), 2)]), r.random() < 0.3) for _ in range(150)]


def test_auroc_draws(spark, rows):
    df = spark.createDataFrame(rows, "cluster string, score double, label boolean")
    got = {x.draw: x.auroc for x in rs.auroc_draws(df, "cluster", "score", "label", DRAWS).collect()}
    names = sorted({c for c, _, _ in rows})
    for d, picks in enumerate(drawn(len(names), DRAWS)):
        again = [x for p in picks for x in rows if x[0] == names[p]]
        assert got[d] == pytest.approx(area([s for _, s, _ in again], [y for _, _, y in again]))


def test_auroc_of_one_class_is_null(spark):
    df = spark.createDataFrame([("a", 0.5, True), ("b", 0.7, False)], "cluster string, score double, label boolean")
    got = {x.draw: x.auroc for x in rs.auroc_draws(df, "cluster", "score", "label", 20).collect()}
    assert got == {d: None if len(set(p)) == 1 else 0.0 for d, p in enumerate(drawn(2, 20))}


def test_resampled_sums(spark, rows):
    df = spark.createDataFrame(rows, "cluster string, score double, label boolean")
    sums = df.groupBy("cluster").agg(F.sum("score").alias("s"), F.count("*").alias("n")).join(rs.numbered(df, "cluster"), "cluster").select("at", "s", "n")
    got = {x.draw: (x.s, x.n) for x in rs.resampled(sums, ["s", "n"], DRAWS).collect()}
    names = sorted({c for c, _, _ in rows})
    for d, picks in enumerate(drawn(len(names), DRAWS)):
        again = [x for p in picks for x in rows if x[0] == names[p]]
        assert got[d] == (pytest.approx(sum(s for _, s, _ in again)), len(again))


def test_percentiles(spark):
    r = random.Random(1)
    rows = [(g, r.choice([None, 1.0, 2.5, r.random()])) for g in "aaaabbc" for _ in range(40)] + [("one", 7.0), ("none", None), (None, 3.0)]
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p975": 0.975, "p100": 1.0}
    got = {x.g: x for x in rs.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", shares).collect()}
    for g in {"a", "b", "c", "one"}:
        values = [v for k, v in rows if k == g and v is not None]
        assert [got[g][n] for n in shares] == pytest.approx([float(np.quantile(values, q)) for q in shares.values()])
    assert set(got) == {"a", "b", "c", "one"}
    values = [v for _, v in rows if v is not None]
    whole = rs.percentiles(spark.createDataFrame(rows, "g string, v double"), [], "v", shares).collect()
    assert len(whole) == 1 and [whole[0][n] for n in shares] == pytest.approx([float(np.quantile(values, q)) for q in shares.values()])


def test_permutations_look_values_up_where_they_draw(spark, monkeypatch):
    import hashlib

    from orrery.operators import resample as rs

    monkeypatch.setattr(rs, "SLAB", 8)
    monkeypatch.setattr(rs, "CHUNK", 16)  # a group of 40 is three chunks
    rows = [(g, k, float((k * 37) % 11)) for g, n in (("a", 40), ("b", 1), ("c", 17)) for k in range(n)]
    gains = rs.permuted_gains(spark.createDataFrame(rows, "arm string, fact long, value double"), "arm", "fact", "value", 5)
    got = {(x.arm, x.perm): x.gain for x in gains.collect()}
    draw = lambda perm, fact, n: int(hashlib.md5(f"{perm}-{fact}".encode()).hexdigest()[:8], 16) % n
    for g in "abc":
        own = [v for h, _, v in rows if h == g]
        for perm in range(5):
            want = sum(own[(k + 1 + draw(perm, k, max(len(own) - 1, 1))) % len(own)] > v for k, v in enumerate(own)) / len(own)
            assert abs(got[g, perm] - want) < 1e-12
    assert len(got) == 15
