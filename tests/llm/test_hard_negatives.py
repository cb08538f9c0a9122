"""Hard negatives against plain sorting of all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, a int, vec int, row_block int, score double"


def make(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 0.5) for r in rows], SCHEMA)


def brute(rows, is_anchor, positives=5, k=10, low=30, high=90):
    out = []
    for i, v, label in rows:
        if not is_anchor(i):
            continue
        def dot(x):
            return sum(int(a) * int(b) for a, b in zip(v, x))

        order = sorted(((-dot(x), j, kind) for j, x, kind in rows if j != i))
        for s, p, _ in [o for o in order if o[2] == label][:positives]:
            found = [(j, -t) for t, j, kind in order if kind != label and low * -s <= 100 * -t <= high * -s][:k]
            out += [(i, p, n, j, -s, t) for n, (j, t) in enumerate(found, 1)]
    return sorted(out)


def whole(v):
    return [float(np.floor(256.0 * np.float64(np.float32(x)))) for x in v]


@pytest.fixture
def small_blocks(monkeypatch):
    for name, n in (("ROW_BLOCK", 40), ("ANCHOR_BLOCK", 7), ("SCORES", 100)):
        monkeypatch.setattr(hn, name, n)


def test_blocks(spark, small_blocks):
    r = random.Random(3)
    rows = [(i, [r.choice([-1.0, 0.5, 0.5, 0.25, r.random()]) for _ in range(6)], r.randrange(4)) for i in range(300)]
    rows += [(i, [0.5] * 6, i % 3) for i in range(300, 420)]  # many ties
    got = hn.hard_negatives(hn.participants(make(spark, rows)), F.col("vec_id") % 10 == 0)
    want = brute([(i, whole(v), kind) for i, v, kind in rows], lambda i: i % 10 == 0)
    assert len(want) > 500 and sorted(map(tuple, got.collect())) == want


def test_odd_rows(spark, small_blocks):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 1.0], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.4], 2), (3, [0.25], 2), (4, [], 2),  # shorter vectors end in zeros
        (5, None, 1), (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, 1.0], None), (None, [1.0, 1.0], 1),
        (11, [0.5, 0.25], 1), (11, [0.75, 0.25], 1), (11, [0.75, 0.25], 0), (11, [0.75, 0.25], 0),  # the least (label, vector) counts
        (10, [3e38, 3e38], 3), (12, [1e30, -1e30], 3), (13, [1e29, 2e30], 4), (20, [1e12, 3.0], 3), (21, [1e3, 1e-3], 4),
    ]
    rows = [(r[0], r[1], r[2]) for r in rows]
    got = hn.hard_negatives(hn.participants(make(spark, rows)), F.col("vec_id") % 10 == 0)
    taken = [(i, whole([*v, 0.0, 0.0][:2]), kind) for i, v, kind in rows if i is not None and i not in (5, 6, 7, 8, 9, 11)] + [(11, whole([0.75, 0.25]), 0)]
    held = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    far = lambda s: abs(s) > 10**37
    want = [(a, p, n, j, held(s), held(t)) for a, p, n, j, s, t in brute(taken, lambda i: i % 10 == 0) if not far(s)]
    found = sorted(map(tuple, got.collect()))
    assert [r for r in found if r[0] in (0, 20)] == [r for r in want if r[0] in (0, 20)] and any(r[0] == 0 for r in found)


def test_exact_beyond_doubles():
    a, b = np.array([[2.0**40, 1.0]]), np.array([[2.0**40, 1.0], [2.0**40, 0.0], [1.0, 1.0]])
    assert hn.scores(a, b).tolist() == [[2**80 + 1, 2**80, 2**40 + 1]]


def test_no_rows(spark):
    assert hn.hard_negatives(hn.participants(make(spark, [])), F.col("vec_id") % 10 == 0).count() == 0
    alone = make(spark, [(0, [1.0], 1), (1, [1.0], 2)])  # no positive
    assert hn.hard_negatives(hn.participants(alone), F.col("vec_id") % 10 == 0).count() == 0


def test_text_ids_and_labels(spark):
    rows = [("0", [1.0], "1"), ("1", [1.0], "1"), ("2", [0.5], "2"), ("x", [0.5], "2"), ("3", [0.5], "b")]
    got = hn.hard_negatives(hn.participants(spark.createDataFrame(rows, "vec_id string, embedding array<double>, label string")), F.col("vec_id") == 0)
    assert [tuple(r) for r in got.collect()] == [(0, 1, 1, 2, 65536, 32768)]
