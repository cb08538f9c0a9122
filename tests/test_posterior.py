"""Posterior states against a plain bank of credits."""

import random

import numpy as np
import pytest

from orrery.operators import posterior as po


class Bank:
    """Keeps every credit and adds up what a reader may see."""

    def __init__(self, zeta, ridge, dim):
        self.zeta, self.ridge, self.dim, self.credits = zeta, ridge, dim, []

    def moments(self, arm, step, context):
        a, b = self.ridge * np.eye(self.dim), np.zeros(self.dim)
        for s, m, c, psi, r in self.credits:
            if m == arm and s < step and c != context:
                w = self.zeta ** (step - s)
                a, b = a + w * np.outer(psi, psi), b + w * r * psi
        return a, b


def frames(spark, credits, reads):
    w = spark.createDataFrame([(m, s, c, [float(x) for x in psi], float(r)) for s, m, c, psi, r in credits], "arm string, step long, context string, psi array<double>, reward double")
    return w, spark.createDataFrame(reads, "read long, arm string, step long, context string")


@pytest.mark.parametrize("zeta,block", [(0.9, 7), (0.999, 16), (1.0, 5), (0.05, 9)])
def test_every_state(spark, monkeypatch, zeta, block):
    monkeypatch.setattr(po, "BLOCK", block)
    r = random.Random(block)
    bank = Bank(zeta, 2.0, 4)
    step = 0
    for _ in range(160):
        step += r.choice([1, 1, 1, 40])
        bank.credits.append((step, r.choice(["a", "a", "a", "b"]), r.choice([None, "x", "y", f"c{step}"]), np.array([1.0, *(r.random() for _ in range(3))]), r.random() - 0.3))
    reads = [(k, m, s, c) for k, (s, m, c) in enumerate((s, m, c) for s in range(0, step + 3, 9) for m in ("a", "b", "none") for c in ("x", None, "new"))]
    got = {x["read"]: x for x in po.posterior_states(*frames(spark, bank.credits, reads), 4, zeta, 2.0).collect()}
    assert len(got) == len(reads)
    for k, m, s, c in reads:
        a, b = bank.moments(m, s, c)
        assert np.allclose(got[k].a, a.reshape(-1)) and np.allclose(got[k].b, b) and np.allclose(got[k]["mean"], np.linalg.solve(a, b))


def test_own_context_is_left_out_and_old_credit_fades(spark):
    one = np.ones(3)
    score = lambda credits, context, step: sum(po.posterior_states(*frames(spark, credits, [(1, "role", step, context)]), 3, 0.5).collect()[0]["mean"])
    assert score([(0, "role", "A", one, 5.0)], "B", 1) > 0.1
    assert abs(score([(0, "role", "A", one, 5.0)], "A", 1)) < 1e-12
    credits = [(0, "role", "old", one, 1.0), *((k, "other", f"f{k}", one, 0.0) for k in range(1, 11))]
    assert score(credits, "now", 11) < score(credits[:1], "now", 1)


def test_long_gaps_do_not_overflow():
    steps = np.array([0, 1, 2_000_000, 2_000_001, 9_000_000], dtype=np.int64)
    sums, _ = po.decayed_before(np.array(["k"] * 5, dtype=object), steps, np.ones((5, 1)), 0.995)
    assert np.allclose(sums[:, 0], [0, 0.995, 0, 0.995, 0])
