"""Periodic runs against a search of every period from every word."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

import __spark_entry__ as entry
from orrery.llm.periodic import find_runs, levels, periodic_runs


def brute(words, least, times):
    found = {}
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            s = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i - s + p >= max(least, times * p):
                found.setdefault((s, i - s + p), p)  # the least period comes first
            i += i == s
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    return [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs)]


def made(r):
    """Words with repeated stretches, some of them inside others, and some that are nearly periodic."""
    words = []
    for _ in range(r.randint(0, 7)):
        block = [r.randint(0, r.choice([1, 2, 5, 50])) for _ in range(r.randint(1, 12))]
        words += block * r.randint(1, 12)
        if r.random() < 0.3:
            words += [r.randint(0, 60) for _ in range(r.randint(0, 40))]
        if words and r.random() < 0.2:
            words[r.randrange(len(words))] = 99
    return words


@pytest.mark.parametrize("least,times", [(24, 3), (93, 3), (6, 2), (2, 2), (47, 4)])
def test_find_runs(least, times):
    r = random.Random(least)
    for _ in range(150):
        texts = [made(r) for _ in range(r.randint(0, 5))]
        ids, sizes = np.array(sum(texts, []), dtype=np.int64), np.array([len(t) for t in texts], dtype=np.int64)
        rows = list(zip(*(x.tolist() for x in find_runs(ids, sizes, least, times))))
        assert rows == [(k, *run) for k, t in enumerate(texts) for run in brute(t, least, times)]


def test_levels_name_equal_stretches():
    ids = np.array([1, 2, 1, 2, 1, 2, 3, 1, 2], dtype=np.int64)
    named = levels(ids, np.array([7, 2]))
    for j, level in enumerate(named):
        for a in range(9):
            for b in range(a + 1, 9):
                end = 7 if b < 7 else 9
                alike = (a < 7) == (b < 7) and b + 2**j <= end and ids[a : a + 2**j].tolist() == ids[b : b + 2**j].tolist()
                assert (level[a] >= 0 and level[a] == level[b]) == alike


def test_rows(spark, frame, odd):
    looped = "a b  c\n" * 9 + "a b"
    rows = [*odd, (20, looped), (20, looped), (21, "x " * 40_000), (22, "A a " * 11 + "a A"), (23, "é é ü " * 12)]
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(frame(rows)).collect()), key=str)
    want = []
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        runs = [(0, 40_000, 1)] if i == 21 else [] if len(words) > 10_000 else brute(words, 24, 3)
        want.append((i, runs, " ".join(collapse(words, runs) if i != 21 else ["x"])))
    assert got == sorted(want, key=str)
    assert periodic_runs(frame([])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(frame(rows), times=1)


def test_op12(spark, frame, tmp_path):
    r = random.Random(7)
    rows = [(i, " ".join(f"w{x}" for x in (made(r) if i % 2 else [r.randint(0, 400) for _ in range(r.randint(0, 300))]))) for i in range(400)]
    rows += [(500, None), (501, ""), (None, "a " * 30), (502, "b\t" * 30)]
    frame(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in entry.queries()["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    rewritten = 0
    for i, t in rows:
        words = (t or "").split()
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if i is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            rewritten += 1
        runs = brute(words, 24, 3)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[i].n_runs == len(runs)
        assert (got[i].start, got[i].length, got[i].period, got[i].exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert got[i].runs_sha256 == digest("".join(f"{s},{n},{p}\n" for s, n, p in runs))
        assert got[i].collapsed_sha256 == digest(" ".join(collapse(words, runs)))
    assert rewritten > 20
