"""Searches of every hundredth document: no text travels to meet an id, and what a task holds has a bound."""

import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from __spark_entry__ import queries
from orrery.operators import dense, retrieval as rt

SF = "/root/testdata/sf0.001"


def brute(asked, corpus, k):
    """(query, rank, doc) by the formula; documents are (scope, doc, tokens)."""
    out = []
    for query, scope, want in asked:
        docs = [(d, Counter(t), len(t)) for s, d, t in corpus if s == scope]
        mean, score = sum(n for *_, n in docs) / max(len(docs), 1), {}
        for w in set(want):
            df = sum(w in c for _, c, _ in docs)
            for d, c, n in docs:
                if w in c:
                    score[d] = score.get(d, 0) + math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * n / mean))
        best = sorted(score, key=lambda d: (-round(score[d], 9), d))[:k]
        out += [(query, i, d) for i, d in enumerate(best, 1)]
    return sorted(out)


def made(n, m):
    r = random.Random(7)
    word = lambda: f"w{int(r.paretovariate(0.7)) % 90}"
    corpus = [(r.choice("ab"), i, [word() for _ in range(r.randrange(30))]) for i in range(n)]
    corpus += [(s, n + i, t) for s, i, t in corpus[:40]]  # copies tie
    asked = [(i, r.choice("abc"), [word() for _ in range(r.randrange(6))]) for i in range(m)]
    return asked, corpus


@pytest.mark.parametrize("few, queries_of_group, parts", [(1 << 14, 1 << 14, 32), (0, 3, 3)])
def test_bm25_of_parts_and_groups(spark, monkeypatch, few, queries_of_group, parts):
    for name, value in (("FEW_WORDS", few), ("MOST_QUERIES", queries_of_group), ("PARTS", parts), ("PART_DOCS", 20)):
        monkeypatch.setattr(rt, name, value)
    asked, corpus = made(150, 12)
    got = rt.bm25_topk(spark.createDataFrame(asked, "query long, scope string, tokens array<string>"), spark.createDataFrame(corpus, "scope string, doc long, tokens array<string>"), 5)
    assert sorted((x.query, x["rank"], x.doc) for x in got.collect()) == brute(asked, corpus, 5)


def test_tiles_give_what_all_at_once_gives(monkeypatch):
    asked, corpus = made(300, 25)
    asked, corpus = [(q, "a", t) for q, _, t in asked if t], sorted(((0, i, t) for _, i, t in corpus), key=lambda x: x[1])
    ids = defaultdict(lambda: len(ids))
    hashed = [[ids[w] for w in t] for *_, t in corpus]
    docs = pa.record_batch({"doc": pa.array([i for _, i, _ in corpus]), "length": pa.array([float(len(t)) for t in hashed]), "tokens": pa.array(hashed, pa.list_(pa.int64()))})
    df, mean = Counter(w for t in hashed for w in set(t)), np.mean([len(t) for t in hashed])
    want = [sorted({ids[w] for w in t} & set(df)) for *_, t in asked]
    idf = [[math.log(1 + (len(hashed) - df[w] + 0.5) / (df[w] + 0.5)) for w in t] for t in want]
    asks = pa.record_batch({"query": pa.array([q for q, *_ in asked]), "tokens": pa.array(want, pa.list_(pa.int64())), "idf": pa.array(idf, pa.list_(pa.float64()))})
    for sizes in ((4096, 1 << 20, 512, 512), (7, 60, 4, 2)):
        for name, value in zip(("TILE_DOCS", "TILE_WORDS", "TILE_QUERIES", "MOST_FREQUENT"), sizes):
            monkeypatch.setattr(rt, name, value)
        bests, seen, out = rt._bests([asks], 5), 0, []
        for some in rt._tiles(docs):
            assert some.num_rows == 1 or some.num_rows <= sizes[0] and len(some.column("tokens").flatten()) <= sizes[1]
            tile = rt._Tile(some)
            part = tile.tf * 2.5 / (tile.tf + (1.5 * (0.25 + 0.75 * tile.lengths / mean))[tile.owner])
            for best in bests:
                best.add(tile, part, seen)
            seen += some.num_rows
        assert seen == docs.num_rows
        for best in bests:
            for name, places in zip(best.names.to_pylist(), best.places):
                out += [(name, i, corpus[p][1]) for i, p in enumerate(places, 1)]
        assert sorted(out) == brute(asked, [("a", i, t) for _, i, t in corpus], 5)


@pytest.mark.parametrize("name", ["hybrid_rrf", "hybrid_coverage", "retriever_robustness"])
def test_no_text_travels_to_meet_an_id(spark, monkeypatch, name):
    plans, written = [], rt.staged

    def spy(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, label)

    monkeypatch.setattr(rt, "staged", spy)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        queries()[name](spark, SF)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    texts = [p for p in plans if "text:string" in p]
    assert texts and not any("SortMergeJoin" in p for p in texts)


def test_similarities_held_at_once_have_a_bound():
    rng = np.random.default_rng(1)
    near = dense._Nearest(dense._unit(rng.normal(size=(3000, 8))), None, 5)
    tracemalloc.start()
    near.add(rng.normal(size=(4000, 8)), np.arange(4000), None)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20
