"""The grid of retrievers against plain rankings."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import robustness as rb


def made():
    r = random.Random(9)
    words = [f"w{k}" for k in range(9)]
    labels = {d: [r.choice(words) for _ in range(r.randint(0, 3))] for d in range(25)}
    asked = {(q, n): [r.choice(words) for _ in range(r.randint(0, 5))] for q in range(8) for n in (0, 1)}
    sides = []
    for _ in range(2):
        rows = {}
        for q, n in asked:
            docs = r.sample(range(25), r.randint(0, 10))
            rows[q, n] = sorted(((r.choice([1.0, 2.0, r.random()]), d) for d in docs), key=lambda x: (-x[0], x[1]))
        sides.append(rows)
    return labels, asked, sides


def plain(labels, asked, sides, weight, k):
    out = {}
    share = lambda a, b: len(set(a) & set(b)) / len(set(a)) if a else 0.0
    fuse = lambda lists: {d: sum(1 / (60 + x.index(d) + 1) for x in lists if d in x) for x in lists for d in x}
    for q in range(8):
        for kind in rb.KINDS:
            lists = []
            for n in (0, 1):
                found = [[d for _, d in s[q, n]] for s in sides]
                score = fuse(found) if kind == "hybrid" else {d: x for x, d in sides[rb.KINDS.index(kind)][q, n]}
                low, high = (min(score.values()), max(score.values())) if score else (0, 0)
                norm = {d: (x - low) / (high - low) if high > low else 1.0 for d, x in score.items()}
                cov = {d: (share(labels[d], asked[q, n]), share(asked[q, n], labels[d])) for d in score}
                total = {d: round(norm[d] + weight * sum(cov[d]), 9) for d in score}
                lists.append(sorted(score, key=lambda d: (-total[d], *((-round(c, 9) for c in cov[d]) if weight else (0, 0)), -round(score[d], 12), d))[:k])
            out[kind, "onepass", q] = lists[0]
            both = fuse(lists)
            out[kind, "rounds", q] = sorted(both, key=lambda d: (-round(both[d], 12), d))[:k]
    return out


def test_variants(spark):
    labels, asked, sides = made()
    frames = [spark.createDataFrame([(q, n, d, s, k) for (q, n), x in side.items() for k, (s, d) in enumerate(x, 1)], "query long, rendering int, doc long, score double, rank long") for side in sides]
    a = spark.createDataFrame([(q, n, t) for (q, n), t in asked.items()], "query long, rendering int, tokens array<string>")
    b = spark.createDataFrame(list(labels.items()), "doc long, label array<string>")
    got = {}
    for x in rb.variant_ranks(*frames, a, b, [0.0, 0.5], 4).collect():
        got.setdefault((x.kind, x.method, x.query, x.weight), {})[x["rank"]] = x.doc
    for w in (0.0, 0.5):
        for (kind, method, q), docs in plain(labels, asked, sides, w, 4).items():
            assert [d for _, d in sorted(got.get((kind, method, q, w), {}).items())] == docs


def test_metrics_and_intervals(spark):
    r = random.Random(2)
    ranks = [("lexical", "onepass", 0.0, q, q % 7, k) for q in range(40) for k in [r.randint(1, 14)]]
    gold = [(q, q % 7) for q in range(40) if q % 5]
    facts = [(q, f"s{q % 4}", "en" if q % 2 else "fr") for q in range(50)]
    out = rb.grid_metrics(
        spark.createDataFrame(ranks, "kind string, method string, weight double, query long, doc long, rank long"), spark.createDataFrame(gold, "query long, doc long"), spark.createDataFrame(facts, "query long, source string, lang string"), F.col("source"), F.col("lang"), 100,
    )
    rows = {(x.modality, x.metric): x for x in out.collect()}
    first = {q: k for _, _, _, q, _, k in ranks if q % 5}
    for m in ("en", "fr", "pooled"):
        own = [q for q, _, lang in facts if m in (lang, "pooled")]
        x = rows[m, "mrr"]
        assert x.n == len(own) and x.value == pytest.approx(sum(1 / first[q] if q in first else 0.0 for q in own) / len(own)) and x.ci_low <= x.value + 1e-6 and x.value - 1e-6 <= x.ci_high
        assert rows[m, "recall_at_10"].value == pytest.approx(sum(first.get(q, 99) <= 10 for q in own) / len(own))
