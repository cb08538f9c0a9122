import random

import numpy as np
import xxhash

from orrery.llm import simhash
from orrery.llm.simhash import build_trees, components, fingerprint, near_groups, search_trees


def plain(text, words=3):
    parts = "".join(c.lower() if c.isascii() else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        parts = parts.replace(c, " ")
    parts = [p for p in parts.split(" ") if p]
    shingles = [" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] or ([" ".join(parts)] if parts else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def test_fingerprint_against_plain():
    for t in ["", "a", "A b", "a b c", "É a B\x1cc d e f", " x  y\nz w " * 9]:
        assert fingerprint(t, 3) == plain(t)


def test_tree_search_against_brute_force():
    r = np.random.default_rng(1)
    values = np.unique(r.integers(0, 1 << 12, 400).astype(np.uint64))
    r.shuffle(values)
    tree = np.sort(r.integers(0, 3, len(values)))
    trees = build_trees(values, tree)
    root = trees[0][np.searchsorted(tree[trees[0]], tree)]
    for radius in (0, 2, 3):
        q, n = search_trees(values, trees, values, root, radius)
        want = {(i, j) for i in range(len(values)) for j in range(len(values)) if tree[i] == tree[j] and bin(int(values[i] ^ values[j])).count("1") <= radius}
        assert set(zip(q.tolist(), n.tolist())) == want and len(q) == len(want)


def brute(rows, words, radius):
    fps = [plain(t or "", words) for _, t in rows]
    group = list(range(len(rows)))
    find = lambda x: x if group[x] == x else find(group[x])
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                group[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, fps[k], least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def test_groups_against_brute_force(frame, odd, monkeypatch):
    r = random.Random(2)
    base = [[f"w{r.randint(0, 500)}" for _ in range(120)] for _ in range(20)]
    rows = list(odd)
    for k in range(200):
        t = list(base[k % 20])
        for _ in range(k % 4):
            t[r.randrange(120)] = f"e{k}"
        rows.append((1000 + k, " ".join(t)))
    rows += [(5000 + k, f"only{k}") for k in range(20)]
    want = brute(rows, 3, 2)
    unsigned = lambda x: x & ((1 << 64) - 1)
    run = lambda: sorted(((x.doc_id, unsigned(x.fp), x.component_id) for x in near_groups(frame(rows)).collect()), key=str)
    assert run() == want
    monkeypatch.setattr(simhash, "TREE_NODES", 3)  # shards cut into several trees lose no link
    monkeypatch.setattr(simhash, "QUERY_BLOCK", 2)
    assert run() == want
    assert near_groups(frame([])).count() == 0


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 300) if i % 100 != 99] + [(500, 7), (600, 600)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[99] == 0 and got[150] == 100 and got[299] == 200 and got[500] == 0 and 600 not in got
