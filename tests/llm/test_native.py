import hashlib
import re
import zlib
from collections import Counter, defaultdict

from orrery.llm import sharding
from orrery.llm.exact_dedup import exact_groups
from orrery.llm.fingerprints import K, WINDOW, edited_fingerprints, places, winnow
from orrery.llm.line_dedup import drop_boilerplate
from orrery.llm.sharding import place_units, shard_documents


def test_sharding_law(frame, odd):
    rows = odd + [(100 + i, "hot text" if i % 3 else f"text {i} " * (i % 50)) for i in range(3000)]
    got = shard_documents(frame(rows), 8).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = dict((i, t) for i, t in rows if i is not None)
    for r in got:
        if r.doc_id is not None:
            data = (text[r.doc_id] or "").encode()
            assert r.size == len(data) + 16 and r.text_crc32 == zlib.crc32(data)
    assert shard_documents(frame([]), 8).count() == 0


def test_ring_bounds_and_movement():
    units = [(c, 0, 50 + c * 7919 % 100, 1) for c in range(sharding.CELLS)]
    loads = Counter()
    at = {}
    for cell, sub, shard, _ in place_units(units, 40):
        loads[shard] += 50 + cell * 7919 % 100
        at[cell] = shard
    mean = sum(loads.values()) / 40
    assert max(loads.values()) <= mean + 150 and min(loads.values()) >= mean - 150
    moved = sum(at[c] != s for c, _, s, _ in place_units(units, 41))
    assert moved < 0.06 * len(units)  # a plain modulo moves nearly all, the ideal is 1 / 41


def test_shards_against_a_plain_walk(frame, spark):
    rows = [(i, f"text {i} " * (1 + i % 90)) for i in range(4000)] + [(5000 + i, "hot") for i in range(2000)] + [(None, None)] * 300 + [(7000, "long " * 900)]
    docs = frame(rows)
    got = shard_documents(docs, 8).collect()
    cells = {r.doc_id: (r.c, r.size) for r in docs.selectExpr("doc_id", f"pmod(xxhash64(coalesce(text, '')), {sharding.CELLS}) c", "octet_length(coalesce(text, '')) + 16 size").collect()}
    mean = sum(r.size for r in got) / 8
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    assert max(loads.values()) < 1.01 * mean and min(loads.values()) > 0.99 * mean
    nodes = sharding._virtual_nodes(8, 64, sharding.CELLS)
    units = defaultdict(int)
    for r in got:
        if r.doc_id is not None and r.doc_id < 5000:  # texts of their own
            units[cells[r.doc_id][0]] += r.size
    first = {c: next((s for n, s in nodes if n >= c), nodes[0][1]) for c in units}
    home = [r for r in got if r.doc_id is not None and r.doc_id < 5000]
    assert sum(r.shard == first[cells[r.doc_id][0]] for r in home) > 0.5 * len(home)  # most stay where the ring puts them
    room, walked = [mean] * 8, {}
    everything = sorted(place_units([(c, 0, b, 1) for c, b in units.items()], 8), key=lambda p: p[0])
    mean_of = sum(units.values()) / 8
    room = [mean_of] * 8
    for c in sorted(units):  # the walk, node by node
        k = next((k for k, (n, _) in enumerate(nodes) if n >= c), 0)
        walked[c] = next((nodes[(k + j) % len(nodes)][1] for j in range(len(nodes)) if room[nodes[(k + j) % len(nodes)][1]] >= units[c]), None)
        if walked[c] is not None:
            room[walked[c]] -= units[c]
    assert all(walked[c] in (None, s) for c, _, s, _ in everything) and sum(walked[c] is None for c in walked) < 20


def test_exact_groups_against_brute_force(frame, odd):
    rows = odd + [(200 + i, "x" * (i % 5) + " " * (i % 7)) for i in range(300)]
    groups = defaultdict(list)
    bare = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    for i, t in rows:
        groups[bare(t)].append((-len(t or ""), i is None, i))
    got = exact_groups(frame(rows), runs=16, fan_in=4).collect()
    want = Counter()
    for i, t in rows:
        keep = min(groups[bare(t)], key=lambda x: (x[0], x[1], x[2] or 0))[2]
        want[i, keep, len(groups[bare(t)]), i == keep, hashlib.sha256(bare(t).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == want
    assert exact_groups(frame([])).count() == 0


def test_winnowing_places_and_guarantee(frame, odd):
    got = winnow(frame(odd + [(20, " ".join(map(str, range(100))))]), "text", "g").select("doc_id", "text", places(winnow_col()).alias("p")).collect()
    for r in got:
        tokens = re.findall(r"[^\x20\x09-\x0D]{1,8}", r.text or "")
        at = [p.place for p in r.p]
        assert at == sorted(at) and len(set(at)) == len(at)
        grams = max(0, len(tokens) - K + 1) or bool(tokens)
        assert bool(at) == bool(tokens)
        if grams > WINDOW:
            assert all(any(s <= p < s + WINDOW for p in at) for s in range(0, grams - WINDOW + 1, 97))


def winnow_col():
    from pyspark.sql import functions as F

    return F.col("g")


def test_rightmost_of_equal_hashes(frame):
    [r] = winnow(frame([(1, "a " * 30)]), "text", "g").select(places(winnow_col()).alias("p")).collect()
    assert [p.place for p in r.p] == list(range(WINDOW - 1, 30 - K + 1))


def test_edited_fingerprints_against_brute_force(frame, odd):
    rows = [r for r in odd if r[0] is not None]
    rows = list({i: (i, t) for i, t in rows}.values()) + [(50 + i, f"word{i} " * (i + 1)) for i in range(40)]
    order = sorted(rows, key=lambda r: -r[0])
    got = {r.doc_id: r for r in edited_fingerprints(frame(rows)).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        assert got[i].n_chars == len(t) and got[i].edited == t[: len(t) - half] + nxt[:half]
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
    assert got[4].grams == got[5].grams and got[4].near_next == 0 and got[5].near_next == 1
    assert edited_fingerprints(frame([])).count() == 0
    assert len(edited_fingerprints(frame(odd)).collect()) == len(odd)


def test_line_dedup(frame, odd):
    rows = [(i, f"own {i}\nFRAME\n\nrare {i % 50}", "h") for i in range(100)] + [(1000, "FRAME\nx", None), (1001, None, "h")]
    got = {r.doc_id: r for r in drop_boilerplate(frame(rows), ratio=0.05).collect()}
    assert got[7].text == "own 7\n\nrare 7" and got[7].n_dropped == 1 and got[7].n_lines == 4
    assert got[1000].text == "FRAME\nx" and got[1001].text is None and got[1001].n_lines == 0
    whole = {r.doc_id: r for r in drop_boilerplate(frame([(i, "A\nB", "h") for i in range(9)]), min_left=0.3).collect()}
    assert whole[3].text == "A\nB"
    assert len(drop_boilerplate(frame(odd)).collect()) == len(odd)
    assert drop_boilerplate(frame([])).count() == 0


def test_line_dedup_without_broadcast(frame, monkeypatch):
    from orrery.llm import line_dedup

    rows = [(i, f"own {i}\nFRAME", "h" if i % 2 else None) for i in range(40)]
    want = sorted(tuple(r) for r in drop_boilerplate(frame(rows)).select("doc_id", "text", "n_dropped").collect())
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    assert sorted(tuple(r) for r in drop_boilerplate(frame(rows)).select("doc_id", "text", "n_dropped").collect()) == want


def test_line_dedup_by_length(frame):
    passage = " ".join(f"p{j}" for j in range(60))
    rows = [(i, f"own {i}\nLes.\nmore {i}" if i % 40 else f"own {i}\n{passage}\nLes.\nmore {i}") for i in range(400)]
    rows += [(1000 + i, "\n".join(" ".join(f"c{k}w{j}" for j in range(12)) for k in range(6))) for i in range(6)]
    rows += [(2000 + i, f"top {i}\nBy chance.\nend {i}") for i in range(6)]
    rows = [(i, t, "h") for i, t in rows]
    flat, got = ({r.doc_id: r.text for r in drop_boilerplate(frame(rows), decay=d).collect()} for d in (1.0, 0.5))
    assert passage in flat[40] and got[40] == "own 40\nmore 40"  # 10 of 412 pages
    assert got[1002] == dict((i, t) for i, t, _ in rows)[1002]  # copies have the same surroundings
    assert got[2003] == "top 3\nBy chance.\nend 3" and got[1] == "own 1\nmore 1"
    assert len(drop_boilerplate(frame([]), decay=0.5).collect()) == 0
