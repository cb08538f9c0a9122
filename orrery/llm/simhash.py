"""Near duplicates by SimHash fingerprints and BK-trees."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from orrery.llm.batches import text_slices, whole_texts
from orrery.session import staged, unstage

TREE_NODES = 20_000  # of one tree; a larger shard is sharded anew
FINE = 8  # blocks that agree in a shard of those
QUERY_BLOCK = 4096
SEED = 42


def fingerprint(text: str, words: int) -> int:
    """64 bits; each is on if it is on in over half the hashes of the ``words``-word shingles."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII letters and white space count
    if not parts:
        return 0
    flat, size = b" ".join(parts), len(parts)
    if size <= words:
        hashes = [xxhash.xxh64_intdigest(flat, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=size) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(flat[a:b], SEED) for a, b in zip(starts[: size - words + 1].tolist(), ends[words - 1 :].tolist())]
    on = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[at : at + (1 << 14)], dtype=">u8")
        on += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(on * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed) for every row.  Null texts have no words, like empty
    ones: fingerprint zero.  Texts of fewer words are one shingle."""
    rows = whole_texts(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for part, texts in text_slices(batches, "text"):
            fps = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def build_trees(values: np.ndarray, tree: np.ndarray):
    """BK-trees of distinct ``values``, one for each number in the sorted ``tree``.

    Returns (root of each tree, first child, number of children, children,
    distances of children).  All trees grow together, one level at a time: values
    under a node that have the same distance to it follow the same edge, and the
    first of them becomes the child at its end.
    """
    n = len(values)
    roots = np.flatnonzero(np.diff(tree, prepend=-1))
    parent = np.full(n, -1, dtype=np.int64)
    edge = np.zeros(n, dtype=np.int64)
    node = roots[np.searchsorted(tree[roots], tree)]
    rest = np.setdiff1d(np.arange(n), roots)
    while len(rest):
        d = np.bitwise_count(values[rest] ^ values[node[rest]]).astype(np.int64)
        _, first, group = np.unique(node[rest] * 65 + d, return_index=True, return_inverse=True)
        child = rest[first]
        parent[child], edge[child] = node[child], d[first]
        node[rest] = child[group]
        rest = np.delete(rest, first)
    order = np.lexsort((edge, parent))
    order = order[parent[order] >= 0]
    count = np.bincount(parent[order], minlength=n)
    start = np.concatenate([[0], np.cumsum(count)[:-1]])
    return roots, start, count, order, edge[order]


def search_trees(values, trees, queries: np.ndarray, root: np.ndarray, radius: int):
    """(query, node) of all values within ``radius``, following from each node only
    edges whose distance differs from the query's by no more than it."""
    _, start, count, child, edge = trees
    asked, nodes, found = np.arange(len(queries)), root, []
    while len(asked):
        d = np.bitwise_count(queries[asked] ^ values[nodes]).astype(np.int64)
        near = d <= radius
        found.append((asked[near], nodes[near]))
        n = count[nodes]
        at = np.repeat(start[nodes] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        follow = np.abs(edge[at] - np.repeat(d, n)) <= radius
        asked, nodes = np.repeat(asked, n)[follow], child[at[follow]]
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the classes of a[i] and b[i]; ``label`` holds the least member of each class."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label != label[label]).any():
            label[:] = label[label]


def shard_links(fp: np.ndarray, home: np.ndarray, shard: np.ndarray, radius: int):
    """(fingerprint, least of its class) for all that have a link within their shard.

    Rows are sorted by shard.  Those at home are in the shard's tree; all are asked.
    """
    values, tree = fp[home].view(np.uint64), shard[home]
    if not len(values):
        return fp[:0], fp[:0]
    at = np.flatnonzero(home)
    trees = build_trees(values, tree)
    root_of = trees[0][np.minimum(np.searchsorted(tree[trees[0]], shard), len(trees[0]) - 1)]
    asks = np.flatnonzero(tree[root_of] == shard)
    label = np.arange(len(fp))
    for a in range(0, len(asks), QUERY_BLOCK):
        part = asks[a : a + QUERY_BLOCK]
        q, node = search_trees(values, trees, fp[part].view(np.uint64), root_of[part], radius)
        _joined(label, part[q], at[node])
    own = np.flatnonzero(label != np.arange(len(fp)))
    return fp[own], fp[label[own]]


def _blocks(radius: int, distinct: int, most: int = 64) -> int:
    """The least number of blocks that leaves about ``most`` fingerprints to a shard, or fewer; any number finds the same links."""
    kept = 2
    while kept < 8 and distinct > most << (64 * kept // (radius + kept)):
        kept += 1
    return radius + kept


def _sharded(distinct: DataFrame, radius: int, blocks: int, first: int) -> DataFrame:
    """fp with t, k: a choice of blocks, numbered from ``first``, and its bits."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius), first):
        mask = sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen)
        mask = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(mask)).alias("k")))
    return distinct.select("fp", F.explode(F.array(*keys)).alias("s")).select("fp", "s.t", "s.k")


def links(distinct: DataFrame, radius: int, blocks: int) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that join the same
    classes as all pairs within ``radius``, at most one for each row of a shard.

    The 64 bits are cut into ``blocks``; fingerprints that differ in at most
    ``radius`` bits agree in at least ``blocks - radius`` of them.  Each choice of
    that many blocks and their bits is a shard, where rows meet.  Two rows that
    meet in a shard of over ``TREE_NODES`` meet again in shards of choices out of
    ``FINE`` further blocks: for a radius of 2 these leave 14 bits open, so no
    shard holds over 16,384 fingerprints, and a row has 45 copies at most,
    however many rows are alike.
    """
    coarse = _sharded(distinct, radius, blocks, 0)
    large = staged(coarse.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > TREE_NODES).select("t", "k"), "large")
    rows = coarse
    if not large.isEmpty():
        alike = coarse.join(large, ["t", "k"], "left_semi").select("fp").distinct()
        rows = coarse.join(large, ["t", "k"], "left_anti").unionByName(_sharded(alike, radius, radius + FINE, 1 << 20))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("t", "k", "fp").repartition(n, "t", "k").sortWithinPartitions("t", "k")

    def run(batches):
        held = None
        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "k", "fp")}
            if held is not None:
                cols = {c: np.concatenate([held[c], cols[c]]) for c in cols}
            change = np.flatnonzero((np.diff(cols["t"]) != 0) | (np.diff(cols["k"]) != 0))
            cut = change[-1] + 1 if len(change) else 0
            held = {c: v[cut:] for c, v in cols.items()}
            if cut:
                yield link_batch({c: v[:cut] for c, v in cols.items()})
        if held is not None:
            yield link_batch(held)

    def link_batch(cols):
        new = (np.diff(cols["t"], prepend=-1) != 0) | (np.diff(cols["k"], prepend=0) != 0)
        shard = np.cumsum(new) - 1 if len(new) else np.zeros(0, dtype=np.int64)
        if len(shard):
            shard -= shard[0]
        shared = np.bincount(shard, minlength=1)[shard] > 1
        a, b = shard_links(cols["fp"][shared], np.ones(int(shared.sum()), dtype=bool), shard[shared], radius)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: the least node of every connected component that ``edges``
    (a, b) span, by alternating large-star and small-star steps.

    Each round keeps as many edges as there are nodes at most, is written to the
    shared folder and replaces the one before.
    """
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = staged(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        unstage(edges)
        edges = after
        # Stars: every node has one edge, and no node that others point to has one.
        apart = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
        if apart:
            break
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_groups(docs: DataFrame, *, words: int = 3, radius: int = 2, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed), component_id for every row.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the
    least id that links reach, the own one included.  Rows without words have
    fingerprint zero and link like others.  Equal fingerprints are one node, so
    copies cost one row.  Null ids pass through and name no component unless it
    has no other id.  An empty table gives an empty result; other columns are
    not read.
    """
    printed = staged(fingerprints(docs, words=words, id_col=id_col, text_col=text_col), "fingerprints")
    classes = staged(printed.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes.select("fp"), radius, blocks or _blocks(radius, classes.count())))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    member = rooted.join(named, "root").select("fp", "component_id")
    return printed.join(member, "fp").select("doc_id", "fp", "component_id")
