"""Hard negatives of anchors from a full sort of integer scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orrery.operators.retrieval import ranked
from orrery.session import staged

ROW_BLOCK = 4096  # rows that a task scores and sorts for an anchor at once
ANCHOR_BLOCK = 2048
SCORES = 1 << 21  # that a task holds at once
EXACT = 2.0**53  # below, sums of whole doubles are exact
MOST = 10**37  # scores beyond count as this
LONG = (1 << 63) - 1


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """A row of ``dim`` numbers for each vector; shorter ones end in zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = vectors.flatten().to_numpy()
    return out


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in doubles, or in Python's numbers where doubles might round."""
    out = anchors @ rows.T
    big = np.abs(anchors).max(initial=0, axis=1)[:, None] * np.abs(rows).max(initial=0, axis=1) * anchors.shape[1] >= EXACT
    if big.any():
        out = out.astype(object)
        for a, r in zip(*np.nonzero(big)):
            out[a, r] = max(-MOST, min(MOST, sum(int(x) * int(y) for x, y in zip(anchors[a], rows[r]))))
    return out


def negatives(order: np.ndarray, ids: np.ndarray, score: np.ndarray, other: np.ndarray, positive: list, k: int, low: int, high: int):
    """(number of the positive, row) of up to ``k`` rows for each positive score: those of
    another label with low% to high% of it, from the upper limit down.

    ``order`` sorts the rows by falling score, then id.
    """
    falling = -score[order]
    open_ = np.flatnonzero(other[order])  # places of rows of another label
    found = []
    for n, s in enumerate(positive):
        # 100 score <= high s is the same as score <= floor(high s / 100).
        top = np.searchsorted(falling, -((high * s) // 100), side="left")
        part = open_[np.searchsorted(open_, top) :][:k]
        part = part[[100 * int(x) >= low * s for x in score[order[part]]]] if len(part) else part
        found += [(n, r) for r in order[part].tolist()]
    return found


def _dealt(rows: DataFrame, anchors: DataFrame, row_blocks: int, anchor_blocks: int):
    """Both sides grouped by (block of anchors, block of rows)."""
    def every(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    def own(n, seed):
        return F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n))

    left = anchors.select("*", own(anchor_blocks, 1).alias("a"), every(row_blocks).alias("r"))
    # Cogrouped sides need columns of their own, though both come from the same table.
    right = rows.select(*[F.col(c).alias(f"row_{c}") for c in rows.columns], own(row_blocks, 2).alias("row_block"), every(anchor_blocks).alias("anchor_block"))
    return left.groupBy("a", "r").cogroup(right.groupBy("anchor_block", "row_block"))


def _each(anchor: pa.Table, row: pa.Table, step):
    """Calls ``step`` with an anchor's place, its scores of all rows, and the rows' order, ids and labels."""
    anchor, row = anchor.combine_chunks(), row.sort_by("row_vec_id").combine_chunks()
    if not anchor.num_rows or not row.num_rows:
        return
    vectors = [t.column(c).combine_chunks() for t, c in ((anchor, "vec"), (row, "row_vec"))]
    vectors = [v.chunk(0) if isinstance(v, pa.ChunkedArray) else v for v in vectors]
    dim = max(int(np.diff(v.offsets.to_numpy()).max()) for v in vectors)
    left, right = (_matrix(v, dim) for v in vectors)
    ids, labels = row.column("row_vec_id").to_numpy(), row.column("row_label").to_numpy()
    for a in range(0, len(left), most := max(1, SCORES // len(right))):
        for n, score in enumerate(scores(left[a : a + most], right), a):
            step(n, score, np.argsort(-score, kind="stable"), ids, labels)  # rows come by id, so ties stay so


def participants(embeddings: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: float = 256.0) -> DataFrame:
    """vec_id, label, vec (whole numbers: floor(scale x)) of the rows that take part.

    Rows without an id, with a null label, a null vector, or a null or non-finite
    component take no part, nor do those whose id or label is a text and no whole number.  Of rows that repeat an id the least (label, vector) counts.
    """
    x = F.col("v").cast("array<double>")
    whole = embeddings.select(F.col(id_col).try_cast("long").alias("vec_id"), F.col(label_col).try_cast("long").alias("label"), F.col(vec_col).alias("v"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    # floor() of a double is a long; a double of 2^52 or more is whole already.
    floor = lambda c: F.when(F.abs(c * scale) < 2.0**52, F.floor(c * scale).cast("double")).otherwise(c * scale)
    kept = whole.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    kept = kept.select("vec_id", F.struct("label", F.transform(x, floor).alias("vec")).alias("row"))
    return kept.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.vec")


def hard_negatives(rows: DataFrame, is_anchor, *, positives: int = 5, k: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id (once each), label, vec (whole numbers), as ``participants``
    gives them; ``is_anchor`` is a condition on vec_id.  A row's score is its inner
    product with the anchor; higher scores come first, ties by smaller id.  An
    anchor's positives are its first ``positives`` other rows of its label; for each,
    the first ``k`` rows of other labels whose score is ``low`` to ``high`` percent of
    the positive's are returned, fewer where there are no more.  Anchors without
    positives, and positives without such rows, give no rows; an empty table gives none.
    Vectors of different lengths are compared as if the shorter ended in zeros.  Scores
    are exact up to 10^37 and count as that beyond; beyond the range of long they are
    returned as its ends.

    Blocks of ``ANCHOR_BLOCK`` anchors and ``ROW_BLOCK`` rows meet in pairs.  Each pair
    sorts all its scores of an anchor and hands on the first few that may be
    wanted, so what is merged for an anchor is a small part of the rows.
    """
    rows = staged(rows.select("vec_id", "label", "vec"), "vectors")
    anchors = rows.where(is_anchor)
    row_blocks, anchor_blocks = max(1, -(-rows.count() // ROW_BLOCK)), max(1, -(-anchors.count() // ANCHOR_BLOCK))

    def near(anchor: pa.Table, row: pa.Table) -> pa.Table:
        out, own, kinds = [], anchor.column("vec_id").to_pylist(), anchor.column("label").to_pylist()

        def step(n, score, order, ids, labels):
            first = order[(labels[order] == kinds[n]) & (ids[order] != own[n])][:positives]
            out.extend((own[n], int(ids[r]), str(int(score[r]))) for r in first)

        _each(anchor, row, step)
        return _table(out, [("vec_id", pa.int64()), ("id", pa.int64()), ("score", pa.string())])

    found = _dealt(rows, anchors, row_blocks, anchor_blocks).applyInArrow(near, "vec_id long, id long, score string")
    found = ranked(found.withColumn("score", F.col("score").cast("decimal(38,0)")), ["vec_id"], [F.desc("score"), F.col("id")], positives)
    lists = found.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", F.col("score").cast("string").alias("score")))).alias("positives"))
    asked = staged(anchors.join(lists, "vec_id"), "anchors")

    def mine(anchor: pa.Table, row: pa.Table) -> pa.Table:
        out, own, kinds, firsts = [], *(anchor.column(c).to_pylist() for c in ("vec_id", "label", "positives"))

        def step(n, score, order, ids, labels):
            wanted = [int(p["score"]) for p in firsts[n]]
            for at, r in negatives(order, ids, score, labels != kinds[n], wanted, k, low, high):
                out.append((own[n], firsts[n][at]["id"], int(ids[r]), str(wanted[at]), str(int(score[r]))))

        _each(anchor, row, step)
        return _table(out, [("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("negative_id", pa.int64()), ("positive_score", pa.string()), ("negative_score", pa.string())])

    mined = _dealt(rows, asked, row_blocks, anchor_blocks).applyInArrow(mine, "anchor_id long, positive_id long, negative_id long, positive_score string, negative_score string")
    mined = mined.withColumns({c: F.col(c).cast("decimal(38,0)") for c in ("positive_score", "negative_score")})
    first = ranked(mined, ["anchor_id", "positive_id"], [F.desc("negative_score"), F.col("negative_id")], k)
    held = {c: F.greatest(F.least(F.col(c), F.lit(LONG)), F.lit(-LONG - 1)).cast("long").alias(c) for c in ("positive_score", "negative_score")}
    return first.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", *held.values())


def _table(rows: list[tuple], fields: list) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.table({name: pa.array(list(c), kind) for (name, kind), c in zip(fields, columns)})
