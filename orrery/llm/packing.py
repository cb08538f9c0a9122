"""Best-fit packing of token sequences by minimum bin slack."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from orrery.llm.batches import slices, whole_texts
from orrery.llm.bpe import encoder
from orrery.session import staged

SALTS = 256


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to ``room``.

    Bit s of a set is on if some combination has the sum s; each length is added
    as often as it is there, by doubling, the longest first.  Walking back from the
    best sum takes short pieces only where longer ones cannot make it up, so that
    short ones are left to fill later bins.
    """
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        before, left, block = reach, min(counts[length], room // length), 1
        while left:
            take = min(block, left)
            reach |= (reach << (take * length)) & mask
            left -= take
            block *= 2
        if reach != before:
            steps.append((length, before))
    total, used = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> total & 1:
            total -= length
            n += 1
        if n:
            used[length] = n
    return used


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(bins, lengths of each) by minimum bin slack.

    Each bin takes the longest piece left, then the fullest combination for the
    rest of it.  A combination is used again for as many bins as the counts give,
    so the work depends on the number of different lengths, not of pieces.
    """
    counts, out = {x: n for x, n in counts.items() if n}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        used = fullest(counts, capacity - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        bins = min(counts[x] // n for x, n in used.items())
        out.append((bins, used))
        for x, n in used.items():
            counts[x] -= bins * n
            if not counts[x]:
                del counts[x]
    return out


def _places(plan: list[tuple[int, dict[int, int]]], capacity: int) -> dict[str, np.ndarray]:
    """For each run of pieces of one length, by their rank: where it starts, the first bin and the place in each bin."""
    taken, first, rows = {}, 0, []
    for bins, used in plan:
        offset = 0
        for length in sorted(used, reverse=True):
            for _ in range(used[length]):
                start = taken.get(length, 0)
                rows.append((length, start, first, offset))
                taken[length] = start + bins
                offset += length
        first += bins
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 48) + table[:, 1], "start": table[:, 1], "bin": table[:, 2], "offset": table[:, 3]}


def pack(pieces: DataFrame, *, capacity: int, length_col: str = "length", order: list[str]) -> DataFrame:
    """``pieces`` with sequence_id and offset: rows of lengths from 1 to
    ``capacity`` share sequences that hold at most ``capacity``.

    Only the number of pieces of each length reaches the driver, at most
    ``capacity`` numbers.  Pieces of one length are numbered within salted groups
    and the groups put end to end, so a length that many pieces share is numbered
    by many tasks.  Ties in ``order`` are broken arbitrarily; every piece gets a
    place of its own.  An empty table gives an empty result.  Columns sequence_id
    and offset replace input columns of those names; all others stay.
    """
    pieces = pieces.drop(*{"sequence_id", "offset"} - {length_col, *order})
    pieces = pieces.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int"))
    by_salt = pieces.groupBy(length_col, "__salt").agg(F.count("*").alias("__n"))
    base = by_salt.withColumn("__base", F.sum("__n").over(W.partitionBy(length_col).orderBy("__salt")) - F.col("__n")).drop("__n")
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy(length_col).count().collect()}
    where = _places(plan_bins(counts, capacity), capacity)
    nth = F.row_number().over(W.partitionBy(length_col, "__salt").orderBy(*order))
    ranked = pieces.join(base, [length_col, "__salt"]).withColumn("__rank", F.col("__base") + nth - 1).drop("__salt", "__base")
    names = [c for c in ranked.columns if c != "__rank"]

    def run(batches):
        for b in batches:
            length, rank = b.column(length_col).to_numpy().astype(np.int64), b.column("__rank").to_numpy()
            at = np.searchsorted(where["key"], (length << 48) + rank, side="right") - 1
            cols = [b.column(c) for c in names] + [pa.array(where["bin"][at] + rank - where["start"][at]), pa.array(where["offset"][at])]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(*names).schema)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def token_pieces(docs: DataFrame, path: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and then
    ``end_id``, cut only where longer than ``capacity``.

    Null and empty texts are the single ``end_id``.  Other columns are not read.
    """
    rows = whole_texts(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    end, width = int(end_id).to_bytes(4, "little"), 4 * capacity

    def run(batches):
        bpe = encoder(path)
        for part in slices(batches, "text"):
            flat, counts = bpe.encode_column(part.column("text"))
            data, owner, piece, length, crc = memoryview(np.ascontiguousarray(flat, dtype="<u4")).cast("B"), [], [], [], []
            for k, (stop, size) in enumerate(zip((4 * np.cumsum(counts)).tolist(), counts.tolist())):
                start = stop - 4 * size
                for n in range(size // capacity + 1):  # the end counts as one more
                    cut = data[start + n * width : min(start + (n + 1) * width, stop)]
                    full = len(cut) == width
                    owner.append(k)
                    piece.append(n)
                    length.append(len(cut) // 4 + (not full))
                    crc.append(zlib.crc32(cut) if full else zlib.crc32(end, zlib.crc32(cut)))
            piece = np.array(piece, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece), pa.array(piece.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, path: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents with their sequence and place in it; see
    ``token_pieces`` and ``pack``."""
    pieces = staged(token_pieces(docs, path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col), "pieces")
    return pack(pieces, capacity=capacity, order=["doc_id", "piece"])
