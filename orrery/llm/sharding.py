"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Documents sit on a ring at the hash of their text, so equal texts sit together.
Clockwise from there the first virtual node whose shard has room takes them.  The ring is cut into a fixed number of cells; a text that holds more than
a small share of all bytes is split by document into several units, so that a
hot text spreads over shards and over tasks.  Only the bytes and rows of the
units reach the driver: their number is bounded by ``CELLS + 2 * UNITS``
whatever the size of the input.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, functions as F, Window as W

from orrery.session import staged

CELLS = 1 << 16  # of the ring
UNITS = 10_240  # a text with over 1/UNITS of all bytes is split


def _virtual_nodes(shards: int, replicas: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node in clockwise order."""
    nodes = []
    for shard in range(shards):
        for copy in range(replicas):
            h = int.from_bytes(hashlib.sha256(f"{shard}/{copy}".encode()).digest()[:8], "big")
            nodes.append((h, shard))
    return [(h * cells >> 64, shard) for h, shard in sorted(nodes)]


def _clockwise(nodes: list[tuple[int, int]]) -> list[list[int]]:
    """For each virtual node all shards in the order in which a walk from it meets them."""
    last: list[int] = []
    out: list[list[int]] = [[] for _ in nodes]
    for k in range(2 * len(nodes) - 1, -1, -1):
        shard = nodes[k % len(nodes)][1]
        last = [shard, *(s for s in last if s != shard)]
        if k < len(nodes):
            out[k] = last
    return out


def place_units(units, shards: int, replicas: int = 64, cells: int = CELLS):
    """Walks the ring once: ``units`` are (cell, sub, bytes, rows) and come back
    as (cell, sub, shard, first slot).

    A unit goes to the first shard clockwise that it does not lift over the mean.
    The few that fit nowhere any more go, largest first, to the shard that holds
    least.  So shards end within about one unit of the mean, from above and below.
    """
    nodes = _virtual_nodes(shards, replicas, cells)
    order, cell_of = _clockwise(nodes), [cell for cell, _ in nodes]
    room = [sum(u[2] for u in units) / shards] * shards
    chosen, left = {}, []
    units = sorted(units, key=lambda u: (u[0], u[1]))
    for unit in units:
        for shard in order[bisect_left(cell_of, unit[0]) % len(nodes)]:
            if room[shard] >= unit[2]:
                break
        else:
            left.append(unit)
            continue
        chosen[unit[:2]] = shard
        room[shard] -= unit[2]
    for unit in sorted(left, key=lambda u: (-u[2], u[0], u[1])):
        shard = max(range(shards), key=lambda k: (room[k], -k))
        chosen[unit[:2]] = shard
        room[shard] -= unit[2]
    rows, placed = [0] * shards, []
    for cell, sub, _, count in units:
        shard = chosen[cell, sub]
        placed.append((cell, sub, shard, rows[shard]))
        rows[shard] += count
    return placed


def shard_documents(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", replicas: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row.

    Size is the UTF-8 length plus 16.  Shards get nearly equal bytes: they end
    within about one unit of the mean; a document is never split.  Null texts
    count as empty; rows with a null or repeated id are placed like others and
    get slots of their own; an empty table gives an empty result.  Other columns
    are not read.
    """
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    narrow = staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.pmod(F.xxhash64(text), F.lit(CELLS)).cast("int").alias("cell"),
            F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).alias("nameless"),
        ),
        "ring",
    )
    total = narrow.agg(F.sum("size")).first()[0] or 0
    hot = (
        narrow.groupBy("h").agg(F.sum("size").alias("bytes"))
        .where(F.col("bytes") * UNITS > total)
        .select("h", F.ceil(F.col("bytes") * UNITS / total).cast("int").alias("parts"))
    )  # fewer than UNITS rows: each holds over 1/UNITS of all bytes
    unit = (
        narrow.join(F.broadcast(hot), "h", "left")
        .withColumn("sub", F.when(F.col("parts").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("h", "doc_id", "nameless"), F.col("parts"))).cast("int"))
        .drop("parts")
    )
    sums = unit.groupBy("cell", "sub").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    placed = place_units([tuple(r) for r in sums.collect()], shards, replicas)
    plan = spark.createDataFrame(placed, "cell int, sub int, shard int, base long")
    order = W.partitionBy("cell", "sub").orderBy("h", "doc_id")
    return (
        unit.withColumn("nth", F.row_number().over(order))
        .join(F.broadcast(plan), ["cell", "sub"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("nth") - 1).alias("slot"))
    )
