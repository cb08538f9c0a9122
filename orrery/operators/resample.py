"""Cluster bootstraps of sums, ratios and areas, and exact percentiles by selection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from orrery.operators.stats import draw, placed, times_drawn
from orrery.session import staged


def numbered(rows: DataFrame, cluster: str) -> DataFrame:
    """cluster (as ``cluster``), at: distinct clusters and their numbers from 0 in order."""
    return placed(rows.select(cluster).distinct(), [], [cluster], "at").withColumn("at", F.col("at") - 1)


def resampled(clusters: DataFrame, sums: list[str], draws: int) -> DataFrame:
    """draw and the ``sums`` of the clusters (at, ...) that it holds.

    Clusters are summed beforehand, so the work is draws times clusters, in rows that
    are partly added up before they are shuffled.
    """
    size = clusters.count()
    met = times_drawn(size, draws, clusters.sparkSession).join(clusters, "at")
    return met.groupBy("draw").agg(*[F.sum(F.col("times") * F.col(c)).alias(c) for c in sums])


def auroc_draws(rows: DataFrame, cluster: str, score: str, label: str, draws: int) -> DataFrame:
    """draw, auroc: the area under the ROC curve over resampled clusters; null for draws with one class.

    Rows are counted by score and cluster, sorted once into ranges of scores, and met with
    the vector of how often each draw has their cluster.  A range adds up, for all draws
    at once, its positives, negatives, and the pairs in order within it; what is
    still missing are its positives times the negatives of lower ranges, so the ranges
    are put together by their sums alone.  Equal scores lie in one range and count half.
    """
    spark = rows.sparkSession
    names = staged(numbered(rows, cluster), "clusters")
    size = names.count()
    binned = rows.groupBy(cluster, score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p")).join(names, cluster)
    ranged = binned.select("at", F.col(score).cast("double").alias("score"), "n", "p").repartitionByRange("score").withColumn("range", F.spark_partition_id())
    ranged = staged(ranged, "ranges")
    counts = times_drawn(size, draws, spark).groupBy("at").agg(F.collect_list(F.struct("draw", "times")).alias("drawn"))  # at most a number for each draw

    def summed(t: pa.Table) -> pa.Table:
        t = t.sort_by("score")
        n, p, scores = (t.column(c).to_numpy() for c in ("n", "p", "score"))
        cuts = [0, *(np.flatnonzero(np.diff(scores)) + 1).tolist(), len(scores)]
        drawn = t.column("drawn").to_pylist()
        positive, negative, pairs = np.zeros(draws), np.zeros(draws), np.zeros(draws)
        for a, b in zip(cuts, cuts[1:]):
            up, down = np.zeros(draws), np.zeros(draws)
            for r in range(a, b):
                if drawn[r]:
                    at = np.array([x["draw"] for x in drawn[r]])
                    times = np.array([x["times"] for x in drawn[r]], dtype=np.float64)
                    up[at] += times * p[r]
                    down[at] += times * (n[r] - p[r])
            pairs += up * (negative + down / 2)
            positive += up
            negative += down
        first = pa.array(np.full(draws, scores[0]))
        return pa.table({"first": first, "draw": pa.array(np.arange(draws, dtype=np.int64)), "positive": positive, "negative": negative, "pairs": pairs})

    parts = ranged.join(counts, "at", "left").select("range", "score", "n", "p", "drawn").groupBy("range").applyInArrow(summed, "first double, draw long, positive double, negative double, pairs double")
    parts = staged(parts, "areas")  # draws times ranges
    below = F.sum("negative").over(W.partitionBy("draw").orderBy("first")) - F.col("negative")
    whole = parts.withColumn("pairs", F.col("pairs") + F.col("positive") * below).groupBy("draw").agg(F.sum("pairs").alias("pairs"), F.sum("positive").alias("p"), F.sum("negative").alias("n"))
    return whole.select("draw", F.try_divide(F.col("pairs"), F.nullif(F.col("p") * F.col("n"), F.lit(0.0))).alias("auroc"))


SLAB = 4096  # values that travel in a row
CHUNK = 1 << 23  # values of a group that a task holds, a multiple of SLAB
FACTS = 1 << 18  # facts of a group that a task draws for


def permuted_gains(rows: DataFrame, group: str, fact: str, value: str, perms: int) -> DataFrame:
    """``group``, perm, gain: how often, in each permutation, another fact's value of the group beats a fact's own.

    A fact at place i of n borrows from place i + 1 + draw % n.  What is drawn is never shuffled:
    blocks of facts meet chunks of their group's values, and the task that draws looks the values up, so each value travels once
    for every ``FACTS`` facts of its group.  A group of over ``CHUNK`` values is drawn for once for each chunk.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    order = placed(rows.select(group, fact, F.col(value).cast("double").alias("own")), [group], [fact], "rank").withColumn("i", F.col("rank") - 1).join(F.broadcast(sizes), group)
    order = staged(order.select(group, fact, "own", "i", "n"), "donors")  # facts and values are both read from it
    every = order.count()
    block = min(FACTS, max(1000, -(-every // (4 * parts))))
    last = lambda size: F.floor((F.col("n") - 1) / size)
    slab = order.groupBy(group, F.floor(F.col("i") / SLAB).alias("slab"), "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "own"))), lambda x: x["own"]).alias("held"))
    slab = slab.select(group, F.explode(F.sequence(F.lit(0).cast("long"), last(block))).alias("block"), F.floor(F.col("slab") * SLAB / CHUNK).alias("chunk"), (F.col("slab") * SLAB).alias("i"), "held")
    asks = order.select(group, F.floor(F.col("i") / block).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), last(CHUNK))).alias("chunk"), "i", "n", "own", fact)
    met = slab.unionByName(asks, allowMissingColumns=True).repartition(max(parts, -(-every // block)), group, "block", "chunk")
    met = met.sortWithinPartitions(group, "block", "chunk", F.col("held").isNull(), "i")  # values come before the facts that ask for them
    asking = F.col("held").isNull()
    drawn = F.transform(F.sequence(F.lit(0), F.lit(perms - 1)), lambda perm: (F.col("i") + 1 + draw(F.greatest(F.col("n") - 1, F.lit(1)), perm, F.col(fact))) % F.col("n"))
    met = met.select(F.when(~asking, F.col(group)).alias(group), "i", "own", "held", F.when(asking, drawn).alias("drawn"))
    kind = rows.schema[group].dataType

    def run(batches):
        name, first, chunk, values, gain, seen = None, 0, [], None, np.zeros(perms, dtype=np.int64), np.zeros(perms, dtype=np.int64)

        def told():
            return pa.RecordBatch.from_arrays([pa.array([name] * perms, to_arrow_type(kind)), pa.array(np.arange(perms)), pa.array(gain), pa.array(seen)], names=[group, "perm", "gain", "seen"])

        for b in batches:
            fact, place = b.column("held").is_null().to_numpy(zero_copy_only=False), b.column("i").to_numpy()
            turns = [0, *(np.flatnonzero(np.diff(fact)) + 1).tolist(), len(fact)]
            for x, y in zip(turns, turns[1:]):
                if y > x and not fact[x]:
                    if values is not None:  # the facts of the last chunk are all done
                        yield told()
                        gain, seen, values = np.zeros(perms, dtype=np.int64), np.zeros(perms, dtype=np.int64), None
                    if not chunk:
                        name, first = b.column(group)[x].as_py(), int(place[x])
                    chunk.append(b.column("held").slice(x, y - x).flatten().to_numpy(zero_copy_only=False))
                elif y > x:
                    if chunk:
                        values, chunk = np.concatenate(chunk), []
                    own = b.column("own").to_numpy(zero_copy_only=False)
                    for z in range(x, y, 1000):
                        end = min(z + 1000, y)
                        at = b.column("drawn").slice(z, end - z).flatten().to_numpy().reshape(-1, perms) - first
                        here = (at >= 0) & (at < len(values))
                        seen += here.sum(axis=0)
                        gain += (here & (values[np.where(here, at, 0)] > own[z:end, None])).sum(axis=0)
        if values is not None:
            yield told()

    sums = met.mapInArrow(run, f"{group} {kind.simpleString()}, perm long, gain long, seen long")
    return sums.groupBy(group, "perm").agg((F.sum("gain") / F.sum("seen")).alias("gain"))


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``by`` and, for each name, the percentile at its share by linear interpolation between the two nearest ranks; null values do not count.

    Values are put in order in ranges that many tasks sort; of each group only the
    ranks that are asked for go on.  Groups that are null or have no values give no row.
    """
    known = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    order = staged(placed(known, by, ["_v"], "_n"), "percentiles")
    # Position (n - 1) share from 0: its floor and the rank after, each with its part of the value.
    need = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in shares.items()]))
    one = by or [F.lit(0).alias("_all")]
    at = order.groupBy(*one).agg(F.max("_n").alias("_of")).select(*by, "_of", need.alias("_a")).withColumn("_h", (F.col("_of") - 1) * F.col("_a.q")).withColumn("_low", F.floor("_h"))
    part = F.col("_h") - F.col("_low")
    each = at.select(*by, F.col("_a.name").alias("_name"), F.explode(F.array(F.struct((F.col("_low") + 1).alias("n"), (1 - part).alias("w")), F.struct(F.least(F.col("_low") + 2, F.col("_of")).alias("n"), part.alias("w")))).alias("_x"))
    each = each.select(*by, "_name", F.col("_x.n").alias("_n"), F.col("_x.w").alias("_w"))
    met = order.join(each, [*by, "_n"])
    return met.groupBy(*one).agg(*[F.sum(F.when(F.col("_name") == name, F.col("_w") * F.col("_v"))).alias(name) for name in shares]).select(*by, *shares)


def bounds(value: str, name: str) -> list[Column]:
    """Bounds of the central 95 % of a few thousand draws by linear interpolation, and whether they leave out 0."""
    low, high = F.percentile(value, F.lit(0.025)), F.percentile(value, F.lit(0.975))
    return [F.round(low, 6).alias(f"{name}_low"), F.round(high, 6).alias(f"{name}_high"), ((low > 0) | (high < 0)).alias(f"{name}_excludes_zero")]
