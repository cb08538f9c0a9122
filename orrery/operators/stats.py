"""Resampling, permutation and summary statistics with draws that any engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from orrery.session import staged


def draw(n: Column, *keys: Column) -> Column:
    """A number from 0 to n - 1 that depends on the keys alone: the first 32 bits of an MD5."""
    key = F.concat_ws("-", *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % n


def placed(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... within ``by`` in the order of ``order``.

    Ranges of (by, order) are sorted by many tasks and their lengths added up, so a
    group that holds all rows is not sorted by one task, as a window would.
    """
    keys = [*by, *order]
    local = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()).withColumn("__in", F.monotonically_increasing_id())
    local = staged(local, "ordered")
    sizes = local.groupBy("__part", *by).agg(F.count("*").alias("__n"), F.min("__in").alias("__first"))  # a row for each range and group
    base = sizes.withColumn("__base", F.sum("__n").over(W.partitionBy(*by or [F.lit(1)]).orderBy("__part")) - F.col("__n"))
    base = base.select("__base", "__first", F.col("__part").alias("__p"), *[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)])
    match = [F.col("__part") == F.col("__p"), *(F.col(c).eqNullSafe(F.col(f"__by{k}")) for k, c in enumerate(by))]
    return local.join(base, match).select(*rows.columns, (F.col("__base") + F.col("__in") - F.col("__first") + 1).alias(name))


def by_cluster(rows: DataFrame, cluster: str, value: str) -> DataFrame:
    """at, total, n: clusters in order, with what a ratio of sums needs."""
    sums = rows.groupBy(cluster).agg(F.sum(value).alias("total"), F.count(value).alias("n"))
    return placed(sums, [], [cluster], "at").select((F.col("at") - 1).alias("at"), "total", "n")


def times_drawn(size: int, draws: int, spark) -> DataFrame:
    """draw, at, times: of each draw of ``size`` clusters with replacement, how often each one that it has came."""
    slots = spark.range(draws * size).select(F.floor(F.col("id") / max(size, 1)).cast("long").alias("draw"), (F.col("id") % max(size, 1)).alias("slot"))
    at = draw(F.lit(size).cast("long"), F.col("draw"), F.col("slot"))
    return slots.select("draw", at.alias("at")).groupBy("draw", "at").agg(F.count("*").alias("times"))


def bootstrap(clusters: DataFrame, draws: int) -> DataFrame:
    """draw, statistic: the ratio of sums over as many clusters as there are, drawn with replacement.

    Clusters are summed beforehand, so the work is draws times clusters; how often a draw
    has a cluster is counted before it is met with the cluster's sums.
    """
    met = times_drawn(clusters.count(), draws, clusters.sparkSession).join(clusters, "at")
    return met.groupBy("draw").agg((F.sum(F.col("times") * F.col("total")) / F.sum(F.col("times") * F.col("n"))).alias("statistic"))


def interval(samples: DataFrame, value: str = "statistic") -> list[Column]:
    """Bounds of the central 95 % by linear interpolation, and whether they leave out 0."""
    low, high = F.percentile(value, F.lit(0.025)), F.percentile(value, F.lit(0.975))
    return [F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), ((low > 0) | (high < 0)).alias("excludes_zero")]


def normal_interval(value: str, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Aggregates: bounds of a mean's central 95 % from its standard error."""
    half = z * F.stddev_samp(value) / F.sqrt(F.count(value))
    return F.avg(value) - half, F.avg(value) + half


def gate(low: Column, high: Column, at: float = 0.0) -> Column:
    """pass if all of an interval lies over ``at``, fail if all lies under it, else inconclusive; null bounds decide nothing."""
    return F.when(low > at, "pass").when(high < at, "fail").otherwise("inconclusive")


def assert_rate(rate: float, reference: float, tolerance: float = 0.05) -> None:
    """Raises where a rate, as of self-retrieval, is worse than its reference by more than the tolerance."""
    if rate > reference + tolerance:
        raise AssertionError(f"rate {rate:.4f} is over {reference:.4f} by more than {tolerance}")


def distribution_distance(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """l1 and max_abs distance between the shares of ``key`` in two tables, over the union of its values."""
    def shares(df, name):
        return df.groupBy(key).agg(F.count("*").alias(name)).withColumn(name, F.col(name) / F.sum(name).over(W.partitionBy(F.lit(1))))

    d = F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))
    return shares(a, "p").join(shares(b, "q"), key, "full_outer").agg(F.sum(d).alias("l1"), F.max(d).alias("max_abs"))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for all pairs: 1 for a column with itself, 0 where one does not vary."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = rows.agg(*[(F.lit(1.0) if a == b else F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))).alias(f"{a}|{b}") for a, b in pairs])
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])
    return one.select(F.explode(each).alias("e")).select("e.*")


def correlated_features(matrix: dict[tuple[str, str], float], order: list[str], threshold: float) -> list[str]:
    """Features kept when each one, in order, drops the later ones it correlates with."""
    kept: list[str] = []
    for c in order:
        if all(abs(matrix.get((k, c), matrix.get((c, k), 0.0))) <= threshold for k in kept):
            kept.append(c)
    return kept


def stratum(rows: DataFrame, key: str, kinds: str) -> DataFrame:
    """``key``, stratum: of the kinds (an array column) of a row the one that the fewest rows have, of equals the first."""
    each = rows.select(key, F.explode(F.array_distinct(kinds)).alias("kind"))
    n = each.groupBy("kind").agg(F.count("*").alias("n"))
    return each.join(n, "kind").groupBy(key).agg(F.min(F.struct("n", "kind"))["kind"].alias("stratum"))
