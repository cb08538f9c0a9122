"""Ranking metrics over fused supplier rankings, and set and classification measures."""

from pyspark.sql import Window as W, functions as F

from orrery.functions.text import jaccard
from orrery.operators import metrics as me
from orrery.plans.fusion import R, rankings
from orrery.plans.rerank import GOLD, POOL, gold, pool
from orrery.operators import fusion as fu
from orrery.operators.retrieval import ranked
from orrery.plans.registry import query
from orrery.session import table

GR = f"{POOL}, {GOLD}, o AS (SELECT fact, tag, row_number() OVER (PARTITION BY fact ORDER BY round(score, 12) DESC, tag) AS rank FROM pool), gr AS (SELECT fact, min(CASE WHEN tag = gold THEN rank END) AS gr FROM o JOIN gold USING (fact) GROUP BY fact)"
MEASURES = "count(*) AS n, round(avg(CASE WHEN gr <= 1 THEN 1 ELSE 0 END), 6) AS accuracy, round(avg(coalesce(1 / gr, 0)), 6) AS mrr, " + ", ".join(f"round(avg(CASE WHEN gr <= {k} THEN 1 ELSE 0 END), 6) AS recall_at_{k}" for k in me.DEPTHS)


def gold_ranks(spark, sf_dir):
    placed = ranked(pool(spark, sf_dir), ["fact"], [F.desc(F.round("score", 12)), F.col("tag")])
    return me.first_gold_rank(placed, gold(spark, sf_dir), ["fact"])


@query(f"WITH {GR} SELECT coalesce(modality, 'pooled') AS modality, {MEASURES} FROM (SELECT gr, CASE WHEN fact % 3 = 0 THEN 'table' ELSE 'text' END AS modality FROM gr) GROUP BY GROUPING SETS ((modality), ())")
def rank_metrics_by_modality(spark, sf_dir):
    """Accuracy, MRR and recall by modality and over all."""
    rows = gold_ranks(spark, sf_dir).withColumn("modality", F.explode(F.array(F.lit("pooled"), F.when(F.col("fact") % 3 == 0, "table").otherwise("text"))))
    return rows.groupBy("modality").agg(*me.rank_metrics(F.col("gold_rank")))


@query(f"WITH {GR} SELECT fact, gr AS gold_rank, round(coalesce(1 / gr, 0), 6)::DOUBLE AS reciprocal, round(coalesce(1 / log2(gr + 1), 0), 6)::DOUBLE AS logarithmic FROM gr")
def rank_rewards(spark, sf_dir):
    rows = gold_ranks(spark, sf_dir)
    return rows.select("fact", "gold_rank", F.round(fu.rank_gain(F.col("gold_rank")), 6).alias("reciprocal"), F.round(fu.rank_gain(F.col("gold_rank"), "log"), 6).alias("logarithmic"))


@query(
    f"""WITH {R}, {GOLD}, x AS (SELECT fact, min(list) AS first FROM r JOIN gold USING (fact) WHERE tag = gold AND rank <= 10 GROUP BY fact)
    SELECT i::BIGINT AS lists, count(*) AS n, round(avg(CASE WHEN first <= i THEN 1 ELSE 0 END), 6) AS coverage FROM gold LEFT JOIN x USING (fact), (VALUES (1), (2), (3)) t(i) GROUP BY i"""
)
def marginal_coverage(spark, sf_dir):
    """How many facts have their gold tag in one of the first i lists."""
    g = gold(spark, sf_dir)
    first = rankings(spark, sf_dir).where("rank <= 10").join(g, "fact").where("tag = gold").groupBy("fact").agg(F.min("list").alias("first"))
    rows = g.join(first, "fact", "left").withColumn("lists", F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])))
    return rows.groupBy("lists").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("first") <= F.col("lists"), 1.0).otherwise(0.0)), 6).alias("coverage"))


@query(
    f"""WITH {R}, t AS (SELECT fact, list, list(tag) AS ts FROM r WHERE rank <= 10 GROUP BY ALL)
    SELECT a.fact, round(avg(len(list_intersect(a.ts, b.ts)) / len(list_distinct(list_concat(a.ts, b.ts)))), 6) AS mean_jaccard FROM t a JOIN t b ON a.fact = b.fact AND a.list < b.list GROUP BY a.fact"""
)
def pairwise_jaccard(spark, sf_dir):
    lists = rankings(spark, sf_dir).where("rank <= 10").groupBy("fact", "list").agg(F.collect_list("tag").alias("tags"))
    return me.pairwise_jaccard(lists).withColumn("mean_jaccard", F.round("mean_jaccard", 6))


CTX = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:\\.[0-9]+)?'))"


@query(
    f"""WITH t AS (SELECT conv_id, turn, {CTX} AS ts FROM conversations),
    j AS (SELECT a.conv_id, a.turn, max(CASE WHEN b.turn IS NULL THEN NULL WHEN len(a.ts) + len(b.ts) = 0 THEN 1 ELSE len(list_intersect(a.ts, b.ts)) / len(list_distinct(list_concat(a.ts, b.ts))) END) AS m
          FROM t a LEFT JOIN t b ON a.conv_id = b.conv_id AND b.turn < a.turn GROUP BY ALL)
    SELECT conv_id, turn, round(1 - coalesce(m, 0), 6)::DOUBLE AS novelty FROM j"""
)
def novelty(spark, sf_dir):
    """How far each turn of a conversation differs from all turns before."""
    from orrery.functions.text import context_tokens

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", context_tokens(F.col("text")).alias("tokens"))
    return me.novelty(rows, "conv_id", "turn", "tokens").withColumn("novelty", F.round("novelty", 6))


@query(
    """WITH g AS (SELECT o_custkey AS k, o_orderpriority AS p, count(*) AS g FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL), p AS (SELECT o_custkey AS k, o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL),
    s AS (SELECT coalesce(sum(least(coalesce(g, 0), coalesce(n, 0))), 0) AS tp, sum(g) AS gold, sum(n) AS predicted FROM g FULL JOIN p USING (k, p)),
    r AS (SELECT *, coalesce(tp / predicted, 0) AS pr, coalesce(tp / gold, 0) AS re FROM s)
    SELECT tp::BIGINT AS tp, gold::BIGINT AS gold, predicted::BIGINT AS predicted, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1 FROM r"""
)
def set_match_prf(spark, sf_dir):
    """Multisets of (customer, priority) in two samples of orders matched against each other."""
    orders = table(spark, sf_dir, "orders")
    out = me.precision_recall(orders.where("o_orderkey % 3 <> 0"), orders.where("o_orderkey % 2 = 0"), ["o_custkey", "o_orderpriority"])
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


SIGNAL = "SELECT l_returnflag AS grp, CASE WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN NULL ELSE l_discount > 0.05 END AS fired, l_quantity > 25 AS truth FROM lineitem"


@query(
    f"""WITH s AS ({SIGNAL}), c AS (SELECT grp, count(*) FILTER (fired AND truth) AS tp, count(*) FILTER (fired AND NOT truth) AS fp, count(*) FILTER (truth AND (fired IS NULL OR NOT fired)) AS fn, count(*) FILTER (fired) AS issued, count(*) FILTER (truth) AS pos, count(fired) AS ruled, count(*) AS n FROM s GROUP BY grp)
    SELECT grp, tp, fp, fn, issued, round(tp / issued, 6) AS precision, round(tp / pos, 6) AS recall, round(2 * tp / (issued + pos), 6) AS f1, round(pos / n, 6) AS base_rate, round(tp / issued / (pos / n), 6) AS lift, round(ruled / n, 6) AS coverage FROM c"""
)
def confusion_rates(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    fired = F.when(~((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1)), F.col("l_discount") > 0.05)
    return lines.groupBy(F.col("l_returnflag").alias("grp")).agg(*me.confusion(fired, F.col("l_quantity") > 25))


@query(
    """WITH x AS (SELECT event_type AS grp, value AS s, user_id % 3 = 0 AS y FROM events), m AS (SELECT grp, y, row_number() OVER (PARTITION BY grp ORDER BY s) AS rn, s FROM x), k AS (SELECT grp, y, avg(rn) OVER (PARTITION BY grp, s) AS mid FROM m)
    SELECT grp, round((sum(mid) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auroc FROM k GROUP BY grp"""
)
def auroc_midrank(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("grp"), "value", (F.col("user_id") % 3 == 0).alias("y"))
    return me.auroc(rows, ["grp"], "value", "y").withColumn("auroc", F.round("auroc", 6))


@query(
    """WITH x AS (SELECT event_type AS grp, user_id % 3 = 0 AS y, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events), h AS (SELECT *, sum(y::INT) OVER (PARTITION BY grp ORDER BY r) AS h FROM x)
    SELECT grp, round(avg(h / r) FILTER (y), 6) AS average_precision FROM h GROUP BY grp"""
)
def average_precision(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("grp"), "value", (F.col("user_id") % 3 == 0).alias("y"), "event_id")
    return me.average_precision(rows, ["grp"], "value", "y", "event_id").withColumn("average_precision", F.round("average_precision", 6))


@query(
    f"""WITH s AS ({SIGNAL.replace("l_discount > 0.05 END AS fired", "l_discount END AS score")}), t AS (SELECT unnest([0.02, 0.04, 0.06, 0.08])::DOUBLE AS threshold)
    SELECT threshold, count(*) FILTER (score >= threshold) AS issued, round(count(*) FILTER (score >= threshold AND truth) / count(*) FILTER (score >= threshold), 6) AS precision, round(count(*) FILTER (score >= threshold AND truth) / count(*) FILTER (truth), 6) AS recall FROM s, t GROUP BY threshold"""
)
def threshold_sweep(spark, sf_dir):
    """Rates at each threshold, all thresholds in one pass."""
    score = F.when(~((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1)), F.col("l_discount"))
    rows = table(spark, sf_dir, "lineitem").select(score.alias("score"), (F.col("l_quantity") > 25).alias("truth"), F.explode(F.array(*map(F.lit, (0.02, 0.04, 0.06, 0.08)))).alias("threshold"))
    fired = F.count(F.when(F.col("score") >= F.col("threshold"), 1))
    both = F.count(F.when((F.col("score") >= F.col("threshold")) & F.col("truth"), 1))
    return rows.groupBy("threshold").agg(fired.alias("issued"), F.round(F.try_divide(both, fired), 6).alias("precision"), F.round(F.try_divide(both, F.count(F.when(F.col("truth"), 1))), 6).alias("recall"))


@query("WITH x AS (SELECT o_custkey AS fact, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS round, o_totalprice AS v FROM orders) SELECT fact, round, max(v) OVER (PARTITION BY fact ORDER BY round) AS best_so_far FROM x")
def oracle_prefix(spark, sf_dir):
    """The best value up to each round."""
    rows = ranked(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("fact"), "o_orderdate", "o_orderkey", "o_totalprice"), ["fact"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return rows.select("fact", F.col("rank").alias("round"), F.max("o_totalprice").over(W.partitionBy("fact").orderBy("rank")).alias("best_so_far"))


@query("SELECT o_custkey AS fact, count(*) AS rounds, min_by(o_totalprice, row(o_orderdate, o_orderkey)) AS first_value, max_by(o_totalprice, row(o_orderdate, o_orderkey)) AS last_value, round(max_by(o_totalprice, row(o_orderdate, o_orderkey)) - min_by(o_totalprice, row(o_orderdate, o_orderkey)), 6) AS delta FROM orders GROUP BY 1")
def round1_vs_full(spark, sf_dir):
    at = F.struct("o_orderdate", "o_orderkey")
    first, last = F.min_by("o_totalprice", at), F.max_by("o_totalprice", at)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("fact")).agg(F.count("*").alias("rounds"), first.alias("first_value"), last.alias("last_value"), F.round(last - first, 6).alias("delta"))


@query(
    f"""WITH {GR}, b AS (SELECT fact, min(CASE WHEN tag = gold THEN rank END) AS br FROM r JOIN gold USING (fact) WHERE list = 1 GROUP BY fact)
    SELECT fact % 2 AS stratum, count(*) FILTER (coalesce(gr, 999) < coalesce(br, 999)) AS improved, count(*) FILTER (coalesce(gr, 999) = coalesce(br, 999)) AS unchanged, count(*) FILTER (coalesce(gr, 999) > coalesce(br, 999)) AS degraded, round(avg(coalesce(1 / gr, 0) - coalesce(1 / br, 0)), 6) AS gain FROM gr JOIN b USING (fact) GROUP BY 1"""
)
def improvement_counts(spark, sf_dir):
    """Facts whose gold rank the fusion improves over the first list, by stratum."""
    before = me.first_gold_rank(rankings(spark, sf_dir).where("list = 1"), gold(spark, sf_dir), ["fact"]).withColumnRenamed("gold_rank", "before")
    rows = gold_ranks(spark, sf_dir).join(before, "fact")
    a, b = F.coalesce("gold_rank", F.lit(999)), F.coalesce("before", F.lit(999))
    count = lambda c: F.count(F.when(c, 1))
    return rows.groupBy((F.col("fact") % 2).alias("stratum")).agg(count(a < b).alias("improved"), count(a == b).alias("unchanged"), count(a > b).alias("degraded"), F.round(F.avg(fu.rank_gain(F.col("gold_rank")) - fu.rank_gain(F.col("before"))), 6).alias("gain"))
