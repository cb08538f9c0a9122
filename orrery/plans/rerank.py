"""Suppliers of parts re-ranked with verdicts from two hypotheses on three dimensions."""

from pyspark.sql import functions as F

from orrery.operators import fusion as fu, rerank as rr
from orrery.operators.metrics import first_gold_rank
from orrery.plans.fusion import R, rankings
from orrery.plans.registry import query
from orrery.session import dealt, staged, table

#: pool: the fused top 20; v: verdicts, some null, none for every seventh candidate; gold: the supplier of a part's last shipment.
POOL = f"""{R}, f AS (SELECT fact, tag, sum(1.0::DOUBLE / (60 + rank)) AS score, min(rank) AS br, min(list) AS fl FROM r GROUP BY ALL),
    pool AS (SELECT fact, tag, score FROM (SELECT *, row_number() OVER (PARTITION BY fact ORDER BY round(score, 12) DESC, fl, br, tag) AS rank FROM f) WHERE rank <= 20)"""
VERDICTS = """h AS (SELECT * FROM (VALUES (0), (1)) t(hyp)), dim AS (SELECT * FROM (VALUES (1, 'A'), (2, 'B'), (3, 'C')) t(k, dimension)),
    v AS (SELECT fact, hyp, tag, dimension, CASE (fact * 31 + tag * 17 + hyp * 7 + k * 5) % 5 WHEN 0 THEN NULL WHEN 1 THEN false WHEN 2 THEN false ELSE true END AS verdict FROM pool, h, dim WHERE (fact + tag) % 7 <> 0)"""
GOLD = "gold AS (SELECT l_partkey AS fact, max_by(l_suppkey, row(l_shipdate, l_orderkey, l_linenumber)) AS gold FROM lineitem GROUP BY 1)"


def pool(spark, sf_dir):
    return fu.fused_ranking(fu.rrf(rankings(spark, sf_dir)), 20).select("fact", "tag", F.col("rrf").alias("score"))


def hyps(facts):
    return facts.select("fact").distinct().withColumn("hyp", F.explode(F.array(F.lit(0), F.lit(1))))


def verdicts(rows):
    dims = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(d).alias("dimension")) for k, d in ((1, "A"), (2, "B"), (3, "C"))])
    grid = rows.where((F.col("fact") + F.col("tag")) % 7 != 0).withColumn("hyp", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("d", F.explode(dims))
    m = (F.col("fact") * 31 + F.col("tag") * 17 + F.col("hyp") * 7 + F.col("d.k") * 5) % 5
    return grid.select("fact", "hyp", "tag", "d.dimension", F.when(m > 2, True).when(m > 0, False).alias("verdict"))


def gold(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("fact"), "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber")
    return dealt(lines, "fact").groupBy("fact").agg(F.max_by("l_suppkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("gold"))


def consensus_pool(spark, sf_dir, policy="drop", fill="zero", weighted=False):
    rows = dealt(staged(pool(spark, sf_dir), "pool"), "fact")  # four parts of the plan read it
    v = verdicts(rows)
    agree = rr.agreement(v, "weighted", rr.variance_weights(v)) if weighted else rr.agreement(v, policy)
    return rr.consensus(rows, agree, hyps(rows), fill)


def _sql(agree, fill="0", extra=""):
    return f"""WITH {POOL}, {VERDICTS}{extra}, a AS ({agree}), g AS (SELECT p.fact, p.tag, p.score, h.hyp, a.agree FROM pool p CROSS JOIN h LEFT JOIN a ON a.fact = p.fact AND a.hyp = h.hyp AND a.tag = p.tag),
    g2 AS (SELECT fact, tag, score, coalesce(agree, {fill}, 0) AS agree FROM g), cs AS (SELECT fact, tag, max(score) AS score, avg(agree) AS consensus FROM g2 GROUP BY fact, tag)"""


AGREE = "SELECT fact, hyp, tag, avg({0}) AS agree FROM v GROUP BY ALL"
DROP = AGREE.format("verdict::INT::DOUBLE")
BLEND = """, b AS (SELECT fact, tag, consensus, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE {tied} END + {beta} * consensus AS final FROM cs WINDOW w AS (PARTITION BY fact)),
    o AS (SELECT *, row_number() OVER (PARTITION BY fact ORDER BY round(final, 9) DESC, tag) AS rank FROM b)"""
SHOW = " SELECT fact, tag, round(consensus, 6) AS consensus, round(final, 6) AS final, rank FROM o WHERE rank <= 10"


def _show(df):
    return df.where("rank <= 10").select("fact", "tag", F.round("consensus", 6).alias("consensus"), F.round("final", 6).alias("final"), "rank")


@query(_sql(DROP) + BLEND.format(tied="0", beta="0.6::DOUBLE") + SHOW)
def beta_blend(spark, sf_dir):
    """Scaled fusion score plus 0.6 times the share of supporting rulings."""
    return _show(rr.blend(consensus_pool(spark, sf_dir), 0.6))


@query(_sql(DROP, "avg(agree) OVER (PARTITION BY fact, hyp)") + BLEND.format(tied="0", beta="0.6::DOUBLE") + SHOW)
def mean_fill_consensus(spark, sf_dir):
    """Candidates without rulings get the mean of their hypothesis."""
    return _show(rr.blend(consensus_pool(spark, sf_dir, fill="mean"), 0.6))


@query(
    _sql(
        "SELECT fact, hyp, tag, CASE WHEN sum(w) FILTER (verdict IS NOT NULL) <> 0 THEN sum(w * verdict::INT::DOUBLE) / sum(w) FILTER (verdict IS NOT NULL) END AS agree FROM v JOIN vw USING (fact, hyp, dimension) GROUP BY ALL",
        extra=", vv AS (SELECT fact, hyp, dimension, coalesce(var_pop(verdict::INT::DOUBLE), 0) AS x FROM v GROUP BY ALL), vw AS (SELECT fact, hyp, dimension, CASE WHEN max(x) OVER (PARTITION BY fact, hyp) > 0 THEN x ELSE 1 END AS w FROM vv)",
    )
    + BLEND.format(tied="0", beta="0.6::DOUBLE")
    + SHOW
)
def variance_weighted_consensus(spark, sf_dir):
    """Dimensions weigh as much as their rulings vary."""
    return _show(rr.blend(consensus_pool(spark, sf_dir, weighted=True), 0.6))


POLICIES = {"drop": "verdict::INT::DOUBLE", "negative": "coalesce(verdict::INT::DOUBLE, 0)", "neutral": "coalesce(verdict::INT::DOUBLE, 0.5)"}


@query("WITH " + POOL + ", " + VERDICTS + " " + " UNION ALL ".join(f"SELECT '{p}' AS policy, fact, hyp::BIGINT AS hyp, tag, round(avg({e}), 6) AS agree FROM v GROUP BY ALL" for p, e in POLICIES.items()))
def abstention_policies(spark, sf_dir):
    """Agreement when abstentions are dropped, count against, or count one half."""
    out = rr.agreements(verdicts(pool(spark, sf_dir)), list(POLICIES))
    return out.select("policy", "fact", F.col("hyp").cast("long").alias("hyp"), "tag", F.round("agree", 6).alias("agree"))


@query("WITH " + POOL + ", " + VERDICTS + " SELECT fact, hyp::BIGINT AS hyp, tag, round(sum(coalesce(verdict::INT, 0)) / 3, 6) AS agree FROM v GROUP BY fact, hyp, tag")
def strict_denominator_score(spark, sf_dir):
    """Every dimension counts, unresolved ones as contradictions."""
    return rr.agreement(verdicts(pool(spark, sf_dir)), "strict").select("fact", F.col("hyp").cast("long").alias("hyp"), "tag", F.round("agree", 6).alias("agree"))


@query(f"WITH {POOL}, {VERDICTS}, sy AS (SELECT fact, hyp, tag, dimension, tag % 2 = 0 AS verdict FROM pool, h, dim) SELECT sy.fact, sy.hyp::BIGINT AS hyp, sy.tag, round(avg(coalesce(v.verdict, sy.verdict)::INT), 6) AS agree FROM sy LEFT JOIN v USING (fact, hyp, tag, dimension) GROUP BY ALL")
def hybrid_agree(spark, sf_dir):
    """Model verdicts, with symbolic ones where the model does not rule."""
    rows = dealt(staged(pool(spark, sf_dir), "pool"), "fact")
    symbolic = rows.withColumn("hyp", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("dimension", F.explode(F.array(*map(F.lit, "ABC")))).select("fact", "hyp", "tag", "dimension", (F.col("tag") % 2 == 0).alias("verdict"))
    return rr.agreement(rr.hybrid_verdicts(verdicts(rows), symbolic)).select("fact", F.col("hyp").cast("long").alias("hyp"), "tag", F.round("agree", 6).alias("agree"))


@query(_sql(DROP) + " SELECT fact, round(0.6::DOUBLE * (max(consensus) - min(consensus)) / nullif(max(score) - min(score), 0), 6) AS share FROM cs GROUP BY fact")
def rerank_share(spark, sf_dir):
    return rr.rerank_share(consensus_pool(spark, sf_dir), 0.6).select("fact", F.round("share", 6).alias("share"))


@query(f"WITH {R} SELECT fact, list::BIGINT AS list, tag, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END, 6)::DOUBLE AS tie_one, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END, 6)::DOUBLE AS tie_zero FROM r WINDOW w AS (PARTITION BY fact, list)")
def range_normalise_tied(spark, sf_dir):
    """Scaling within a list with either rule for lists whose scores are all alike."""
    rows = rankings(spark, sf_dir)
    scaled = [F.round(rr.minmax(F.col("score"), ["fact", "list"], t), 6).alias(n) for n, t in (("tie_one", 1.0), ("tie_zero", 0.0))]
    return rows.select("fact", F.col("list").cast("long").alias("list"), "tag", *scaled)


BETAS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)


@query(
    _sql(DROP)
    + f""", {GOLD}, be AS (SELECT unnest([{', '.join(f'{b}::DOUBLE' for b in BETAS)}]) AS beta),
    n AS (SELECT fact, tag, consensus, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS norm FROM cs WINDOW w AS (PARTITION BY fact)),
    o AS (SELECT fact, beta, tag, row_number() OVER (PARTITION BY fact, beta ORDER BY round(norm + beta * consensus, 9) DESC, tag) AS rank FROM n, be),
    k AS (SELECT beta, fact, min(CASE WHEN tag = gold THEN rank END) AS gr FROM o JOIN gold USING (fact) GROUP BY ALL),
    e AS (SELECT beta, avg(CASE WHEN gr <= 5 THEN 1 ELSE 0 END) AS recall_at_5, avg(coalesce(1 / gr, 0)) AS mrr FROM k GROUP BY beta)
    SELECT beta, round(recall_at_5, 6) AS recall_at_5, round(mrr, 6) AS mrr, beta = (SELECT max_by(beta, row(round(recall_at_5, 9), round(mrr, 9), -beta)) FROM e) AS selected FROM e"""
)
def beta_sweep_select(spark, sf_dir):
    """Metrics at each weight of the consensus, and the best by recall, then MRR, then the smaller weight."""
    base = consensus_pool(spark, sf_dir).withColumn("norm", rr.minmax(F.col("score"), ["fact"], 0.0))
    grid = base.withColumn("beta", F.explode(F.array(*map(F.lit, BETAS)))).withColumn("final", F.col("norm") + F.col("beta") * F.col("consensus"))
    rows = rr.ranked(grid, ["fact", "beta"], [F.desc(F.round("final", 9)), F.col("tag")])
    found = first_gold_rank(rows, gold(spark, sf_dir), ["beta", "fact"])
    e = found.groupBy("beta").agg(F.avg(F.when(F.col("gold_rank") <= 5, 1.0).otherwise(0.0)).alias("recall_at_5"), F.avg(fu.rank_gain(F.col("gold_rank"))).alias("mrr"))
    best = e.agg(F.max_by("beta", F.struct(F.round("recall_at_5", 9), F.round("mrr", 9), -F.col("beta"))).alias("best"))
    return e.crossJoin(F.broadcast(best)).select("beta", F.round("recall_at_5", 6).alias("recall_at_5"), F.round("mrr", 6).alias("mrr"), (F.col("beta") == F.col("best")).alias("selected"))


@query(f"WITH {R}, {GOLD}, k AS (SELECT fact, list, min(CASE WHEN tag = gold THEN rank END) AS gr FROM r JOIN gold USING (fact) GROUP BY ALL) SELECT fact, min_by(list, row(gr, list)) FILTER (gr IS NOT NULL)::BIGINT AS list, min(gr) AS gold_rank FROM k GROUP BY fact")
def best_single_oracle(spark, sf_dir):
    """The one list that ranks the gold supplier best; null where none has it."""
    found = first_gold_rank(rankings(spark, sf_dir), gold(spark, sf_dir), ["fact", "list"])
    best = F.min(F.when(F.col("gold_rank").isNotNull(), F.struct("gold_rank", "list")))
    return found.groupBy("fact").agg(best.alias("b")).select("fact", F.col("b.list").cast("long").alias("list"), F.col("b.gold_rank").alias("gold_rank"))


WINDOWS = (5, 10, 20)


@query(
    " UNION ALL ".join(
        f"SELECT * FROM ({_sql(DROP, extra='').replace('WHERE (fact + tag) % 7 <> 0', f'WHERE (fact, tag) IN (SELECT (fact, tag) FROM (SELECT fact, tag, row_number() OVER (PARTITION BY fact ORDER BY round(score, 12) DESC, tag) AS wr FROM pool) WHERE wr <= {k}) AND (fact + tag) % 7 <> 0')} SELECT {k}::BIGINT AS win, round(avg(consensus), 6) AS mean_consensus, count(CASE WHEN consensus > 0 THEN 1 END) AS judged FROM cs)"
        for k in WINDOWS
    )
)
def window_sensitivity(spark, sf_dir):
    """The consensus when only verdicts on the first 5, 10 or 20 candidates count."""
    # A candidate outside a window has no verdict under either hypothesis, so its consensus is 0.
    placed = rr.ranked(consensus_pool(spark, sf_dir), ["fact"], [F.desc(F.round("score", 12)), F.col("tag")])
    inside = [F.when(F.col("rank") <= k, F.col("consensus")).otherwise(0.0) for k in WINDOWS]
    sums = placed.agg(*[a for k, c in zip(WINDOWS, inside) for a in (F.round(F.avg(c), 6).alias(f"mean{k}"), F.count(F.when(c > 0, 1)).alias(f"judged{k}"))])
    each = F.array(*[F.struct(F.lit(k).cast("long").alias("win"), F.col(f"mean{k}").alias("mean_consensus"), F.col(f"judged{k}").alias("judged")) for k in WINDOWS])
    return sums.select(F.explode(each).alias("w")).select("w.*")
