"""Panels over verdicts, query forms and arms."""

from pyspark.sql import functions as F

from orrery.functions.text import tokens
from orrery.operators import fusion as fu, metrics as me, panels, rerank as rr
from orrery.operators.passages import containing
from orrery.operators.retrieval import bm25_topk, ranked
from orrery.plans.fusion import R, rankings
from orrery.plans.registry import query
from orrery.plans.rerank import GOLD, POOL, VERDICTS, gold, pool, verdicts
from orrery.plans.retrieval import SCORES, TOK
from orrery.plans.statistics import DRAW
from orrery.session import table

CALLS = f"WITH {POOL}, {VERDICTS}, {GOLD}, j AS (SELECT v.*, v.tag = gold AS is_gold FROM v JOIN gold USING (fact)), s AS (SELECT fact, hyp, is_gold, avg(verdict::INT::DOUBLE) AS s, count(verdict) AS n, count(*) FILTER (verdict) AS yes FROM j GROUP BY ALL)"


def _judged(spark, sf_dir):
    return verdicts(pool(spark, sf_dir)).join(gold(spark, sf_dir), "fact").withColumn("is_gold", F.col("tag") == F.col("gold"))


@query(
    CALLS
    + """, c AS (SELECT fact, hyp, max(s) FILTER (is_gold) - max(s) FILTER (NOT is_gold) AS gap FROM s GROUP BY ALL)
    SELECT (SELECT round(sum(yes) FILTER (is_gold) / sum(n) FILTER (is_gold), 6) FROM s) AS gold_support, (SELECT round(sum(yes) FILTER (NOT is_gold) / sum(n) FILTER (NOT is_gold), 6) FROM s) AS other_support,
           round(avg(gap), 6) AS mean_gap, round(count(CASE WHEN gap > 0 THEN 1 END) / count(gap), 6) AS favouring FROM c"""
)
def support_gap_panel(spark, sf_dir):
    """How much more rulings support the gold candidate than others of the same call."""
    v = F.col("verdict").cast("double")
    s = _judged(spark, sf_dir).groupBy("fact", "hyp", "is_gold").agg(F.avg(v).alias("s"), F.count("verdict").alias("n"), F.sum(v).alias("yes"))
    side = lambda c, g: F.sum(F.when(F.col("is_gold") == g, F.col(c)))
    rates = s.agg(F.round(side("yes", True) / side("n", True), 6).alias("gold_support"), F.round(side("yes", False) / side("n", False), 6).alias("other_support"))
    gap = s.groupBy("fact", "hyp").agg((F.max(F.when(F.col("is_gold"), F.col("s"))) - F.max(F.when(~F.col("is_gold"), F.col("s")))).alias("gap"))
    return rates.crossJoin(gap.agg(F.round(F.avg("gap"), 6).alias("mean_gap"), F.round(F.count(F.when(F.col("gap") > 0, 1)) / F.count("gap"), 6).alias("favouring")))


@query(
    f"""WITH {POOL}, {VERDICTS}, {GOLD}, t AS (SELECT fact, hyp, avg(verdict::INT::DOUBLE) AS s FROM v WHERE tag % 2 = hyp GROUP BY ALL), w AS (SELECT fact, min_by(tag, row(-round(score, 12), tag)) AS top FROM pool GROUP BY fact),
    x AS (SELECT t.*, (top <> gold) AS wrong FROM t JOIN w USING (fact) JOIN gold USING (fact)), mr AS (SELECT hyp, wrong, s, row_number() OVER (PARTITION BY hyp ORDER BY 1 - s) AS rn FROM x WHERE s IS NOT NULL), k AS (SELECT *, avg(rn) OVER (PARTITION BY hyp, s) AS mid FROM mr)
    SELECT hyp::BIGINT AS hyp, round(avg(s) FILTER (wrong), 6) AS support_when_wrong, round(avg(s) FILTER (NOT wrong), 6) AS support_when_right,
           round((sum(mid) FILTER (wrong) - count(*) FILTER (wrong) * (count(*) FILTER (wrong) + 1) / 2) / (count(*) FILTER (wrong) * count(*) FILTER (NOT wrong)), 6) AS auroc FROM k GROUP BY hyp"""
)
def calibration_panel(spark, sf_dir):
    """Support of hypotheses whose first candidate is wrong or right, and how well low support tells."""
    t = verdicts(pool(spark, sf_dir)).where(F.col("tag") % 2 == F.col("hyp")).groupBy("fact", "hyp").agg(F.avg(F.col("verdict").cast("double")).alias("s"))
    top = pool(spark, sf_dir).groupBy("fact").agg(F.min_by("tag", F.struct(-F.round("score", 12), F.col("tag"))).alias("top"))
    x = t.join(top, "fact").join(gold(spark, sf_dir), "fact").select("hyp", "s", (1 - F.col("s")).alias("doubt"), (F.col("top") != F.col("gold")).alias("wrong")).where("s is not null")
    mean = x.groupBy("hyp").agg(F.round(F.avg(F.when(F.col("wrong"), F.col("s"))), 6).alias("support_when_wrong"), F.round(F.avg(F.when(~F.col("wrong"), F.col("s"))), 6).alias("support_when_right"))
    return mean.join(me.auroc(x, ["hyp"], "doubt", "wrong"), "hyp").select(F.col("hyp").cast("long").alias("hyp"), "support_when_wrong", "support_when_right", F.round("auroc", 6).alias("auroc"))


CONTEXTS = 41
#: From contexts c(context, ...) to draws tm(draw, at_, times) over numbered contexts k(context, at_).
TIMES = f"""k AS (SELECT context, row_number() OVER (ORDER BY context) - 1 AS at_ FROM (SELECT DISTINCT context FROM c)), z AS (SELECT count(*)::BIGINT AS m FROM k),
    tm AS (SELECT draw, at_, count(*) AS times FROM (SELECT dr.range AS draw, {DRAW.format("dr.range, '-', sl.range", 'm')} AS at_ FROM range({panels.DRAWS}) dr, z, range((SELECT m FROM z)) sl) GROUP BY ALL)"""
BOUNDS = "round(avg(x), 6) AS {0}_mean, round(quantile_cont(x, 0.025), 6) AS {0}_low, round(quantile_cont(x, 0.975), 6) AS {0}_high, (quantile_cont(x, 0.025) > 0 OR quantile_cont(x, 0.975) < 0) AS {0}_excludes_zero"


@query(
    CALLS
    + f""", c AS (SELECT fact % {CONTEXTS} AS context, coalesce(sum(yes) FILTER (is_gold), 0) AS gy, coalesce(sum(n) FILTER (is_gold), 0) AS ga, coalesce(sum(yes) FILTER (NOT is_gold), 0) AS oy, coalesce(sum(n) FILTER (NOT is_gold), 0) AS oa FROM s GROUP BY fact, hyp), {TIMES},
    b AS (SELECT draw, sum(times * gy) / nullif(sum(times * ga), 0) - sum(times * oy) / nullif(sum(times * oa), 0) AS x FROM tm JOIN k USING (at_) JOIN (SELECT context, sum(gy) AS gy, sum(ga) AS ga, sum(oy) AS oy, sum(oa) AS oa FROM c GROUP BY context) USING (context) GROUP BY draw),
    p AS (SELECT *, CASE WHEN ga > 0 AND oa > 0 THEN gy / ga - oy / oa END AS pair FROM c)
    SELECT count(*) AS calls, sum(ga)::BIGINT AS gold_judgements, sum(oa)::BIGINT AS other_judgements, round(sum(gy) / sum(ga), 6) AS gold_support, round(sum(oy) / sum(oa), 6) AS other_support, round(sum(gy) / sum(ga) - sum(oy) / sum(oa), 6) AS gap,
           count(pair) AS paired, round(avg(pair), 6) AS paired_gap, round(100.0::DOUBLE * count(*) FILTER (pair > 0) / count(pair), 3) AS favouring, any_value(q.gap_mean) AS gap_mean, any_value(q.gap_low) AS gap_low, any_value(q.gap_high) AS gap_high, any_value(q.gap_excludes_zero) AS gap_excludes_zero
    FROM p, (SELECT {BOUNDS.format('gap')} FROM b) q"""
)
def support_gap_intervals(spark, sf_dir):
    """The support of gold candidates against others, with the gap's interval over 2,000 draws of contexts."""
    v, is_gold = F.col("verdict"), F.col("is_gold")
    count = lambda c: F.count(F.when(c, 1))
    calls = _judged(spark, sf_dir).groupBy("fact", "hyp").agg(count(is_gold & v).alias("gold_yes"), count(is_gold & v.isNotNull()).alias("gold_all"), count(~is_gold & v).alias("other_yes"), count(~is_gold & v.isNotNull()).alias("other_all"))
    return panels.support_panel(calls.withColumn("context", F.col("fact") % CONTEXTS))


@query(
    f"""WITH {POOL}, {VERDICTS}, {GOLD}, t AS (SELECT fact, hyp, avg(verdict::INT::DOUBLE) AS s FROM v WHERE tag % 2 = hyp GROUP BY ALL), w AS (SELECT fact, min_by(tag, row(-round(score, 12), tag)) AS top FROM pool GROUP BY fact),
    o AS (SELECT fact % {CONTEXTS} AS context, fact * 2 + hyp AS key, s, top <> gold AS wrong FROM t JOIN w USING (fact) JOIN gold USING (fact)), c AS (SELECT * FROM o WHERE s IS NOT NULL), {TIMES},
    db AS (SELECT draw, sum(times * s) FILTER (wrong) / nullif(sum(times) FILTER (wrong), 0) - sum(times * s) FILTER (NOT wrong) / nullif(sum(times) FILTER (NOT wrong), 0) AS x FROM tm JOIN k USING (at_) JOIN c USING (context) GROUP BY draw),
    ab AS (SELECT draw, s, coalesce(sum(times) FILTER (wrong), 0) AS p, coalesce(sum(times) FILTER (NOT wrong), 0) AS q FROM tm JOIN k USING (at_) JOIN c USING (context) GROUP BY ALL),
    ac AS (SELECT draw, sum(p * (below + q / 2)) / nullif(sum(p) * sum(q), 0) - 0.5 AS x FROM (SELECT *, sum(q) OVER (PARTITION BY draw ORDER BY 1 - s) - q AS below FROM ab) GROUP BY draw),
    a1 AS (SELECT sum(p * (below + q / 2)) / (sum(p) * sum(q)) AS auroc FROM (SELECT *, sum(q) OVER (ORDER BY 1 - s) - q AS below FROM (SELECT s, count(*) FILTER (wrong) AS p, count(*) FILTER (NOT wrong) AS q FROM c GROUP BY s))),
    ap AS (SELECT avg(h / r) AS ap FROM (SELECT wrong, row_number() OVER u AS r, sum(wrong::INT) OVER u AS h FROM c WINDOW u AS (ORDER BY s, key)) WHERE wrong)
    SELECT count(*) AS n, count(s) AS judged, round(count(s) / count(*), 6) AS ruled_share, round(avg(wrong::INT), 6) AS wrong_share, round(avg(wrong::INT) FILTER (s IS NOT NULL), 6) AS wrong_share_judged,
           round(avg(s) FILTER (wrong), 6) AS support_when_wrong, round(avg(s) FILTER (NOT wrong), 6) AS support_when_right, round(avg(s) FILTER (wrong) - avg(s) FILTER (NOT wrong), 6) + 0 AS difference,
           (SELECT round(auroc, 6) FROM a1) AS auroc, (SELECT round(ap, 6) FROM ap) AS average_precision, any_value(q.difference_mean) AS difference_mean, any_value(q.difference_low) AS difference_low, any_value(q.difference_high) AS difference_high, any_value(q.difference_excludes_zero) AS difference_excludes_zero,
           any_value(y.area_mean) AS area_mean, any_value(y.area_low) AS area_low, any_value(y.area_high) AS area_high, any_value(y.area_excludes_zero) AS area_excludes_zero
    FROM o, (SELECT {BOUNDS.format('difference')} FROM db) q, (SELECT {BOUNDS.format('area')} FROM ac) y"""
)
def calibration_intervals(spark, sf_dir):
    """Whether low support tells wrong hypotheses, with intervals of difference and area over 2,000 draws of contexts."""
    rows = pool(spark, sf_dir)
    t = verdicts(rows).where(F.col("tag") % 2 == F.col("hyp")).groupBy("fact", "hyp").agg(F.avg(F.col("verdict").cast("double")).alias("support"))
    top = rows.groupBy("fact").agg(F.min_by("tag", F.struct(-F.round("score", 12), F.col("tag"))).alias("top"))
    x = t.join(top, "fact").join(gold(spark, sf_dir), "fact")
    return panels.calibration_panel(x.select((F.col("fact") % CONTEXTS).alias("context"), (F.col("fact") * 2 + F.col("hyp")).alias("key"), "support", (F.col("top") != F.col("gold")).alias("wrong")))


@query(
    f"""WITH {POOL}, {VERDICTS}, d AS (SELECT fact, hyp, dimension, avg(verdict::INT::DOUBLE) AS s FROM v GROUP BY ALL), e AS (SELECT *, CASE WHEN s >= 0.6 THEN 'support' WHEN s <= 0.25 THEN 'contradict' ELSE 'unresolved' END AS state FROM d)
    SELECT fact, hyp::BIGINT AS hyp, count(*) FILTER (state = 'support') AS supported, count(*) FILTER (state = 'contradict') AS contradicted, count(*) FILTER (state = 'contradict' AND dimension IN ('A', 'B')) >= 2 AS mismatch FROM e GROUP BY fact, hyp"""
)
def verdict_fold(spark, sf_dir):
    """One verdict for each dimension from all candidates, and a mismatch from two structural contradictions."""
    from orrery.operators.symbolic import feedback

    f = feedback(verdicts(pool(spark, sf_dir)), ["fact", "hyp"])
    count = lambda c: F.count(F.when(c, 1))
    no = F.col("state") == "contradicted"
    return f.groupBy("fact", F.col("hyp").cast("long").alias("hyp")).agg(count(F.col("state") == "supported").alias("supported"), count(no).alias("contradicted"), (count(no & F.col("dimension").isin("A", "B")) >= 2).alias("mismatch"))


FORMS = {"whole": (1, 10_000), "head": (1, 8), "tail": (5, 10_000)}


@query(
    "WITH c AS (SELECT '*' AS scope, doc_id AS doc, " + TOK.format("text") + " AS ts FROM documents), b AS (SELECT item_id, " + TOK.format("text") + " AS ts FROM benchmark), q AS (" + " UNION ALL ".join(f"SELECT item_id * 10 + {k} AS query, '*' AS scope, ts[{a}:{z}] AS ts FROM b" for k, (a, z) in enumerate(FORMS.values())) + "), "
    + SCORES
    + """, g AS (SELECT item_id, min(doc_id) AS gold FROM documents JOIN benchmark ON contains(documents.text, benchmark.text) GROUP BY 1),
    o AS (SELECT query // 10 AS item_id, query % 10 AS form, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM s),
    m AS (SELECT g.item_id, f.range AS form, min(CASE WHEN doc = gold AND rank <= 20 THEN rank END) AS gr FROM g CROSS JOIN range(3) f LEFT JOIN o ON o.item_id = g.item_id AND o.form = f.range GROUP BY ALL)
    SELECT form, count(*) AS n, round(avg(coalesce(1 / gr, 0)), 6) AS mrr, round(avg(CASE WHEN gr <= 5 THEN 1 ELSE 0 END), 6) AS recall_at_5 FROM m GROUP BY form"""
)
def query_form_contrast(spark, sf_dir):
    """The same passages asked whole, by head and by tail; gold is the first document that holds the passage."""
    docs = table(spark, sf_dir, "documents")
    items = table(spark, sf_dir, "benchmark")
    t = tokens(F.col("text"))
    forms = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("form"), F.slice(t, a, z).alias("tokens")) for k, (a, z) in enumerate((a, z - a + 1) for a, z in FORMS.values())]))
    asked = items.select("item_id", forms.alias("f")).select((F.col("item_id") * 10 + F.col("f.form")).alias("query"), F.lit("*").alias("scope"), "f.tokens")
    corpus = docs.select(F.lit("*").alias("scope"), F.col("doc_id").alias("doc"), tokens(F.col("text")).alias("tokens"))
    found = bm25_topk(asked, corpus, 20).select(F.floor(F.col("query") / 10).alias("item_id"), (F.col("query") % 10).alias("form"), "doc", "rank")
    passages = items.select("item_id", F.col("text").alias("passage"))
    g = containing(docs.select("doc_id", "text"), "doc_id", "text", passages, "passage").groupBy("item_id").agg(F.min("doc_id").alias("gold"))
    rows = g.withColumn("form", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)]))).join(found, ["item_id", "form"], "left")
    m = rows.groupBy("item_id", "form").agg(F.min(F.when(F.col("doc") == F.col("gold"), F.col("rank"))).alias("gr"))
    return m.groupBy("form").agg(F.count("*").alias("n"), F.round(F.avg(fu.rank_gain(F.col("gr"))), 6).alias("mrr"), F.round(F.avg(F.when(F.col("gr") <= 5, 1.0).otherwise(0.0)), 6).alias("recall_at_5"))


ARMS = {"S1": [1], "S2": [1, 2], "S3": [2, 3]}


@query(
    f"WITH {R}, {GOLD}, arm AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {i})" for a, ls in ARMS.items() for i in ls) + """) t(arm, list)),
    ok AS (SELECT fact, list FROM r GROUP BY ALL HAVING max(score) > 30), k AS (SELECT r.fact, arm, r.list, tag, rank, ok.fact IS NOT NULL AS passes FROM r JOIN arm USING (list) LEFT JOIN ok ON ok.fact = r.fact AND ok.list = r.list),
    used AS (SELECT * FROM (SELECT *, bool_or(passes) OVER (PARTITION BY fact, arm) AS any_ FROM k) WHERE passes OR NOT any_),
    f AS (SELECT fact, arm, tag, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM used GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY fact, arm ORDER BY round(rrf, 12) DESC, tag) AS rank FROM f),
    g AS (SELECT fact, arm, min(CASE WHEN tag = gold THEN rank END) AS gr FROM o JOIN gold USING (fact) GROUP BY ALL)
    SELECT arm, count(*) AS n, round(avg(coalesce(1 / gr, 0)), 6) AS mrr, round(avg(CASE WHEN gr <= 5 THEN 1 ELSE 0 END), 6) AS recall_at_5 FROM g GROUP BY arm"""
)
def arm_fallback_scores(spark, sf_dir):
    """Arms fuse those of their lists that pass a filter, or all where none does."""
    from orrery.operators.symbolic import tightest_level

    rows = rankings(spark, sf_dir)
    passing = rows.groupBy("fact", "list").agg((F.max("score") > 30).alias("passes"))
    arms = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(i).alias("list")) for a, ls in ARMS.items() for i in ls]))
    slots = passing.sparkSession.range(1).select(arms.alias("s")).select("s.*")
    used = tightest_level(rows.join(F.broadcast(slots), "list").join(passing, ["fact", "list"]), ["fact", "arm"], [F.col("passes"), F.lit(True)])
    fused = fu.rrf(used, by=["fact", "arm"])
    placed = ranked(fused, ["fact", "arm"], [F.desc(F.round("rrf", 12)), F.col("tag")])
    g = me.first_gold_rank(placed, gold(spark, sf_dir), ["fact", "arm"])
    return g.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg(fu.rank_gain(F.col("gold_rank"))), 6).alias("mrr"), F.round(F.avg(F.when(F.col("gold_rank") <= 5, 1.0).otherwise(0.0)), 6).alias("recall_at_5"))


@query(f"WITH {POOL}, {GOLD}, w AS (SELECT fact, min_by(tag, row(-round(score, 12), tag)) AS top FROM pool GROUP BY fact) SELECT fact % 3 AS grp, count(gold) AS n, round(avg(CASE WHEN top = gold THEN 1 ELSE 0 END), 6) AS accuracy FROM w JOIN gold USING (fact) GROUP BY 1")
def single_model_accuracy(spark, sf_dir):
    """The share of facts whose first candidate is the gold one."""
    top = pool(spark, sf_dir).groupBy("fact").agg(F.min_by("tag", F.struct(-F.round("score", 12), F.col("tag"))).alias("top"))
    return top.join(gold(spark, sf_dir), "fact").groupBy((F.col("fact") % 3).alias("grp")).agg(F.count("gold").alias("n"), F.round(F.avg(F.when(F.col("top") == F.col("gold"), 1.0).otherwise(0.0)), 6).alias("accuracy"))


@query(f"WITH {POOL} SELECT fact, tag, round(norm, 6)::DOUBLE AS norm, row_number() OVER (PARTITION BY fact ORDER BY round(norm, 9) DESC, tag) AS rank FROM (SELECT fact, tag, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS norm FROM pool WINDOW w AS (PARTITION BY fact))")
def fused_only_ranking(spark, sf_dir):
    """The fusion score alone, scaled, ties by tag."""
    rows = pool(spark, sf_dir).withColumn("consensus", F.lit(0.0))
    return rr.blend(rows, 0.0).select("fact", "tag", F.round("norm", 6).alias("norm"), "rank")


@query(f"WITH {POOL}, {VERDICTS} SELECT win::BIGINT AS win, count(*) AS verdicts, count(CASE WHEN rank <= win THEN 1 END) AS inside FROM v JOIN (SELECT fact, tag, row_number() OVER (PARTITION BY fact ORDER BY round(score, 12) DESC, tag) AS rank FROM pool) USING (fact, tag), (VALUES (5), (10)) t(win) GROUP BY win")
def window_overlap(spark, sf_dir):
    """How many verdicts fall in the windows of the first candidates."""
    rows = pool(spark, sf_dir)
    placed = ranked(rows, ["fact"], [F.desc(F.round("score", 12)), F.col("tag")]).select("fact", "tag", "rank")
    v = verdicts(rows).join(placed, ["fact", "tag"]).withColumn("win", F.explode(F.array(F.lit(5).cast("long"), F.lit(10).cast("long"))))
    return v.groupBy("win").agg(F.count("*").alias("verdicts"), F.count(F.when(F.col("rank") <= F.col("win"), 1)).alias("inside"))
