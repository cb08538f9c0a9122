"""Grids of configurations and retrievers, answers that name candidates."""

from pyspark.sql import Window as W, functions as F

from orrery.operators import ablation as ab, fusion as fu, metrics as me
from orrery.plans.fusion import R, rankings
from orrery.plans.registry import query
from orrery.plans.rerank import GOLD, gold
from orrery.plans.statistics import DRAW
from orrery.session import staged, table

CONSENSUS = "((fact * 7 + tag * 3) % 5) / 4.0::DOUBLE"


@query(
    f"""WITH {R}, x AS (SELECT *, {CONSENSUS.replace('tag * 3', 'tag * 3 + list')} AS consensus FROM r), f AS (SELECT fact, tag, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(list) AS fl, min(rank) AS br, min_by(consensus, (rank, list)) AS c FROM x GROUP BY ALL)
    SELECT fact, tag, round(rrf + 0.1 * c, 9)::DOUBLE AS final, rank FROM (SELECT *, row_number() OVER (PARTITION BY fact ORDER BY round(rrf + 0.1::DOUBLE * c, 12) DESC, fl, br, tag) AS rank FROM f) WHERE rank <= 10"""
)
def null_search_fusion(spark, sf_dir):
    """Rounds fused with the consensus where a tag stands best."""
    rows = rankings(spark, sf_dir).withColumn("consensus", ((F.col("fact") * 7 + F.col("tag") * 3 + F.col("list")) % 5) / 4.0)
    return fu.null_search(rows, 0.1).where("rank <= 10").select("fact", "tag", F.round("final", 9).alias("final"), "rank")


LISTS = {"J1": [1], "J2": [1, 2], "J3": [1, 2, 3]}
GRID = [(f"{j}-{mode}-{beta}", lists, mode, beta) for j, lists in LISTS.items() for mode in ("sum", "mean") for beta in (0.0, 0.6)]


@query(
    f"WITH {R}, {GOLD}, cfg AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {ls}, '{m}', {b}::DOUBLE)" for c, ls, m, b in GRID) + f""") t(config, lists, mode, beta)),
    f AS (SELECT config, fact, tag, beta, round(CASE WHEN mode = 'mean' THEN avg(1.0::DOUBLE / (60 + rank)) ELSE sum(1.0::DOUBLE / (60 + rank)) END, 12) AS s, min(list) AS fl, min(rank) AS br FROM r JOIN cfg ON list_contains(lists, list) GROUP BY config, fact, tag, beta, mode),
    b AS (SELECT *, CASE WHEN max(s) OVER w > min(s) OVER w THEN (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) ELSE 1 END + beta * {CONSENSUS} AS final FROM f WINDOW w AS (PARTITION BY config, fact)),
    o AS (SELECT *, row_number() OVER (PARTITION BY config, fact ORDER BY round(final, 12) DESC, fl, br, tag) AS rank FROM b),
    g AS (SELECT config, fact, min(CASE WHEN tag = gold THEN rank END) AS gr FROM o JOIN gold USING (fact) GROUP BY ALL)
    SELECT config, count(*) AS n, round(avg(CASE WHEN gr <= 1 THEN 1 ELSE 0 END), 6) AS accuracy, round(avg(coalesce(1 / gr, 0)), 6) AS mrr, round(avg(CASE WHEN gr <= 10 THEN 1 ELSE 0 END), 6) AS recall_at_10 FROM g GROUP BY config"""
)
def config_ablation(spark, sf_dir):
    """Every configuration of lists, fusion and weight of the consensus, scored against gold."""
    rows = rankings(spark, sf_dir)
    configs = spark.createDataFrame(GRID, "config string, lists array<int>, mode string, beta double")
    consensus = rows.select("fact", "tag").distinct().withColumn("consensus", ((F.col("fact") * 7 + F.col("tag") * 3) % 5) / 4.0)
    placed = fu.config_grid(rows, configs, consensus)
    first = me.first_gold_rank(placed, gold(spark, sf_dir), ["config", "fact"])
    return first.groupBy("config").agg(*me.rank_metrics(F.col("gold_rank"), (10,)))


ABLATIONS = [ab.Ablation("A_j1", (1,)), ab.Ablation("B_select", (1, 2, 3), (0, 1), "select"), ab.Ablation("C_fuse", (1, 2, 3), (0, 1)), ab.Ablation("C_single", (1, 2, 3))]
_AB = ", ".join(f"('{c.name}', {list(c.hyps)}, {list(c.renderings)}, {str(c.aggregation == 'select').lower()})" for c in ABLATIONS)
_ENDS = "round(quantile_cont(x, 0.025), 6) + 0 AS {0}_low, round(quantile_cont(x, 0.975), 6) + 0 AS {0}_high, (quantile_cont(x, 0.025) > 0 OR quantile_cont(x, 0.975) < 0) AS {0}_excludes_zero"


@query(
    f"""WITH {R}, {GOLD}, rr AS (SELECT fact, list AS hyp, 0 AS rendering, tag, rank FROM r UNION ALL SELECT fact, list, 1, tag, row_number() OVER (PARTITION BY fact, list ORDER BY rank) FROM r WHERE tag % 4 <> 3),
    cf AS (SELECT * FROM (VALUES {_AB}) t(config, hyps, renderings, one)), us AS (SELECT cf.config, one, rr.* FROM rr JOIN cf ON list_contains(hyps, hyp) AND list_contains(renderings, rendering)),
    ls AS (SELECT fact, list AS hyp, max(score) AS score FROM r GROUP BY ALL), bh AS (SELECT config, fact, max_by(hyp, row(round(score, 12), -hyp)) AS best FROM (SELECT DISTINCT config, fact, hyp FROM us WHERE one) JOIN ls USING (fact, hyp) GROUP BY ALL),
    fu AS (SELECT us.config, us.fact, tag, sum(1.0::DOUBLE / (60 + rank)) AS s, avg(1.0::DOUBLE / (60 + rank)) AS m, min(hyp * 1000 + rendering) AS fl, min(rank) AS br FROM us LEFT JOIN bh ON bh.config = us.config AND bh.fact = us.fact WHERE NOT one OR hyp = best GROUP BY ALL),
    va AS (SELECT config, 'sum' AS variant, fact, tag, s AS x, fl, br FROM fu UNION ALL SELECT config, 'mean', fact, tag, m, fl, br FROM fu),
    pl AS (SELECT *, row_number() OVER (PARTITION BY config, variant, fact ORDER BY round(x, 12) DESC, fl, br, tag) AS rank FROM va), rk AS (SELECT config, variant, pl.fact, min(rank) FILTER (tag = gold) AS rank FROM pl LEFT JOIN gold ON gold.fact = pl.fact GROUP BY config, variant, pl.fact),
    ea AS (SELECT config, variant, fact, fact % 41 AS context, unnest(['accuracy', 'mrr', 'recall_at_10']) AS metric, unnest([(coalesce(rank, 999) <= 1)::INT::DOUBLE, coalesce(1 / rank, 0), (coalesce(rank, 999) <= 10)::INT::DOUBLE]) AS v FROM rk),
    di AS (SELECT a.*, a.v - b.v AS d FROM ea a JOIN ea b ON b.config = 'A_j1' AND b.variant = a.variant AND b.fact = a.fact AND b.metric = a.metric), mo AS (SELECT *, CASE WHEN fact % 2 = 0 THEN 'table' ELSE 'text' END AS modality FROM di UNION ALL SELECT *, 'pooled' FROM di),
    pe AS (SELECT config, variant, modality, metric, context, sum(v) AS tv, sum(d) AS td, count(*) AS n FROM mo GROUP BY ALL),
    k AS (SELECT modality, context, row_number() OVER (PARTITION BY modality ORDER BY context) - 1 AS at_, count(*) OVER (PARTITION BY modality) AS m FROM (SELECT DISTINCT modality, context FROM pe)),
    tm AS (SELECT modality, draw, at_, count(*) AS times FROM (SELECT modality, dr.range AS draw, {DRAW.format("dr.range, '-', sl.range", 'm')} AS at_ FROM range(2000) dr, (SELECT DISTINCT modality, m FROM k) z, range(41) sl WHERE sl.range < m) GROUP BY ALL),
    bs AS (SELECT config, variant, modality, metric, draw, sum(times * tv) / sum(times * n) AS xv, sum(times * td) / sum(times * n) AS xd FROM tm JOIN k USING (modality, at_) JOIN pe USING (modality, context) GROUP BY ALL),
    ci AS (SELECT config, variant, modality, metric, {_ENDS.format('value').replace('(x,', '(xv,')}, {_ENDS.format('difference').replace('(x,', '(xd,')} FROM bs GROUP BY ALL)
    SELECT config, variant, modality, metric, count(*) AS facts, round(avg(v), 6) AS value, round(avg(d), 6) + 0 AS difference, count(*) FILTER (round(d, 12) > 0) AS improved, count(*) FILTER (round(d, 12) = 0) AS unchanged, count(*) FILTER (round(d, 12) < 0) AS degraded,
           any_value(value_low) AS value_low, any_value(value_high) AS value_high, any_value(value_excludes_zero) AS value_excludes_zero, any_value(difference_low) AS difference_low, any_value(difference_high) AS difference_high, any_value(difference_excludes_zero) AS difference_excludes_zero
    FROM mo JOIN ci USING (config, variant, modality, metric) GROUP BY config, variant, modality, metric"""
)
def ablation_grid(spark, sf_dir):
    """Single, selected and fused hypotheses, with one rendering and two, by sum and by mean, against the single one, with intervals over 2,000 draws of contexts."""
    rows = rankings(spark, sf_dir).withColumnRenamed("list", "hyp")
    shown = F.col("tag") % 4 != 3
    some = F.count(F.when(shown, 1)).over(W.partitionBy("fact", "hyp").orderBy("rank"))
    each = F.array(F.struct(F.lit(0).alias("rendering"), "rank"), F.when(shown, F.struct(F.lit(1).alias("rendering"), F.col("_some").alias("rank"))))
    both = rows.withColumn("_some", some).select("fact", "hyp", "tag", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("_r")).select("fact", "hyp", "tag", "_r.*")
    ranks = staged(ab.ablation_ranks(both, rows.groupBy("fact", "hyp").agg(F.max("score").alias("score")), gold(spark, sf_dir), ABLATIONS), "ranks")
    out = ab.ablation_table(ranks, "A_j1", F.col("fact") % 41, F.when(F.col("fact") % 2 == 0, "table").otherwise("text"), 2000)
    return out.withColumns({c: F.round(c, 6) for c in ("value", "difference")})


KINDS = {"lexical": [1], "dense": [2], "hybrid": [1, 2]}


@query(
    f"WITH {R}, {GOLD}, cfg AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {ls})" for c, ls in KINDS.items()) + """) t(kind, lists)),
    f AS (SELECT kind, fact, tag, sum(1.0::DOUBLE / (60 + rank)) AS s, min(list) AS fl, min(rank) AS br FROM r JOIN cfg ON list_contains(lists, list) GROUP BY kind, fact, tag),
    o AS (SELECT *, row_number() OVER (PARTITION BY kind, fact ORDER BY round(s, 12) DESC, fl, br, tag) AS rank FROM f),
    g AS (SELECT kind, fact, min(CASE WHEN tag = gold THEN rank END) AS gr FROM o JOIN gold USING (fact) GROUP BY ALL), a AS (SELECT *, CASE WHEN fact % 2 = 0 THEN 'table' ELSE 'text' END AS modality FROM g UNION ALL SELECT *, 'all' FROM g)
    SELECT kind, modality, count(*) AS n, round(avg(CASE WHEN gr <= 1 THEN 1 ELSE 0 END), 6) AS accuracy, round(avg(coalesce(1 / gr, 0)), 6) AS mrr, round(avg(CASE WHEN gr <= 10 THEN 1 ELSE 0 END), 6) AS recall_at_10, round(avg(CASE WHEN gr <= 50 THEN 1 ELSE 0 END), 6) AS recall_at_50 FROM a GROUP BY kind, modality"""
)
def retriever_grid(spark, sf_dir):
    """The rankings of two retrievers and their fusion, by kind of input."""
    rows = rankings(spark, sf_dir)
    configs = spark.createDataFrame([(k, ls, "sum", 0.0) for k, ls in KINDS.items()], "config string, lists array<int>, mode string, beta double")
    none = rows.select("fact", "tag").where("false").withColumn("consensus", F.lit(0.0))
    first = me.first_gold_rank(fu.config_grid(rows, configs, none), gold(spark, sf_dir), ["config", "fact"])
    kinds = F.explode(F.array(F.when(F.col("fact") % 2 == 0, "table").otherwise("text"), F.lit("all")))
    return first.select(F.col("config").alias("kind"), kinds.alias("modality"), "gold_rank").groupBy("kind", "modality").agg(*me.rank_metrics(F.col("gold_rank"), (10, 50)))


@query(
    f"""WITH {R}, c AS (SELECT fact, tag, rank FROM r WHERE list = 1),
    nm AS (SELECT fact, tag, 0 AS priority, 0 AS pos FROM c WHERE rank = 2 AND fact % 2 = 0 UNION ALL SELECT fact, tag, 1, CASE rank WHEN 5 THEN 0 ELSE 1 END FROM c WHERE rank IN (5, 3) UNION ALL SELECT c.fact, c.tag, 2, 0 FROM c JOIN (SELECT fact, min(tag) AS tag FROM c GROUP BY fact) USING (fact, tag)),
    f AS (SELECT fact, tag, min(row(priority, pos)) AS pl FROM nm GROUP BY ALL)
    SELECT fact, tag, rank FROM (SELECT c.fact, c.tag, row_number() OVER (PARTITION BY c.fact ORDER BY pl IS NULL, pl, c.rank, c.tag) AS rank FROM c LEFT JOIN f USING (fact, tag)) WHERE rank <= 8"""
)
def ranked_answer_parse(spark, sf_dir):
    """Candidates in the order of answers that name indices and tags, some of which are none."""
    candidates = rankings(spark, sf_dir).where("list = 1").select("fact", "tag", "rank")
    least = candidates.groupBy("fact").agg(F.min("tag").cast("string").alias("least"))
    head = F.when(F.col("fact") % 2 == 0, F.lit('{"selected_index": "2", ')).otherwise('{"selected_index": "none", "selected_tag": "x", ')
    answers = least.select("fact", F.concat(head, F.lit('"ranked_indices": [5, "3", "five", 9999, 5], "ranked_tags": ["'), "least", F.lit('", "nobody"]}')).alias("answer"))
    return fu.composite(candidates, fu.named_candidates(answers, candidates)).where("rank <= 8").select("fact", "tag", "rank")


@query(
    """WITH n AS (SELECT 'family' AS dimension, r_name AS category, n_name AS phrase FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'role', c_mktsegment, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'scope', 'not-applicable', 'not applicable')
    SELECT dimension, category, array_to_string(list_sort(list(DISTINCT phrase)), ',') AS phrases, count(DISTINCT phrase) AS n_phrases, count(*) AS n FROM n GROUP BY ALL"""
)
def hierarchy_vocabulary(spark, sf_dir):
    """Categories of each dimension with their phrases, built from the levels of a hierarchy."""
    nation, region, customer = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    row = lambda d, c: (F.lit(d).alias("dimension"), c.alias("category"), F.col("n_name").alias("phrase"))
    family = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(*row("family", F.col("r_name")))
    role = customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(*row("role", F.col("c_mktsegment")))
    fixed = spark.createDataFrame([("scope", "not-applicable", "not applicable")], "dimension string, category string, phrase string")
    n = family.unionByName(role).unionByName(fixed).groupBy("dimension", "category", "phrase").agg(F.count("*").alias("k"))  # before the sets, so a hot category sends each phrase once
    return n.groupBy("dimension", "category").agg(F.array_join(F.sort_array(F.collect_set("phrase")), ",").alias("phrases"), F.count("*").alias("n_phrases"), F.sum("k").alias("n"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT item_id FROM benchmark)")
def lookup_by_key(spark, sf_dir):
    """Rows of given keys, as random access by key."""
    from orrery.sources.readers import rows_by_key

    keys = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("o_orderkey"))
    return rows_by_key(table(spark, sf_dir, "orders"), "o_orderkey", keys).select("o_orderkey", "o_custkey", "o_totalprice")
