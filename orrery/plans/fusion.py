"""Three rankings of suppliers for each part, fused in every way."""

from pyspark.sql import functions as F

from orrery.operators import fusion as fu
from orrery.operators.retrieval import ranked
from orrery.plans.registry import query
from orrery.session import dealt, table

#: m: best values of a supplier for a part; r(fact, list, tag, rank, score): by quantity, by price (even suppliers), by discount (not every third).
R = """m AS (SELECT l_partkey AS fact, l_suppkey AS tag, max(l_quantity) AS v1, max(l_extendedprice) AS v2, max(l_discount) AS v3 FROM lineitem GROUP BY ALL),
    u AS (SELECT fact, 1 AS list, tag, v1 AS score FROM m UNION ALL SELECT fact, 2, tag, v2 FROM m WHERE tag % 2 = 0 UNION ALL SELECT fact, 3, tag, v3 FROM m WHERE tag % 3 <> 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY fact, list ORDER BY score DESC, tag) AS rank FROM u)"""
FUSED = "f AS (SELECT fact, tag, {agg} AS rrf, min(rank) AS best_rank, min(list) AS first_list, min_by(list, (rank, list)) AS best_list, count(*) AS hits FROM r GROUP BY fact, tag)"
ORDERED = "SELECT fact, tag, round(rrf, 9) AS rrf, best_rank, first_list::BIGINT AS first_list, best_list::BIGINT AS best_list, hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY fact ORDER BY round(rrf, 12) DESC, first_list, best_rank, tag) AS rank FROM f) WHERE rank <= 10"


def rankings(spark, sf_dir):
    """Dealt by fact, so that rankings, fusions and joins within a fact add no shuffle."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("fact"), F.col("l_suppkey").alias("tag"), "l_quantity", "l_extendedprice", "l_discount")
    best = dealt(lines, "fact").groupBy("fact", "tag").agg(F.max("l_quantity").alias("v1"), F.max("l_extendedprice").alias("v2"), F.max("l_discount").alias("v3"))
    entry = lambda n, ok: F.when(ok, F.struct(F.lit(n).alias("list"), F.col(f"v{n}").alias("score")))
    entries = F.array(entry(1, F.lit(True)), entry(2, F.col("tag") % 2 == 0), entry(3, F.col("tag") % 3 != 0))
    rows = best.select("fact", "tag", F.explode(F.filter(entries, lambda x: x.isNotNull())).alias("e")).select("fact", "tag", "e.*")
    return ranked(rows, ["fact", "list"], [F.desc("score"), F.col("tag")])


def _ordered(fused):
    out = fu.fused_ranking(fused, 10)
    return out.select("fact", "tag", F.round("rrf", 9).alias("rrf"), "best_rank", *[F.col(c).cast("long").alias(c) for c in ("first_list", "best_list")], "hits", "rank")


@query(f"WITH {R}, {FUSED.format(agg='sum(1.0::DOUBLE / (60 + rank))')} {ORDERED}")
def rrf_sum(spark, sf_dir):
    return _ordered(fu.rrf(rankings(spark, sf_dir), "sum"))


@query(f"WITH {R}, {FUSED.format(agg='avg(1.0::DOUBLE / (60 + rank))')} {ORDERED}")
def rrf_mean(spark, sf_dir):
    return _ordered(fu.rrf(rankings(spark, sf_dir), "mean"))


@query(f"WITH {R}, f0 AS (SELECT fact, count(DISTINCT list) AS n FROM r GROUP BY fact), {FUSED.format(agg='sum(1.0::DOUBLE / (60 + rank))').replace('f AS', 'f1 AS')}, f AS (SELECT f1.* REPLACE (rrf / n AS rrf) FROM f1 JOIN f0 USING (fact)) {ORDERED}")
def rrf_config_mean(spark, sf_dir):
    return _ordered(fu.rrf(rankings(spark, sf_dir), "lists"))


@query(
    f"""WITH {R}, i AS (SELECT fact, CASE WHEN list < 3 THEN 0 ELSE 1 END AS hyp, tag, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(list) AS fl, min(rank) AS br FROM r GROUP BY ALL),
    j AS (SELECT fact, hyp, tag, row_number() OVER (PARTITION BY fact, hyp ORDER BY round(rrf, 12) DESC, fl, br, tag) AS rank FROM i),
    f AS (SELECT fact, tag, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(rank) AS best_rank, min(hyp) AS first_list FROM j GROUP BY ALL)
    SELECT fact, tag, round(rrf, 9) AS rrf, rank FROM (SELECT *, row_number() OVER (PARTITION BY fact ORDER BY round(rrf, 12) DESC, first_list, best_rank, tag) AS rank FROM f) WHERE rank <= 10"""
)
def rrf_dual_nested(spark, sf_dir):
    """Two renderings of one hypothesis fused first, then both hypotheses."""
    rows = rankings(spark, sf_dir).withColumn("hyp", F.when(F.col("list") < 3, 0).otherwise(1))
    return fu.fused_ranking(fu.nested_rrf(rows), 10).select("fact", "tag", F.round("rrf", 9).alias("rrf"), "rank")


@query(
    f"""WITH {R}, n AS (SELECT fact, list, tag, rank, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS s FROM r WINDOW w AS (PARTITION BY fact, list)),
    f AS (SELECT fact, tag, sum(s) AS combsum, min(list) AS fl FROM n GROUP BY ALL)
    SELECT fact, tag, round(combsum, 9) AS combsum, rank FROM (SELECT *, row_number() OVER (PARTITION BY fact ORDER BY round(combsum, 9) DESC, fl, tag) AS rank FROM f) WHERE rank <= 10"""
)
def combsum(spark, sf_dir):
    out = ranked(fu.combsum(rankings(spark, sf_dir)), ["fact"], [F.desc(F.round("combsum", 9)), F.col("first_list"), F.col("tag")], 10)
    return out.select("fact", "tag", F.round("combsum", 9).alias("combsum"), "rank")


SEL = f"{R}, ls AS (SELECT fact, list, avg(score) / max(max(score)) OVER (PARTITION BY list) AS s FROM r GROUP BY fact, list), ch AS (SELECT fact, max_by(list, (round(s, 12), -list)) AS list FROM ls GROUP BY fact)"


def _chosen(rows):
    from pyspark.sql import Window as W

    means = rows.groupBy("fact", "list").agg(F.avg("score").alias("a"), F.max("score").alias("m"))
    return fu.selected_list(means.withColumn("score", F.col("a") / F.max("m").over(W.partitionBy("list"))))


@query(f"WITH {SEL} SELECT r.fact, r.tag, r.list::BIGINT AS list, r.rank FROM r JOIN ch USING (fact, list) WHERE r.rank <= 10")
def selection(spark, sf_dir):
    """Only the list that scores best."""
    rows = rankings(spark, sf_dir)
    chosen = _chosen(rows)
    return fu.selection(rows, chosen, False).where("rank <= 10").join(chosen, "fact").select("fact", "tag", F.col("list").cast("long").alias("list"), "rank")


@query(
    f"""WITH {SEL}, own AS (SELECT r.fact, r.tag, 0 AS part, r.rank AS k FROM r JOIN ch USING (fact, list)),
    oth AS (SELECT fact, tag, 1 AS part, min(rank) AS k FROM r ANTI JOIN own USING (fact, tag) GROUP BY fact, tag)
    SELECT fact, tag, part::BIGINT AS part, rank FROM (SELECT *, row_number() OVER (PARTITION BY fact ORDER BY part, k, tag) AS rank FROM (SELECT * FROM own UNION ALL SELECT * FROM oth)) WHERE rank <= 20"""
)
def selection_union(spark, sf_dir):
    """The best list, then the other tags by their best rank elsewhere."""
    rows = rankings(spark, sf_dir)
    return fu.selection(rows, _chosen(rows), True).where("rank <= 20").select("fact", "tag", F.col("part").cast("long").alias("part"), "rank")


@query(f"WITH {R}, f AS (SELECT fact, tag, min((list, rank)) AS pl FROM r WHERE rank <= 5 GROUP BY ALL) SELECT fact, tag, (pl[1])::BIGINT AS list, row_number() OVER (PARTITION BY fact ORDER BY pl, tag) AS rank FROM f".replace("min((list, rank))", "min(row(list, rank))"))
def coverage_ceiling(spark, sf_dir):
    """The union of the lists' heads, each tag once."""
    out = fu.coverage_ceiling(rankings(spark, sf_dir).where("rank <= 5"))
    return out.select("fact", "tag", F.col("list").cast("long").alias("list"), "rank")


@query(
    f"""WITH {R}, c AS (SELECT fact, tag, rank FROM r WHERE list = 1),
    nm AS (SELECT fact, tag, 0 AS priority, 0 AS pos FROM c WHERE rank = 3 UNION ALL SELECT fact, tag, 1, rank FROM r WHERE list = 3 AND rank <= 4 UNION ALL SELECT fact, tag, 2, rank FROM r WHERE list = 2 AND rank <= 4),
    f AS (SELECT fact, tag, min(row(priority, pos)) AS pl FROM nm GROUP BY ALL)
    SELECT fact, tag, candidate_rank, rank FROM (SELECT c.fact, c.tag, c.rank AS candidate_rank, row_number() OVER (PARTITION BY c.fact ORDER BY pl IS NULL, pl, c.rank, c.tag) AS rank FROM c LEFT JOIN f USING (fact, tag)) WHERE rank <= 15"""
)
def composite_rank(spark, sf_dir):
    """A selected tag, then tags named by index, then by name, then the rest in the old order."""
    rows = rankings(spark, sf_dir)
    candidates = rows.where("list = 1")
    named = candidates.where("rank = 3").select("fact", "tag", F.lit(0).alias("priority"), F.lit(0).cast("long").alias("pos"))
    named = named.unionByName(rows.where("list > 1 and rank <= 4").select("fact", "tag", (4 - F.col("list")).alias("priority"), F.col("rank").alias("pos")))
    return fu.composite(candidates, named).where("rank <= 15").select("fact", "tag", "candidate_rank", "rank")


@query(
    f"""WITH {R}, c AS (SELECT fact, tag, rank, CASE WHEN list = 1 THEN 0 ELSE 1 END AS other FROM r WHERE list < 3),
    f AS (SELECT fact, tag, min(row(other, rank)) AS pl FROM c GROUP BY ALL)
    SELECT fact, tag, rank FROM (SELECT fact, tag, row_number() OVER (PARTITION BY fact ORDER BY pl, tag) AS rank FROM f) WHERE rank <= 12"""
)
def compatible_first(spark, sf_dir):
    """Candidates of the wanted kind first, the others fill up."""
    rows = rankings(spark, sf_dir).where("list < 3").select("fact", "tag", F.struct((F.col("list") != 1).cast("int").alias("other"), "rank").alias("at"))
    first = rows.groupBy("fact", "tag").agg(F.min("at").alias("at"))
    return ranked(first, ["fact"], [F.col("at"), F.col("tag")], 12).select("fact", "tag", "rank")
