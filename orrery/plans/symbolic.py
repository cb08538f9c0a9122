"""Parts as concepts, a small vocabulary of materials, finishes and sizes."""

from pyspark.sql import functions as F

from orrery.functions.text import label_tokens
from orrery.operators import symbolic as sy
from orrery.operators.retrieval import ranked
from orrery.plans.fusion import R, rankings
from orrery.plans.registry import query
from orrery.plans.rerank import POOL, VERDICTS, pool, verdicts
from orrery.plans.retrieval import LABEL
from orrery.session import table

VOCAB = {
    "material": {"metal": ["steel", "brass", "tin", "copper", "nickel"], "red metal": ["copper", "brass"]},
    "finish": {"plated": ["plated", "anodized"], "polished": ["polished", "burnished", "brushed"]},
    "size": {"large": ["large", "economy"], "small": ["small", "medium"], "promo": ["promo"]},
}
ROWS = ", ".join(f"('{d}', '{c}', '{p}')" for d, cs in VOCAB.items() for c, ps in cs.items() for p in ps)
PC = f"""vo AS (SELECT *, list_distinct({LABEL.format('phrase')}) AS pt FROM (VALUES {ROWS}) t(dimension, category, phrase)),
    pa AS (SELECT p_partkey, p_brand, p_name || ' ' || p_type AS text FROM part), pt AS (SELECT *, list_distinct({LABEL.format('text')}) AS ts FROM pa),
    pc AS (SELECT p_partkey, dimension, list_sort(list_distinct(list(category))) AS categories FROM pt JOIN vo ON contains(lower(text), phrase) OR (len(pt) > 0 AND len(list_intersect(pt, ts)) = len(pt)) GROUP BY ALL)"""


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat_ws(" ", "p_name", "p_type").alias("text"))


def profiles(spark, sf_dir):
    return sy.phrase_categories(_parts(spark, sf_dir), sy.vocabulary(spark, VOCAB), "p_partkey", "text")


@query(f"WITH {PC} SELECT p_partkey, dimension, array_to_string(categories, ',') AS categories FROM pc")
def phrase_categories(spark, sf_dir):
    return profiles(spark, sf_dir).withColumn("categories", F.array_join("categories", ","))


@query(
    f"""WITH {PC}, di AS (SELECT DISTINCT dimension FROM vo), g AS (SELECT a.p_partkey AS hyp, b.p_partkey AS cand, dimension, a.ts AS ht, b.ts AS ct FROM pt a JOIN pt b ON b.p_partkey = a.p_partkey + 1, di),
    v AS (SELECT hyp, cand, g.dimension, coalesce(len(h.categories), 0) AS hn, coalesce(len(c.categories), 0) AS cn, h.categories AS hc, c.categories AS cc, len(list_intersect(ht, ct)) / len(ht) AS share, len(ht) AS n FROM g LEFT JOIN pc h ON h.p_partkey = hyp AND h.dimension = g.dimension LEFT JOIN pc c ON c.p_partkey = cand AND c.dimension = g.dimension)
    SELECT hyp, cand, dimension, CASE WHEN hn > 0 AND cn = 0 THEN false WHEN hn > 0 OR cn > 0 THEN coalesce(list_has_any(hc, cc), false) WHEN n > 0 THEN share >= 0.5 END AS verdict,
           round(CASE WHEN hn > 0 AND cn = 0 THEN 0.35 WHEN hn > 0 OR cn > 0 THEN 0.85 WHEN n > 0 THEN greatest(0.2, least(0.75, share)) END, 6)::DOUBLE AS confidence FROM v"""
)
def dimension_verdicts(spark, sf_dir):
    """Each part judged against the next one on every dimension."""
    parts = _parts(spark, sf_dir).withColumn("tokens", F.array_distinct(label_tokens(F.col("text"))))
    dims = F.explode(F.array(*map(F.lit, VOCAB))).alias("dimension")
    a = parts.select(F.col("p_partkey").alias("hyp"), (F.col("p_partkey") + 1).alias("cand"), F.col("tokens").alias("ht"))
    grid = a.join(parts.select(F.col("p_partkey").alias("cand"), F.col("tokens").alias("ct")), "cand").select("hyp", "cand", "ht", "ct", dims)
    p = profiles(spark, sf_dir)
    grid = grid.join(p.select(F.col("p_partkey").alias("hyp"), "dimension", F.col("categories").alias("hc")), ["hyp", "dimension"], "left").join(p.select(F.col("p_partkey").alias("cand"), "dimension", F.col("categories").alias("cc")), ["cand", "dimension"], "left")
    v = sy.dimension_verdict(F.col("hc"), F.col("cc"), F.col("ht"), F.col("ct"))
    return grid.select("hyp", "cand", "dimension", v.alias("v")).select("hyp", "cand", "dimension", "v.verdict", F.round("v.confidence", 6).alias("confidence"))


@query(f"WITH {POOL}, {VERDICTS}, a AS (SELECT fact, hyp, tag, avg(verdict::INT) AS a FROM v GROUP BY ALL) SELECT fact, tag, round(avg(coalesce(a, 0)), 6) AS consensus, count(*) AS hypotheses FROM a GROUP BY ALL")
def agree_consensus(spark, sf_dir):
    from orrery.operators.rerank import agreement

    a = agreement(verdicts(pool(spark, sf_dir)))
    return a.groupBy("fact", "tag").agg(F.round(F.avg(F.coalesce("agree", F.lit(0.0))), 6).alias("consensus"), F.count("*").alias("hypotheses"))


FB = "SELECT fact, dimension, avg(verdict::INT::DOUBLE) AS s FROM {0} GROUP BY ALL"
ST = "CASE WHEN s >= 0.6 THEN 'supported' WHEN s <= 0.25 THEN 'contradicted' ELSE 'unresolved' END"


@query(f"WITH {POOL}, {VERDICTS}, fb AS ({FB.format('v')}) SELECT fact, dimension, round(s, 6) AS support, {ST} AS state, round(coalesce(abs(s - 0.5) * 2, 0), 6)::DOUBLE AS confidence FROM fb")
def feedback_bands(spark, sf_dir):
    return sy.feedback(verdicts(pool(spark, sf_dir)), ["fact"]).withColumn("support", F.round("support", 6)).withColumn("confidence", F.round("confidence", 6))


@query(
    f"""WITH {POOL}, {VERDICTS}, a AS (SELECT *, {ST} AS st, coalesce(abs(s - 0.5) * 2, 0) AS c FROM ({FB.format('(SELECT * FROM v WHERE hyp = 0)')})), b AS (SELECT *, {ST} AS st, coalesce(abs(s - 0.5) * 2, 0) AS c FROM ({FB.format("(SELECT * FROM v WHERE hyp = 1 AND dimension <> 'C')")})),
    j AS (SELECT fact, dimension, coalesce(a.st, 'unresolved') AS s, coalesce(b.st, 'unresolved') AS m, a.c AS sc, b.c AS mc FROM a FULL JOIN b USING (fact, dimension))
    SELECT fact, dimension, CASE WHEN s <> 'unresolved' THEN s ELSE m END AS state, round(coalesce(CASE WHEN s <> 'unresolved' THEN sc ELSE mc END, 0) / CASE WHEN s <> 'unresolved' AND m <> 'unresolved' AND s <> m THEN 2 ELSE 1 END, 6)::DOUBLE AS confidence FROM j"""
)
def feedback_merge(spark, sf_dir):
    v = verdicts(pool(spark, sf_dir))
    out = sy.merge_feedback(sy.feedback(v.where("hyp = 0"), ["fact"]), sy.feedback(v.where("hyp = 1 and dimension <> 'C'"), ["fact"]), ["fact"])
    return out.withColumn("confidence", F.round("confidence", 6))


@query(
    f"""WITH {R}, h AS (SELECT fact, tag, rank AS old_rank, row_number() OVER (PARTITION BY fact, tag % 4 ORDER BY rank) = 1 AS is_rep FROM r WHERE list = 1 AND rank <= 12)
    SELECT fact, tag, old_rank, is_rep, rank FROM (SELECT *, row_number() OVER (PARTITION BY fact ORDER BY is_rep DESC, old_rank) AS rank FROM h) WHERE rank <= 6"""
)
def cluster_representatives(spark, sf_dir):
    """Six diverse suppliers of each part: one of each group first."""
    rows = rankings(spark, sf_dir).where("list = 1").select("fact", "tag", "rank", (F.col("tag") % 4).alias("signature"))
    return sy.cluster_representatives(rows, "signature", 6, 12).select("fact", "tag", "old_rank", "is_rep", "rank")


@query("SELECT p_partkey, p_size, p_brand FROM part WHERE (p_size <= 30 OR p_type LIKE '%STEEL%') AND coalesce(CASE WHEN p_brand LIKE '%1' THEN p_retailprice > 950 END, true)")
def compatibility_filter(spark, sf_dir):
    """Checks that must all pass; one that does not apply passes."""
    checks = [(F.col("p_size") <= 30) | F.col("p_type").contains("STEEL"), F.when(F.col("p_brand").endswith("1"), F.col("p_retailprice") > 950)]
    return table(spark, sf_dir, "part").where(sy.compatible(checks)).select("p_partkey", "p_size", "p_brand")


@query(
    """WITH x AS (SELECT o_custkey AS fact, o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '1%' THEN 1 WHEN o_orderstatus = 'F' THEN 2 END AS level FROM orders)
    SELECT fact, o_orderkey, level::BIGINT AS level FROM (SELECT *, min(level) OVER (PARTITION BY fact) AS t FROM x WHERE level IS NOT NULL) WHERE level = t"""
)
def fallback_levels(spark, sf_dir):
    """The tightest level of compatibility that a customer has any order for."""
    done, first = F.col("o_orderstatus") == "F", F.col("o_orderpriority").startswith("1")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("fact"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    return sy.tightest_level(rows, ["fact"], [done & first, first, done]).select("fact", "o_orderkey", F.col("level").cast("long").alias("level"))


@query("SELECT dimension, count(*) FILTER (verdict) AS support, count(*) FILTER (NOT verdict) AS against, count(*) FILTER (verdict IS NULL) AS abstain, count(*) FILTER (verdict) - count(*) FILTER (NOT verdict) AS margin FROM v GROUP BY dimension".join([f"WITH {POOL}, {VERDICTS} ", ""]))
def dimension_tallies(spark, sf_dir):
    count = lambda c: F.count(F.when(c, 1))
    yes, no = count(F.col("verdict")), count(~F.col("verdict"))
    return verdicts(pool(spark, sf_dir)).groupBy("dimension").agg(yes.alias("support"), no.alias("against"), count(F.col("verdict").isNull()).alias("abstain"), (yes - no).alias("margin"))


FIXED = {"scope": {"not-applicable": ["not applicable", "without size"]}, "qualifier": {"type-1": ["type 1", "type I"]}}
ALIASES = {"PROMO": "ECONOMY"}
_FIXED_ROWS = ", ".join(f"('{d}', '{c}', '{p.lower()}', 0)" for d, cs in FIXED.items() for c, ps in cs.items() for p in ps)


@query(
    f"""WITH n AS (SELECT 'family' AS dimension, r_name AS category, n_name AS phrase, false AS spelt FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'role', p_type, p_brand || '-' || p_name, true FROM part UNION ALL SELECT 'role', p_type, CASE WHEN p_size % 2 = 0 THEN '  ' ELSE p_name END, false FROM part),
    m AS (SELECT dimension, CASE WHEN category = 'PROMO' THEN 'ECONOMY' ELSE category END AS category, nullif(lower(trim(phrase)), '') AS phrase, spelt FROM n), g AS (SELECT dimension, category, phrase, spelt, count(*) AS n FROM m WHERE phrase IS NOT NULL GROUP BY ALL),
    x AS (SELECT dimension, category, unnest(CASE WHEN spelt THEN list_distinct([phrase, replace(phrase, '-', ' '), replace(phrase, '-', '/')]) ELSE [phrase] END) AS phrase, n FROM g UNION ALL SELECT * FROM (VALUES {_FIXED_ROWS}) t(d, c, p, n)),
    y AS (SELECT dimension, category, phrase, sum(n)::BIGINT AS n FROM x GROUP BY ALL)
    SELECT dimension, category, phrase, n, array_to_string(list_sort(list_distinct({LABEL.format('phrase')})), ' ') AS tokens FROM y"""
)
def vocabulary_of_levels(spark, sf_dir):
    """Regions with their nations, and types of parts with their names in several spellings, as categories with phrases."""
    nation, region, part = (table(spark, sf_dir, t) for t in ("nation", "region", "part"))
    row = lambda df, d, c, p, spelt: df.select(F.lit(d).alias("dimension"), c.alias("category"), p.alias("phrase"), F.lit(spelt).alias("spelt"))
    nodes = row(nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")), "family", F.col("r_name"), F.col("n_name"), False)
    nodes = nodes.unionByName(row(part, "role", F.col("p_type"), F.concat_ws("-", "p_brand", "p_name"), True)).unionByName(row(part, "role", F.col("p_type"), F.when(F.col("p_size") % 2 == 0, "  ").otherwise(F.col("p_name")), False))
    out = sy.hierarchy_vocabulary(nodes, FIXED, ALIASES)
    return out.select("dimension", "category", "phrase", "n", F.array_join(F.sort_array("phrase_tokens"), " ").alias("tokens"))


@query(
    f"""WITH {PC}, c AS (SELECT p_partkey, array_to_string(list_sort(list(dimension || '=' || array_to_string(categories, '+'))), ';') AS dimensions FROM pc GROUP BY 1)
    SELECT p_partkey, coalesce(dimensions, '') AS dimensions, coalesce(CASE WHEN p_size % 2 = 0 THEN nullif(trim(p_brand), '') END, p_type) AS kind, nullif(trim(p_name), '') AS label, NULL::VARCHAR AS period FROM part LEFT JOIN c USING (p_partkey)"""
)
def candidate_profiles(spark, sf_dir):
    """Each part's categories, and of its metadata the first alias that says something."""
    part = table(spark, sf_dir, "part").withColumn("maker", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_brand")).otherwise("  "))
    named = sy.metadata({"kind": ["datatype", "maker", "p_type"], "label": ["p_name"], "period": ["period"]}, part.columns)
    told = profiles(spark, sf_dir).groupBy("p_partkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat("dimension", F.lit("="), F.array_join("categories", "+")))), ";").alias("dimensions"))
    return part.select("p_partkey", *[c.alias(n) for n, c in named.items()]).join(told, "p_partkey", "left").withColumn("dimensions", F.coalesce("dimensions", F.lit("")))
