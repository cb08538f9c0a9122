"""Audits of verdicts, revisions, samples, evidence and hypotheses."""

from pyspark.sql import Window as W, functions as F

from orrery.functions.text import tokens
from orrery.operators import audit, compat
from orrery.plans.registry import query
from orrery.plans.rerank import GOLD, POOL, VERDICTS, gold, pool, verdicts
from orrery.plans.retrieval import TOK
from orrery.plans.statistics import DRAW
from orrery.session import table


@query(
    f"""WITH {POOL}, {VERDICTS}, {GOLD}, d AS (SELECT fact, hyp, dimension, avg(verdict::INT::DOUBLE) AS s FROM v GROUP BY ALL),
    t AS (SELECT fact, hyp, dimension, NOT verdict AS disagrees FROM v JOIN gold USING (fact) WHERE tag = gold AND verdict IS NOT NULL),
    o AS (SELECT *, coalesce(s <= 0.25, false) AS minus, coalesce(s >= 0.6, false) AS plus FROM d JOIN t USING (fact, hyp, dimension))
    SELECT dimension, count(*) AS n, count(*) FILTER (disagrees) AS disagree, count(*) FILTER (minus) AS fired_minus, count(*) FILTER (minus AND disagrees) AS true_minus, count(*) FILTER (plus) AS fired_plus, count(*) FILTER (plus AND NOT disagrees) AS true_plus,
           round(coalesce(count(*) FILTER (minus AND disagrees) / nullif(count(*) FILTER (minus), 0), 0), 6)::DOUBLE AS precision_minus, round(coalesce(count(*) FILTER (minus AND disagrees) / nullif(count(*) FILTER (disagrees), 0), 0), 6)::DOUBLE AS recall_minus FROM o GROUP BY dimension"""
)
def verdict_truth(spark, sf_dir):
    """How often what all rulings say of a dimension is what the gold candidate's ruling says."""
    o = audit.verdict_truth(verdicts(pool(spark, sf_dir)), gold(spark, sf_dir))
    count = lambda c: F.count(F.when(c, 1))
    minus, plus, wrong = F.col("state") == "contradicted", F.col("state") == "supported", F.col("disagrees")
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return o.groupBy("dimension").agg(
        F.count("*").alias("n"), count(wrong).alias("disagree"), count(minus).alias("fired_minus"), count(minus & wrong).alias("true_minus"), count(plus).alias("fired_plus"), count(plus & ~wrong).alias("true_plus"),
        share(count(minus & wrong), count(minus)).alias("precision_minus"), share(count(minus & wrong), count(wrong)).alias("recall_minus"),
    )


@query(
    f"""WITH t AS (SELECT conv_id, role, turn, {TOK.format('text')} AS ts FROM conversations), l AS (SELECT conv_id, role, max_by(ts, turn) AS gold FROM t GROUP BY ALL),
    c AS (SELECT conv_id, role, turn, CASE WHEN len(list_distinct(ts)) > 0 AND len(gold) > 0 THEN len(list_intersect(list_distinct(ts), gold)) / len(list_distinct(ts)) END AS c FROM t JOIN l USING (conv_id, role)),
    e AS (SELECT role, c AS before, lead(c) OVER (PARTITION BY conv_id, role ORDER BY turn) AS after FROM c)
    SELECT role, CASE WHEN after > before THEN 'improved' WHEN after < before THEN 'worsened' ELSE 'unchanged' END AS change, count(*) AS n, round(avg(after - before), 6)::DOUBLE AS mean_delta FROM e WHERE before IS NOT NULL AND after IS NOT NULL GROUP BY ALL"""
)
def revision_effectiveness(spark, sf_dir):
    """Whether a role's turns come closer to its last one of the conversation."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.array_distinct(tokens(F.col("text"))).alias("ts"))
    last = t.groupBy("conv_id", "role").agg(F.max_by("ts", "turn").alias("gold"))
    rounds = t.join(last, ["conv_id", "role"]).withColumn("closeness", audit.closeness(F.col("ts"), F.col("gold")))
    out = audit.revisions(rounds, ["conv_id", "role"], "turn")
    return out.groupBy("role", "change").agg(F.count("*").alias("n"), F.round(F.avg(F.col("after") - F.col("before")), 6).alias("mean_delta"))


FIRED = """count(*) AS n, count(*) FILTER (disagrees) AS disagree, count(*) FILTER (state = 'contradicted') AS fired_minus, count(*) FILTER (state = 'contradicted' AND disagrees) AS true_minus, count(*) FILTER (state = 'supported') AS fired_plus, count(*) FILTER (state = 'supported' AND NOT disagrees) AS true_plus,
           round(coalesce(count(*) FILTER (state = 'contradicted' AND disagrees) / nullif(count(*) FILTER (state = 'contradicted'), 0), 0), 6)::DOUBLE AS precision_minus, round(coalesce(count(*) FILTER (state = 'contradicted' AND disagrees) / nullif(count(*) FILTER (disagrees), 0), 0), 6)::DOUBLE AS recall_minus, round(count(*) FILTER (state <> 'unresolved') / count(*), 6)::DOUBLE AS ruled"""


@query(
    f"""WITH {POOL}, {VERDICTS}, {GOLD}, t AS (SELECT fact, hyp, dimension, NOT verdict AS disagrees FROM v JOIN gold USING (fact) WHERE tag = gold AND verdict IS NOT NULL),
    lf AS (SELECT layer, fact, hyp, dimension, avg(verdict::INT::DOUBLE) AS s FROM (SELECT 's' AS layer, * FROM v WHERE dimension <> 'C' UNION ALL SELECT 'm', * FROM v WHERE tag % 3 <> 0) GROUP BY ALL),
    lg AS (SELECT *, CASE WHEN s >= 0.6 THEN 'supported' WHEN s <= 0.25 THEN 'contradicted' ELSE 'unresolved' END AS st FROM lf),
    lo AS (SELECT t.*, coalesce(a.st, 'unresolved') AS s, coalesce(b.st, 'unresolved') AS m FROM t LEFT JOIN lg a ON a.layer = 's' AND a.fact = t.fact AND a.hyp = t.hyp AND a.dimension = t.dimension LEFT JOIN lg b ON b.layer = 'm' AND b.fact = t.fact AND b.hyp = t.hyp AND b.dimension = t.dimension),
    ll AS (SELECT 'symbolic' AS layer, dimension, s AS state, disagrees FROM lo UNION ALL SELECT 'model', dimension, m, disagrees FROM lo UNION ALL SELECT 'merged', dimension, CASE WHEN s <> 'unresolved' THEN s ELSE m END, disagrees FROM lo)
    SELECT layer, dimension, {FIRED} FROM ll GROUP BY layer, dimension"""
)
def verdict_truth_layers(spark, sf_dir):
    """How often symbolic rulings, a model's and both merged are what the gold candidate's ruling says."""
    v = verdicts(pool(spark, sf_dir))
    truth = v.join(gold(spark, sf_dir), "fact").where((F.col("tag") == F.col("gold")) & F.col("verdict").isNotNull()).select("fact", "hyp", "dimension", (~F.col("verdict")).alias("disagrees"))
    return audit.fired_rates(audit.verdict_layers(v.where("dimension <> 'C'"), v.where("tag % 3 <> 0"), truth), ["layer", "dimension"])


REVISION_DRAWS = 20


@query(
    f"""WITH t AS (SELECT conv_id, role, turn, list_distinct({TOK.format('text')}) AS ts FROM conversations), l AS (SELECT conv_id, role, max_by(ts, turn) AS gold FROM t GROUP BY ALL),
    c AS (SELECT conv_id, role, turn, gold, CASE WHEN len(ts) > 0 AND len(gold) > 0 THEN len(list_intersect(ts, gold)) / len(ts) END AS c FROM t JOIN l USING (conv_id, role)),
    e AS (SELECT * FROM (SELECT conv_id, role, turn, gold, c AS before, lead(c) OVER (PARTITION BY conv_id, role ORDER BY turn) AS after FROM c) WHERE before IS NOT NULL AND after IS NOT NULL),
    k AS (SELECT role, ts, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS at_, count(*) OVER (PARTITION BY role) AS n FROM t),
    d AS (SELECT e.*, {DRAW.format("j.range, '-', e.conv_id, '-', e.role, '-', e.turn", "z.n")} AS at_ FROM e JOIN (SELECT DISTINCT role, n FROM k) z USING (role), range({REVISION_DRAWS}) j),
    r AS (SELECT conv_id, role, turn, avg(x) AS m, count(*) FILTER (x > 0) / nullif(count(x), 0) AS up, count(*) FILTER (x = 0) / nullif(count(x), 0) AS same, count(*) FILTER (x < 0) / nullif(count(x), 0) AS down
          FROM (SELECT d.*, CASE WHEN len(k.ts) > 0 AND len(gold) > 0 THEN len(list_intersect(k.ts, gold)) / len(k.ts) END - before AS x FROM d JOIN k USING (role, at_)) GROUP BY ALL)
    SELECT role, count(*) AS n, round(avg((after > before)::INT), 6) AS improved, round(avg((after = before)::INT), 6) AS unchanged, round(avg((after < before)::INT), 6) AS worsened, round(avg(after - before), 6) AS mean_delta,
           round(avg(up), 6) AS random_improved, round(avg(same), 6) AS random_unchanged, round(avg(down), 6) AS random_worsened, round(avg(m), 6) AS random_mean_delta FROM e JOIN r USING (conv_id, role, turn) GROUP BY role"""
)
def revision_baseline(spark, sf_dir):
    """How often a role's next turn comes closer to its last one, beside twenty other turns of the role drawn at random."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.array_distinct(tokens(F.col("text"))).alias("ts"))
    last = t.groupBy("conv_id", "role").agg(F.max_by("ts", "turn").alias("gold"))
    rounds = t.join(last, ["conv_id", "role"]).withColumn("closeness", audit.closeness(F.col("ts"), F.col("gold")))
    key = ["conv_id", "role", "turn"]
    events = audit.revisions(rounds, ["conv_id", "role"], "turn").join(rounds.select(*key, "gold"), key).withColumn("kind", F.col("role"))
    drawn = audit.random_revisions(events, t.select(F.col("role").alias("kind"), F.col("ts").alias("value"), F.struct("conv_id", "turn").alias("place")), key, "kind", REVISION_DRAWS)
    share = lambda c: F.round(F.avg(F.when(F.col("change") == c, 1.0).otherwise(0.0)), 6).alias(c)
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return drawn.groupBy("role").agg(F.count("*").alias("n"), share("improved"), share("unchanged"), share("worsened"), mean(F.col("after") - F.col("before"), "mean_delta"), *[mean(f"random_{c}", f"random_{c}") for c in ("improved", "unchanged", "worsened")], mean("random_mean", "random_mean_delta"))


@query(
    """WITH x AS (SELECT lang, substr(text, 1, 200) AS cand, CASE WHEN doc_id % 3 = 0 THEN substr(text, 11, 20) WHEN doc_id % 3 = 1 THEN 'nowhere ' || doc_id END AS sel FROM documents),
    y AS (SELECT CASE WHEN coalesce(sel, '') <> '' AND contains(coalesce(cand, ''), sel) THEN 'exact_substring' ELSE 'fallback_' || lang END AS level FROM x)
    SELECT level, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS rate FROM y GROUP BY level"""
)
def relocation_levels(spark, sf_dir):
    """Evidence found again word for word in its text, or the text in its place."""
    text = F.col("text")
    sel = F.when(F.col("doc_id") % 3 == 0, F.substring(text, 11, 20)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("nowhere "), F.col("doc_id").cast("string")))
    rows = table(spark, sf_dir, "documents").select("lang", F.substring(text, 1, 200).alias("cand"), sel.alias("sel"))
    return audit.level_rates(audit.relocate(rows, "sel", "cand", "lang")).withColumn("rate", F.round("rate", 6))


@query("SELECT 'share_' || a.c_mktsegment AS name, expected, declared FROM (SELECT c_mktsegment, count(*)::VARCHAR AS expected FROM customer GROUP BY 1) a FULL JOIN (SELECT c_mktsegment, count(*)::VARCHAR AS declared FROM customer WHERE c_acctbal > 0 GROUP BY 1) b ON a.c_mktsegment = b.c_mktsegment WHERE expected IS DISTINCT FROM declared")
def config_drift(spark, sf_dir):
    """Settings, here counts of segments, that are not as expected."""
    c = table(spark, sf_dir, "customer")
    settings = lambda df: df.groupBy(F.concat(F.lit("share_"), F.col("c_mktsegment")).alias("name")).agg(F.count("*").cast("string").alias("value"))
    return audit.drift(settings(c), settings(c.where("c_acctbal > 0")))


ATTEMPTS, TABLES, TEXTS = 8, 30, 20
TARGET, TARGET_WEIGHT = 200, 0.5  # rows of a sample
ORDERS = "x AS (SELECT o_custkey AS context, CASE WHEN o_custkey % 3 = 0 THEN 'text' ELSE 'table' END AS kind, o_orderpriority AS class, o_orderstatus || (o_orderkey % 50) AS concept FROM orders)"


@query(
    f"""WITH {ORDERS}, k AS (SELECT DISTINCT context, kind FROM x),
    ch AS (SELECT attempt, context FROM (SELECT a.range AS attempt, context, kind, row_number() OVER (PARTITION BY a.range, kind ORDER BY md5(concat(a.range, '-', context)), context) AS r FROM k, range({ATTEMPTS}) a) WHERE r <= CASE kind WHEN 'table' THEN {TABLES} ELSE {TEXTS} END),
    s AS (SELECT attempt, x.* FROM x JOIN ch USING (context) UNION ALL SELECT -1, * FROM x),
    m AS (SELECT attempt, count(*) AS n, count(DISTINCT context) AS cx, count(DISTINCT concept) AS cc, count(*) FILTER (kind = 'table') AS tb, count(DISTINCT context) FILTER (kind = 'table') AS tc, count(DISTINCT context) FILTER (kind <> 'table') AS xc FROM s GROUP BY attempt),
    w AS (SELECT * FROM m WHERE attempt = -1), q AS (SELECT attempt, class, count(*) AS k FROM s GROUP BY ALL),
    l AS (SELECT m.attempt, sum(abs(coalesce(q.k, 0) / m.n - r.k / w.n)) AS class_l1 FROM m, w, (SELECT * FROM q WHERE attempt = -1) r LEFT JOIN q ON q.attempt = m.attempt AND q.class = r.class WHERE m.attempt >= 0 GROUP BY m.attempt),
    d AS (SELECT m.attempt, m.n, round(abs(m.tb / m.n - w.tb / w.n), 6) AS kind_delta, round(class_l1, 6) AS class_l1, round(greatest(abs(m.tb / m.tc - w.tb / w.tc) / (w.tb / w.tc), abs((m.n - m.tb) / m.xc - (w.n - w.tb) / w.xc) / ((w.n - w.tb) / w.xc)), 6) AS per_context_delta, round(abs(m.cc / m.cx - w.cc / w.cx) / (w.cc / w.cx), 6) AS concept_delta FROM m JOIN l USING (attempt), w),
    f AS (SELECT *, concat_ws(',', CASE WHEN kind_delta > 0.08 THEN 'kind_delta' END, CASE WHEN class_l1 > 0.15 THEN 'class_l1' END, CASE WHEN per_context_delta > 0.35 THEN 'per_context_delta' END, CASE WHEN concept_delta > 0.60 THEN 'concept_delta' END) AS flags, kind_delta + 0.5 * class_l1 + 0.2 * per_context_delta + 0.2 * concept_delta + {TARGET_WEIGHT} * abs(n - {TARGET}) / {TARGET} AS score FROM d),
    g AS (SELECT *, coalesce(round(score, 9) < min(round(score, 9)) OVER (ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS least FROM f)
    SELECT attempt, n, kind_delta, class_l1, per_context_delta, concept_delta, flags, round(score, 6) AS score, attempt = coalesce((SELECT min(attempt) FROM g WHERE least AND flags = ''), (SELECT max(attempt) FROM g WHERE least)) AS taken FROM f"""
)
def context_sample_quality(spark, sf_dir):
    """Samples of customers drawn by a hash, how far each is from all, and the one to take."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("context"), F.when(F.col("o_custkey") % 3 == 0, "text").otherwise("table").alias("kind"), F.col("o_orderpriority").alias("class"), F.concat("o_orderstatus", (F.col("o_orderkey") % 50).cast("string")).alias("concept"))
    drawn = rows.select("context", "kind").distinct().withColumn("attempt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ATTEMPTS - 1).cast("long"))))
    place = F.row_number().over(W.partitionBy("attempt", "kind").orderBy(F.md5(F.concat_ws("-", F.col("attempt").cast("string"), F.col("context").cast("string"))), "context"))
    chosen = drawn.withColumn("r", place).where(F.col("r") <= F.when(F.col("kind") == "table", TABLES).otherwise(TEXTS)).select("attempt", "context")
    return audit.sample_quality(rows, chosen, TARGET, TARGET_WEIGHT).withColumns({c: F.round(c, 6) for c in ("kind_delta", "class_l1", "per_context_delta", "concept_delta", "score")})


DATATYPES = ("monetaryItemType", "sharesItemType", "perShareItemType", "percentItemType", "stringItemType")
PHRASES = ("total amount", "Number of Shares issued", "earnings per share", "interest rate", "nothing said")
FAMILIES = ("asset", "liability", "revenue", "expense", "lease")
QUALIFIERS = ("accumulated", "weighted_average", "fair_value", "other")


def _pick(values, index):
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


@query(
    f"""WITH h AS (SELECT p_partkey, {list(DATATYPES)}[1 + p_partkey % 5] AS dt, {list(PHRASES)}[1 + p_size % 5] AS t, list_distinct([{list(FAMILIES)}[1 + p_partkey % 5], {list(FAMILIES)}[1 + p_size % 5]]) AS fam,
        CASE p_size % 4 WHEN 0 THEN ['instant'] WHEN 1 THEN ['duration'] WHEN 2 THEN ['instant', 'duration'] ELSE [] END AS tmp, [{list(QUALIFIERS)}[1 + p_partkey % 4]] AS ql FROM part),
    c AS (SELECT p_partkey, (dt = 'stringItemType' OR t NOT IN ('Number of Shares issued', 'earnings per share', 'interest rate') OR (t = 'Number of Shares issued' AND dt = 'sharesItemType') OR (t = 'earnings per share' AND dt = 'perShareItemType') OR (t = 'interest rate' AND dt = 'percentItemType')) AS datatype,
        len(tmp) <= 1 AND NOT (len(tmp) = 1 AND ql[1] <> 'other' AND tmp[1] <> CASE WHEN ql[1] = 'weighted_average' THEN 'duration' ELSE 'instant' END) AS period_type,
        NOT (list_has_any(fam, ['asset', 'expense']) AND list_has_any(fam, ['liability', 'revenue'])) AS balance FROM h)
    SELECT p_partkey, datatype, period_type, balance, datatype AND period_type AND balance AS passed FROM c"""
)
def hypothesis_compatibility(spark, sf_dir):
    """Datatype, period type and balance of hypotheses made from parts."""
    key, size = F.col("p_partkey"), F.col("p_size")
    temporal = F.when(size % 4 == 0, F.array(F.lit("instant"))).when(size % 4 == 1, F.array(F.lit("duration"))).when(size % 4 == 2, F.array(F.lit("instant"), F.lit("duration")))
    checks = compat.verdict(_pick(DATATYPES, key % 5), _pick(PHRASES, size % 5), F.array(_pick(FAMILIES, key % 5), _pick(FAMILIES, size % 5)), temporal, F.array(_pick(QUALIFIERS, key % 4)))
    return table(spark, sf_dir, "part").select("p_partkey", *[v.alias(k) for k, v in checks.items()])


@query(
    f"""SELECT p_partkey, 1.0::DOUBLE AS bias, (p_size % 2 = 0)::INT::DOUBLE AS is_table, (p_size % 2 = 1)::INT::DOUBLE AS is_text, (p_partkey % 5 = 0)::INT::DOUBLE AS is_monetary, (p_partkey % 5 IN (1, 2))::INT::DOUBLE AS is_shares, (p_partkey % 5 = 3)::INT::DOUBLE AS is_percent,
    len({TOK.format('p_name')})::DOUBLE AS token_count, (contains(lower(p_type), 'standard'))::INT::DOUBLE AS has_cue FROM part"""
)
def feature_vectors(spark, sf_dir):
    """Indicators of a fact's form as numbers."""
    kind = F.when(F.col("p_size") % 2 == 0, "table").otherwise("text")
    found = audit.indicators(_pick(DATATYPES, F.col("p_partkey") % 5), kind, {"token_count": F.size(tokens(F.col("p_name"))), "has_cue": F.contains(F.lower("p_type"), F.lit("standard"))})
    return table(spark, sf_dir, "part").select("p_partkey", *[v.alias(k) for k, v in found.items()])
