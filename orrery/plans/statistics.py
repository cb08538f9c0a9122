"""Bootstraps, permutations and summary statistics."""

from pyspark.sql import Window as W, functions as F

from orrery.operators import resample as rs, splits as sp, stats as st
from orrery.plans.registry import query
from orrery.session import table

DRAWS = 2000
DRAW = "(concat('0x', substr(md5(concat({0})), 1, 8))::UBIGINT % {1})::BIGINT"


def _boot(values: str) -> str:
    return f"""c AS (SELECT row_number() OVER (ORDER BY ctx) - 1 AS at_, sum(v) AS s, count(v) AS n FROM ({values}) GROUP BY ctx), z AS (SELECT count(*)::BIGINT AS m FROM c),
    d AS (SELECT dr.range AS draw, {DRAW.format("dr.range, '-', sl.range", 'm')} AS at_ FROM range({DRAWS}) dr, z, range((SELECT m FROM z)) sl), b AS (SELECT draw, sum(s) / sum(n) AS x FROM d JOIN c USING (at_) GROUP BY draw)"""


CI = "round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high, (quantile_cont(x, 0.025) > 0 OR quantile_cont(x, 0.975) < 0) AS excludes_zero"


@query(f"WITH {_boot('SELECT o_custkey % 97 AS ctx, CASE WHEN o_totalprice > 150000 THEN 1.0::DOUBLE ELSE 0 END AS v FROM orders')} SELECT (SELECT round(sum(s) / sum(n), 6) FROM c) AS mean, {CI} FROM b")
def bootstrap_context_ci(spark, sf_dir):
    """The share of large orders with a confidence interval over resampled customer groups."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 97).alias("ctx"), F.when(F.col("o_totalprice") > 150000, 1.0).otherwise(0.0).alias("v"))
    samples = st.bootstrap(st.by_cluster(rows, "ctx", "v"), DRAWS)
    return samples.agg(*st.interval(samples)).crossJoin(rows.agg(F.round(F.avg("v"), 6).alias("mean")))


@query(f"WITH {_boot('SELECT p_partkey % 53 AS ctx, a.v - b.v AS v FROM part JOIN (SELECT l_partkey AS k, avg(l_discount) AS v FROM lineitem GROUP BY 1) a ON a.k = p_partkey JOIN (SELECT l_partkey AS k, avg(l_tax) AS v FROM lineitem GROUP BY 1) b ON b.k = p_partkey')} SELECT (SELECT round(sum(s) / sum(n), 6) FROM c) AS mean, {CI} FROM b")
def paired_bootstrap(spark, sf_dir):
    """The difference between two values of the same parts, with the same draws for both."""
    means = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg((F.avg("l_discount") - F.avg("l_tax")).alias("v"))
    rows = table(spark, sf_dir, "part").join(means, F.col("p_partkey") == F.col("k")).select((F.col("p_partkey") % 53).alias("ctx"), "v")
    samples = st.bootstrap(st.by_cluster(rows, "ctx", "v"), DRAWS)
    return samples.agg(*st.interval(samples)).crossJoin(rows.agg(F.round(F.avg("v"), 6).alias("mean")))


PERMS = 200


@query(
    f"""WITH x AS (SELECT event_type AS arm, event_id AS fact, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    base AS (SELECT arm, avg(greatest(value, value)) AS observed FROM x GROUP BY arm),
    p AS (SELECT x.arm, pm.range AS perm, x.value, (x.i + 1 + {DRAW.format("pm.range, '-', x.fact", 'greatest(x.n - 1, 1)')}) % x.n AS j FROM x, range({PERMS}) pm),
    g AS (SELECT p.arm, perm, avg(CASE WHEN y.value > p.value THEN 1 ELSE 0 END) AS gain FROM p JOIN x y ON y.arm = p.arm AND y.i = p.j GROUP BY ALL)
    SELECT arm, round(avg(gain), 6) AS null_mean, round(stddev_samp(gain), 6) AS null_sd, count(*) FILTER (gain >= 0.5) AS at_least, round((count(*) FILTER (gain >= 0.5) + 1) / ({PERMS} + 1), 6) AS p_smoothed, round(count(*) FILTER (gain >= 0.5) / {PERMS}, 6) AS p_plain FROM g GROUP BY arm"""
)
def permutation_null(spark, sf_dir):
    """Each fact borrows another fact's value of its arm; how often that beats its own, and both p values of one half."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), F.col("event_id").alias("fact"), "value")
    gains = rs.permuted_gains(rows, "arm", "fact", "value", PERMS)
    more = F.count(F.when(F.col("gain") >= 0.5, 1))
    return gains.groupBy("arm").agg(F.round(F.avg("gain"), 6).alias("null_mean"), F.round(F.stddev_samp("gain"), 6).alias("null_sd"), more.alias("at_least"), F.round((more + 1) / (PERMS + 1), 6).alias("p_smoothed"), F.round(more / PERMS, 6).alias("p_plain"))


@query("SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def percentile_linear(spark, sf_dir):
    """Exact percentiles by linear interpolation."""
    out = rs.percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")])


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS variance, round(stddev_samp(l_quantity) / sqrt(count(*)), 9) AS se FROM lineitem GROUP BY 1")
def ols_slope(spark, sf_dir):
    sd = F.stddev_samp("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"), F.round(sd, 6).alias("sd"), F.round(F.var_pop("l_quantity"), 6).alias("variance"), F.round(sd / F.sqrt(F.count("*")), 9).alias("se"))


COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "flat")


@query(
    "WITH x AS (SELECT *, 1.0::DOUBLE AS flat FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, " + ("1.0::DOUBLE" if a == b else "0.0::DOUBLE" if "flat" in (a, b) else f"round(corr({a}, {b}), 6)") + " AS r" + (" FROM x" if "flat" not in (a, b) and a != b else "") for i, a in enumerate(COLUMNS) for b in COLUMNS[i:])
)
def corr_matrix(spark, sf_dir):
    """Pearson correlations; columns that do not vary correlate with nothing."""
    return st.correlations(table(spark, sf_dir, "lineitem").withColumn("flat", F.lit(1.0)), list(COLUMNS)).withColumn("r", F.round("r", 6))


@query(
    """WITH p AS (SELECT c_mktsegment AS k, count(*) / sum(count(*)) OVER () AS p FROM customer WHERE c_custkey % 2 = 0 AND c_mktsegment <> 'BUILDING' GROUP BY 1), q AS (SELECT c_mktsegment AS k, count(*) / sum(count(*)) OVER () AS q FROM customer WHERE c_custkey % 2 = 1 GROUP BY 1)
    SELECT round(sum(abs(coalesce(p, 0) - coalesce(q, 0))), 6) AS l1, round(max(abs(coalesce(p, 0) - coalesce(q, 0))), 6) AS max_abs FROM p FULL JOIN q USING (k)"""
)
def distribution_distance(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    out = st.distribution_distance(c.where("c_custkey % 2 = 0 and c_mktsegment <> 'BUILDING'"), c.where("c_custkey % 2 = 1"), "c_mktsegment")
    return out.select(F.round("l1", 6).alias("l1"), F.round("max_abs", 6).alias("max_abs"))


QUOTA = 100


@query(
    f"""WITH o AS (SELECT o_custkey AS k, list_distinct(list(o_orderpriority)) AS kinds FROM orders GROUP BY 1), e AS (SELECT k, unnest(kinds) AS kind FROM o), f AS (SELECT kind, count(*) AS n FROM e GROUP BY 1),
    s AS (SELECT k, min_by(kind, row(n, kind)) AS stratum FROM e JOIN f USING (kind) GROUP BY k), z AS (SELECT stratum, count(*) AS n, sum(count(*)) OVER () AS total FROM s GROUP BY 1),
    slots AS (SELECT stratum, j.range AS j, row_number() OVER (ORDER BY round(j.range - 1 - {QUOTA}.0::DOUBLE * n / total, 9), n DESC, stratum DESC) AS r FROM z, range(2, {QUOTA} + 1) j WHERE j.range <= n),
    q AS (SELECT z.stratum, 1 + count(r) AS quota FROM z LEFT JOIN slots ON slots.stratum = z.stratum AND r <= least({QUOTA}, total) - (SELECT count(*) FROM z) GROUP BY z.stratum),
    p AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat('7-', k)), k) <= quota AS test FROM s JOIN q USING (stratum)),
    seen AS (SELECT DISTINCT kind FROM p JOIN e USING (k) WHERE NOT test), lost AS (SELECT DISTINCT k FROM p JOIN e USING (k) WHERE test AND kind NOT IN (SELECT kind FROM seen))
    SELECT k AS o_custkey, stratum, CASE WHEN NOT test THEN 'train' WHEN k IN (SELECT k FROM lost) THEN 'excluded' ELSE 'test' END AS split FROM p"""
)
def stratified_split(spark, sf_dir):
    """A test split of 100 customers: strata by the rarest priority of a customer's orders, quotas by the
    largest deficit, rows by a hash; a test row with a priority that training never has is excluded."""
    kinds = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("kinds"))
    rows = sp.quota_sample(st.stratum(kinds, "k", "kinds"), "stratum", [F.md5(F.concat(F.lit("7-"), F.col("k").cast("string")))], QUOTA, "k")
    each = rows.join(kinds, "k").select("k", "chosen", F.explode("kinds").alias("kind"))
    lost = each.where("chosen").join(each.where("not chosen").select("kind").distinct(), "kind", "left_anti").select("k").distinct().withColumn("lost", F.lit(True))
    split = F.when(~F.col("chosen"), "train").when(F.col("lost"), "excluded").otherwise("test")
    return rows.join(lost, "k", "left").select(F.col("k").alias("o_custkey"), "stratum", split.alias("split"))


SPLIT = dict(train=60, test=20, attempts=5, max_difference=0.1)


def _quota_sql(name: str, groups: str, target: int) -> str:
    return f"""{name}0 AS (SELECT *, least(sum(cap) OVER (PARTITION BY attempt), {target}) AS total, weight / sum(weight) OVER (PARTITION BY attempt) * least(sum(cap) OVER (PARTITION BY attempt), {target}) AS raw, count(*) OVER (PARTITION BY attempt) AS m FROM {groups} WHERE cap > 0),
    {name}1 AS (SELECT attempt, stratum, total, m, row_number() OVER (PARTITION BY attempt ORDER BY round(raw - (j - 1), 9) DESC, weight DESC, stratum DESC) AS r FROM (SELECT *, unnest(range((CASE WHEN total >= m THEN 2 ELSE 1 END)::BIGINT, least(cap, total)::BIGINT + 1)) AS j FROM {name}0)),
    {name} AS (SELECT x.attempt, x.stratum, CASE WHEN any_value(x.total) >= any_value(x.m) THEN 1 ELSE 0 END + count(r) AS quota FROM {name}0 x LEFT JOIN {name}1 y ON y.attempt = x.attempt AND y.stratum = x.stratum AND r <= y.total - CASE WHEN y.total >= y.m THEN y.m ELSE 0 END GROUP BY ALL)"""


def _difference_sql(name: str, counts: str) -> str:
    return f"{name} AS (SELECT attempt, max(abs(tr / nullif(sum_tr, 0) - te / nullif(sum_te, 0))) AS d FROM (SELECT *, sum(tr) OVER (PARTITION BY attempt) AS sum_tr, sum(te) OVER (PARTITION BY attempt) AS sum_te FROM (SELECT attempt, what, coalesce(sum(n) FILTER (split = 'train'), 0) AS tr, coalesce(sum(n) FILTER (split = 'test'), 0) AS te FROM ({counts}) GROUP BY ALL)) GROUP BY attempt)"


SPLITS = f"""each AS (SELECT o_custkey AS key, o_orderpriority AS kind, count(*) AS n FROM orders GROUP BY ALL), pa AS (SELECT DISTINCT key, 'k:' || kind AS part FROM each UNION SELECT DISTINCT o_custkey, 'c:' || (o_orderkey % 150) FROM orders),
    st AS (SELECT key, min_by(kind, row(often, kind)) AS stratum FROM each JOIN (SELECT kind, count(*) AS often FROM each GROUP BY kind) USING (kind) GROUP BY key), rw AS (SELECT st.*, a.range AS attempt FROM st, range({SPLIT["attempts"]}) a),
    gz AS (SELECT attempt, stratum, count(*) AS weight, count(*) AS cap FROM rw GROUP BY ALL), {_quota_sql("qa", "gz", SPLIT["train"])},
    tr AS (SELECT attempt, stratum, key FROM (SELECT *, row_number() OVER (PARTITION BY attempt, stratum ORDER BY md5(concat('7-train-', attempt, '-', key)), key) AS r FROM rw) JOIN qa USING (attempt, stratum) WHERE r <= quota),
    kn AS (SELECT DISTINCT attempt, part FROM pa JOIN tr USING (key)), el AS (SELECT attempt, stratum, key FROM rw WHERE (attempt, key) NOT IN (SELECT (attempt, key) FROM tr) AND (SELECT count(*) FROM pa WHERE pa.key = rw.key) = (SELECT count(*) FROM pa JOIN kn USING (part) WHERE pa.key = rw.key AND kn.attempt = rw.attempt)),
    gc AS (SELECT gz.attempt, gz.stratum, weight, count(*) AS cap FROM gz JOIN el USING (attempt, stratum) GROUP BY ALL), {_quota_sql("qb", "gc", SPLIT["test"])},
    te AS (SELECT attempt, stratum, key FROM (SELECT *, row_number() OVER (PARTITION BY attempt, stratum ORDER BY md5(concat('7-test-', attempt, '-', key)), key) AS r FROM el) JOIN qb USING (attempt, stratum) WHERE r <= quota),
    me AS (SELECT *, 'train' AS split FROM tr UNION ALL SELECT *, 'test' FROM te), nn AS (SELECT attempt, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test FROM me GROUP BY 1),
    {_difference_sql("d1", "SELECT attempt, split, stratum AS what, 1 AS n FROM me")}, {_difference_sql("d2", "SELECT attempt, split, kind AS what, 1 AS n FROM me JOIN each USING (key)")}, {_difference_sql("d3", "SELECT attempt, split, kind AS what, n FROM me JOIN each USING (key)")},
    mi AS (SELECT attempt, count(*) FILTER (t = 0) AS missing FROM (SELECT attempt, part, max((split = 'train')::INT) AS t FROM me JOIN pa USING (key) GROUP BY ALL) GROUP BY attempt),
    rp AS (SELECT nn.*, d1.d AS stratum_difference, d2.d AS presence_difference, d3.d AS entity_difference, missing, 10 * abs(test - {SPLIT["test"]}) / {SPLIT["test"]} + 5 * abs(train - {SPLIT["train"]}) / {SPLIT["train"]} + 4 * d1.d + 2 * d2.d + d3.d AS score FROM nn JOIN d1 USING (attempt) JOIN d2 USING (attempt) JOIN d3 USING (attempt) JOIN mi USING (attempt)),
    bs AS (SELECT min_by(attempt, row(round(score, 9), attempt)) AS best FROM rp)"""


def _split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderpriority", (F.col("o_orderkey") % 150).alias("concept"))
    kinds = orders.groupBy("key", "o_orderpriority").agg(F.count("*").alias("n")).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("o_orderpriority", "n"))).alias("k"))
    concepts = orders.groupBy("key").agg(F.collect_set("concept").alias("concepts"))
    samples = kinds.join(concepts, "key").select("key", F.col("key").alias("context"), "concepts", F.col("k.o_orderpriority").alias("kinds"), F.col("k.n").alias("kind_counts"))
    return samples, *sp.split_attempts(samples, **SPLIT)


@query(
    f"WITH {SPLITS} SELECT attempt, train, test, 0::BIGINT AS shared_contexts, missing AS missing_in_train, round(stratum_difference, 6) AS stratum_difference, round(presence_difference, 6) AS presence_difference, round(entity_difference, 6) AS entity_difference, round(score, 6) AS score, missing = 0 AND round(stratum_difference, 9) <= {SPLIT['max_difference']} AS passed, attempt = best AS chosen FROM rp, bs"
)
def split_attempts(spark, sf_dir):
    """Five attempts to split customers by the priorities and kinds of their orders, their checks and scores."""
    _, _, report = _split(spark, sf_dir)
    return report.withColumns({c: F.round(c, 6) for c in ("stratum_difference", "presence_difference", "entity_difference", "score")})


@query(f"WITH {SPLITS} SELECT st.key AS o_custkey, coalesce(split, 'unused') AS split FROM st LEFT JOIN (SELECT key, split FROM me JOIN bs ON attempt = best) USING (key)")
def best_split(spark, sf_dir):
    """The members of the chosen attempt."""
    samples, members, report = _split(spark, sf_dir)
    return sp.chosen_split(samples, members, report).select(F.col("key").alias("o_custkey"), "split")


@query("SELECT * FROM (SELECT doc_id, lang, toxic::BIGINT AS toxic, row_number() OVER (ORDER BY md5(concat('9-', doc_id)), doc_id) AS nth FROM documents LEFT JOIN labels USING (doc_id)) WHERE nth <= 50")
def spot_check_sample(spark, sf_dir):
    """The first 50 documents in the order of a hash, with their label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").withColumn("h", F.md5(F.concat(F.lit("9-"), F.col("doc_id").cast("string"))))
    some = docs.orderBy("h", "doc_id").limit(50)
    return some.withColumn("nth", F.row_number().over(W.orderBy("h", "doc_id")).cast("long")).join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("long").alias("toxic")), "doc_id", "left").drop("h")


@query(
    """WITH g AS (SELECT l_returnflag || l_linestatus AS gate, avg(l_discount) AS m, count(*) AS n, 1.959963984540054::DOUBLE * stddev_samp(l_discount) / sqrt(count(*)) AS h FROM lineitem GROUP BY 1)
    SELECT gate, n, round(m - h, 6) AS low, round(m + h, 6) AS high, CASE WHEN m - h > 0.0495 THEN 'pass' WHEN m + h < 0.0495 THEN 'fail' ELSE 'inconclusive' END AS decision FROM g"""
)
def decision_gates(spark, sf_dir):
    """Verdicts from where a mean's interval lies."""
    low, high = st.normal_interval("l_discount")
    g = table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("gate")).agg(F.count("*").alias("n"), low.alias("low"), high.alias("high"))
    return g.select("gate", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), st.gate(F.col("low"), F.col("high"), 0.0495).alias("decision"))
