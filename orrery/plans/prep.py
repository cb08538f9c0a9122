"""Preparation queries over the star schema, documents and pages."""

from pyspark.sql import Window as W, functions as F

from orrery.operators import modelio, prep
from orrery.plans.metrics import CTX
from orrery.plans.registry import query
from orrery.session import table


@query("SELECT lang, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM documents GROUP BY lang, source")
def value_counts(spark, sf_dir):
    """Counts of sources and their share of the language."""
    n = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("lang")), 6))


@query("WITH e AS (SELECT o_orderkey, unnest([o_orderstatus, split_part(o_orderpriority, '-', 1), o_orderstatus]) AS v, unnest(range(3)) AS pos FROM orders) SELECT v, pos, count(*) AS n, count(DISTINCT o_orderkey) AS present FROM e GROUP BY ALL")
def entity_explode_counts(spark, sf_dir):
    """Entities of each order with their place, counted with and without repeats."""
    e = table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(F.array("o_orderstatus", F.split_part("o_orderpriority", F.lit("-"), F.lit(1)), "o_orderstatus")).alias("pos", "v"))
    return e.groupBy("v", F.col("pos").cast("long").alias("pos")).agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("present"))


@query("SELECT l_returnflag, count(*) AS present FROM (SELECT DISTINCT l_returnflag, l_orderkey, l_linestatus FROM lineitem) GROUP BY 1")
def presence_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linestatus").distinct().groupBy("l_returnflag").agg(F.count("*").alias("present"))


@query("SELECT source, count(*) AS samples, count(CASE WHEN toxic IS NOT NULL THEN 1 END) AS labelled, count(CASE WHEN trim(text) = '' THEN 1 END) AS empty, count(DISTINCT md5(text)) AS texts, sum(n_chars)::BIGINT AS chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def dataset_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("samples"), F.count("toxic").alias("labelled"), F.count(F.when(F.trim("text") == "", 1)).alias("empty"), F.countDistinct(F.md5("text")).alias("texts"), F.sum("n_chars").alias("chars"))


@query("SELECT o_custkey, array_to_string(list(o_orderpriority ORDER BY f), ',') AS priorities, sum(n)::BIGINT AS n FROM (SELECT o_custkey, o_orderpriority, min(row(o_orderdate, o_orderkey)) AS f, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY o_custkey")
def group_ordered_unique(spark, sf_dir):
    """Distinct priorities of a customer in the order in which they first occur."""
    rows = table(spark, sf_dir, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return rows.groupBy("o_custkey").agg(F.array_join(prep.ordered_unique("at", "o_orderpriority"), ",").alias("priorities"), F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT l_orderkey AS s, l_quantity AS v, l_linenumber AS e FROM lineitem WHERE l_linenumber % 2 = 0), c AS (SELECT l_orderkey AS s, l_quantity AS v, l_linenumber AS c FROM lineitem WHERE l_linenumber % 2 = 1 UNION ALL SELECT l_orderkey, l_quantity, l_linenumber + 10 FROM lineitem WHERE l_linenumber = 2),
    er AS (SELECT *, row_number() OVER (PARTITION BY s, v ORDER BY e) AS k FROM e), cr AS (SELECT *, row_number() OVER (PARTITION BY s, v ORDER BY c) AS k FROM c), n AS (SELECT s, v, count(*) AS n_cells, min(c) AS f FROM c GROUP BY ALL)
    SELECT er.s AS l_orderkey, er.e::BIGINT AS entity, n_cells, coalesce(cr.c, f)::BIGINT AS cell, CASE WHEN n_cells IS NULL THEN 'unmatched' WHEN cr.c IS NULL THEN 'reused' WHEN n_cells = 1 THEN 'exact' ELSE 'ambiguous' END AS status FROM er LEFT JOIN n ON n.s = er.s AND n.v = er.v LEFT JOIN cr ON cr.s = er.s AND cr.v = er.v AND cr.k = er.k"""
)
def one_to_one_match(spark, sf_dir):
    """Even lines of an order matched with cells of equal quantity."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("v"), "l_linenumber")
    entities = lines.where("l_linenumber % 2 = 0").withColumnRenamed("l_linenumber", "entity")
    cells = lines.where("l_linenumber % 2 = 1").unionByName(lines.where("l_linenumber = 2").withColumn("l_linenumber", F.col("l_linenumber") + 10)).withColumnRenamed("l_linenumber", "c")
    out = prep.one_to_one(entities, cells, ["l_orderkey", "v"], "entity", "c")
    return out.select("l_orderkey", F.col("entity").cast("long").alias("entity"), "n_cells", F.col("cell").cast("long").alias("cell"), "status")


@query("WITH n AS (SELECT text, source, count(*) AS n FROM documents GROUP BY ALL) SELECT count(CASE WHEN n > 1 THEN 1 END) AS groups, coalesce(sum(CASE WHEN n > 1 THEN n - 1 END), 0)::BIGINT AS extra, sum(n)::BIGINT AS rows FROM n")
def dup_summary(spark, sf_dir):
    return prep.duplicate_summary(table(spark, sf_dir, "documents"), ["text", "source"])


@query("WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 49), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49) SELECT count(CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 1 END) AS shared, count(CASE WHEN b.k IS NULL THEN 1 END) AS only_a, count(CASE WHEN a.k IS NULL THEN 1 END) AS only_b FROM a FULL JOIN b ON a.k = b.k")
def split_overlap_checks(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return prep.split_overlap(lines.where("l_returnflag = 'A' and l_quantity > 49"), lines.where("l_returnflag = 'R' and l_quantity > 49"), "l_suppkey")


@query(
    """WITH a AS (SELECT o_orderkey AS k, o_custkey AS c, epoch(o_orderdate)::BIGINT // 86400 AS s, epoch(o_orderdate)::BIGINT // 86400 + 30 AS e FROM orders)
    SELECT a.k AS o_orderkey, count(*) AS overlapping, max(b.k) AS last_key FROM a JOIN a b ON a.c = b.c AND a.s < b.e AND a.e > b.s AND a.k <> b.k GROUP BY a.k"""
)
def interval_overlap(spark, sf_dir):
    """Orders of a customer whose thirty days overlap."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("long").alias("start")).withColumn("end", F.col("start") + 30)
    other = rows.select(F.col("o_orderkey").alias("other"), "o_custkey", F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    out = prep.interval_overlap(rows, other, "o_custkey", 30).where("other <> o_orderkey")
    return out.groupBy("o_orderkey").agg(F.count("*").alias("overlapping"), F.max("other").alias("last_key"))


@query("SELECT 'c' || c_custkey AS node, r_name || ' > ' || n_name || ' > ' || c_name AS path, 2::BIGINT AS depth FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'n' || n_nationkey, r_name || ' > ' || n_name, 1 FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'r' || r_regionkey, r_name, 0 FROM region")
def tree_paths(spark, sf_dir):
    """Paths from regions through nations to customers."""
    node = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    r = table(spark, sf_dir, "region").select(node("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    n = table(spark, sf_dir, "nation").select(node("n", "n_nationkey").alias("node"), node("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    c = table(spark, sf_dir, "customer").select(node("c", "c_custkey").alias("node"), node("n", "c_nationkey").alias("parent"), F.col("c_name").alias("name"))
    return prep.tree_paths(r.unionByName(n).unionByName(c)).withColumn("depth", F.col("depth").cast("long"))


@query("SELECT 'c' || c_custkey AS node, 2::BIGINT AS depth, r_name || '|' || n_name || '|' || c_mktsegment AS notes FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'n' || n_nationkey, 1, r_name || '|' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'r' || r_regionkey, 0, r_name FROM region")
def tree_inherited_notes(spark, sf_dir):
    """Lists that nodes inherit from all nodes above."""
    node = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    row = lambda n, p, name: (n.alias("node"), p.alias("parent"), F.col(name).alias("name"), F.array(name).alias("notes"))
    r = table(spark, sf_dir, "region").select(*row(node("r", "r_regionkey"), F.lit(None).cast("string"), "r_name"))
    n = table(spark, sf_dir, "nation").select(*row(node("n", "n_nationkey"), node("r", "n_regionkey"), "n_name"))
    c = table(spark, sf_dir, "customer").select(*row(node("c", "c_custkey"), node("n", "c_nationkey"), "c_mktsegment"))
    out = prep.tree_paths(r.unionByName(n).unionByName(c), "notes")
    return out.select("node", F.col("depth").cast("long").alias("depth"), F.array_join("notes", "|").alias("notes"))


RULES = [("prefix", "PROMO", "promotion"), ("suffix", "BRASS", "red metal"), ("suffix", "COPPER", "red metal"), ("pattern", "^(SMALL|MEDIUM)", "small"), ("inside", "POLISHED", "polished")]


@query("SELECT p_partkey, CASE WHEN p_type LIKE 'PROMO%' THEN 'promotion' WHEN p_type LIKE '%BRASS' OR p_type LIKE '%COPPER' THEN 'red metal' WHEN p_type LIKE 'SMALL%' OR p_type LIKE 'MEDIUM%' THEN 'small' WHEN p_type LIKE '%POLISHED%' THEN 'polished' ELSE 'other' END AS role FROM part")
def case_classifier(spark, sf_dir):
    """The first rule that a type meets."""
    return table(spark, sf_dir, "part").select("p_partkey", prep.by_rules(F.col("p_type"), RULES, "other").alias("role"))


@query("WITH g AS (SELECT l_suppkey, l_quantity, list_sort(list(DISTINCT l_partkey)) AS golds FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, coalesce(len(golds), 0) AS n_golds, golds[1] AS first_gold FROM lineitem LEFT JOIN g USING (l_suppkey, l_quantity) WHERE l_returnflag = 'A'")
def gold_pair_lookup(spark, sf_dir):
    """The parts that a supplier's returned lines of equal quantity name, none or several."""
    lines = table(spark, sf_dir, "lineitem")
    out = prep.gold_lookup(lines.where("l_returnflag = 'A'"), lines.where("l_returnflag = 'R'"), ["l_suppkey", "l_quantity"], "l_partkey")
    return out.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "n_golds", F.get("golds", F.lit(0)).alias("first_gold"))


@query("SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def resume_anti_join(spark, sf_dir):
    """What is still to do: rows without an output."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, contains(lower(html), '<table') AS has_table, length(html) AS n_chars FROM pages")
def page_routing(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.contains(F.lower("html"), F.lit("<table")).alias("has_table"), F.char_length("html").cast("long").alias("n_chars"))


@query(
    """WITH a AS (SELECT page_id, regexp_replace(replace(html, '"</p>"', chr(1)), '<!--.*?-->', ' ', 'gs') AS x FROM pages), b AS (SELECT page_id, regexp_replace(x, '<[^>]*$', '') AS x, regexp_matches(x, '<[^>]*$') AS cut FROM a),
    c AS (SELECT page_id, CASE WHEN NOT cut AND regexp_matches(x, '&[^\\s;>]{0,33}$') THEN regexp_replace(x, '[^>]*$', '') ELSE x END AS x FROM b), d AS (SELECT page_id, regexp_replace(x, '<[^>]*>', ' ', 'g') AS x FROM c),
    e AS (SELECT page_id, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g'), chr(1), '"</p>"') AS x FROM d)
    SELECT page_id, regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS text FROM e"""
)
def html_visible_text(spark, sf_dir):
    """The text nodes of each page; its SQL knows the few references and the one script of these pages."""
    return prep.html_text(table(spark, sf_dir, "pages"), "page_id", "html")


@query(
    """WITH a AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<li>(.*?)</li>', 1, 's') AS cells FROM pages), b AS (SELECT page_id, unnest(cells) AS x, generate_subscripts(cells, 1) - 1 AS col FROM a),
    c AS (SELECT page_id, col, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g') AS x FROM b)
    SELECT page_id, 0::INTEGER AS "table", 0::INTEGER AS "row", col::INTEGER AS col, regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS cell FROM c"""
)
def html_table_cells(spark, sf_dir):
    """Cells of tables built from each page's list items, with column spans filled out."""
    pages = table(spark, sf_dir, "pages").withColumn("html", F.concat(F.lit("<table><tr>"), F.regexp_replace(F.regexp_replace("html", "<li>", "<td>"), "</li>", "</td>"), F.lit("</tr></table>")))
    return prep.html_cells(pages, "page_id", "html")


@query()
def html_table_context(spark, sf_dir):
    """Numbers in tables built from each page's list items, with the labels of their row and column."""
    pages = table(spark, sf_dir, "pages").withColumn("html", F.concat(F.lit("<table><tr><th>Item</th><th>2023</th><th>Year ended 2024</th></tr><tr>"), F.regexp_replace(F.regexp_replace("html", "<li>", "<td>Label</td><td>1,234</td><td>(5.6) "), "</li>", "</td></tr><tr>"), F.lit("</tr></table>")))
    return prep.table_context(prep.html_cells(pages, "page_id", "html"), ["page_id", "table"])


@query(
    f"""WITH RECURSIVE x AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY text) - 1 AS n, regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '^ | $', '', 'g') AS low, {CTX} AS ts FROM conversations WHERE text IS NOT NULL),
    p AS (SELECT a.conv_id, a.n AS i, b.n AS j FROM x a JOIN x b ON b.conv_id = a.conv_id AND a.role = 'user' AND b.role = 'assistant'
          WHERE a.low = b.low OR (a.low <> '' AND b.low <> '' AND (contains(a.low, b.low) OR contains(b.low, a.low))) OR (CASE WHEN len(a.ts) + len(b.ts) = 0 THEN 1.0 ELSE len(list_intersect(a.ts, b.ts)) / len(list_distinct(list_concat(a.ts, b.ts))) END) >= 0.1),
    z AS (SELECT conv_id, count(*) FILTER (role = 'user' AND text IS NOT NULL) AS k FROM conversations GROUP BY 1),
    s AS (SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS mask, 0::BIGINT AS matched FROM z UNION SELECT s.conv_id, s.i + 1, CASE WHEN p.j IS NULL THEN mask ELSE mask | (1::BIGINT << p.j) END, matched + (p.j IS NOT NULL)::INT
          FROM s JOIN z ON z.conv_id = s.conv_id AND s.i < z.k LEFT JOIN (SELECT conv_id, i, j FROM p UNION ALL SELECT conv_id, n, NULL FROM x WHERE role = 'user') p ON p.conv_id = s.conv_id AND p.i = s.i WHERE p.j IS NULL OR (mask & (1::BIGINT << p.j)) = 0)
    SELECT conv_id, max(matched)::BIGINT AS matched FROM s GROUP BY conv_id"""
)
def bipartite_match(spark, sf_dir):
    """How many turns of users find a turn of the assistant like them, one to one."""
    turns = table(spark, sf_dir, "conversations")
    text = lambda role: F.sort_array(F.collect_list(F.when(F.col("role") == role, F.col("text"))))
    return prep.bipartite_match(turns.groupBy("conv_id").agg(text("user").alias("a"), text("assistant").alias("b")), "conv_id", "a", "b", 0.1)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props ELSE '[' || props || ', ' || props || ']' END AS parsed, true AS ok FROM events")
def json_salvage(spark, sf_dir):
    """Objects rescued from answers that break off."""
    broken = F.concat(F.lit("<think>x</think>```json\n["), F.col("props"), F.lit(", "), F.col("props"), F.lit(', {"k": '))
    return modelio.parse_answers(table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(broken).alias("answer")), "event_id", "answer")


@query("SELECT event_id, 'seen ' || event_type AS answer FROM events")
def generated_answers(spark, sf_dir):
    """A generator behind the interface for model calls, here one that repeats its prompt."""
    return modelio.generate(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", "event_type", lambda prompts: [f"seen {p}" for p in prompts])


@query(
    """WITH l AS (SELECT o_orderkey, l_quantity, l_shipdate FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_discount > 0.08) ON l_orderkey = o_orderkey)
    SELECT o_orderkey, count(l_quantity) AS hits, coalesce(sum(l_quantity), 0) AS quantity FROM l GROUP BY o_orderkey"""
)
def left_join_defaults(spark, sf_dir):
    """Gold rows without a partner count as empty."""
    some = table(spark, sf_dir, "lineitem").where("l_discount > 0.08")
    rows = table(spark, sf_dir, "orders").join(some, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.groupBy("o_orderkey").agg(F.count("l_quantity").alias("hits"), F.coalesce(F.sum("l_quantity"), F.lit(0.0)).alias("quantity"))


@query("SELECT k::BIGINT AS k FROM (SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def key_set_operations(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    a = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"))
    return a.intersect(orders.where("o_orderpriority like '1%'").select("o_custkey")).subtract(orders.where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT user_id, sum(calls)::BIGINT AS calls, sum(tokens)::BIGINT AS tokens, sum(tokens + retry)::BIGINT AS upper_bound FROM (SELECT user_id, 1 AS calls, coalesce(json_extract_string(props, '$.k')::BIGINT, 0) AS tokens, CASE WHEN event_type = 'error' THEN 100 ELSE 0 END AS retry FROM events) GROUP BY 1")
def cost_accounting(spark, sf_dir):
    """Calls and tokens of each context, with an upper bound for retries."""
    tokens = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    retry = F.when(F.col("event_type") == "error", 100).otherwise(0)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens"), F.sum(tokens + retry).alias("upper_bound"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY md5(concat('3-', o_orderkey)), o_orderkey) - o_totalprice AS before FROM orders) WHERE before < 300000")
def sample_until_target(spark, sf_dir):
    """Orders of a customer in the order of a hash until their sum reaches a target."""
    w = W.partitionBy("o_custkey").orderBy(F.md5(F.concat(F.lit("3-"), F.col("o_orderkey").cast("string"))), "o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("before", F.sum("o_totalprice").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("o_totalprice"))
    return rows.where("before < 300000").select("o_custkey", "o_orderkey")
