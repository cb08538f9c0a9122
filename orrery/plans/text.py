"""Text functions over whole tables."""

from pyspark.sql import functions as F

from orrery.functions import text as tx
from orrery.operators.passages import containing
from orrery.plans.registry import query
from orrery.plans.retrieval import LABEL, TOK
from orrery.session import table


@query(f"SELECT p_partkey, array_to_string({TOK.format('p_name')}, ' ') AS plain, array_to_string({LABEL.format('joined')}, ' ') AS label FROM (SELECT *, p_type || replace(p_name, ' ', '') || 'PartsUnits' AS joined FROM part)")
def tokenise_variants(spark, sf_dir):
    """Plain tokens of a name, and label tokens of one run together."""
    label = F.concat("p_type", F.replace("p_name", F.lit(" "), F.lit("")), F.lit("PartsUnits"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.tokens(F.col("p_name")), " ").alias("plain"), F.array_join(tx.label_tokens(label), " ").alias("label"))


@query("SELECT o_orderkey, floor(o_totalprice)::BIGINT::VARCHAR AS plain FROM orders")
def normalise_numeric(spark, sf_dir):
    """Amounts written with currency, separators and brackets, read back."""
    amount = F.format_number(F.floor("o_totalprice"), 0)
    shown = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("$ "), amount)).otherwise(F.concat(F.lit("("), amount, F.lit(")")))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.plain_number(shown).alias("plain"))


@query("SELECT doc_id, CASE WHEN length(text) <= 205 THEN text ELSE rtrim(substr(text, 1, 100), ' ') || ' ... ' || ltrim(right(text, 100), ' ') END AS short FROM documents")
def truncate_head_tail(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.head_and_tail(F.col("text"), 205).alias("short"))


NORM = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'), ' '))"


@query(
    f"""WITH t AS (SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
    s AS (SELECT *, {NORM.format('x')} AS nx, {NORM.format('y')} AS ny, list_distinct(regexp_extract_all(lower(x), '[a-z0-9]+(?:\\.[0-9]+)?')) AS tx, list_distinct(regexp_extract_all(lower(y), '[a-z0-9]+(?:\\.[0-9]+)?')) AS ty FROM t)
    SELECT conv_id, turn, nx = ny OR (nx <> '' AND ny <> '' AND (contains(nx, ny) OR contains(ny, nx))) OR coalesce(len(list_intersect(tx, ty)) / nullif(len(list_distinct(list_concat(tx, ty))), 0), 1) >= 0.05 AS matched FROM s"""
)
def relaxed_context_match(spark, sf_dir):
    """Whether neighbouring turns say alike."""
    turns = table(spark, sf_dir, "conversations")
    a = turns.select("conv_id", "turn", F.col("text").alias("x"))
    b = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", tx.relaxed_match(F.col("x"), F.col("y"), 0.05).alias("matched"))


@query("SELECT p_partkey, 'us:' || p_brand AS tag, p_brand AS raw, substr(upper(replace(p_brand, '#', '.')), 1, 3) || '.' || substr(replace(upper(replace(p_brand, '#', '.')), '.', ''), 4) AS code FROM part")
def tag_and_code(spark, sf_dir):
    """Tags with and without prefix, codes with a dot after the third character."""
    tagged = tx.with_prefix(F.col("p_brand"), "us:")
    return table(spark, sf_dir, "part").select("p_partkey", tagged.alias("tag"), tx.without_prefix(tagged, "us:").alias("raw"), tx.dotted_code(F.replace("p_brand", F.lit("#"), F.lit("."))).alias("code"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '</t[dh]>', ' | ', 'gi'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), ' ') AS text FROM pages")
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("text"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_linenumber::BIGINT * 3 AS first_start, l_linenumber::BIGINT * 3 + 19 AS last_end, 2::BIGINT AS n FROM lineitem")
def range_parse(spark, sf_dir):
    """Ranges written as "start end;start end"."""
    n = F.col("l_linenumber")
    position = F.concat_ws(";", F.concat_ws(" ", n * 3, n * 3 + 5), F.concat_ws(" ", n * 3 + 9, n * 3 + 19))
    r = tx.ranges(position)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", n.cast("long").alias("l_linenumber"), F.array_min(F.transform(r, lambda x: x["start"])).cast("long").alias("first_start"), F.array_max(F.transform(r, lambda x: x["end"])).cast("long").alias("last_end"), F.size(r).cast("long").alias("n"))


@query("SELECT doc_id, text_in.item_id IS NOT NULL AS found, item_id FROM documents JOIN benchmark text_in ON contains(documents.text, text_in.text)")
def exact_substring(spark, sf_dir):
    """Documents that hold a benchmark passage word for word."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    return containing(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", items, "passage").select("doc_id", F.lit(True).alias("found"), "item_id")


@query(
    """WITH a AS (SELECT o_orderkey, o_orderkey % 6 AS way, floor(o_totalprice)::BIGINT AS n FROM orders)
    SELECT o_orderkey, CASE WHEN way = 5 THEN '' WHEN way = 3 THEN '-' WHEN way = 4 THEN '-' || n WHEN way = 0 AND n BETWEEN 100000 AND 999999 AND n // 1000 = n % 1000 THEN (n % 1000)::VARCHAR ELSE n::VARCHAR END AS plain, way NOT IN (3, 5) AS numeric FROM a"""
)
def dataset_numbers(spark, sf_dir):
    """Amounts as cells of a table show them, some twice, some with words; where the signs before
    an amount of two equal groups go, its groups are taken for a repeat."""
    amount, way = F.format_number(F.floor("o_totalprice"), 0), F.col("o_orderkey") % 6
    shown = (
        F.when(way == 0, F.concat(F.lit("$ "), amount, F.lit(" $  "), amount)).when(way == 1, F.concat(F.lit("("), amount, F.lit(")")))
        .when(way == 2, F.concat(amount, F.lit(" % "), amount)).when(way == 3, F.lit(" \u2014 ")).when(way == 4, F.concat(F.lit("\u2212"), amount, F.lit("%"))).otherwise(F.concat(F.lit("about "), amount))
    )
    plain = tx.dataset_number(shown)
    return table(spark, sf_dir, "orders").select("o_orderkey", plain.alias("plain"), plain.rlike(r"\d").alias("numeric"))


@query("SELECT p_partkey, lower(p_brand) || '|' || p_type || '|' || p_size AS parts, 3 + (p_size % 2) AS n, p_size % 2 = 1 AS flag FROM part".replace("3 + (p_size % 2)", "3::BIGINT"))
def coercions(spark, sf_dir):
    """Lists and flags written as text."""
    text = F.concat(F.lit(" "), F.lower("p_brand"), F.lit(" ,; "), F.col("p_type"), F.lit(";"), F.col("p_size").cast("string"), F.lit(" , "))
    parts = tx.listed(text)
    flag = F.when(F.col("p_size") % 2 == 1, F.lit(" Yes ")).otherwise("no")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(parts, "|").alias("parts"), F.size(parts).cast("long").alias("n"), tx.truthy(flag).alias("flag"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'us:Item' || p_size WHEN 1 THEN 'us:Item' || (p_size + 1) ELSE '' END AS tag FROM part")
def tag_from_text(spark, sf_dir):
    """The candidate that an answer in words names, in full or without its prefix."""
    size = F.col("p_size")
    item = lambda n: F.concat(F.lit("Item"), n.cast("string"))
    tags = F.array(F.concat(F.lit("us:"), item(size)), F.concat(F.lit("us:"), item(size + 1)))
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("not us:Other, Item"), (size + 1).cast("string"), F.lit(" but us:"), item(size), F.lit("."))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("I say "), item(size + 1), F.lit(" then us:None"))).otherwise("none of them")
    return table(spark, sf_dir, "part").select("p_partkey", tx.tag_in(text, tags, "us:[A-Za-z][A-Za-z0-9_]*").alias("tag"))


@query("SELECT event_id, lower(trim(event_type)) IN ('purchase', 'n/a', '') AS unresolved, coalesce(CASE WHEN event_type = 'click' THEN 'CONTEXT' WHEN event_type = 'view' THEN 'FAMILY' END, upper(event_type)) AS dimension FROM events")
def unresolved_and_alias(spark, sf_dir):
    """Values that say nothing, and dimension names by alias."""
    names = F.create_map(F.lit("click"), F.lit("CONTEXT"), F.lit("view"), F.lit("FAMILY"))
    value = F.when(F.col("event_type") == "purchase", F.lit(" N/A ")).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", tx.unresolved(value).alias("unresolved"), F.coalesce(F.try_element_at(names, F.col("event_type")), F.upper("event_type")).alias("dimension"))


@query(
    """WITH p AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+([A-Z0-9($])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts FROM documents),
    t AS (SELECT doc_id, list_filter(list_transform(parts, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS parts FROM p)
    SELECT doc_id, pos, sentence, len(regexp_extract_all(sentence, '\\d[\\d,.]*'))::BIGINT AS numbers FROM (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS sentence FROM t)"""
)
def sentence_split(spark, sf_dir):
    """Sentences of each document with their place and numbers."""
    s = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))
    return s.select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence", F.size(F.regexp_extract_all("sentence", F.lit(r"\d[\d,.]*"), F.lit(0))).cast("long").alias("numbers"))


@query(
    """WITH c AS (SELECT doc_id, text, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS pos FROM documents WHERE text <> ''),
    n AS (SELECT *, lag(ch) OVER w AS p1, lag(ch, 2) OVER w AS p2, first_value(CASE WHEN NOT regexp_matches(ch, '\\s') THEN ch END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    b AS (SELECT *, ch IN ('.', '!', '?') AND NOT coalesce(ch = '.' AND p2 = '.' AND upper(p1) = p1 AND lower(p1) <> p1, false) AND (nx IS NULL OR (upper(nx) = nx AND lower(nx) <> nx) OR nx BETWEEN '0' AND '9' OR nx IN ('"', '¿', '¡')) AS edge FROM n),
    g AS (SELECT *, coalesce(sum(edge::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nth FROM b),
    s AS (SELECT doc_id, nth, min(pos) - 1 AS start, max(pos) AS stop, any_value(text) AS text FROM g GROUP BY doc_id, nth),
    r AS (SELECT doc_id, start, stop, regexp_replace(regexp_replace(substr(text, start + 1, stop - start), '\\s+', ' ', 'g'), '^ | $', '', 'g') AS sentence FROM s)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS pos, start::BIGINT AS start, stop::BIGINT AS stop, sentence FROM r WHERE sentence <> ''"""
)
def sentence_scan(spark, sf_dir):
    """Sentences with their places, by the marks that end them; a dotted initial ends none."""
    return tx.scanned_sentences(table(spark, sf_dir, "documents").where("text <> ''"), "doc_id", "text").select("doc_id", "pos", "start", F.col("end").alias("stop"), "sentence")
