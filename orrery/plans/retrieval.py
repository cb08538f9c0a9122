"""Benchmark passages as queries against documents, and vectors against vectors."""

from pyspark.sql import functions as F

from orrery.functions.text import STOP_WORDS, label_tokens, tokens
from orrery.operators.dense import cosine_topk as nearest
from orrery.operators.fusion import fused_ranking, rrf
from orrery.operators.robustness import grid_metrics, variant_ranks
from orrery.operators.retrieval import bm25_topk as topk, coverage_rescore as rescore, padded_topk, ranked, scope_or_all, typed_scopes
from orrery.plans.registry import query
from orrery.session import staged, table

TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
#: From corpus c(scope, doc, ts) and queries q(query, scope, ts) to scores s(query, doc, score).
SCORES = """
    n AS (SELECT scope, count(*) AS n, avg(len(ts)) AS al FROM c GROUP BY scope),
    p AS (SELECT scope, doc, dl, t, count(*) AS tf FROM (SELECT scope, doc, len(ts) AS dl, unnest(ts) AS t FROM c) GROUP BY ALL),
    df AS (SELECT scope, t, count(*) AS df FROM p GROUP BY ALL),
    s AS (SELECT query, doc, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / al))) AS score
          FROM (SELECT query, scope, unnest(list_distinct(ts)) AS t FROM q) JOIN p USING (scope, t) JOIN df USING (scope, t) JOIN n USING (scope) GROUP BY ALL)"""
DOCS = f"c AS (SELECT '*' AS scope, doc_id AS doc, {TOK.format('text')} AS ts FROM documents)"
ITEMS = f"q AS (SELECT item_id AS query, '*' AS scope, {TOK.format('text')} AS ts FROM benchmark)"
#: The tokenizer for labels, in functions that DuckDB has.
CAMEL = "regexp_replace(regexp_replace({0}, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
STOP = f"[{','.join(repr(w) for w in STOP_WORDS)}]"
LABEL = (
    "list_filter(list_transform(regexp_extract_all({0} || ' ' || " + CAMEL + ", '[A-Za-z0-9]+'), lambda x: CASE "
    "WHEN length(x) > 4 AND lower(x) LIKE '%ies' THEN lower(x)[:-4] || 'y' WHEN length(x) > 3 AND lower(x) LIKE '%s' AND lower(x) NOT LIKE '%ss' THEN lower(x)[:-2] ELSE lower(x) END), "
    "lambda x: NOT list_contains(" + STOP + ", x))"
)


def _corpus(spark, sf_dir):
    return _whole(table(spark, sf_dir, "documents"))


def _items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.lit("*").alias("scope"), tokens(F.col("text")).alias("tokens"))


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(f"WITH {DOCS}, {ITEMS}, {SCORES} SELECT query AS item_id, doc AS doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM s) WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    """The ten best documents for each benchmark passage."""
    return _rounded(topk(_items(spark, sf_dir), _corpus(spark, sf_dir), 10), "score").withColumnsRenamed({"query": "item_id", "doc": "doc_id"})


@query(
    f"""WITH t AS (SELECT item_id AS query, CASE item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'xx' END AS type, {TOK.format('text')} AS ts FROM benchmark),
    q AS (SELECT query, CASE WHEN type IN (SELECT lang FROM documents) THEN type ELSE '*' END AS scope, ts FROM t),
    c AS (SELECT lang AS scope, doc_id AS doc, {TOK.format('text')} AS ts FROM documents UNION ALL SELECT '*', doc_id, {TOK.format("lang || '. ' || text")} FROM documents), {SCORES}
    SELECT query AS item_id, scope, doc AS doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM s) JOIN (SELECT query, scope FROM q) USING (query) WHERE rank <= 10"""
)
def bm25_typed_fallback(spark, sf_dir):
    """Queries of a known type search its scope, others all documents with the type before the text."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("type"), F.col("doc_id").alias("doc"), "text")
    kind = F.when(F.col("item_id") % 3 == 0, "en").when(F.col("item_id") % 3 == 1, "fr").otherwise("xx")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), kind.alias("type"), tokens(F.col("text")).alias("tokens"))
    asked = scope_or_all(asked, docs)
    corpus = typed_scopes(docs, tokens(F.col("text")), tokens(F.concat("type", F.lit(". "), "text")))
    return _rounded(topk(asked, corpus, 10), "score").join(asked.select("query", "scope"), "query").withColumnsRenamed({"query": "item_id", "doc": "doc_id"})


@query(
    f"""WITH t AS (SELECT item_id AS query, CASE item_id % 2 WHEN 0 THEN 'en' ELSE 'xx' END AS scope, {TOK.format('text')} AS ts FROM benchmark),
    q AS (SELECT * FROM t), c AS (SELECT lang AS scope, doc_id AS doc, {TOK.format('text')} AS ts FROM documents), {SCORES}
    SELECT query AS item_id, doc AS doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM s) WHERE rank <= 5"""
)
def bm25_strict_type(spark, sf_dir):
    """A query whose type no document has finds nothing."""
    corpus = table(spark, sf_dir, "documents").select(F.col("lang").alias("scope"), F.col("doc_id").alias("doc"), tokens(F.col("text")).alias("tokens"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.when(F.col("item_id") % 2 == 0, "en").otherwise("xx").alias("scope"), tokens(F.col("text")).alias("tokens"))
    return _rounded(topk(asked, corpus, 5), "score").withColumnsRenamed({"query": "item_id", "doc": "doc_id"})


@query(
    f"""WITH {DOCS}, q AS (SELECT item_id AS query, '*' AS scope, [({TOK.format('text')})[1] || '{{}}', ({TOK.format('text')})[3]] AS ts FROM benchmark), {SCORES},
    a AS (SELECT q.query, d.doc_id AS doc, coalesce(score, 0) AS score, score IS NULL AS pad FROM q CROSS JOIN documents d LEFT JOIN s ON s.query = q.query AND s.doc = d.doc_id)
    SELECT query AS item_id, doc AS doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY pad, round(score, 9) DESC, doc) AS rank FROM a) WHERE rank <= 20"""
)
def bm25_zero_padding(spark, sf_dir):
    """Twenty documents for each query, filled up with those that share no word."""
    t = tokens(F.col("text"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.lit("*").alias("scope"), F.array(F.concat(F.get(t, F.lit(0)), F.lit("{}")), F.get(t, F.lit(2))).alias("tokens"))
    return _rounded(padded_topk(asked, _corpus(spark, sf_dir), 20), "score").withColumnsRenamed({"query": "item_id", "doc": "doc_id"})


@query(
    f"""WITH c AS (SELECT p_brand AS scope, p_partkey AS doc, {LABEL.format("p_type || ' ' || replace(p_name, ' ', '')")} AS ts FROM part),
    q AS (SELECT p_partkey AS query, p_brand AS scope, {LABEL.format("p_name || ' of the ' || p_type")} AS ts FROM part WHERE p_partkey % 100 = 0), {SCORES}
    SELECT query, doc, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM s) WHERE rank <= 10"""
)
def bm25_label_tokens(spark, sf_dir):
    """BM25 over label tokens: camel parts count beside their word, plurals and stop words fall off."""
    part = table(spark, sf_dir, "part")
    label = F.concat("p_type", F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("")))
    corpus = part.select(F.col("p_brand").alias("scope"), F.col("p_partkey").alias("doc"), label_tokens(label).alias("tokens"))
    asked = part.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query"), F.col("p_brand").alias("scope"), label_tokens(F.concat("p_name", F.lit(" of the "), "p_type")).alias("tokens"))
    return _rounded(topk(asked, corpus, 10), "score")


@query(
    f"""WITH {DOCS}, {ITEMS}, {SCORES},
    pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS r FROM s) WHERE r <= 100),
    l AS (SELECT doc_id AS doc, {LABEL.format("array_to_string(string_split(text, ' ')[1:8], ' ')")} AS label FROM documents),
    qt AS (SELECT item_id AS query, {LABEL.format('text')} AS ts FROM benchmark),
    f AS (SELECT query, doc, score, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS norm,
            CASE WHEN len(list_distinct(label)) = 0 THEN 0 ELSE len(list_intersect(label, ts)) / len(list_distinct(label)) END AS cov,
            CASE WHEN len(list_distinct(ts)) = 0 THEN 0 ELSE len(list_intersect(label, ts)) / len(list_distinct(ts)) END AS qcov
          FROM pool JOIN l USING (doc) JOIN qt USING (query) WINDOW w AS (PARTITION BY query)),
    g AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(norm + cov + qcov, 9) DESC, round(cov, 9) DESC, round(qcov, 9) DESC, round(score, 9) DESC, doc) AS rank FROM f)
    SELECT query AS item_id, doc AS doc_id, rank, round(score, 6) AS score, round(norm, 6)::DOUBLE AS bm25_normalized, round(cov, 6)::DOUBLE AS label_coverage, round(qcov, 6)::DOUBLE AS query_coverage, round(norm + cov + qcov, 6)::DOUBLE AS retrieval FROM g WHERE rank <= 10"""
)
def coverage_rescore(spark, sf_dir):
    """BM25 pools of ten times the results, re-ranked with the coverage between query and label, a document's first eight words."""
    pool = topk(_items(spark, sf_dir), _corpus(spark, sf_dir), 10 * 10).drop("rank")
    head = F.array_join(F.slice(F.split("text", " "), 1, 8), " ")
    labels = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), label_tokens(head).alias("label"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), label_tokens(F.col("text")).alias("tokens"))
    out = rescore(pool, labels, asked, 1.0, 10)
    return _rounded(out, "score", "bm25_normalized", "label_coverage", "query_coverage", "retrieval").withColumnsRenamed({"query": "item_id", "doc": "doc_id"})


@query(
    f"""WITH c AS (SELECT p_brand AS scope, p_partkey AS doc, {TOK.format("p_name || ' ' || p_type")} AS ts FROM part),
    q AS (SELECT p_partkey AS query, p_brand AS scope, {TOK.format('p_name')} AS ts FROM part), {SCORES},
    b AS (SELECT query, min_by(doc, (-round(score, 9), doc)) AS best FROM (SELECT query, doc, score FROM s) GROUP BY query)
    SELECT scope AS p_brand, count(*) AS n, count(CASE WHEN best = query THEN 1 END) AS hits, round(1 - count(CASE WHEN best = query THEN 1 END) / count(*), 6) AS failure_rate FROM q LEFT JOIN b USING (query) GROUP BY scope"""
)
def self_retrieval_rate(spark, sf_dir):
    """How often a part's name finds the part itself first among its brand."""
    part = table(spark, sf_dir, "part")
    corpus = part.select(F.col("p_brand").alias("scope"), F.col("p_partkey").alias("doc"), tokens(F.concat_ws(" ", "p_name", "p_type")).alias("tokens"))
    asked = part.select(F.col("p_partkey").alias("query"), F.col("p_brand").alias("scope"), tokens(F.col("p_name")).alias("tokens"))
    # Parts of a brand whose names have the same words ask the same, so each set of words is searched once.
    asked = asked.withColumn("tokens", F.array_sort(F.array_distinct("tokens")))
    first = asked.groupBy("scope", "tokens").agg(F.min("query").alias("query"))
    best = topk(first, corpus, 1).select("query", F.col("doc").alias("best"))
    hit = F.count(F.when(F.col("best") == F.col("query"), 1))
    told = first.join(best, "query").select("scope", "tokens", "best")
    return asked.join(told, ["scope", "tokens"], "left").groupBy(F.col("scope").alias("p_brand")).agg(F.count("*").alias("n"), hit.alias("hits"), F.round(1 - hit / F.count("*"), 6).alias("failure_rate"))


COSINE = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vec"), F.col("label").alias("type"))


@query(
    f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS query, b.vec_id AS doc, {COSINE} AS sim FROM e a, e b WHERE a.vec_id % 100 = 0)
    SELECT query, doc, round(sim, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, doc) AS rank FROM s) WHERE rank <= 10"""
)
def cosine_topk(spark, sf_dir):
    """The ten nearest vectors of every hundredth one."""
    vectors = _vectors(spark, sf_dir)
    asked = vectors.where("doc % 100 = 0").select(F.col("doc").alias("query"), "vec")
    return _rounded(nearest(asked, vectors.select("doc", "vec"), 10), "similarity")


@query(
    f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS query, b.vec_id AS doc, {COSINE} AS sim FROM e a JOIN e b USING (label) WHERE a.vec_id % 100 = 0)
    SELECT query, doc, round(sim, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, doc) AS rank FROM s) WHERE rank <= 5"""
)
def cosine_topk_typed(spark, sf_dir):
    """The five nearest vectors of the same type."""
    vectors = _vectors(spark, sf_dir)
    asked = vectors.where("doc % 100 = 0").withColumnRenamed("doc", "query")
    return _rounded(nearest(asked, vectors, 5, typed=True), "similarity")


#: Ids of documents that are sent to all tasks, at most; beyond that texts are shuffled to meet them.
MOST_IDS = 1 << 22


def _both(spark, vectors, docs):
    """(``vectors`` (doc) that have a document, written once; ``docs`` (doc_id) that have a vector)."""
    vectors = staged(vectors.join(docs.select(F.col("doc_id").alias("doc")), "doc", "left_semi"), "vectors")
    ids = vectors.select(F.col("doc").alias("doc_id"))
    return vectors, docs.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, "doc_id", "left_semi")


def _whole(docs):
    return docs.select(F.lit("*").alias("scope"), F.col("doc_id").alias("doc"), tokens(F.col("text")).alias("tokens"))


@query(
    f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings JOIN documents ON doc_id = vec_id),
    c AS (SELECT '*' AS scope, doc_id AS doc, {TOK.format('text')} AS ts FROM documents WHERE doc_id IN (SELECT vec_id FROM e)),
    q AS (SELECT doc AS query, scope, ts[1:12] AS ts FROM c WHERE doc % 100 = 0), {SCORES},
    ds AS (SELECT a.vec_id AS query, b.vec_id AS doc, {COSINE} AS sim FROM e a, e b WHERE a.vec_id % 100 = 0),
    r AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS r FROM s UNION ALL SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, doc) FROM ds),
    f AS (SELECT query, doc, sum(1.0::DOUBLE / (60 + r)) AS rrf FROM r WHERE r <= 50 GROUP BY ALL)
    SELECT query, doc, round(rrf, 9) AS rrf, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(rrf, 12) DESC, doc) AS rank FROM f) WHERE rank <= 10"""
)
def hybrid_rrf(spark, sf_dir):
    """Lexical and dense rankings of documents that have a vector, fused by reciprocal rank."""
    vectors, own = _both(spark, _vectors(spark, sf_dir).select("doc", "vec"), table(spark, sf_dir, "documents"))
    corpus = _whole(own)
    asked = corpus.where("doc % 100 = 0").select(F.col("doc").alias("query"), "scope", F.slice("tokens", 1, 12).alias("tokens"))
    lexical = topk(asked, corpus, 50).select("query", "doc", "rank", F.lit(0).alias("list"))
    dense = nearest(vectors.where("doc % 100 = 0").withColumnRenamed("doc", "query"), vectors, 50).select("query", "doc", "rank", F.lit(1).alias("list"))
    fused = rrf(lexical.unionByName(dense).withColumnsRenamed({"query": "fact", "doc": "tag"}))
    return ranked(fused, ["fact"], [F.desc(F.round("rrf", 12)), F.col("tag")], 10).select(F.col("fact").alias("query"), F.col("tag").alias("doc"), F.round("rrf", 9).alias("rrf"), "rank")


@query(
    f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings JOIN documents ON doc_id = vec_id),
    c AS (SELECT '*' AS scope, doc_id AS doc, {TOK.format('text')} AS ts FROM documents WHERE doc_id IN (SELECT vec_id FROM e)), q AS (SELECT doc AS query, scope, ts FROM c WHERE doc % 100 = 0), {SCORES},
    ds AS (SELECT a.vec_id AS query, b.vec_id AS doc, {COSINE} AS sim FROM e a, e b WHERE a.vec_id % 100 = 0),
    r AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS r FROM s UNION ALL SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, doc) FROM ds),
    pool AS (SELECT query, doc, sum(1.0::DOUBLE / (60 + r)) AS score FROM r WHERE r <= 100 GROUP BY ALL),
    l AS (SELECT doc_id AS doc, {LABEL.format("array_to_string(string_split(text, ' ')[1:8], ' ')")} AS label, {LABEL.format('text')} AS ts FROM documents),
    f AS (SELECT query, doc, score, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS norm,
            CASE WHEN len(list_distinct(l.label)) = 0 THEN 0 ELSE len(list_intersect(l.label, k.ts)) / len(list_distinct(l.label)) END AS cov, CASE WHEN len(list_distinct(k.ts)) = 0 THEN 0 ELSE len(list_intersect(l.label, k.ts)) / len(list_distinct(k.ts)) END AS qcov
          FROM pool JOIN l USING (doc) JOIN (SELECT doc AS query, ts FROM l) k USING (query) WINDOW w AS (PARTITION BY query)),
    g AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(norm + cov + qcov, 9) DESC, round(cov, 9) DESC, round(qcov, 9) DESC, round(score, 9) DESC, doc) AS rank FROM f)
    SELECT query, doc, rank, round(score, 9) AS score, round(norm, 6)::DOUBLE AS bm25_normalized, round(cov, 6)::DOUBLE AS label_coverage, round(qcov, 6)::DOUBLE AS query_coverage, round(norm + cov + qcov, 6)::DOUBLE AS retrieval FROM g WHERE rank <= 10"""
)
def hybrid_coverage(spark, sf_dir):
    """Whole documents against documents: lexical and dense rankings without coverage, fused, and coverage once after that."""
    vectors, own = _both(spark, _vectors(spark, sf_dir).select("doc", "vec"), table(spark, sf_dir, "documents"))
    corpus = _whole(own)
    lexical = topk(corpus.where("doc % 100 = 0").select(F.col("doc").alias("query"), "scope", "tokens"), corpus, 100).select("query", "doc", "rank", F.lit(0).alias("list"))
    dense = nearest(vectors.where("doc % 100 = 0").withColumnRenamed("doc", "query"), vectors, 100).select("query", "doc", "rank", F.lit(1).alias("list"))
    fused = rrf(lexical.unionByName(dense).withColumnsRenamed({"query": "fact", "doc": "tag"})).select(F.col("fact").alias("query"), F.col("tag").alias("doc"), F.col("rrf").alias("score"))
    docs = table(spark, sf_dir, "documents")
    labels = docs.select(F.col("doc_id").alias("doc"), label_tokens(F.array_join(F.slice(F.split("text", " "), 1, 8), " ")).alias("label"))
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), label_tokens(F.col("text")).alias("tokens"))
    return _rounded(rescore(fused, labels, asked, 1.0, 10), "bm25_normalized", "label_coverage", "query_coverage", "retrieval").withColumn("score", F.round("score", 9))


ROBUST = dict(weights=[0.0, 1.0], pool=100, k=50, draws=2000)
_NORM = "CASE WHEN max(x) OVER w > min(x) OVER w THEN (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) ELSE 1 END"


@query(
    f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings JOIN documents ON doc_id = vec_id), dd AS (SELECT doc_id AS doc, text, lang, source, {TOK.format('text')} AS ts FROM documents WHERE doc_id IN (SELECT vec_id FROM e)),
    c AS (SELECT '*' AS scope, doc, ts FROM dd), q AS (SELECT doc * 10 AS query, '*' AS scope, ts FROM c WHERE doc % 100 = 0 UNION ALL SELECT doc * 10 + 1, '*', ts[1:12] FROM c WHERE doc % 100 = 0), {SCORES},
    ll AS (SELECT query // 10 AS query, query % 10 AS rendering, doc, score AS s, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS r FROM s WHERE doc <> query // 10),
    ds AS (SELECT a.vec_id AS query, b.vec_id AS doc, {COSINE} AS sim FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    dn AS (SELECT query, g.range AS rendering, doc, sim AS s, row_number() OVER (PARTITION BY query, g.range ORDER BY round(sim, 9) DESC, doc) AS r FROM ds, range(2) g),
    pl AS (SELECT 'lexical' AS kind, * FROM ll WHERE r <= 100 UNION ALL SELECT 'dense', * FROM dn WHERE r <= 100),
    po AS (SELECT kind, query, rendering, doc, s FROM pl UNION ALL SELECT 'hybrid', query, rendering, doc, sum(1.0::DOUBLE / (60 + r)) FROM pl GROUP BY query, rendering, doc),
    lb AS (SELECT doc, {LABEL.format("array_to_string(string_split(text, ' ')[1:8], ' ')")} AS label FROM dd),
    qt AS (SELECT doc AS query, 0 AS rendering, {LABEL.format('text')} AS ts FROM dd UNION ALL SELECT doc, 1, {LABEL.format("array_to_string(ts[1:12], ' ')")} FROM dd),
    nm AS (SELECT kind, query, rendering, doc, s, {_NORM} AS norm FROM (SELECT *, round(s, 12) AS x FROM po) WINDOW w AS (PARTITION BY kind, query, rendering)),
    cv AS (SELECT nm.*, CASE WHEN len(list_distinct(label)) = 0 THEN 0 ELSE len(list_intersect(label, ts)) / len(list_distinct(label)) END AS cov, CASE WHEN len(list_distinct(ts)) = 0 THEN 0 ELSE len(list_intersect(label, ts)) / len(list_distinct(ts)) END AS qcov FROM nm JOIN lb USING (doc) JOIN qt USING (query, rendering)),
    rk AS (SELECT * FROM (SELECT cv.*, weight, row_number() OVER (PARTITION BY kind, query, rendering, weight ORDER BY round(norm + weight * (cov + qcov), 9) DESC, weight * round(cov, 9) DESC, weight * round(qcov, 9) DESC, round(s, 12) DESC, doc) AS rank FROM cv, (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) t(weight)) WHERE rank <= 50),
    va AS (SELECT kind, 'onepass' AS method, weight, query, doc, rank FROM rk WHERE rendering = 0 UNION ALL
           SELECT kind, 'rounds', weight, query, doc, row_number() OVER (PARTITION BY kind, weight, query ORDER BY round(x, 12) DESC, doc) FROM (SELECT kind, weight, query, doc, sum(1.0::DOUBLE / (60 + rank)) AS x FROM rk GROUP BY ALL)),
    fi AS (SELECT kind, method, weight, va.query, min(rank) AS rank FROM va JOIN e a ON a.vec_id = va.query JOIN e b ON b.vec_id = va.doc WHERE a.label = b.label AND rank <= 50 GROUP BY ALL),
    ev AS (SELECT v.kind, v.method, v.weight, dd.doc AS query, source AS context, lang, rank FROM dd CROSS JOIN (SELECT DISTINCT kind, method, weight FROM va) v LEFT JOIN fi ON fi.kind = v.kind AND fi.method = v.method AND fi.weight = v.weight AND fi.query = dd.doc WHERE dd.doc % 100 = 0),
    ro AS (SELECT kind, method, weight, modality, context, unnest(['accuracy', 'mrr', 'recall_at_10']) AS metric, unnest([(coalesce(rank, 999) <= 1)::INT::DOUBLE, coalesce(1 / rank, 0), (coalesce(rank, 999) <= 10)::INT::DOUBLE]) AS v FROM (SELECT *, lang AS modality FROM ev UNION ALL SELECT *, 'pooled' FROM ev)),
    pe AS (SELECT kind, method, weight, modality, metric, context, sum(v) AS total, count(*) AS n FROM ro GROUP BY ALL),
    k AS (SELECT modality, context, row_number() OVER (PARTITION BY modality ORDER BY context) - 1 AS at_, count(*) OVER (PARTITION BY modality) AS m FROM (SELECT DISTINCT modality, context FROM pe)),
    tm AS (SELECT modality, draw, at_, count(*) AS times FROM (SELECT modality, dr.range AS draw, (concat('0x', substr(md5(concat(dr.range, '-', sl.range)), 1, 8))::UBIGINT % m)::BIGINT AS at_ FROM range(2000) dr, (SELECT DISTINCT modality, m FROM k) z, range(1000) sl WHERE sl.range < m) GROUP BY ALL),
    bs AS (SELECT kind, method, weight, modality, metric, draw, sum(times * total) / sum(times * n) AS x FROM tm JOIN k USING (modality, at_) JOIN pe USING (modality, context) GROUP BY ALL)
    SELECT kind, method, weight, modality, metric, n, round(value, 6) AS value, round(quantile_cont(x, 0.025), 6) AS ci_low, round(quantile_cont(x, 0.975), 6) AS ci_high, (quantile_cont(x, 0.025) > 0 OR quantile_cont(x, 0.975) < 0) AS ci_excludes_zero
    FROM bs JOIN (SELECT kind, method, weight, modality, metric, sum(n)::BIGINT AS n, sum(total) / sum(n) AS value FROM pe GROUP BY ALL) USING (kind, method, weight, modality, metric) GROUP BY kind, method, weight, modality, metric, n, value"""
)
def retriever_robustness(spark, sf_dir):
    """Every hundredth document asked whole and by its first twelve words, of words, of vectors and of both, with and without
    coverage: where the first document of its class stands, by language, with intervals over sources."""
    docs = table(spark, sf_dir, "documents")
    vectors, own = _both(spark, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vec"), "label"), docs)
    corpus = _whole(own)
    some = own.where("doc_id % 100 = 0")
    head = F.slice(tokens(F.col("text")), 1, 12)
    both = F.explode(F.array(F.struct(F.lit(0).alias("rendering"), tokens(F.col("text")).alias("words"), F.col("text").alias("shown")), F.struct(F.lit(1).alias("rendering"), head.alias("words"), F.array_join(head, " ").alias("shown"))))
    asked = some.select(F.col("doc_id").alias("query"), both.alias("r")).select("query", "r.*")
    # One more than the pool, since a document finds itself.
    scores = topk(asked.select((F.col("query") * 10 + F.col("rendering")).alias("query"), F.lit("*").alias("scope"), F.col("words").alias("tokens")), corpus, ROBUST["pool"] + 1)
    lexical = ranked(scores.where("doc <> floor(query / 10)").drop("rank"), ["query"], [F.desc(F.round("score", 9)), F.col("doc")], ROBUST["pool"])
    lexical = lexical.select(F.floor(F.col("query") / 10).alias("query"), (F.col("query") % 10).cast("int").alias("rendering"), "doc", "score", "rank")
    near = nearest(vectors.where("doc % 100 = 0").select(F.col("doc").alias("query"), "vec"), vectors.select("doc", "vec"), ROBUST["pool"] + 1)
    dense = ranked(near.where("doc <> query").drop("rank"), ["query"], [F.desc(F.round("similarity", 9)), F.col("doc")], ROBUST["pool"])
    dense = dense.select("query", F.explode(F.array(F.lit(0), F.lit(1))).alias("rendering"), "doc", F.col("similarity").alias("score"), "rank")
    labels = own.select(F.col("doc_id").alias("doc"), label_tokens(F.array_join(F.slice(F.split("text", " "), 1, 8), " ")).alias("label"))
    ranks = variant_ranks(lexical, dense, asked.select("query", "rendering", label_tokens(F.col("shown")).alias("tokens")), labels, ROBUST["weights"], ROBUST["k"])
    kinds = vectors.select("doc", "label")
    gold = ranks.select("query", "doc").distinct().join(kinds, "doc").join(kinds.select(F.col("doc").alias("query"), F.col("label").alias("own")), "query").where("label = own").select("query", "doc")
    out = grid_metrics(ranks, gold, some.select(F.col("doc_id").alias("query"), "source", "lang"), F.col("source"), F.col("lang"), ROBUST["draws"])
    return _rounded(out, "value")
