"""Queries over the whole tables, one for each operator, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm.bpe import encode_decode
from orrery.llm.exact_dedup import exact_groups
from orrery.llm.fingerprints import edited_fingerprints
from orrery.llm.hard_negatives import hard_negatives, participants
from orrery.llm.hmm import score_texts
from orrery.llm.licenses import scan
from orrery.llm.line_dedup import drop_boilerplate
from orrery.llm.packing import pack_documents
from orrery.llm.periodic import periodic_runs
from orrery.llm.personal_data import KINDS, personal_data
from orrery.llm.sharding import shard_documents
from orrery.llm.simhash import near_groups
from orrery.llm.toxicity import fit, held_out, score
from orrery.session import table

SHARDS = 40
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), SHARDS).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op4_pack_min_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, capacity=2048)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode_decode(table(spark, sf_dir, "documents"), TOKENIZER)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_groups(table(spark, sf_dir, "documents"), words=3, radius=2)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"))
    label = lambda x: x["label"]
    word = lambda x: x["word"]
    base = F.array_distinct(F.transform("places", label))
    both = F.array_union(base, F.transform("matches", label))
    best = F.array_max(F.transform("matches", lambda x: x["containment"]))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", word)).alias("first_word"),
        F.array_max(F.transform("places", word)).alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(both), ",").alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size("places") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(grams):
        return F.sha2(F.concat_ws(",", F.transform(grams, lambda x: F.hex(x))), 256)

    rows = edited_fingerprints(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digest("grams").alias("fingerprint"), digest("edited_grams").alias("edited_fingerprint"), "near_edited", "near_next", F.size("grams").cast("long").alias("n_grams"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drop_boilerplate(table(spark, sf_dir, "documents"), host_col="source")
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op10_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0, F.lit(False))
    rows = score_texts(table(spark, sf_dir, "documents"), ~apart)
    return rows.select("doc_id", (~F.col("learns")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal_data(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def written(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    def number(k):
        return F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    every = F.sort_array(F.concat("base", "added"))
    return rows.select("doc_id", *[number(k) for k in range(len(KINDS))], F.sha2(written(F.sort_array("base")), 256).alias("base_sha256"), written(every).alias("spans"), F.size("added").cast("long").alias("n_added"))


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text; of the texts with crc32(doc_id) % 10 = 0, words from a place on repeat a stretch."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    marked = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    n = F.size("words")
    at = marked.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return at.select("doc_id", F.when(n > 0, F.array_join(F.transform("words", place), " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(looped(table(spark, sf_dir, "documents")), least=24, times=3)
    # Ratios of numbers under 2^26 differ as doubles if they differ.
    best = F.array_max(F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("e"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r["length"].alias("n"))))
    written = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    at = rows.withColumn("best", best)
    return at.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("(1000 * best.n) div (-best.p)").alias("exponent_milli"), F.sha2(written, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = participants(table(spark, sf_dir, "embeddings"))
    noisy = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(noisy, F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_ring_shards, op3_exact_dedup, op4_pack_min_slack, op5_bpe_round_trip, op6_simhash_groups, op7_license_scan, op8_fingerprints, op9_line_dedup, op10_hmm_scores, op11_personal_data, op12_periodic_runs, op13_hard_negatives)}

ORACLES = {
    "op3_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
               count(*) OVER (PARTITION BY h) AS group_size,
               doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST) AS kept,
               h AS text_sha256
        FROM d""",
    "op9_line_dedup": r"""
        WITH p AS (SELECT doc_id, coalesce(source, '') AS host, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
             o AS (SELECT host, l, count(*) AS n FROM (SELECT host, unnest(list_distinct(list_filter(ls, lambda x: trim(x, ' ') <> ''))) AS l FROM p) GROUP BY host, l),
             b AS (SELECT o.host, list(o.l) AS boiler FROM o JOIN (SELECT host, count(*) AS pages FROM p GROUP BY host) t USING (host)
                   WHERE n >= 4 AND n > 0.05 * pages GROUP BY o.host),
             c AS (SELECT doc_id, text, ls, list_filter(ls, lambda x: trim(x, ' ') = '' OR NOT list_contains(coalesce(boiler, []), x)) AS rest FROM p LEFT JOIN b USING (host))
        SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(ls) END::BIGINT AS n_lines,
               CASE WHEN text IS NULL THEN 0 ELSE len(ls) - len(rest) END::BIGINT AS n_dropped,
               CASE WHEN text IS NOT NULL THEN sha256(array_to_string(rest, chr(10))) END AS text_sha256
        FROM c""",
    "op12_periodic_runs": r"""
        WITH w0 AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
                           xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) AS h FROM documents),
             w1 AS (SELECT doc_id, words, len(words) AS n, coalesce(h % 10 = 0 AND len(words) > 0, false) AS looped, h // 10 AS g FROM w0),
             w2 AS (SELECT *, CASE WHEN looped THEN g % n END AS a FROM w1), w3 AS (SELECT *, CASE WHEN looped THEN 1 + (n - a) // (3 + g % 8) END AS p FROM w2),
             w AS (SELECT doc_id, n, CASE WHEN looped THEN list_transform(range(n), lambda i: words[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1)::BIGINT]) ELSE words END AS words FROM w3),
             t AS (SELECT doc_id, n, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM w),
             m AS (SELECT x.doc_id, y.i - x.i AS p, x.i FROM t x JOIN t y ON y.doc_id = x.doc_id AND y.word = x.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n WHERE x.n >= 24),
             s AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS part FROM m),
             c AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM s GROUP BY doc_id, p, part HAVING count(*) + p >= greatest(24, 3 * p)),
             r AS (SELECT doc_id, start, length, min(p) AS period FROM c GROUP BY doc_id, start, length),
             q AS (SELECT doc_id, count(*) AS n_runs, min_by(struct_pack(start, length, period), row(-(length / period), start, period)) AS best, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs FROM r GROUP BY doc_id),
             d AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
             k AS (SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS left_ FROM t ANTI JOIN d USING (doc_id, i) GROUP BY doc_id)
        SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli, coalesce(runs, sha256('')) AS runs_sha256, coalesce(left_, sha256('')) AS collapsed_sha256
        FROM w LEFT JOIN q USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op13_hard_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.vec_id AS anchor_id, a.label AS al, b.vec_id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
             p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE al = label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
             n AS (SELECT p.*, vec_id AS negative_id, score AS negative_score FROM p JOIN s USING (anchor_id) WHERE al <> label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
        SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, negative_id, positive_score, negative_score FROM n
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) QUALIFY row_number() OVER w <= 10""",
}
