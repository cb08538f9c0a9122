"""Controlled vocabularies: categories of values and concepts, verdicts and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from orrery.functions.text import label_tokens, squeeze
from orrery.operators.passages import phrase_candidates
from orrery.operators.retrieval import ranked


def vocabulary(spark, entries: dict[str, dict[str, list[str]]]) -> DataFrame:
    """dimension, category, phrase, phrase_tokens from nested dictionaries; as small as the vocabulary that is written down."""
    rows = [(d, c, p.lower()) for d, cs in entries.items() for c, ps in cs.items() for p in ps]
    return spark.createDataFrame(rows, "dimension string, category string, phrase string").withColumn("phrase_tokens", F.array_distinct(label_tokens(F.col("phrase"))))


def spellings(name: Column) -> Column:
    """Ways to write a hyphenated name: as it is, with spaces, with slashes; without repeats."""
    return F.array_distinct(F.array(name, F.replace(name, F.lit("-"), F.lit(" ")), F.replace(name, F.lit("-"), F.lit("/"))))


def hierarchy_vocabulary(nodes: DataFrame, fixed: dict[str, dict[str, list[str]]], aliases: dict[str, str]) -> DataFrame:
    """dimension, category, phrase, phrase_tokens, n from the nodes of a hierarchy and what is written down.

    ``nodes``: dimension, category, phrase, spelt (whether the phrase is a name with several
    spellings).  Phrases are squeezed and in lower case; nodes without a category or
    a phrase say nothing; ``aliases`` put categories under another name; n counts the nodes of a phrase.
    Phrases are counted before they are spelt, so a hot category sends each phrase once.
    """
    put = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None
    category = F.coalesce(F.try_element_at(put, F.col("category")), F.col("category")) if aliases else F.col("category")
    plain = nodes.select("dimension", F.nullif(squeeze(category), F.lit("")).alias("category"), F.nullif(F.lower(squeeze(F.col("phrase"))), F.lit("")).alias("phrase"), "spelt")
    counted = plain.where("category is not null and phrase is not null").groupBy("dimension", "category", "phrase", "spelt").agg(F.count("*").alias("n"))
    spelt = counted.select("dimension", "category", F.explode(F.when(F.col("spelt"), spellings(F.col("phrase"))).otherwise(F.array("phrase"))).alias("phrase"), "n")
    written = [(d, c, p.lower(), 0) for d, cs in fixed.items() for c, ps in cs.items() for p in ps]
    own = nodes.sparkSession.createDataFrame(written, "dimension string, category string, phrase string, n long")
    every = spelt.unionByName(own).groupBy("dimension", "category", "phrase").agg(F.sum("n").alias("n"))
    return every.withColumn("phrase_tokens", F.array_distinct(label_tokens(F.col("phrase"))))


FEW_PHRASES = 2_000  # that are sent to every task


def phrase_categories(texts: DataFrame, vocab: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, dimension, categories: a category matches where one of its phrases is
    part of the lower-case text, or all the phrase's tokens are among the text's.

    A vocabulary of at most ``FEW_PHRASES`` is sent to the texts; a larger one meets
    them through an index of rare tokens and characters, with the same result.  Do this
    once for each distinct text, not for each fact that shows it; ``key`` names a row.
    """
    rows = texts.select(F.col(key).alias("key"), F.lower(text).alias("text"), F.array_distinct(label_tokens(F.col(text))).alias("tokens"))
    hit = F.contains("text", "phrase") | ((F.size("phrase_tokens") > 0) & (F.size(F.array_except("phrase_tokens", "tokens")) == 0))
    if vocab.count() <= FEW_PHRASES:
        met = rows.join(F.broadcast(vocab), hit)
    else:
        phrases = vocab.select("phrase", "phrase_tokens").distinct()
        pairs = phrase_candidates(rows, phrases).join(phrases, "phrase")
        met = pairs.join(rows, "key").where(hit).select("key", "phrase").join(vocab, "phrase")
    return met.groupBy(F.col("key").alias(key), "dimension").agg(F.sort_array(F.collect_set("category")).alias("categories"))


def metadata(aliases: dict[str, list[str]], columns: list[str]) -> dict[str, Column]:
    """For each name the first of its aliases among ``columns`` that holds more than white space, squeezed; else null."""
    def first(names: list[str]) -> Column:
        there = [F.nullif(squeeze(F.col(c).cast("string")), F.lit("")) for c in names if c in columns]
        return F.coalesce(*there) if there else F.lit(None).cast("string")

    return {name: first(names) for name, names in aliases.items()}


def dimension_verdict(hyp_categories: Column, cand_categories: Column, hyp_tokens: Column, cand_tokens: Column) -> Column:
    """(verdict, confidence): by categories where either side has any, else by the share of
    the hypothesis' tokens that the candidate has; null without either."""
    share = F.size(F.array_intersect(hyp_tokens, cand_tokens)) / F.size(F.array_distinct(hyp_tokens))
    ruling = lambda v, c: F.struct(F.lit(v).alias("verdict") if isinstance(v, bool) else v.alias("verdict"), (F.lit(c) if isinstance(c, float) else c).alias("confidence"))
    h, c = F.coalesce(F.size(hyp_categories), F.lit(0)), F.coalesce(F.size(cand_categories), F.lit(0))
    return (
        F.when((h > 0) & (c == 0), ruling(False, 0.35))
        .when((h > 0) | (c > 0), ruling(F.coalesce(F.arrays_overlap(hyp_categories, cand_categories), F.lit(False)), 0.85))
        .when((F.size(hyp_tokens) > 0), ruling(share >= 0.5, F.greatest(F.lit(0.2), F.least(F.lit(0.75), share))))
    )


def feedback(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """``by``, dimension, support, state, confidence: the share of rulings that support,
    "supported" from 0.6, "contradicted" up to 0.25, else "unresolved"."""
    v = F.col("verdict").cast("double")
    rows = verdicts.groupBy(*by, "dimension").agg(F.avg(v).alias("support"))
    state = F.when(F.col("support") >= 0.6, "supported").when(F.col("support") <= 0.25, "contradicted").otherwise("unresolved")
    return rows.withColumn("state", state).withColumn("confidence", F.coalesce(F.abs(F.col("support") - 0.5) * 2, F.lit(0.0)))


def merge_feedback(symbolic: DataFrame, model: DataFrame, by: list[str]) -> DataFrame:
    """The symbolic state unless it is unresolved; where both rule and differ, half the confidence."""
    keys = [*by, "dimension"]
    s = symbolic.select(*keys, F.col("state").alias("s"), F.col("confidence").alias("sc"))
    m = model.select(*keys, F.col("state").alias("m"), F.col("confidence").alias("mc"))
    rows = s.join(m, keys, "full_outer").withColumn("s", F.coalesce("s", F.lit("unresolved"))).withColumn("m", F.coalesce("m", F.lit("unresolved")))
    own = F.col("s") != "unresolved"
    differ = own & (F.col("m") != "unresolved") & (F.col("s") != F.col("m"))
    confidence = F.coalesce(F.when(own, F.col("sc")).otherwise(F.col("mc")), F.lit(0.0))
    return rows.select(*keys, F.when(own, F.col("s")).otherwise(F.col("m")).alias("state"), F.when(differ, confidence / 2).otherwise(confidence).alias("confidence"))


def cluster_representatives(ranking: DataFrame, signature: str, m: int, depth: int) -> DataFrame:
    """``m`` candidates of each fact: the first of each signature among the first
    max(depth, m), in rank order, then the others by rank."""
    head = ranking.where(F.col("rank") <= max(depth, m))
    first = F.row_number().over(W.partitionBy("fact", signature).orderBy("rank")) == 1
    rows = head.withColumn("is_rep", first).withColumnRenamed("rank", "old_rank")
    return ranked(rows, ["fact"], [F.desc("is_rep"), F.col("old_rank")], m)


def compatible(checks: list[Column]) -> Column:
    """All checks pass; a check that cannot be made (null) passes."""
    out = F.lit(True)
    for c in checks:
        out = out & F.coalesce(c, F.lit(True))
    return out


def tightest_level(rows: DataFrame, by: list[str], levels: list[Column]) -> DataFrame:
    """Rows of the first level, from strict to loose, that has any within ``by``."""
    level = F.lit(None).cast("int")
    for i in reversed(range(len(levels))):
        level = F.when(levels[i], i).otherwise(level)
    out = rows.withColumn("level", level).where(F.col("level").isNotNull())
    return out.withColumn("_tight", F.min("level").over(W.partitionBy(*by))).where(F.col("level") == F.col("_tight")).drop("_tight")
