"""Texts that hold passages or phrases, by an index of what they are looked up by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WORDS = 4  # of the part of a passage that texts are looked up by
CHARACTERS = 3  # of the part of a phrase


def _held(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` as a generator's output: what is used within functions of arrays is then not computed for each element."""
    return rows.select(*[c for c in rows.columns if c != column], F.explode(F.array(column)).alias(column))


def _grams(pieces: Column, first: int) -> Column:
    """Hashes of all runs of ``WORDS`` pieces, from piece ``first`` on."""
    last = F.size(pieces) - WORDS - first
    return F.when(last >= 0, F.transform(F.sequence(F.lit(first), last + first), lambda i: F.xxhash64(F.slice(pieces, i + 1, F.lit(WORDS)))))


def containing(texts: DataFrame, key: str, text: str, passages: DataFrame, passage: str) -> DataFrame:
    """Rows of ``texts`` joined with the ``passages`` that their column ``text`` contains.

    A passage of ``WORDS`` + 2 pieces or more between spaces has inner pieces that stand
    unchanged in every text around it; the first ``WORDS`` of them are hashed and met
    with the hashes of all such runs of the texts.  Hashes travel with the texts' ``key``
    alone; the text itself is fetched once for each passage that met, and compared.
    Shorter passages are compared with every text; null matches nothing.  Rows
    that share a key are each compared.
    """
    keyed = passages.withColumn("_gram", F.when(F.size(F.split(passage, " ")) >= WORDS + 2, F.xxhash64(F.slice(F.split(passage, " "), 2, WORDS))))
    long, short = keyed.where("_gram is not null"), keyed.where(F.col("_gram").isNull() & F.col(passage).isNotNull()).drop("_gram")
    runs = _held(texts.select(key, F.split(text, " ").alias("_pieces")), "_pieces").select(key, F.explode(F.array_distinct(_grams(F.col("_pieces"), 0))).alias("_gram"))
    met = runs.join(long, "_gram").drop("_gram").distinct()
    found = texts.join(met, texts[key].eqNullSafe(met[key])).drop(met[key]).where(F.contains(text, passage))
    if short.isEmpty():
        return found
    return found.unionByName(texts.join(short, F.contains(text, passage)).select(*found.columns))


def _rarest(phrases: DataFrame, held: DataFrame, parts: str, part: str) -> DataFrame:
    """phrase, ``part``: of each phrase's ``parts`` the one that the fewest texts hold (``held``: key, part)."""
    each = phrases.select("phrase", F.explode(parts).alias(part))
    often = held.join(each.select(part).distinct(), part, "left_semi").groupBy(part).agg(F.count("*").alias("_n"))
    # A part that no text holds rules the phrase out, and comes first.
    return each.join(often, part, "left").groupBy("phrase").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), part))[part].alias(part))


def phrase_candidates(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """key, phrase: pairs that hold all those where the text contains the phrase, or all the
    phrase's tokens (at least one) are among the text's.

    ``texts``: key, text (lower case), tokens; ``phrases``: phrase, phrase_tokens.  A phrase is looked
    up by its rarest token, and by its rarest run of ``CHARACTERS`` characters, so no
    text meets a phrase with which it shares neither; only shorter phrases, of which
    there are few, meet all texts.
    """
    words = texts.select("key", F.explode("tokens").alias("token"))
    by_token = words.join(_rarest(phrases, words, "phrase_tokens", "token"), "token").select("key", "phrase")
    runs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(c) - (CHARACTERS - 1)), lambda i: F.substring(c, i, F.lit(CHARACTERS))))
    long = phrases.where(F.char_length("phrase") >= CHARACTERS).withColumn("_runs", runs(F.col("phrase")))
    pieces = _held(texts.select("key", "text"), "text").where(F.char_length("text") >= CHARACTERS).select("key", F.explode(runs(F.col("text"))).alias("run"))
    by_run = pieces.join(_rarest(long, pieces, "_runs", "run"), "run").select("key", "phrase")
    short = texts.select("key", "text").join(phrases.where(F.char_length("phrase") < CHARACTERS).select("phrase"), F.contains("text", "phrase")).select("key", "phrase")
    return by_token.unionByName(by_run).unionByName(short).distinct()
