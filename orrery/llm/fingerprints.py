"""Document fingerprints by winnowing, with native functions only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, Window as W

K = 5  # tokens of a gram
WINDOW = 8  # grams of a window, a power of two
PIECE = 8  # characters of a token at most
POS_BITS = 28  # of a packed gram; they hold its place counted from the end
BUCKET_BYTES = 32 << 20
MOST_BUCKETS = 1 << 16
NO_ID = -(1 << 63)


def winnow(df: DataFrame, text_col: str, out: str, window: int = WINDOW) -> DataFrame:
    """``df`` with column ``out``: the grams that winnowing keeps, in text order.

    Tokens are runs of up to ``PIECE`` characters other than ASCII white space.
    The hash of a gram of ``K`` tokens combines those of two halves that
    neighbouring grams share, as a rolling hash shares its sums.  A gram is
    packed into one long, hash first, then its place from the end, so the least
    long of a window is the least hash and, among equal ones, the rightmost.
    Window minima are again combined by halves.  Any ``window + K - 1`` tokens
    that two texts share give both a common gram, with its place.

    Null counts as empty and has no grams; a text of fewer than ``K`` tokens has
    one gram of all tokens.  Columns starting with ``_w`` are replaced.
    """
    def halves(a: str, step: int, f) -> Column:
        n = F.size(a) - step
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + step), n), f)

    hashed = lambda x, y: F.xxhash64(x, y)
    tokens = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0))
    df = df.withColumn("_w1", F.transform(tokens, lambda x: F.xxhash64(x)))
    n, none = F.size("_w1"), F.array().cast("array<bigint>")
    df = df.withColumn("_w2", F.when(n >= K, halves("_w1", 1, hashed)))
    df = df.withColumn("_w4", F.when(n >= K, halves("_w2", 2, hashed)))
    grams = F.zip_with("_w4", F.slice("_w1", F.lit(K), n - (K - 1)), hashed)
    df = df.withColumn("_wg", F.when(n >= K, grams).when(n > 0, F.array(F.xxhash64("_w1"))).otherwise(none))
    last = F.lit((1 << POS_BITS) - 1)
    df = df.withColumn("_wm", F.transform("_wg", lambda h, i: F.shiftleft(F.shiftrightunsigned(h, POS_BITS + 1), POS_BITS).bitwiseOR(last - i)))
    step = 1
    while step < window:
        df = df.withColumn("_wm", F.when(F.size("_wm") > step, halves("_wm", step, lambda x, y: F.least(x, y))).when(n > 0, F.array(F.array_min("_wm"))).otherwise(none))
        step *= 2
    return df.withColumn(out, F.array_distinct("_wm")).drop("_w1", "_w2", "_w4", "_wg", "_wm")


def places(packed: Column) -> Column:
    """(hash, place) of each kept gram; places count tokens from 0."""
    last = (1 << POS_BITS) - 1
    return F.transform(packed, lambda x: F.struct(F.shiftrightunsigned(x, POS_BITS).alias("hash"), (F.lit(last) - x.bitwiseAND(F.lit(last))).cast("int").alias("place")))


def hashes(packed: Column) -> Column:
    return F.array_distinct(F.transform(packed, lambda x: F.shiftrightunsigned(x, POS_BITS)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def _with_bucket(df: DataFrame, key: str, bounds: list[int], out: str) -> DataFrame:
    """``df`` with ``out``: how many of the sorted ``bounds`` are at most ``key``, by binary
    search, one projection for each step."""
    df = df.withColumn(out, F.lit(0))
    if not bounds:
        return df
    table = F.lit(np.array(bounds, dtype=np.int64))  # one literal, however many bounds
    step = 1 << (len(bounds).bit_length() - 1)
    while step:
        there = F.col(out) + step
        df = df.withColumn(out, F.when((there <= len(bounds)) & (F.get(table, there - 1) <= F.col(key)), there).otherwise(F.col(out)))
        step //= 2
    return df


def with_next(docs: DataFrame, carried: list[str], *, prepare=lambda df: df, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with next_<c> for each carried column: the value of the next
    document in descending id, the first one's after the last.  ``prepare`` adds
    columns to rows of ``docs``; the copies are chosen before it does.

    Ids are cut at quantiles into buckets that grow in number with the bytes of
    text; each is ordered on its own, and gets a copy of the row that follows its
    last.  So every text moves once and no task orders more than a bucket.  Null
    ids, and texts that are no whole numbers, come last; rows with equal ids are
    ordered by a hash of the text.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("__k", F.coalesce(F.col(id_col).try_cast("long"), F.lit(NO_ID))).withColumn("__tie", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    plain = docs.select("__k", "__tie", text_col)
    total = plain.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    count = min(MOST_BUCKETS, max(total // BUCKET_BYTES, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = plain.agg(F.percentile_approx("__k", [i / count for i in range(1, count)], 10 * count)).first()[0] or []
    bounds = sorted(set(cuts))
    heads = _with_bucket(plain.select("__k", "__tie"), "__k", bounds, "b").groupBy("b").agg(F.max(F.struct("__k", "__tie")).alias("h")).collect()  # a row for each bucket
    order = sorted(heads, key=lambda r: r["b"])
    steps = [(r["h"]["__k"], r["h"]["__tie"], order[(i + 1) % len(order)]["b"]) for i, r in enumerate(order)]
    follows = spark.createDataFrame(steps, "__k long, __tie long, __b int")
    rows = prepare(_with_bucket(docs, "__k", bounds, "__b").withColumn("__copy", F.lit(False)))
    copies = prepare(docs.join(F.broadcast(follows), ["__k", "__tie"]).withColumn("__copy", F.lit(True)))
    w = W.partitionBy("__b").orderBy("__copy", F.desc("__k"), F.desc("__tie"))
    both = rows.unionByName(copies.select(*rows.columns))
    for c in carried:
        both = both.withColumn(f"next_{c}", F.lead(c).over(w))
    return both.where(~F.col("__copy")).drop("__b", "__k", "__tie", "__copy")


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited, grams, edited_grams, near_edited, near_next.

    The edited text has the second half of a text, rounded down, replaced by the
    first as many characters of the next document's.  Likeness is the Jaccard
    similarity of the kept hashes, 1 for two empty sets.  Null texts count as
    empty.  A single document is its own next one; an empty table gives an empty
    result.  Other columns are not read.
    """
    flat = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    both = with_next(flat, ["text", "grams"], prepare=lambda df: winnow(df, "text", "grams"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    both = both.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    both = winnow(both.drop("text", "next_text"), "edited", "edited_grams")
    both = both.withColumn("_a", hashes(F.col("grams")))
    return both.select("doc_id", "n_chars", "edited", "grams", "edited_grams", likeness(F.col("_a"), hashes(F.col("edited_grams"))).alias("near_edited"), likeness(F.col("_a"), hashes(F.col("next_grams"))).alias("near_next"))
