"""Boilerplate lines by their frequency relative to the site."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orrery.session import staged

#: Bytes up to which the boilerplate of all hosts is broadcast.
BROADCAST_BYTES = 8 << 20
SALTS = 64


def boilerplate(docs: DataFrame, *, host_col: str, text_col: str = "text", ratio: float = 0.05, min_pages: int = 4, decay: float = 1.0) -> DataFrame:
    """host, lines: per host the hashes of lines that stand in more than
    ``ratio`` of the host's pages, and in ``min_pages`` at least.

    A line counts once for each page.  A host has fewer than (mean lines of a
    page) / ``ratio`` such lines, whatever its number of pages.

    With ``decay`` under 1, the ratio falls by that factor with every word after a
    line's first, as chance repeats do.  What counts for the lower ratio is not
    pages but different surroundings, the line before and the line after, so that
    the text of copied pages is not taken for boilerplate.
    """
    page = docs.select(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("lines"))
    pages = page.groupBy("host").agg(F.count("*").alias("pages"))
    if decay < 1:
        return _by_length(page, pages, ratio, min_pages, decay)
    line = page.select("host", F.explode(F.array_distinct(F.transform(F.filter("lines", lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x)))).alias("line"))
    often = line.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return (
        often.join(pages, "host").where(F.col("n") > ratio * F.col("pages"))
        .groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("boiler"))
    )


def _by_length(page: DataFrame, pages: DataFrame, ratio: float, min_pages: int, decay: float) -> DataFrame:
    hashed = page.select("host", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")).alias("w"))).alias("all"))
    hashed = hashed.withColumn("hs", F.col("all.h"))
    each = hashed.select("host", "hs", F.explode(F.array_distinct(F.filter("all", lambda x: x["w"] > 0))).alias("x")).withColumn("at", F.array_position("hs", F.col("x.h")).cast("int"))
    line = each.select("host", F.col("x.h").alias("line"), F.col("x.w").alias("w"), F.xxhash64(F.get("hs", F.col("at") - 2), F.get("hs", F.col("at"))).alias("around"))
    often = line.groupBy("host", "line", "around").agg(F.count("*").alias("n"), F.max("w").alias("w")).groupBy("host", "line").agg(F.sum("n").alias("n"), F.count("*").alias("places"), F.max("w").alias("w"))
    needed = F.lit(ratio) * F.col("pages")
    many = (F.col("n") > needed) | ((F.col("places") >= min_pages) & (F.col("places") > needed * F.pow(F.lit(decay), F.col("w") - 1)))
    return often.where(F.col("n") >= min_pages).join(pages, "host").where(many).groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("boiler"))


def drop_boilerplate(docs: DataFrame, *, host_col: str = "source", text_col: str = "text", ratio: float = 0.05, min_pages: int = 4, min_left: float = 0.0, decay: float = 1.0, keep_copies: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, plus n_lines and
    n_dropped.

    A null host is a host of its own, together with the empty one.  Null texts
    stay null and blank lines stay.  Repeated rows count as pages of their own.
    With ``min_left`` over 0, a page that would keep less than that share of its
    characters is a copy rather than a page with a frame, and stays whole for a
    later document-level pass.  With ``keep_copies`` only a page that would keep no
    line but blank ones stays whole.  The order of the other lines stays.  Columns
    n_lines and n_dropped replace input columns of those names.

    The boilerplate of all hosts is broadcast if it measures at most
    ``BROADCAST_BYTES``; else hosts meet in a join salted on both sides.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    spark = docs.sparkSession
    found = staged(boilerplate(docs, host_col=host_col, text_col=text_col, ratio=ratio, min_pages=min_pages, decay=decay), "boilerplate")
    size = found.agg(F.sum(F.size("boiler") * 8 + F.octet_length("host") + 32)).first()[0] or 0
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"))
    if size <= BROADCAST_BYTES:
        met = wide.join(F.broadcast(found), "host", "left")
    else:
        salted = wide.withColumn("salt", F.pmod(F.xxhash64(f"row.{text_col}"), F.lit(SALTS)))
        met = salted.join(found.join(spark.range(SALTS).withColumnRenamed("id", "salt")), ["host", "salt"], "left")
    text = F.col(f"row.{text_col}")
    lines = F.split(text, "\n")
    left = F.when(F.col("boiler").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains("boiler", F.xxhash64(x)) | (F.trim(x) == "")))
    cut = met.withColumn("lines", lines).withColumn("left", left).withColumn("rest", F.concat_ws("\n", "left"))
    if min_left > 0:
        cut = cut.withColumn("left", F.when(F.char_length("rest") < min_left * F.char_length(text), F.col("lines")).otherwise(F.col("left"))).withColumn("rest", F.concat_ws("\n", "left"))
    if keep_copies:
        cut = cut.withColumn("left", F.when(F.exists("left", lambda x: F.trim(x) != ""), F.col("left")).otherwise(F.col("lines"))).withColumn("rest", F.concat_ws("\n", "left"))
    out = [F.when(text.isNotNull(), F.col("rest")).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names]
    count = F.coalesce(F.size("lines"), F.lit(0))
    return cut.select(*out, F.when(text.isNull(), 0).otherwise(count).cast("long").alias("n_lines"), F.when(text.isNull(), 0).otherwise(F.size("lines") - F.size("left")).cast("long").alias("n_dropped"))
