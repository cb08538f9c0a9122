"""Exact duplicates by a tree merge of digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orrery.session import staged

SPACE = " \t\n\x0b\f\r"
KEY = ["digest", "norm_bytes", "check"]


def _merge(rows: DataFrame, run) -> DataFrame:
    """One round: the runs that share ``run`` are merged, and for each verified
    digest the row that stays and the number of rows go on."""
    return rows.groupBy(run.cast("int").alias("run"), *KEY).agg(F.sum("n").alias("n"), F.min("best").alias("best"))


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", runs: int = 256, fan_in: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without ASCII white space.  The row
    with the most code points, then the smallest id stays.  Every document
    belongs to one of ``runs`` runs, each reduced to one row per digest; rounds
    then merge ``fan_in`` neighbouring runs at a time until one is left.  A
    digest meets itself only with equal length and equal second hash.  No task
    gets more than ``fan_in`` rows of a digest in a round, and winners go back
    down to (run, digest), so a hot text stays spread over all runs.

    Null texts count as empty, so null, empty and blank texts form one group.
    Null ids come last among ties; rows that repeat an id and a text, or only
    swap its white space, share one flag, other rows of the id have their own.  An empty table gives an empty result.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.translate(text, SPACE, "")
    flat = docs.select(F.col(id_col).alias("doc_id"), F.char_length(text).alias("n_chars"), bare.alias("bare"))
    leaf = staged(
        flat.select(
            "doc_id",
            "n_chars",
            F.pmod(F.xxhash64("doc_id", "n_chars", F.spark_partition_id()), F.lit(runs)).cast("int").alias("run"),
            F.unhex(F.sha2("bare", 256)).alias("digest"),
            F.octet_length("bare").alias("norm_bytes"),
            F.xxhash64("bare").alias("check"),
        ),
        "digests",
    )
    best = F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"))
    base = leaf.withColumn("n", F.lit(1).cast("long")).withColumn("best", best)
    first = merged = _merge(base, F.col("run"))
    left = runs
    while left > 1:
        merged = _merge(merged, F.floor(F.col("run") / fan_in))
        left = -(-left // fan_in)
    won = merged.select(*KEY, F.col("n").alias("group_size"), F.col("best.doc_id").alias("keep_id"), (-F.col("best.shorter")).alias("most"))
    down = first.select("run", *KEY).join(won, KEY)
    return leaf.join(down, ["run", *KEY]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("most"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
