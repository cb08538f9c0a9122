"""Readers and sinks for the formats that evidence, concepts and predictions come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

# Schemas of the tables that the operators expect.
CONCEPTS = "tag string, type string, standard_label string, documentation string, references array<string>, retrieval_text string"
FACTS = "context_id string, source_sample_idx bigint, split string, input_type string, entity string, numeric_entity string, value string, datatype string, type string, row_context string, column_context string, sentence_context string, original_context string, ground_truth_concepts array<string>"

# Names of columns that may hold a prediction or identify its row, in order of preference.
PREDICTION_COLUMNS = ("prediction", "pred", "response", "generated_text", "output", "answer")
ID_COLUMNS = ("source_sample_idx", "context_id")


def jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped, broken ones give null columns."""
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return rows if limit is None else rows.limit(limit)


def concepts(spark: SparkSession, path: str, prefix: str = "us-gaap:") -> DataFrame:
    """The taxonomy: prefixed tags with their raw form, texts never null, retrieval text falls back to the label, then to the raw tag."""
    from orrery.functions.text import squeeze, with_prefix, without_prefix

    rows = jsonl(spark, path, CONCEPTS).where("tag is not null")
    raw = without_prefix(F.col("tag"), prefix)
    label = F.coalesce(F.nullif(squeeze(F.col("standard_label")), F.lit("")), raw)
    return rows.select(with_prefix(F.col("tag"), prefix).alias("tag"), raw.alias("raw_tag"), squeeze(F.col("type")).alias("entity_type"), label.alias("standard_label"), squeeze(F.col("documentation")).alias("documentation"), F.coalesce("references", F.array().cast("array<string>")).alias("references"), F.coalesce(F.nullif(squeeze(F.col("retrieval_text")), F.lit("")), label).alias("retrieval_text"))


def facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts to ground, their entity and type read from the first alias that is there."""
    rows = jsonl(spark, path, FACTS)
    return rows.select("context_id", "source_sample_idx", "split", "input_type", F.coalesce("numeric_entity", "entity", "value").alias("entity"), F.coalesce("datatype", "type").alias("entity_type"), "row_context", "column_context", "sentence_context", "original_context", F.coalesce("ground_truth_concepts", F.array().cast("array<string>")).alias("gold_tags"))


def csv_examples(spark: SparkSession, path: str) -> DataFrame:
    """Examples with a header; empty and "nan" answers are null."""
    rows = spark.read.schema("context string, category string, entity string, entity_type string, answer string").csv(path, header=True, multiLine=True, escape='"')
    return rows.withColumn("answer", F.when(~F.lower(F.trim("answer")).isin("", "nan"), F.col("answer")))


def tsv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Tab-separated rows of a fixed number of fields; the read fails on any other."""
    fields = F.split("value", "\t", -1)
    rows = spark.read.text(path).where(F.trim("value") != "")
    checked = F.when(F.size(fields) == len(names), fields).otherwise(F.raise_error(F.concat(F.lit(f"not {len(names)} fields: "), F.col("value"))))
    return rows.select(checked.alias("f")).select(*[F.col("f")[i].alias(n) for i, n in enumerate(names)])


def fixed_width(spark: SparkSession, path: str, widths: dict[str, int | None]) -> DataFrame:
    """Columns by their width; None takes the rest of the line."""
    at, out = 1, []
    for name, width in widths.items():
        n = F.length("value") if width is None else F.lit(width)
        out.append(F.trim(F.substring(F.col("value"), F.lit(at), n)).alias(name))
        at += width or 0
    return spark.read.text(path).where(F.trim("value") != "").select(*out)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions from JSON lines, JSON lists, CSV or Parquet by the file's suffix."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "jsonl":
        return spark.read.json(path)
    if suffix == "json":
        rows = spark.read.option("multiLine", True).json(path)
        return rows.select(F.explode("predictions").alias("p")).select("p.*") if "predictions" in rows.columns else rows
    if suffix == "csv":
        return spark.read.csv(path, header=True, multiLine=True, escape='"')
    if suffix == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for .{suffix}")


def match_predictions(samples: DataFrame, found: DataFrame, position: str | None = None) -> DataFrame:
    """``samples`` with column prediction, joined on the first id column that both have.

    Raises where a sample has no prediction.  Without a common id both sides are
    joined on ``position``, a column that numbers their rows; rows of a table
    have no order of their own, so positions are never guessed.
    """
    name = next((c for c in PREDICTION_COLUMNS if c in found.columns), None)
    key = next((c for c in (*ID_COLUMNS, position) if c in found.columns and c in samples.columns), None)
    if name is None or key is None:
        raise ValueError(f"no prediction or id column among {found.columns}")
    rows = samples.join(found.select(F.col(key), F.col(name).alias("prediction"), F.lit(True).alias("_found")).dropDuplicates([key]), key, "left")
    if not (lost := rows.where(F.col("_found").isNull())).isEmpty():
        raise ValueError(f"no prediction for {key} {lost.first()[key]}")
    return rows.drop("_found")


def remaining(samples: DataFrame, done: DataFrame, key: str, *, failed: str | None = None, settings: dict | None = None) -> DataFrame:
    """What a resumed run still has to do: samples without a row in ``done``.

    Rows whose column ``failed`` is true are to be done again.  Raises if a row was
    made under other ``settings`` (column: value), such as a mode or a number of results.
    """
    for name, value in (settings or {}).items():
        if not (other := done.where(~F.col(name).eqNullSafe(F.lit(value)))).isEmpty():
            raise ValueError(f"cannot resume: {name} was {other.first()[name]!r}, now {value!r}")
    if failed:
        done = done.where(~F.coalesce(F.col(failed), F.lit(False)))
    return samples.join(done.select(key).distinct(), key, "left_anti")


def rows_by_key(rows: DataFrame, key: str, keys: DataFrame, at_once: int = 1000) -> DataFrame:
    """Rows whose ``key`` is in the table ``keys``.  Up to ``at_once`` keys become a
    filter that the Parquet reader skips row groups by; more are a semi join."""
    some = [r[0] for r in keys.select(key).distinct().limit(at_once + 1).collect()]
    if len(some) <= at_once:
        return rows.where(F.col(key).isin([k for k in some if k is not None]))
    return rows.join(keys.select(key), key, "left_semi")


def save_dataset(splits: dict[str, DataFrame], path: str) -> None:
    """Named splits as Parquet folders beside each other."""
    for name, rows in splits.items():
        rows.write.mode("overwrite").parquet(f"{path}/split={name}")


def load_dataset(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A split that ``save_dataset`` wrote, or all of them with column split."""
    return spark.read.parquet(path if split is None else f"{path}/split={split}")


def write_report(tables: list[DataFrame], path: str) -> None:
    """Tables under one header as a single CSV file; reports are small."""
    union_report(tables).coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def xml_elements(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Elements of an XML file as rows."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def linked_labels(locs: DataFrame, arcs: DataFrame, resources: DataFrame, role: str) -> DataFrame:
    """tag, label of a label linkbase: locators (label, href, pos), arcs (from, to) and
    resources (label, role, text, pos) joined; of several labels the first in the file."""
    tag = F.regexp_extract("href", "#(?:[^_]*_)?(.*)$", 1)
    rows = locs.select(F.col("label").alias("from"), tag.alias("tag"), F.col("pos").alias("loc_pos")).join(arcs, "from").join(resources.where(F.col("role") == role).select(F.col("label").alias("to"), "text", "pos"), "to")
    first = F.row_number().over(W.partitionBy("tag").orderBy("pos", "loc_pos"))
    return rows.withColumn("_n", first).where("_n = 1").select("tag", F.col("text").alias("label"))


def reference_text(parts: dict[str, Column]) -> Column:
    """One line for a reference: topic-subtopic-section-paragraph of a codification, else the end of its address, else all parts."""
    asc = F.concat(F.lit("ASC "), F.concat_ws("-", parts["topic"], parts["subtopic"], parts["section"], parts["paragraph"]))
    tail = F.regexp_extract(parts["uri"], "([^/]+)/?$", 1)
    return F.when(parts["topic"].isNotNull() & parts["subtopic"].isNotNull(), asc).when(F.coalesce(tail, F.lit("")) != "", tail).otherwise(F.concat_ws(" ", *parts.values()))


def linked_references(locs: DataFrame, arcs: DataFrame, resources: DataFrame) -> DataFrame:
    """tag, references: the distinct references of each tag in file order."""
    from orrery.operators.prep import ordered_unique

    tag = F.regexp_extract("href", "#(?:[^_]*_)?(.*)$", 1)
    rows = locs.select(F.col("label").alias("from"), tag.alias("tag")).join(arcs, "from").join(resources.select(F.col("label").alias("to"), "reference", "pos"), "to")
    return rows.groupBy("tag").agg(ordered_unique("pos", "reference").alias("references"))


def append_log(rows: DataFrame, path: str) -> None:
    """Appends to a trace of JSON lines; Spark's commit makes each append whole."""
    rows.write.mode("append").json(path)


def union_report(tables: list[DataFrame]) -> DataFrame:
    """Tables with different columns under one header; what a table lacks is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def cached_vectors(spark: SparkSession, path: str, signature: str, build) -> DataFrame:
    """Vectors written under the signature of the model, prefix and tags that made them; built where that is missing."""
    place = f"{path}/signature={signature}"
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file):
        build().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)
