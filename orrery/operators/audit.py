"""Audits: verdicts against truth, revisions, relocated evidence, samples, drift of settings, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from orrery.functions.text import squeeze
from orrery.operators.stats import draw, placed
from orrery.operators.symbolic import feedback, merge_feedback


def verdict_truth(verdicts: DataFrame, gold: DataFrame) -> DataFrame:
    """fact, hyp, dimension, state, disagrees: what all rulings of a hypothesis made of a
    dimension, beside whether the gold candidate's own ruling contradicts it.  Dimensions on
    which the gold candidate has no ruling are left out."""
    truth = verdicts.join(gold, "fact").where((F.col("tag") == F.col("gold")) & F.col("verdict").isNotNull())
    truth = truth.select("fact", "hyp", "dimension", (~F.col("verdict")).alias("disagrees"))
    return feedback(verdicts, ["fact", "hyp"]).join(truth, ["fact", "hyp", "dimension"]).select("fact", "hyp", "dimension", "state", "disagrees")


def verdict_layers(symbolic: DataFrame, model: DataFrame, truth: DataFrame) -> DataFrame:
    """fact, hyp, dimension, layer, state, disagrees: what symbolic rulings, a model's, and both
    merged made of a dimension, beside the truth (fact, hyp, dimension, disagrees).

    A layer without rulings on a dimension leaves it unresolved, so all layers have
    the same rows; dimensions without a truth are left out.
    """
    by, keys = ["fact", "hyp"], ["fact", "hyp", "dimension"]
    own, told = feedback(symbolic, by), feedback(model, by)
    layers = [("symbolic", own), ("model", told), ("merged", merge_feedback(own, told, by))]
    rows = None
    for name, states in layers:
        one = truth.join(states.select(*keys, "state"), keys, "left").select(*keys, F.lit(name).alias("layer"), F.coalesce("state", F.lit("unresolved")).alias("state"), "disagrees")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def fired_rates(layers: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and how often contradictions and support were ruled and right, with precision and recall of contradictions; empty denominators give 0."""
    count = lambda c: F.count(F.when(c, 1))
    minus, plus, wrong = F.col("state") == "contradicted", F.col("state") == "supported", F.col("disagrees")
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return layers.groupBy(*by).agg(
        F.count("*").alias("n"), count(wrong).alias("disagree"), count(minus).alias("fired_minus"), count(minus & wrong).alias("true_minus"), count(plus).alias("fired_plus"), count(plus & ~wrong).alias("true_plus"),
        share(count(minus & wrong), count(minus)).alias("precision_minus"), share(count(minus & wrong), count(wrong)).alias("recall_minus"), share(count(minus | plus), F.count("*")).alias("ruled"),
    )


def closeness(tokens: Column, gold: Column) -> Column:
    """The share of a value's distinct tokens that the gold has; null where either has none."""
    n = F.size(F.array_distinct(tokens))
    return F.when((n > 0) & (F.size(gold) > 0), F.size(F.array_intersect(tokens, gold)) / n)


def revisions(rounds: DataFrame, by: list[str], order: str) -> DataFrame:
    """``by``, ``order``, before, after, change: the closeness of neighbouring rounds of an
    episode; change is improved, worsened or unchanged.  Rounds without a closeness are left out."""
    w = W.partitionBy(*by).orderBy(order)
    rows = rounds.select(*by, order, F.col("closeness").alias("before"), F.lead("closeness").over(w).alias("after")).where("before is not null and after is not null")
    return rows.withColumn("change", F.when(F.col("after") > F.col("before"), "improved").when(F.col("after") < F.col("before"), "worsened").otherwise("unchanged"))


def random_revisions(events: DataFrame, pool: DataFrame, key: list[str], kind: str, draws: int) -> DataFrame:
    """``events`` with what chance would have done: random_mean, random_improved, random_unchanged, random_worsened.

    ``events``: ``key`` (names a row), ``kind``, gold (tokens), before (a closeness); ``pool``: ``kind``, value (tokens),
    place (an order of its own).  Each event draws ``draws`` values of its kind by a
    hash of its key; shares are of the draws that have a closeness, null without any.
    """
    known = placed(pool.select(kind, "value", "place"), [kind], ["place"], "at").withColumn("at", F.col("at") - 1)
    sizes = known.groupBy(kind).agg(F.count("*").alias("_n"))
    slots = events.select(*key, kind, "gold", "before", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_d")).join(sizes, kind)
    asked = slots.withColumn("at", draw(F.col("_n"), F.col("_d"), *[F.col(c) for c in key]))
    change = closeness(F.col("value"), F.col("gold")) - F.col("before")
    met = asked.join(known.select(kind, "at", "value"), [kind, "at"]).withColumn("_c", change)
    share = lambda c: F.try_divide(F.count(F.when(c, 1)), F.count("_c"))
    c = F.col("_c")
    out = met.groupBy(*key).agg(F.avg("_c").alias("random_mean"), share(c > 0).alias("random_improved"), share(c == 0).alias("random_unchanged"), share(c < 0).alias("random_worsened"))
    return events.join(out, key, "left")


def relocate(rows: DataFrame, selected: str, candidate: str, scope: str) -> DataFrame:
    """``rows`` with found, entity and level: a selected substring counts if the candidate text has it, else the text stands in."""
    some = F.coalesce(F.col(selected), F.lit(""))
    found = (some != "") & F.contains(F.coalesce(F.col(candidate), F.lit("")), some)
    return rows.withColumn("found", found).withColumn("entity", F.when(found, squeeze(F.col(selected))).otherwise(squeeze(F.col(candidate)))).withColumn("level", F.when(found, "exact_substring").otherwise(F.concat(F.lit("fallback_"), F.col(scope))))


def level_rates(rows: DataFrame) -> DataFrame:
    """level, n, rate of relocated rows."""
    n = rows.groupBy("level").agg(F.count("*").alias("n"))
    return n.withColumn("rate", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))))


def drift(expected: DataFrame, declared: DataFrame) -> DataFrame:
    """name, expected, declared of every setting that differs or that only one side has; (name, value) tables."""
    e, d = expected.select("name", F.col("value").alias("expected")), declared.select("name", F.col("value").alias("declared"))
    return e.join(d, "name", "full_outer").where(~F.col("expected").eqNullSafe(F.col("declared")))


def assert_no_drift(expected: dict[str, str], declared: dict[str, str]) -> None:
    """Raises before a run whose declared settings are not the expected ones."""
    bad = [f"{k}: expected {expected.get(k)!r}, declared {declared.get(k)!r}" for k in sorted({*expected, *declared}) if expected.get(k) != declared.get(k)]
    if bad:
        raise ValueError("settings differ: " + "; ".join(bad))


# Limits of a sample's differences from the whole, above which it is flagged, and the weight of each in its score.
SAMPLE_LIMITS = {"kind_delta": 0.08, "class_l1": 0.15, "per_context_delta": 0.35, "concept_delta": 0.60}
SAMPLE_WEIGHTS = {"kind_delta": 1.0, "class_l1": 0.5, "per_context_delta": 0.2, "concept_delta": 0.2}


def _summaries(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    one = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.countDistinct("context").alias("contexts"), F.countDistinct("concept").alias("concepts"),
        F.count(F.when(F.col("kind") == "table", 1)).alias("tables"),
        F.countDistinct(F.when(F.col("kind") == "table", F.col("context"))).alias("table_contexts"), F.countDistinct(F.when(F.col("kind") != "table", F.col("context"))).alias("text_contexts"),
    )
    return one, rows.groupBy(*by, "class").agg(F.count("*").alias("k"))


def sample_quality(rows: DataFrame, chosen: DataFrame, target: int = 0, target_weight: float = 1.0) -> DataFrame:
    """For each attempt how far its sample is from all ``rows``, its score, flags, and
    whether it is the one to take.

    ``rows``: context, kind (table or text), class, concept; ``chosen``: attempt, context.
    The score sums the differences, rounded to six places, by their weights; with ``target``
    also the relative distance of the sample's rows from that number.  Attempts are
    looked at in order: the first whose score is the least so far and that has no flag
    ends the search; without one, the least score is taken, of equals the first.
    """
    sample = rows.join(chosen, "context")
    one, classes = _summaries(sample, ["attempt"])
    whole, whole_classes = _summaries(rows.withColumn("all", F.lit(1)), ["all"])
    ref = whole.select(*[F.col(c).alias(f"r_{c}") for c in ("n", "contexts", "concepts", "tables", "table_contexts", "text_contexts")])
    attempts = one.crossJoin(F.broadcast(ref))  # one row
    names = attempts.select("attempt", "n", "r_n").join(whole_classes.select("class", F.col("k").alias("r_k")), how="cross")  # attempts times classes, both small
    l1 = names.join(classes, ["attempt", "class"], "left").groupBy("attempt").agg(F.sum(F.abs(F.coalesce("k", F.lit(0)) / F.col("n") - F.col("r_k") / F.col("r_n"))).alias("class_l1"))
    relative = lambda a, b: F.coalesce(F.try_divide(F.abs(a - b), b), F.lit(0.0))
    per = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = F.col
    rows = attempts.join(l1, "attempt").select(
        "attempt", "n",
        F.abs(c("tables") / c("n") - c("r_tables") / c("r_n")).alias("kind_delta"), "class_l1",
        F.greatest(relative(per(c("tables"), c("table_contexts")), per(c("r_tables"), c("r_table_contexts"))), relative(per(c("n") - c("tables"), c("text_contexts")), per(c("r_n") - c("r_tables"), c("r_text_contexts")))).alias("per_context_delta"),
        relative(c("concepts") / c("contexts"), c("r_concepts") / c("r_contexts")).alias("concept_delta"),
    )
    rows = rows.withColumns({k: F.round(c(k), 6) for k in SAMPLE_LIMITS})
    flags = F.filter(F.array(*[F.when(c(k) > v, k) for k, v in SAMPLE_LIMITS.items()]), lambda x: x.isNotNull())
    score = sum((w * c(k) for k, w in SAMPLE_WEIGHTS.items()), F.lit(0.0))
    score = score + target_weight * F.abs(c("n") - target) / target if target > 0 else score
    rows = rows.withColumn("flags", F.array_join(flags, ",")).withColumn("score", score)
    before = F.min(F.round("score", 9)).over(W.partitionBy(F.lit(1)).orderBy("attempt").rowsBetween(W.unboundedPreceding, -1))  # a row for each attempt
    rows = rows.withColumn("_least", F.coalesce(F.round("score", 9) < before, F.lit(True)))
    ends = rows.agg(F.coalesce(F.min(F.when(c("_least") & (c("flags") == ""), c("attempt"))), F.max(F.when(c("_least"), c("attempt")))).alias("_best"))  # one row
    return rows.crossJoin(F.broadcast(ends)).withColumn("taken", c("attempt") == c("_best")).drop("_best", "_least")


def indicators(datatype: Column, kind: Column, features: dict[str, Column]) -> dict[str, Column]:
    """Features as doubles: a constant, the kind of input, what the datatype says, and given ones (null counts 0)."""
    low = F.lower(F.coalesce(datatype, F.lit("")))
    says = {"bias": F.lit(True), "is_table": kind == "table", "is_text": kind == "text", "is_monetary": F.contains(low, F.lit("monetary")), "is_shares": F.contains(low, F.lit("share")), "is_percent": F.contains(low, F.lit("percent")) | F.contains(low, F.lit("pure"))}
    return {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in (says | features).items()}
