"""Rankings within a fact are dealt once: what fuses and joins them adds no shuffle of rows."""

import pytest

from orrery.session import dealt

SF = "/root/testdata/sf0.001"


def shuffles(df) -> int:
    """Exchanges of an unadapted plan without broadcasts, without those that end a count of a few rows."""
    spark = df.sparkSession
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    return plan.count("Exchange hashpartitioning") - plan.count("REPARTITION_BY_NUM")


def test_parts_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr("orrery.session.PART_ROWS", 10)
    assert dealt(spark.range(95), "id").rdd.getNumPartitions() == 10
    assert dealt(spark.range(5), "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name, most", [("config_ablation", 2), ("abstention_policies", 0), ("strict_denominator_score", 0), ("hybrid_agree", 1), ("variance_weighted_consensus", 0), ("arm_fallback_scores", 1), ("coverage_ceiling", 0), ("marginal_coverage", 1)])
def test_no_shuffle_beside_the_first(spark, name, most):
    import __spark_entry__ as entry

    assert shuffles(entry.queries()[name](spark, SF)) <= most


def test_equal_names_are_searched_once(spark, monkeypatch):
    """Self-retrieval asks each set of words of a brand once, however many parts share it."""
    import __spark_entry__ as entry
    from orrery.plans import retrieval

    asked, search = [], retrieval.topk
    monkeypatch.setattr(retrieval, "topk", lambda q, c, k: asked.append((q.count(), q.select("scope", "tokens").distinct().count())) or search(q, c, k))
    parts = spark.read.parquet(f"{SF}/part.parquet")
    assert entry.queries()["self_retrieval_rate"](spark, SF).selectExpr("sum(n)").first()[0] == parts.count()
    assert len(asked) == 1 and asked[0][0] == asked[0][1]
