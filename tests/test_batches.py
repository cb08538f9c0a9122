"""Whole pages reach Python in batches that are bounded by bytes."""

from pyspark.sql import functions as F

from orrery import session
from orrery.operators import prep


def test_pages_come_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(session, "BATCH_BYTES", 1 << 20)
    names = [f"spark.sql.execution.arrow.maxBytesPer{w}Batch" for w in ("", "Output")]
    before = {n: spark.conf.get(n) for n in names}
    try:
        pages = spark.range(300, numPartitions=1).select("id", F.repeat(F.lit("<p>x</p>"), 4000).alias("html"))
        out = prep.html_text(pages, "id", "html")
        assert all(int(spark.conf.get(n).rstrip("b")) == 1 << 20 for n in names)
        assert out.agg(F.count("*"), F.min(F.length("text"))).first() == (300, 7999)
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
