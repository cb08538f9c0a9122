"""Closed-form expectations of the ranking, agreement and statistics operators."""

import json

import pytest
from pyspark.sql import functions as F

from orrery.functions import text as tx
from orrery.operators import fusion as fu, metrics as me, modelio, prep, rerank as rr, sequence as sq, stats as st, symbolic as sy
from orrery.operators.dense import cosine_topk
from orrery.operators.retrieval import bm25, minmax, padded_topk, scope_or_all
from orrery.sources import readers
from orrery.streaming import rewards


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.fixture
def lists(spark):
    return spark.createDataFrame([(1, 1, "a", 1), (1, 1, "b", 2), (1, 2, "a", 1), (1, 2, "c", 5), (1, 2, "z", 0), (1, 2, None, 3)], "fact int, list int, tag string, rank int")


def test_rrf_of_two_lists_doubles_one(lists):
    got = {r.tag: r for r in fu.rrf(lists).collect()}
    assert got["a"].rrf == pytest.approx(2 / 61) and set(got) == {"a", "b", "c"}
    mean = {r.tag: r.rrf for r in fu.rrf(lists, "mean").collect()}
    assert mean["a"] == pytest.approx(1 / 61) and mean["b"] == pytest.approx(1 / 62)
    share = {r.tag: r.rrf for r in fu.rrf(lists, "lists").collect()}
    assert share["b"] == pytest.approx(1 / 124)


def test_best_rank_keeps_its_list(spark):
    got = fu.rrf(spark.createDataFrame([(1, 1, "t", 5), (1, 2, "t", 2)], "fact int, list int, tag string, rank int")).first()
    assert (got.best_rank, got.best_list, got.first_list, got.hits) == (2, 2, 1, 2)


def test_minmax_rules(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 5.0), (2, 4.0), (2, 4.0)], "fact int, score double")
    assert rows(df.select("fact", minmax(F.col("score"), ["fact"], 0.0).alias("x")), "fact", "x") == [(1, 0.0), (1, 1.0), (2, 0.0), (2, 0.0)]
    assert rows(df.where("fact = 2").select(minmax(F.col("score"), ["fact"], 1.0).alias("x")), "x") == [(1.0,), (1.0,)]


def test_abstention_policies(spark):
    v = spark.createDataFrame([(1, 0, "t", d, x) for d, x in (("a", True), ("b", True), ("c", None))] + [(1, 0, "u", "a", None)], "fact int, hyp int, tag string, dimension string, verdict boolean")
    score = lambda p: {r.tag: r.agree for r in rr.agreement(v, p).collect()}
    assert score("drop") == {"t": 1.0, "u": None}
    assert score("negative") == {"t": pytest.approx(2 / 3), "u": 0.0}
    assert score("neutral") == {"t": pytest.approx(2.5 / 3), "u": 0.5}


def test_rerank_share_and_flat_base(spark):
    pool = spark.createDataFrame([(1, "a", 0.0, 0.0), (1, "b", 1.0, 0.5), (2, "a", 1.0, 0.0), (2, "b", 1.0, 1.0)], "fact int, tag string, score double, consensus double")
    assert rows(rr.rerank_share(pool, 0.6), "fact", "share") == [(1, 0.3), (2, None)]


def test_auroc(spark):
    def of(pairs):
        return me.auroc(spark.createDataFrame([(0, s, y) for s, y in pairs], "g int, s double, y boolean"), ["g"], "s", "y").first().auroc

    assert of([(0.1, False), (0.9, True)]) == 1 and of([(0.9, False), (0.1, True)]) == 0
    assert of([(0.5, False), (0.5, True)]) == 0.5 and of([(0.5, True)]) is None


def test_gold_rank_and_rewards(spark):
    ranking = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1)], "fact int, tag string, rank int")
    gold = spark.createDataFrame([(1, "b"), (2, "x")], "fact int, gold string")
    got = me.first_gold_rank(ranking, gold, ["fact"])
    assert rows(got, "fact", "gold_rank") == [(1, 2), (2, None)]
    m = got.agg(*me.rank_metrics(F.col("gold_rank"))).first()
    assert (m.n, m.accuracy, m.mrr, m.recall_at_10) == (2, 0.0, 0.25, 0.5)


def test_constant_bootstrap_has_no_width(spark):
    df = spark.createDataFrame([(i % 5, 2.0) for i in range(20)], "c int, v double")
    ci = st.bootstrap(st.by_cluster(df, "c", "v"), 30)
    r = ci.agg(*st.interval(ci)).first()
    assert (r.low, r.high, r.excludes_zero) == (2.0, 2.0, True)


def test_label_tokens(spark):
    df = spark.createDataFrame([("CamelCase",), ("Cost of Revenues",), ("",), (None,)], "t string")
    got = [r.x for r in df.select(tx.label_tokens(F.col("t")).alias("x")).collect()]
    assert {"camel", "case"} <= set(got[0]) and "of" not in got[1] and "revenue" in got[1] and got[2] == got[3] == []


def test_feedback_bands_and_merge(spark):
    v = spark.createDataFrame([(1, "a", True), (1, "a", True), (1, "a", False), (1, "b", False), (1, "c", None)], "fact int, dimension string, verdict boolean")
    f = sy.feedback(v, ["fact"])
    assert rows(f, "dimension", "state") == [("a", "supported"), ("b", "contradicted"), ("c", "unresolved")]
    other = f.withColumn("state", F.lit("contradicted"))
    assert rows(sy.merge_feedback(f, other, ["fact"]), "dimension", "state") == [("a", "supported"), ("b", "contradicted"), ("c", "contradicted")]


def test_representatives_are_distinct_and_full(spark):
    ranking = spark.createDataFrame([(1, f"t{i}", i, i // 3) for i in range(1, 10)], "fact int, tag string, rank int, sig int")
    got = sorted(sy.cluster_representatives(ranking, "sig", 5, 9).collect(), key=lambda r: r.rank)
    assert [r.old_rank for r in got] == [1, 3, 6, 9, 2]


def test_bm25_zero_padding_and_scopes(spark):
    corpus = spark.createDataFrame([("*", 1, ["a", "b"]), ("*", 2, ["b"]), ("*", 3, ["c"])], "scope string, doc int, tokens array<string>")
    q = spark.createDataFrame([(7, "*", ["b", "b"]), (8, "*", ["none"])], "query int, scope string, tokens array<string>")
    got = {(r.query, r.rank): (r.doc, r.score > 0) for r in padded_topk(q, corpus, 3).collect()}
    assert got[7, 1] == (2, True) and got[7, 2] == (1, True) and got[7, 3] == (3, False) and got[8, 1] == (1, False)
    assert bm25(q.limit(0), corpus).count() == 0
    asked = scope_or_all(spark.createDataFrame([(1, "x"), (2, "y")], "query int, type string"), spark.createDataFrame([("x",)], "type string"))
    assert rows(asked, "query", "scope") == [(1, "x"), (2, "*")]


def test_cosine_in_blocks(spark, monkeypatch):
    from orrery.operators import dense

    v = spark.createDataFrame([(i, [float(i % 3 + 1), float(i), 1.0]) for i in range(20)], "doc long, vec array<float>")
    q = v.where("doc < 5").withColumnRenamed("doc", "query")
    want = rows(cosine_topk(q, v, 3), "query", "rank", "doc")
    monkeypatch.setattr(dense, "BLOCK_NUMBERS", 3)
    assert rows(cosine_topk(q, v, 3), "query", "rank", "doc") == want


def test_one_to_one_statuses(spark):
    e = spark.createDataFrame([(1, "v", i) for i in (1, 2, 3)] + [(1, "w", 4), (1, "x", 5)], "s int, v string, e int")
    c = spark.createDataFrame([(1, "v", 10), (1, "v", 11), (1, "w", 12)], "s int, v string, c int")
    got = {r.e: (r.cell, r.status) for r in prep.one_to_one(e, c, ["s", "v"], "e", "c").collect()}
    assert got == {1: (10, "ambiguous"), 2: (11, "ambiguous"), 3: (10, "reused"), 4: (12, "exact"), 5: (None, "unmatched")}


def test_interval_overlap_against_nested_loop(spark):
    a = [(1, i * 7 % 50, i * 7 % 50 + i % 9) for i in range(30)]
    b = [(1, i * 5 % 50, i * 5 % 50 + i % 13) for i in range(30)]
    got = prep.interval_overlap(spark.createDataFrame(a, "k int, start long, end long"), spark.createDataFrame(b, "k int, other_start long, other_end long"), "k", 6).count()
    assert got == sum(s < oe and e > os for _, s, e in a for _, os, oe in b)


def test_html_cells_and_text(spark):
    pages = spark.createDataFrame([(1, "<table><tr><th colspan=2>A</th><td>b &amp; c</td></tr><tr><td>1<td>2</table>x"), (2, None)], "page_id int, html string")
    assert rows(prep.html_cells(pages, "page_id", "html"), "table", "row", "col", "cell") == [(0, 0, 0, "A"), (0, 0, 1, "A"), (0, 0, 2, "b & c"), (0, 1, 0, "1"), (0, 1, 1, "2")]
    assert rows(prep.html_text(pages, "page_id", "html"), "page_id", "text")[0] == (1, "A b & c 1 2 x")


def test_salvage():
    assert modelio.salvage('<think>{"no": 1}</think> ```json\n{"a": "}"} ``` rest') == {"a": "}"}
    assert modelio.salvage('[{"a": 1}, {"a": 2}, {"a":') == [{"a": 1}, {"a": 2}]
    assert modelio.salvage("nothing") is None and modelio.salvage(None) is None
    assert modelio.fit_budget(["abcdef", "xy"], 5, len) == ["abc", "xy"]


def test_bipartite_needs_augmenting_paths():
    assert prep.bipartite_size(["ab", "a"], ["a", "b"], lambda x, y: y in x) == 2


def test_quotas_and_features():
    assert st.correlated_features({("a", "b"): 0.99, ("a", "c"): 0.1, ("b", "c"): 0.2}, ["a", "b", "c"], 0.95) == ["a", "c"]


def test_decay_and_asof(spark):
    df = spark.createDataFrame([("x", 1, 1.0, 2.0), ("x", 3, 2.0, 1.0), ("y", 2, 1.0, 1.0)], "arm string, step int, f double, r double")
    got = {r.arm: r for r in sq.decayed_moments(df, ["arm"], "step", "f", "r", 0.5).collect()}
    assert got["x"].a == pytest.approx(1 + 0.25 + 4) and got["x"].b == pytest.approx(0.5 + 2)
    facts = spark.createDataFrame([(10, 5, "c1", "t")], "fact int, seq int, context string, type string")
    mem = spark.createDataFrame([(1, 1, "c2", "t", 0.5), (2, 2, "c1", "t", 0.9), (3, 4, "c3", "t", 0.7), (4, 6, "c4", "t", 1.0)], "memory int, mem_seq int, mem_context string, type string, s double")
    assert rows(sq.asof_topk(facts, mem, 5, F.col("s")), "rank", "memory") == [(1, 3), (2, 1)]


def test_novelty(spark):
    df = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["a", "b"]), (1, 2, ["a", "c"])], "c int, t int, k array<string>")
    assert rows(me.novelty(df, "c", "t", "k"), "t", "novelty") == [(0, 1.0), (1, 0.0), (2, pytest.approx(2 / 3))]


def test_readers(spark, tmp_path):
    (tmp_path / "tax.jsonl").write_text('{"tag": "A", "type": "t", "standard_label": " L  x "}\n\n{"tag": "us-gaap:B", "type": "t", "retrieval_text": "r"}\n')
    got = {r.raw_tag: r for r in readers.concepts(spark, str(tmp_path / "tax.jsonl")).collect()}
    assert got["A"].tag == "us-gaap:A" and got["A"].retrieval_text == "L x" and got["B"].standard_label == "B"
    (tmp_path / "f.jsonl").write_text(json.dumps({"context_id": "1", "value": "5", "type": "m", "ground_truth_concepts": ["x"]}) + "\n")
    f = readers.facts(spark, str(tmp_path / "f.jsonl")).first()
    assert (f.entity, f.entity_type, f.gold_tags) == ("5", "m", ["x"])
    (tmp_path / "a.tsv").write_text("1\t2\n3\t4\n")
    assert rows(readers.tsv(spark, str(tmp_path / "a.tsv"), ["x", "y"]), "x", "y") == [("1", "2"), ("3", "4")]
    with pytest.raises(Exception, match="not 3 fields"):
        readers.tsv(spark, str(tmp_path / "a.tsv"), ["x", "y", "z"]).collect()
    (tmp_path / "w.txt").write_text("A00     Cholera x\n")
    assert rows(readers.fixed_width(spark, str(tmp_path / "w.txt"), {"code": 8, "text": None}), "code", "text") == [("A00", "Cholera x")]
    (tmp_path / "p.json").write_text(json.dumps({"predictions": [{"context_id": 1, "pred": "x"}]}))
    found = readers.predictions(spark, str(tmp_path / "p.json"))
    samples = spark.createDataFrame([(1,)], "context_id long")
    assert rows(readers.match_predictions(samples, found), "context_id", "prediction") == [(1, "x")]
    with pytest.raises(ValueError, match="no prediction for"):
        readers.match_predictions(spark.createDataFrame([(2,)], "context_id long"), found)
    (tmp_path / "x.xml").write_text('<s><e name="a" type="t"/><e name="b" type="u"/></s>')
    assert rows(readers.xml_elements(spark, str(tmp_path / "x.xml"), "e", "_name string, _type string"), "_name") == [("a",), ("b",)]


def test_linkbase(spark):
    locs = spark.createDataFrame([("l1", "f.xsd#us_Cash", 1)], "label string, href string, pos int")
    arcs = spark.createDataFrame([("l1", "r1"), ("l1", "r2")], "from string, to string")
    res = spark.createDataFrame([("r1", "doc", "D", 1), ("r2", "std", "S2", 3), ("r2", "std", "S1", 2)], "label string, role string, text string, pos int")
    assert rows(readers.linked_labels(locs, arcs, res, "std"), "tag", "label") == [("Cash", "S1")]
    refs = spark.createDataFrame([("r1", "b", 2), ("r2", "a", 1), ("r2", "b", 3)], "label string, reference string, pos int")
    assert rows(readers.linked_references(locs, arcs, refs), "tag", "references") == [("Cash", ["a", "b"])]


def test_streams_equal_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    data = [(i, f"2024-01-0{1 + i % 3} 00:00:00", i % 4, "ab"[i % 2], float(i), None) for i in range(40)]
    df = spark.createDataFrame(data, "event_id long, t string, user_id long, event_type string, value double, props string").select("event_id", F.col("t").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    df.repartition(3).write.parquet(src)
    q = rewards.running_arms(rewards.events(spark, src)).writeStream.format("memory").queryName("arms").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    want = rows(df.groupBy(F.col("event_type").alias("arm")).agg(F.count("*").alias("n"), F.sum("value").alias("total")), "arm", "n", "total")
    assert rows(spark.table("arms"), "arm", "n", "total") == want
    rewards.append_once(rewards.events(spark, src), str(tmp_path / "out"), str(tmp_path / "c2"), "event_id").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40
    days = str(tmp_path / "days")
    for day in ("01", "02", "03"):  # in the order of event time, or the watermark leaves rows out
        df.where(F.date_format("ts", "dd") == day).coalesce(1).write.mode("append").parquet(days)
    w = rewards.windowed_rewards(rewards.events(spark, days)).writeStream.format("memory").queryName("wins").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start()
    w.awaitTermination(120)
    assert rows(spark.table("wins"), "arm", "n") == [("a", 7), ("b", 7)]  # the first day; the others are not over yet


def test_asof_sees_all_earlier_memories(spark, monkeypatch):
    monkeypatch.setattr(sq, "BLOCK_ROWS", 20)
    r = [(100 * c + t, c, "u" if t % 2 else "v", sorted({f"w{(7 * c * t + j * j) % 23}" for j in range((c + t) % 6)})) for c in range(40) for t in range(3)]
    got = {}
    for x in sq.asof_jaccard_topk(spark.createDataFrame(r, "seq long, context long, type string, tokens array<string>"), 3).orderBy("rank").collect():
        got.setdefault(x.fact, []).append((x.memory, round(x.similarity, 9)))
    want = {}
    for s, c, y, a in r:
        near = [(-round(len(set(a) & set(b)) / max(len(set(a) | set(b)), 1), 9), m) for m, d, z, b in r if m < s and d != c and z == y]
        if near:
            want[s] = [(m, -v) for v, m in sorted(near)[:3]]
    assert got == want and any(s - m > 2100 for s, found in got.items() for m, _ in found)


def test_staged_tables_can_be_cleared(spark):
    from orrery.session import clear_staged, staged

    kept = staged(spark.range(5), "cleared")
    assert kept.count() == 5
    # Only what this test staged: other tests may still read theirs.
    import orrery.session as session

    rest, session._STAGED[:] = session._STAGED[:-1], session._STAGED[-1:]
    assert clear_staged(spark) == 1 and not session._STAGED
    session._STAGED[:] = rest
    folder = spark._jvm.org.apache.hadoop.fs.Path(kept.inputFiles()[0])
    assert not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
