"""Numbers, aliases, tables, audits, grids and orders cut into ranges, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from orrery.functions import text as tx
from orrery.operators import splits as sp
from orrery.operators import audit, compat, fusion as fu, prep, sequence as sq, stats as st
from orrery.operators.passages import containing
from orrery.sources import readers


def values(spark, column, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", column(F.col("t")).alias("v"))
    return [r.v for r in sorted(rows.collect(), key=lambda r: r.k)]


def test_fixed_words(spark):
    got = values(spark, tx.label_tokens, ["from per which are", "Nil of these"])
    assert got[0] == ["from", "per", "from", "per"] and got[1] == ["nil", "nil"]
    assert values(spark, tx.unresolved, ["nil", " Not  specified ", "N/A", None, "x"]) == [False, True, True, True, False]


def test_numbers(spark):
    shown = ["$ 1,234 $ 1,234", "(5.6)", "—", "+7", "1 2", "about 3", "12%", "2024 2024", "", None, ".5", "-1,000.25", "$ $", "4 , 4 , 4"]
    assert values(spark, tx.dataset_number, shown) == ["1234", "5.6", "-", "7", "12", "", "12", "2024", "", "", ".5", "-1000.25", "", "444"]
    assert values(spark, tx.plain_number, ['"1,000"', "'(2 %)'", "€5", "£ 1", "−3", None]) == ["1000", "2", "€5", "£1", "-3", ""]


def test_coercions(spark):
    assert values(spark, tx.listed, ["a, b;; c ", "", None]) == [["a", "b", "c"], [], []]
    assert values(spark, tx.truthy, [" YES ", "y", "1", "true", "no", None]) == [True, True, True, True, False, False]
    assert values(spark, lambda c: tx.by_alias(c, ["entity_type", "type"]), ['{"Entity-Type": "a", "type": "b"}', '{"TYPE": 3}', "{}", "no json", None]) == ["a", "3", None, None, None]
    tags = F.array(F.lit("us:Cash"), F.lit("us:Debt"))
    assert values(spark, lambda c: tx.tag_in(c, tags, r"us:\w+"), ["Debt, but us:Cash", "us:None or Debt", "x", None]) == ["us:Cash", "us:Debt", "", ""]


def test_table_context(spark):
    grid = [["", "in millions", "2023", "Year ended 2024"], ["Assets"], ["Cash", "$", "1,000", "(2)"], ["Total", "note", "7", "8"]]
    cells = spark.createDataFrame([(0, r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row)], "t int, row int, col int, cell string")
    got = {(r.row, r.col): (r.number, r.row_context, r.column_context) for r in prep.table_context(cells, ["t"]).collect()}
    assert got[2, 2] == ("1000", "Assets | Cash", "2023") and got[2, 3] == ("2", "Assets | Cash", "Year ended 2024")
    assert got[3, 2] == ("7", "Assets | note", "2023") and got[3, 3] == ("8", "Assets | note", "Year ended 2024")
    assert got[0, 2][0] == "2023"


def test_passages_against_contains(spark):
    r = random.Random(4)
    words = ["a", "bb", "ccc", "", "d"]
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 40)))) for i in range(80)] + [(900, None)]
    passages = [(i, t[2:-2]) for i, t in texts[:30] if len(t) > 5] + [(500, "a bb"), (501, None), (502, "zz a bb ccc d d bb")]
    got = containing(spark.createDataFrame(texts, "d int, text string"), "d", "text", spark.createDataFrame(passages, "p int, passage string"), "passage")
    assert sorted((x.d, x.p) for x in got.collect()) == sorted((d, p) for d, t in texts for p, q in passages if t is not None and q is not None and q in t)


def test_orders_in_ranges(spark):
    r = random.Random(6)
    data = [(i, "hot" if i % 10 else "b", r.choice([0.0, 1.0, 5.5, None])) for i in range(300)]
    rows = spark.createDataFrame(data, "i int, g string, v double").repartition(5)
    got = {x.i: x.n for x in st.placed(rows, ["g"], ["i"], "n").collect()}
    for g in ("hot", "b"):
        assert [got[i] for i, h, _ in data if h == g] == list(range(1, 1 + sum(h == g for _, h, _ in data)))
    out = {x.i: x for x in sq.running(rows, "v", ["g"], ["i"], 4, block=16).collect()}
    assert len(out) == len(data)
    mean = lambda xs: sum(xs) / len(xs) if xs else None
    for g in ("hot", "b"):
        seen = []
        for i, h, v in data:
            if h == g:
                seen.append(v)
                assert out[i].nth == len(seen)
                for name, part in (("rolling", seen[-4:]), ("cumulative", seen)):
                    want = mean([x for x in part if x is not None])
                    assert out[i][name] == (pytest.approx(want) if want is not None else None)


def test_quota_sample_and_strata(spark):
    rows = spark.createDataFrame([(k, ["a"] * 2 if k % 10 else ["a", "rare"]) for k in range(100)], "k int, kinds array<string>")
    s = {r.k: r.stratum for r in st.stratum(rows, "k", "kinds").collect()}
    assert all((s[k] == "a") == bool(k % 10) for k in range(100))
    some = sp.quota_sample(st.stratum(rows, "k", "kinds"), "stratum", [-F.col("k")], 20, "k").where("chosen").collect()
    assert sorted(r.k for r in some if r.stratum == "rare") == [80, 90] and len(some) == 20


def test_compatibility(spark):
    row = ("PerShareItemType", "Earnings PER share rate", ["asset", "debt"], ["instant"], ["weighted_average", "odd"])
    df = spark.createDataFrame([row, (None, None, None, None, None), ("sharesItemType", "share count", ["cash"], ["instant", "duration"], [])], "d string, t string, f array<string>, p array<string>, q array<string>")
    checks = compat.verdict(*map(F.col, "dtfpq"))
    got = df.select(*[v.alias(k) for k, v in checks.items()]).collect()
    assert tuple(got[0]) == (False, False, False, False)  # a rate beside per share, instant beside duration, debit beside credit
    assert tuple(got[1]) == (True, True, True, True) and tuple(got[2]) == (True, False, True, False)


def test_audits(spark):
    rounds = spark.createDataFrame([(1, 0, 0.2), (1, 1, 0.5), (1, 2, 0.5), (1, 3, None), (2, 0, 1.0), (2, 1, 0.0)], "e int, r int, closeness double")
    assert sorted((x.e, x.r, x.change) for x in audit.revisions(rounds, ["e"], "r").collect()) == [(1, 0, "improved"), (1, 1, "unchanged"), (2, 0, "worsened")]
    moved = audit.relocate(spark.createDataFrame([("b  c", "a b  c", "s"), ("x", "a b", "s"), (None, None, "d"), ("", "q", "d")], "sel string, cand string, scope string"), "sel", "cand", "scope")
    assert [(r.entity, r.level) for r in moved.collect()] == [("b c", "exact_substring"), ("a b", "fallback_s"), ("", "fallback_d"), ("q", "fallback_d")]
    with pytest.raises(ValueError, match="kappa"):
        audit.assert_no_drift({"kappa": "60", "beta": "0.6"}, {"kappa": "20", "beta": "0.6"})
    audit.assert_no_drift({"a": "1"}, {"a": "1"})


def test_named_candidates_and_null_search(spark):
    cand = spark.createDataFrame([(1, t, k) for k, t in enumerate("abcde", 1)], "fact int, tag string, rank int")
    answers = spark.createDataFrame([(1, '{"selected_index": 9, "selected_tag": "d", "ranking": ["2", "x", 2, 5], "tags": ["a", "zz"]}')], "fact int, answer string")
    got = sorted((r.rank, r.tag) for r in fu.composite(cand, fu.named_candidates(answers, cand)).collect())
    assert [t for _, t in got] == ["d", "b", "e", "a", "c"]
    rounds = spark.createDataFrame([(1, 1, "a", 2, 0.0), (1, 2, "a", 2, 1.0), (1, 1, "b", 3, 0.9), (1, 2, "c", 0, 1.0)], "fact int, list int, tag string, rank int, consensus double")
    assert [(r.tag, r.final) for r in fu.null_search(rounds, 1.0).orderBy("rank").collect()] == [("b", pytest.approx(0.9 + 1 / 63)), ("a", pytest.approx(2 / 62))]


def test_tree_with_notes_and_cycles(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}", [f"x{i}"] if i % 2 else None) for i in range(6)] + [(70, 71, "lost", None)], "node int, parent int, name string, notes array<string>")
    got = {r.node: r for r in prep.tree_paths(nodes, "notes").collect()}
    assert got[5].depth == 5 and got[5].notes == ["x1", "x3", "x5"] and got[5].path == " > ".join(f"n{i}" for i in range(6)) and 70 not in got


def test_sources(spark, tmp_path):
    rows = spark.range(50).withColumn("v", F.col("id") * 2)
    keys = spark.createDataFrame([(3,), (3,), (99,), (None,)], "id long")
    assert [r.v for r in readers.rows_by_key(rows, "id", keys).collect()] == [6]
    assert [r.v for r in readers.rows_by_key(rows, "id", keys, at_once=1).collect()] == [6]
    readers.save_dataset({"train": rows.where("id < 40"), "test": rows.where("id >= 40")}, str(tmp_path / "d"))
    assert readers.load_dataset(spark, str(tmp_path / "d"), "test").count() == 10 and readers.load_dataset(spark, str(tmp_path / "d")).count() == 50
    done = spark.createDataFrame([(1, False, "m"), (2, True, "m")], "id long, failed boolean, mode string")
    assert readers.remaining(rows, done, "id", failed="failed", settings={"mode": "m"}).count() == 49
    with pytest.raises(ValueError, match="mode"):
        readers.remaining(rows, done, "id", settings={"mode": "other"})
    found = spark.createDataFrame([(k, f"p{k}") for k in range(50)], "place long, prediction string")
    assert readers.match_predictions(rows.withColumnRenamed("id", "place"), found, "place").count() == 50
    readers.write_report([rows.limit(2), rows.limit(1).withColumn("w", F.lit('a "b", c'))], str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True, escape='"').where("w is not null").first().w == 'a "b", c'


def brute_sentences(text):
    return [x.strip() for x in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9($])", text) if x.strip()]


def test_sentences_against_plain_split(spark):
    texts = ["A b. C d? e. F", 'He said. "No."  1 two! (x)', "", None, "no end"]
    assert values(spark, tx.sentences, texts) == [brute_sentences(t or "") for t in texts]
