"""Rules whose every case matters."""

import re

import pytest
from pyspark.sql import functions as F

from orrery.functions import text as tx
from orrery.operators import audit, fusion as fu


def scan(text):
    """Sentences by a walk over the characters."""
    spans, start = [], 0
    for i, c in enumerate(text):
        if c not in ".!?":
            continue
        rest = text[i + 1 :].lstrip()
        initial = c == "." and i >= 2 and text[i - 1].isupper() and text[i - 2] == "."
        if not initial and (not rest or rest[0].isupper() or rest[0].isdigit() or rest[0] in '"¿¡'):
            spans.append((start, i + 1))
            start = i + 1
    spans.append((start, len(text)))
    return [(a, b, " ".join(text[a:b].split())) for a, b in spans if text[a:b].strip()]


TEXTS = [
    "It rose. $5 million was paid. (See note 3.) so it is.", "A.B.C. Then, e.g. this.  Next one!Now", 'He said. "No." ¿Que? ¡Si! ño. Ñandú', "No end", " . ", "?!. A", "x.\n\n 7 y. é z. É", "U.S.A. is. U.S. Army.", "³. ²x? ³", "👍. 👍 A. 👍", "",
]


def test_sentences(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    want = {i: [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9(]|[$])", t) if s.strip()] for i, t in enumerate(TEXTS)}
    assert {r.id: r.s for r in df.select("id", tx.sentences(F.col("text")).alias("s")).collect()} == want
    assert want[0][:2] == ["It rose.", "$5 million was paid."]


def test_scanned_sentences(spark):
    got = {}
    for r in tx.scanned_sentences(spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string"), "id", "text").collect():
        got.setdefault(r.id, []).append((r.pos, r.start, r.end, r.sentence))
    for i, t in enumerate(TEXTS):
        assert [x[1:] for x in sorted(got.get(i, []))] == scan(t) and [x[0] for x in sorted(got.get(i, []))] == list(range(len(scan(t))))


def test_a_repeated_amount_is_one(spark):
    shown = {"$ 413,413 $  413,413": "413", "$ 5,005": "5005", "413,413 % 413,413": "413413", "(413,413)": "413413", "$ 12,345 $ 12,345": "12345"}
    got = spark.createDataFrame([(s,) for s in shown], "s string").select("s", tx.dataset_number(F.col("s")).alias("n")).collect()
    assert {r.s: r.n for r in got} == shown


def test_the_sample_that_is_taken(spark):
    whole = [(c, "table" if c % 2 else "text", "x" if c % 3 else "y", f"k{c % 5}") for c in range(60) for _ in range(1 + c % 3)]
    rows = spark.createDataFrame(whole, "context long, kind string, class string, concept string")
    chosen = [(a, c) for a in range(6) for c in range(60) if (c * 7 + a * 13) % (3 + a % 3) == 0]
    for target in (0, 40):
        got = sorted(audit.sample_quality(rows, spark.createDataFrame(chosen, "attempt long, context long"), target, 0.5).collect(), key=lambda r: r.attempt)
        best, taken = None, None
        for r in got:
            if best is None or r.score < best:
                best, taken = r.score, r.attempt
                if not r.flags:
                    break
        assert [r.attempt for r in got if r.taken] == [taken]
        plain = [sum(w * r[k] for k, w in audit.SAMPLE_WEIGHTS.items()) + (0.5 * abs(r.n - target) / target if target else 0) for r in got]
        assert [r.score for r in got] == pytest.approx(plain)


def test_named_tags_get_their_prefix(spark):
    candidates = spark.createDataFrame([(1, "ns:A", 1), (1, "ns:B", 2), (1, "ns:C", 3)], "fact long, tag string, rank long")
    answers = spark.createDataFrame([(1, '{"ranked_tags": ["C", " ns:B ", "Z"], "selected_tag": "A", "ranking": ["2"]}')], "fact long, answer string")
    got = fu.named_candidates(answers, candidates, "ns:").orderBy("priority", "pos").collect()
    assert [r.tag for r in got] == ["ns:A", "ns:B", "ns:C", "ns:B"]


def test_phrases_by_index_and_by_loop(spark, monkeypatch):
    import random

    from orrery.operators import symbolic as sy

    r = random.Random(2)
    words = ["cost", "costs", "of", "Revenue", "sales", "net", "SteelWorks", "x", "ab", "é", "tax"]
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 8)))) for i in range(120)] + [(500, None), (501, "")]
    entries = {"d1": {"a": ["cost of revenue", "steel"], "b": ["net sales", "ab", "x"]}, "d2": {"c": ["taxes", "of", "é"], "e": ["revenue cost", "nothing", "workssales", "st o"]}}
    df, vocab = spark.createDataFrame(texts, "id long, t string"), sy.vocabulary(spark, entries)
    show = lambda: sorted((x.id, x.dimension, tuple(x.categories)) for x in sy.phrase_categories(df, vocab, "id", "t").collect())
    by_loop = show()
    monkeypatch.setattr(sy, "FEW_PHRASES", 0)
    assert show() == by_loop and len(by_loop) > 100


def test_metadata_takes_the_first_alias_that_says_something(spark):
    from orrery.operators import symbolic as sy

    df = spark.createDataFrame([(" ", "b  c", None), ("a", "b", "d")], "x string, y string, z string")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in sy.metadata({"kind": ["x", "y"], "unit": ["none", "z"], "no": ["none"]}, df.columns).items()]).collect()]
    assert got == [("b c", None, None), ("a", "d", None)]


def test_visible_text():
    from orrery.operators.prep import visible_text

    assert visible_text("a &amp; b  <3") == "a & b <3" and visible_text(None) == visible_text(" ") == ""
    assert visible_text('<p>A&nbsp;b</p><script>var t="</p>";</script><!-- no --><br/>c') == 'A b var t="</p>"; c'
    assert visible_text("<p>kept</p><p>whole &amp; text <a hre") == "kept whole & text" and visible_text("<p>kept</p>cut off &am") == "kept"
    assert visible_text("&lt;b&gt;<i></i>") == "<b>" and visible_text("<b>&am") == "&am"
