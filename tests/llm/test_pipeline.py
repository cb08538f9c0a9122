import numpy as np
import pytest
import zlib

import corpus_pipeline
from orrery.llm import toxicity
from tests.llm.test_shingle_join import groups


@pytest.fixture(scope="module")
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    return make


def toxic_corpus(n=900):
    r = np.random.default_rng(3)
    stems, ends = ["vilgrok", "scumpa", "hatzu"], ["ä", "ent", "isch", "or", "ul", "ax"]
    plain = ["the", "of", "river", "stone", "light", "morning", "paper", "blue", "road", "house", "winter", "song"]
    rows, marks = [], []
    for i in range(n):
        words = list(r.choice(plain, int(r.integers(5, 200))))
        if i % 4 == 0:
            for _ in range(3):
                words[int(r.integers(0, len(words)))] = r.choice(stems) + r.choice(ends)
        rows.append((i, " ".join(words)))
        marks.append((i, 0, int(i % 4 == 0)))
    return rows, marks


def test_toxicity_held_out(frame, labels):
    rows, marks = toxic_corpus()
    docs = frame(rows)
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels(marks))).collect()}
    test = [m for m in marks if zlib.crc32(str(m[0]).encode()) % 3 == 1]
    assert np.mean([got[i] >= 0.7 for i, _, y in test if y]) > 0.9
    assert np.mean([got[i] >= 0.7 for i, _, y in test if not y]) < 0.02


def test_toxicity_reads_no_held_out_label(frame, labels):
    rows, marks = toxic_corpus(300)
    docs = frame(rows)
    swapped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, q, y in marks]
    a, b = (toxicity.fit(docs, labels(m)) for m in (marks, swapped))
    assert np.array_equal(a["weights"], b["weights"])


def test_toxicity_odd_rows(frame, labels, odd):
    model = toxicity.fit(frame(odd), labels([]))
    assert model["scale"] == 1.0
    got = toxicity.score(frame(odd), model).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(frame([]), model).count() == 0


def test_best_bags_against_brute_force():
    r = np.random.default_rng(1)
    counts = np.array([0, 3, 20, 0, 8, 1])
    odds = r.normal(size=counts.sum())
    best, at = toxicity.best_bags(odds, counts)
    pos = 0
    for k, n in enumerate(counts):
        part = odds[pos : pos + n]
        pos += n
        if n:
            means = [part[i : i + 8].mean() for i in range(max(1, n - 7))]
            assert np.isclose(best[k], max(means)) and at[k] == int(np.argmax(means))
        else:
            assert best[k] == 0


def test_subwords_share_ngrams():
    grams, starts = toxicity.subwords(["idiot", "idiots", "x", "é" * 60])
    part = [set(grams[a:b].tolist()) for a, b in zip(starts, starts[1:])]
    assert all(part) and len(part[0] & part[1]) >= 5


def test_stages(spark, frame, odd, tmp_path, monkeypatch):
    rows, marks = toxic_corpus(480)
    rows = [(i, t, "s") for i, t in rows] + [(2000 + k, f"FRAME LINE of this site\nown text {k} " + " ".join(f"t{k}w{j}" for j in range(30)), "site") for k in range(40)]
    rows += [(3000 + k, rows[485][1], "site") for k in range(5)] + [r for r in odd]
    d = str(tmp_path)
    frame(rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    clean = corpus_pipeline.toxicity(spark, docs, d)
    assert clean.columns == names
    left = {r.doc_id for r in clean.collect()}
    toxic = {i for i, _, y in marks if y}
    assert len(left & toxic) <= 0.1 * len(toxic) and {r[0] for r in rows} - toxic - left <= set()
    lines = corpus_pipeline.line_dedup(spark, clean, d)
    text = {r.doc_id: r for r in lines.collect()}
    assert lines.columns == names and text[2003].text.startswith("own text 3") and text[2003].n_chars == len(text[2003].text)
    near = corpus_pipeline.near_dedup(spark, lines, d)
    kept = [r.doc_id for r in near.collect()]
    named = {r.doc_id: r.text or "" for r in lines.collect() if r.doc_id is not None}
    assert sorted({k for k in kept if k is not None}) == sorted(set(groups(named.items()).values()))
    packed = corpus_pipeline.packing(spark, near, d)
    assert {r.doc_id for r in packed.collect()} == set(kept)


def test_run_is_all_stages(spark, frame, odd, tmp_path):
    d = str(tmp_path)
    frame(odd).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert corpus_pipeline.run(spark, d).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "packing"]


def test_short_page_loses_its_passage(spark, frame):
    passage = " ".join(f"p{j}" for j in range(60))
    rows = [(i, f"{passage}\nown {i}", "s") for i in range(8)] + [(20 + i, passage, "s") for i in range(2)]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, frame(rows), "").collect()}
    assert got == {i: f"own {i}" for i in range(8)} | {20: passage, 21: passage}


def test_bags_of_an_epoch_are_bounded_by_name(monkeypatch):
    rows, marks = toxic_corpus(200)
    texts, y = [t for _, t in rows], np.array([m[2] for m in marks])
    whole = toxicity.train(texts, y)["weights"]
    monkeypatch.setattr(toxicity, "MOST_BAGS", 5)
    assert not np.array_equal(whole, toxicity.train(texts, y)["weights"])
