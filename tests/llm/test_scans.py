import math
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np

from orrery.llm import licenses
from orrery.llm.hmm import Sequences, score_texts, split_words
from orrery.llm.licenses import PHRASES, TEMPLATES, TemplateIndex, blocks, scan


def plain_words(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_places(words):
    return [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]


ROWS = [
    (101, "x\nLicensed under CC BY-NC 4.0.\nAll rights reserved"),
    (102, "CC by cc BY cc_by ccby All-rights;reserved GENERAL PUBLIC LICENSE"),
    (103, "Released under the MIT License."),
    (104, "Émile all rights réserved This work is licensed under the GNU General Public License, version 3."),
    (105, "w " * 300 + "Licensed under the Apache License Version 2 0" + " w" * 300),
    (106, "cc"),
]


def test_scan_against_brute_force(frame, odd):
    rows = ROWS + odd
    got = scan(frame(rows)).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t in rows}
    wanted = {w for ts in TEMPLATES.values() for t in ts for w in licenses.split_words(t)}
    freq = Counter(w for _, t in rows for w in wanted & set(licenses.split_words(t or "")))
    assert freq
    for r in got:
        if r.doc_id is None:
            continue
        words = plain_words(text[r.doc_id] or "")
        assert r.n_words == len(words)
        assert sorted((p.word, p.label) for p in r.places) == sorted(plain_places(words))
        want = set()
        for at, block in blocks(text[r.doc_id] or ""):
            for label, texts in TEMPLATES.items():
                best = max(len(set(s) & set(block)) / len(set(s)) for s in map(licenses.split_words, texts))
                if best >= licenses.THRESHOLD:
                    want.add((at, label, round(best, 9)))
        assert {(m.word, m.label, round(m.containment, 9)) for m in r.matches} == want
    assert scan(frame([])).count() == 0


def test_filters_lose_nothing():
    r = np.random.default_rng(2)
    vocab = [f"t{k}".encode() for k in range(25)]
    templates = {f"l{k}": [" ".join(w.decode() for w in r.choice(vocab, 7))] for k in range(8)}
    index = TemplateIndex(templates, 0.7, {w: int(r.integers(0, 99)) for w in vocab})
    for _ in range(300):
        block = list(r.choice(vocab, int(r.integers(1, 12))))
        want = {}
        for label, [t] in templates.items():
            s = set(licenses.split_words(t))
            c = len(s & set(block)) / len(s)
            if len(s & set(block)) >= math.ceil(0.7 * len(s) - 1e-9):
                want[label] = c
        assert index.matches(block) == want


def test_forward_against_enumeration():
    r = np.random.default_rng(4)
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    model = {"emit": norm(r.random((5, 3)), 0), "move": norm(r.random((3, 3)), 1), "start": norm(r.random(3), 0)}
    seqs = [[0, 3, 2, 4], [1], [], [2, 2, 0]]
    lengths = np.array([len(s) for s in seqs])
    both = Sequences(np.array([x for s in seqs for x in s]), lengths)
    got = both.log10(model)
    emit_sum, move_sum, start_sum = np.zeros((5, 3)), np.zeros((3, 3)), np.zeros(3)
    for s, value in zip(seqs, got):
        total, parts = 0.0, []
        for path in product(range(3), repeat=len(s)):
            p = 1.0
            for t, (k, x) in enumerate(zip(path, s)):
                p *= (model["start"][k] if t == 0 else model["move"][path[t - 1], k]) * model["emit"][x, k]
            total += p
            parts.append((p, path))
        assert np.isclose(value, math.log10(total))
        if s:
            for p, path in parts:
                start_sum[path[0]] += p / total
                for t, (k, x) in enumerate(zip(path, s)):
                    emit_sum[x, k] += p / total
                    if t:
                        move_sum[path[t - 1], k] += p / total
    sums = np.zeros((5, 3)), np.zeros((3, 3)), np.zeros(3)
    both.expected(model, *sums)
    for a, b in zip(sums, (emit_sum, move_sum, start_sum)):
        assert np.allclose(a, b)


def test_scores(spark, frame, odd):
    from pyspark.sql import functions as F

    r = np.random.default_rng(5)
    left, right = [f"a{k}" for k in range(40)], [f"b{k}" for k in range(40)]
    rows = [(100 + i, " ".join(r.choice(left if i % 2 else right, 60)) + f" rare{i}") for i in range(300)] + odd
    got = score_texts(frame(rows), F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) != 0, symbols=64, states=2).collect()
    learns = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 != 0
    c, ends = Counter(), 0
    for i, t in rows:
        if learns(i):
            c.update(split_words(t or ""))
            ends += 1
    total, distinct = sum(c.values()) + ends, len(c) + 1
    base = lambda n: math.log10((n + 0.1) / (total + 0.1 * (distinct + 1)))
    text, gain = {i: t for i, t in rows}, []
    assert len(got) == len(rows)
    for x in got:
        words = split_words(text[x.doc_id] or "") if x.doc_id is not None else None
        if words is not None:
            assert x.train_tokens == total and x.n_tokens == len(words) + 1
            assert x.n_known == 1 + sum(c[w] > 0 for w in words)
            assert math.isclose(x.base_score, sum(base(c[w]) for w in words) + base(ends), rel_tol=1e-9)
            if x.doc_id >= 100 and not learns(x.doc_id):
                gain.append(x.score - x.base_score)
    assert np.mean(gain) > 5  # the states tell the two kinds of text apart, also in held-out rows
    assert score_texts(frame([]), F.lit(True)).count() == 0


def test_licence_wrapped_over_lines(frame):
    import textwrap

    notices = {label: max(texts, key=len) for label, texts in TEMPLATES.items()}
    rows, fill = [], "river stone light morning " * 40
    for width in (30, 50, 72):
        for k, label in enumerate(notices):
            rows.append((100 * width + k, "\n".join(textwrap.wrap(f"{fill} {notices[label]} {fill}", width))))
    got = {r.doc_id: {m.label for m in r.matches} for r in scan(frame(rows)).collect()}
    for width in (30, 50, 72):
        for k, label in enumerate(notices):
            assert label in got[100 * width + k]
