"""Personal data against the plain expressions and a plain run of the bootstrap."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from orrery.llm.personal_data import KINDS, base_spans, bootstrap, extracted, luhn, personal_data, slots

PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_base(text):
    """The contract word by word."""
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            twice = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
            good = [True, all(int(x) <= 255 for x in m.group().split(".")) if k == 1 else True, 16 <= len(digits) <= 19 and sum(twice) % 10 == 0, 8 <= len(digits) <= 15][k]
            if good:
                out.append((k, m.start(), m.end()))
    return out


def test_base_equals_the_expressions():
    r = random.Random(5)
    signs = ["a", "B", "7", "12", "255", "256", ".", "..", "@", "@", "+", "+1", " ", "  ", "-", "(", ")", "%", "_", "é", "👍", "\n", "4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "x@y.z", "٣"]
    for _ in range(20_000):
        text = "".join(r.choice(signs) for _ in range(r.randint(0, 24)))
        assert base_spans(text) == plain_base(text), text


def test_long_texts_take_no_square_time():
    for text in ("a" * 400_000, "1" * 400_000, "1 " * 200_000 + "x", "a.b-" * 100_000, "1." * 200_000, "+" * 400_000, "@" * 400_000, "a@" * 200_000, "+1 " + "(" * 400_000, "a@b" * 100_000):
        slots(text, base_spans(text))


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def plain_bootstrap(texts, min_support=3, threshold=0.8, doubt=0.25):
    seed, fits, edges = {}, defaultdict(int), set()
    for t in set(texts):
        for _, _, value, kind, fit, around in slots(t, plain_base(t)):
            fits[value] |= fit
            edges |= {(p, value) for p in around}
            if kind >= 0:
                seed[value] = kind
    known = {v: (k, 1.0) for v, k in seed.items()}
    held = defaultdict(set)
    for p, v in edges:
        held[p].add(v)
    while True:
        passed = []
        for p, values in held.items():
            for k in range(4):
                own = [known[v][1] for v in values if v in known and known[v][0] == k]
                might = sum(v not in known and fits[v] >> k & 1 for v in values)
                f = sum(own)
                if len(own) >= min_support and f / (f + len(values) - len(own) - might + doubt * might) >= threshold:
                    passed.append((p, k, f / (f + len(values) - len(own) - might + doubt * might)))
        votes = defaultdict(lambda: defaultdict(float))
        for p, k, c in passed:
            for v in held[p]:
                if v not in known and fits[v] >> k & 1:
                    votes[v][k] += math.log(1 - min(c, 0.99))
        new = {}
        for v, by in votes.items():
            k = max(by, key=lambda k: (round(1 - math.exp(by[k]), 12), -k))
            if 1 - math.exp(by[k]) >= threshold:
                new[v] = (k, 1 - math.exp(by[k]))
        if not new:
            return known
        known |= new


def corpus():
    r = random.Random(2)
    filler = "the of and a to in ist der die que les".split()

    def words(n):
        return " ".join(r.choice(filler) for _ in range(n))

    def number(n):
        return "".join(r.choice("23456789") for _ in range(n))

    rows = []
    for i in range(40):
        rows.append(f"{words(5)} please call me at +1 {number(3)} {number(7)} {words(4)}")
        rows.append(f"{words(5)} Write to: user{i}@mail{i % 7}.example.com, {words(4)}")
        rows.append(f"{words(4)} version {i}.{i % 4} {words(3)} page {number(3)}")
    rows += [f"{words(3)} Call me at {number(3)}-{number(4)} tonight {words(2)}" for _ in range(5)]  # no plus sign: unseen
    rows += [f"{words(3)} write to user3 (at) mail3 (dot) example (dot) com {words(2)}"]  # a known address, spelt out
    rows += [f"ring {x} now" for x in range(5551000, 5551006)]  # a context without seeds
    rows += [f"call me at 555-{1000 + i} {words(2)}" for i in range(6)]  # through these the values above are known
    rows += [f"ring {number(3)}-{number(4)} now" for i in range(3)]  # and these in a second round
    return rows


def test_bootstrap_equals_a_plain_run(spark, frame):
    texts = corpus() + corpus()[:10] + ["", "no digits"]
    found = extracted(frame(list(enumerate(texts)))).cache()
    got = {r.value: (r.kind, round(r.sure, 9)) for r in bootstrap(found).collect()}
    want = {v: (k, round(s, 9)) for v, (k, s) in plain_bootstrap(texts).items()}
    assert got == want and sum(s < 1 for _, s in got.values()) == 14


def test_what_is_added(spark, frame):
    texts = corpus()
    got = {r.doc_id: r for r in personal_data(frame(list(enumerate(texts)))).collect()}
    clean = [i for i, t in enumerate(texts) if "version" in t]
    assert clean and all(not got[i].base and not got[i].added for i in clean)
    added = {(KINDS[s.kind], texts[i][s.start : s.end]) for i, r in got.items() for s in r.added}
    assert ("email", "user3 (at) mail3 (dot) example (dot) com") in added
    assert sum(k == "phone" for k, _ in added) >= 14 and {k for k, _ in added} == {"email", "phone"}
    for i, r in got.items():
        assert [tuple(s) for s in r.base] == plain_base(texts[i])
        assert all(s.end <= b.start or b.end <= s.start for s in r.added for b in r.base)


def test_odd_rows(spark, frame, odd):
    rows = [*odd, (30, "mail bob@x.org"), (30, "mail bob@x.org"), (None, "call +1 234 567 8901"), (31, "👍 bob@x.org é 10.0.0.1")]
    got = sorted((str(r.doc_id), [tuple(s) for s in r.base], len(r.added)) for r in personal_data(frame(rows)).collect())
    assert got == sorted((str(i), plain_base(t or ""), 0) for i, t in rows)
    assert personal_data(frame([])).count() == 0


def test_op11(spark, frame, tmp_path):
    texts = corpus()
    frame(list(enumerate(texts)) + [(900, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in entry.queries()["op11_personal_data"](spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts) + 1
    for i, t in [*enumerate(texts), (900, "")]:
        base = plain_base(t)
        written = [f"{KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert rows[i].base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in KINDS] == [sum(x[0] == j for x in base) for j in range(4)]
        spans = rows[i].spans.split(",") if rows[i].spans else []
        assert set(written) <= set(spans) and len(spans) == len(base) + rows[i].n_added
        assert spans == sorted(spans, key=lambda s: (KINDS.index(s.split(":")[0]), int(s.split(":")[1])))
