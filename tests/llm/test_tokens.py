import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from orrery.llm.bpe import WordBpe, encode_decode
from orrery.llm.packing import fullest, pack_documents, plan_bins

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a\x0bb c\x0cd", "ÀÉ naïve don't I'LL x<|endoftext|>y <|ENDOFTEXT|>", "日本語 テスト 한국어 é ﬁ Ⅷ ² ½ İstanbul Σίσυφος ΣΑΣ", "a" * 500, "aaa aaaa aaaaa", " x y​z\u0085q", "👍🏽 emoji 🇩🇪", "1234567 12a3", "''''s 's 't're", "\x00\x01 \x1c\x1d a\x1fb", "ǅ ŉ ẞ", "x\ty\rz\r\n\n w"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def bpe():
    return WordBpe(PATH)


def random_texts(n):
    r = random.Random(5)
    syllables = ["th", "er", "ing", "ción", "ß", "aa", "x", "Qu", "é", "1", "'", "-", "<|", "ſ", "ab"]
    return ["".join(r.choice(syllables) for _ in range(r.randint(1, 30))) for _ in range(n)]


def test_encoder_equals_library(bpe, library):
    texts = ODD + random_texts(3000)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(texts)] == want


def test_pair_verdicts_equal_exact_merging(bpe):
    words = [w for t in random_texts(500) for w in bpe.lines.findall(t.lower()) if w.isascii()]
    got = bpe.words_to_ids(words)
    assert got == bpe._merge(words) == [bpe._merge_long(w) for w in words]
    stood = sum(np.array(bpe._propose(w), "<u4").tobytes() == ids for w, ids in zip(words, got))
    assert 0 < stood < len(words)  # some proposals stand, some do not


def test_cache_halves(bpe, library, monkeypatch):
    monkeypatch.setattr(bpe, "cached_chunks", 50)
    monkeypatch.setattr(bpe, "cached_words", 20)
    for t in random_texts(200) + ODD:
        assert np.frombuffer(bpe.encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_round_trip(frame, odd, library):
    rows = {r.doc_id: r for r in encode_decode(frame(odd), PATH).collect() if r.doc_id is not None}
    for i, t in odd:
        if i is not None:
            ids = library.encode(t or "", add_special_tokens=False).ids
            assert rows[i].ids == ids and rows[i].decoded == library.decode(ids, skip_special_tokens=False)
    assert encode_decode(frame([]), PATH).count() == 0


def test_fullest_against_brute_force():
    r = random.Random(3)
    for _ in range(60):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(5)}
        room = r.randint(1, 60)
        used = fullest(counts, room)
        sums = {0}
        for x, n in counts.items():
            for _ in range(n):
                sums |= {s + x for s in sums if s + x <= room}
        assert sum(x * n for x, n in used.items()) == max(sums)
        assert all(n <= counts[x] for x, n in used.items())


def test_plan_uses_every_piece():
    r = random.Random(4)
    counts = {x: r.randint(1, 20) for x in range(1, 101)}
    plan = plan_bins(counts, 100)
    back = defaultdict(int)
    for bins, used in plan:
        assert sum(x * n for x, n in used.items()) <= 100
        for x, n in used.items():
            back[x] += bins * n
    assert back == counts
    room: list[int] = []  # best fit of falling lengths, piece by piece
    for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fits = [k for k, free in enumerate(room) if free >= x]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= x
        else:
            room.append(100 - x)
    assert sum(b for b, _ in plan) <= len(room)


def test_packing(frame, odd, library):
    rows = [r for r in odd if r[0] is not None] + [(100 + i, "word " * (i % 700)) for i in range(500)]
    rows = list({i: (i, t) for i, t in rows}.values())
    got = pack_documents(frame(rows), PATH).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    places = defaultdict(list)
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert [p.length for p in pieces] == [min(2048, len(ids) - s) for s in range(0, len(ids), 2048)]
        for k, p in enumerate(pieces):
            assert p.piece == k and p.start == 2048 * k
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
            places[p.sequence_id].append((p.offset, p.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(places) <= -(-total // 2048) + 1
    assert pack_documents(frame([]), PATH).count() == 0
    assert pack_documents(frame(odd), PATH).where("doc_id is null").count() == 2
