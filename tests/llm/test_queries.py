"""Every registered query over small tables, with the digests that its contract asks for."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import __spark_entry__ as entry
from orrery.llm.queries import TOKENIZER

TEXTS = [f"Text {i} says: all rights reserved by house {i % 7}.\nA common line.\n" + " ".join(f"word{(i * k) % 53}" for k in range(1 + i % 60)) for i in range(120)]


@pytest.fixture(scope="module")
def tables(spark, frame, odd, tmp_path_factory):
    """A folder of tables, their rows by id, and one of tables without rows."""
    full, empty = (str(tmp_path_factory.mktemp(n)) for n in ("full", "empty"))
    named = {i: t for i, t in odd if i is not None and i != 5} | {100 + i: t for i, t in enumerate(TEXTS)} | {400: TEXTS[3], 401: TEXTS[3] + " end"}
    for folder, rows in ((full, list(named.items()) + [(None, "a  b c"), (None, None)]), (empty, [])):
        frame([(i, t, f"s{(i or 0) % 3}") for i, t in rows]).write.parquet(f"{folder}/documents.parquet")
        marks = [(i, i % 2, int(i % 5 == 0)) for i, _ in rows if i is not None and i >= 100]
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        vectors = [(i, [((i * k) % 7) / 7 - 0.2 for k in range(1, 9)], i % 3) for i, _ in rows if i is not None]
        spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return full, named, empty


def run(spark, tables, name):
    return [r for r in entry.queries()[name](spark, tables[0]).collect() if r.doc_id is not None]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", [n for n in entry.queries() if re.match(r"op\d+_|pipeline$", n)])
def test_no_rows(spark, tables, name):
    assert entry.queries()[name](spark, tables[2]).count() == 0


def test_op1(spark, tables):
    got = {r.doc_id: r for r in run(spark, tables, "op1_toxicity")}
    assert set(got) == set(tables[1])
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_op2(spark, tables):
    got = run(spark, tables, "op2_ring_shards")
    slots = defaultdict(list)
    for r in got:
        data = (tables[1][r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None) and 0 <= r.shard < 40
    for r in entry.queries()["op2_ring_shards"](spark, tables[0]).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op4(spark, tables):
    library = Tokenizer.from_file(TOKENIZER)
    library.no_truncation()
    held = defaultdict(list)
    pieces = defaultdict(list)
    for r in entry.queries()["op4_pack_min_slack"](spark, tables[0]).collect():
        held[r.sequence_id].append((r.offset, r.length))
        if r.doc_id is not None:
            pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    for i, t in tables[1].items():
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = [ids[a : a + 2048] for a in range(0, len(ids), 2048)]
        assert sorted(pieces[i]) == [(k, 2048 * k, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cuts)]


def test_op5(spark, tables):
    library = Tokenizer.from_file(TOKENIZER)
    library.no_truncation()
    for r in run(spark, tables, "op5_bpe_round_trip"):
        ids = library.encode(tables[1][r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_op6(spark, tables):
    got = {r.doc_id: r for r in run(spark, tables, "op6_simhash_groups")}
    low = {i: (t or "").encode().lower().split() for i, t in tables[1].items()}
    for i, words in low.items():
        parts = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
        assert got[i].fingerprint == f"{bits:016x}"
    assert got[400].component_id == got[103].component_id <= 103 and got[1].component_id == 1 == got[2].component_id


def test_op7(spark, tables):
    got = {r.doc_id: r for r in run(spark, tables, "op7_license_scan")}
    for i in range(120):
        r = got[100 + i]
        assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (1, 3, 3, "reserved") and "reserved" in r.labels.split(",") and r.score == 1.0
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].labels, got[1].score) == (0, 0, None, "", 0.0)


def test_op8(spark, tables):
    got = {r.doc_id: r for r in run(spark, tables, "op8_fingerprints")}
    order = sorted(tables[1], reverse=True)
    for k, i in enumerate(order[:-1]):  # rows without an id follow the last
        text, after = tables[1][i] or "", tables[1][order[k + 1]] or ""
        half = len(text) // 2
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == sha(text[: len(text) - half] + after[:half])
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[400].fingerprint == got[103].fingerprint


def test_op10(spark, tables):
    got = {r.doc_id: r for r in run(spark, tables, "op10_hmm_scores")}
    counts = Counter()
    everything = list(tables[1].items()) + [(None, "a  b c"), (None, None)]
    for i, t in everything:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            counts.update((t or "").encode().lower().split() + [b""])
    total = sum(counts.values())
    for i, t in tables[1].items():
        words = (t or "").encode().lower().split() + [b""]
        want = sum(np.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in words)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert got[i].base_score == pytest.approx(want) and got[i].score < 0
