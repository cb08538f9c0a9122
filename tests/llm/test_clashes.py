"""Columns that an operator uses itself, ids of other types and repeated ids."""

from collections import defaultdict

from orrery.llm.exact_dedup import exact_groups
from orrery.llm.fingerprints import edited_fingerprints, with_next
from orrery.llm.packing import pack


def test_pack_keeps_other_columns(spark):
    rows = [(i, 1 + i % 9, 100 + i, f"s{i}", i, -1) for i in range(60)]
    got = pack(spark.createDataFrame(rows, "id long, length long, offset long, _salt string, _rank long, sequence_id long"), capacity=10, order=["id"])
    assert sorted(got.columns) == sorted(["id", "length", "_salt", "_rank", "sequence_id", "offset"])
    bins = defaultdict(list)
    for r in got.collect():
        assert (r._salt, r._rank) == (f"s{r.id}", r.id)
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 10


def test_next_of_clashing_columns(spark):
    rows = [(i, f"t{i}", 5, 6, True) for i in range(40)]
    got = with_next(spark.createDataFrame(rows, "doc_id long, text string, _k int, _tie int, _copy boolean"), ["text"])
    for r in got.collect():
        assert (r._k, r._tie, r._copy, r.next_text) == (5, 6, True, f"t{(r.doc_id - 1) % 40}")


def test_text_ids(spark):
    rows = [("3", "a b c d e f g"), ("x", "other words"), ("2", "b"), (None, None), ("10", "c")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: r for r in edited_fingerprints(df).collect()}
    assert set(got) == {"3", "x", "2", "10", None}
    assert got["10"].edited == "c" and got["3"].edited == "a b c db"  # after 3 comes 2, whose text has one character
    assert {r.doc_id for r in exact_groups(df).collect()} == set(got)


def test_one_id_with_two_texts(spark):
    rows = [(5, "a b"), (5, "ab"), (6, "ab"), (7, "x"), (7, "x")]
    got = exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(5, 5, 3, False), (5, 5, 3, True), (6, 5, 3, False), (7, 7, 2, True), (7, 7, 2, True)]
