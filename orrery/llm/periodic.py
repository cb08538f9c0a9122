"""Periodic runs of words, by power-of-two naming and grids of candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from orrery.llm.batches import SPACE, lists, runs as spans, slices, whole_texts, word_runs

SLICE_BYTES = 2 << 20  # of texts that are named together
PAIRS = 1 << 20  # candidates that are compared at once

RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _named(keys: np.ndarray) -> np.ndarray:
    """Equal numbers for equal keys; -1 for a key that stands once."""
    order = np.argsort(keys)
    new = np.diff(keys[order], prepend=keys[order[:1]] - 1) != 0
    group = np.cumsum(new) - 1
    names = np.empty(len(keys), dtype=np.int32)
    names[order] = np.where(np.bincount(group)[group] > 1, group, -1) if len(keys) else group
    return names


def levels(ids: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Names of the 2^j words from each place, for j = 0, 1, ...

    Stretches of one text have the same name if they are equal.  A stretch that
    stands once in its text, or that would pass its end, is -1 and drops out of the
    levels above, which end when nothing is left.
    """
    text = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    out = [_named(text * (int(ids.max(initial=0)) + 1) + ids)]
    half = 1
    places = np.flatnonzero(out[0] >= 0)
    while len(places):
        below = out[-1]
        places = places[places + 2 * half <= ends[places]]
        places = places[below[places + half] >= 0]
        names = _named(below[places].astype(np.int64) * (len(ids) + 1) + below[places + half])
        places, names = places[names >= 0], names[names >= 0]
        if not len(places):
            break
        level = np.full(len(ids), -1, dtype=np.int32)
        level[places] = names
        out.append(level)
        half *= 2
    return out


def _same(level: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (level[a] >= 0) & (level[a] == level[b])


def extended(named: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words that agree before, words that agree from) the places ``a`` and ``b`` on, where a < b, by descending levels."""
    before, after = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
    most = len(named[0]) - 1
    for j in range(len(named) - 1, -1, -1):
        x, y = a + after, np.minimum(b + after, most)
        after += (_same(named[j], np.minimum(x, most), y) & (b + after <= most)).astype(np.int64) << j
        x = a - before - (1 << j)
        y = b - before - (1 << j)
        before += (_same(named[j], np.maximum(x, 0), np.maximum(y, 0)) & (x >= 0)).astype(np.int64) << j
    return before, after


def find_runs(ids: np.ndarray, sizes: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in it, length, smallest period) of all runs in texts of ``sizes``
    words one after the other, by text, start and period.

    A run of period p agrees with itself p words on over w = max(least - p,
    (times - 1) p) words at least.  Every such window holds 2^m words from a place of
    the grid with step w + 1 - 2^m, so comparing the names of level m at the grid's
    places finds every run; what agrees there is extended both ways.
    """
    named = levels(ids, sizes)
    first = np.cumsum(sizes) - sizes
    at, length, period = (np.zeros(0, dtype=np.int64) for _ in range(3))
    owner = np.full(len(ids), -1, dtype=np.int32)  # a run found so far that covers a place
    text = np.repeat(np.arange(len(sizes)), sizes)
    for g in range(int(sizes.max(initial=0)).bit_length()):
        low, high = 1 << g, (2 << g) - 1
        level = int(_level(np.arange(low, high + 1), least, times)[0].min())
        if level >= len(named):
            continue
        most = np.minimum(sizes // times, high)
        repeats = np.zeros(len(sizes), dtype=bool)
        repeats[text[named[level] >= 0]] = True
        docs = np.flatnonzero(repeats & (sizes >= least) & (most >= low))
        many = most[docs] - low + 1
        doc, p = np.repeat(docs, many), low + spans(np.arange(high), np.zeros(len(docs), dtype=np.int64), many)
        m, step = _level(p, least, times)
        grid = np.maximum((sizes[doc] - p - (1 << m)) // step + 1, 0)
        cuts = np.flatnonzero(np.diff(np.cumsum(grid) // PAIRS)) + 1
        hits = []
        for a, b in zip([0, *cuts], [*cuts, len(p)]):
            row = np.repeat(np.arange(a, b), grid[a:b])
            nth = np.arange(len(row)) - np.repeat(np.cumsum(grid[a:b]) - grid[a:b], grid[a:b])
            k = first[doc[row]] + nth * step[row]
            for j in np.unique(m[a:b]):
                if j < len(named):
                    part = m[row] == j
                    x, r = k[part], row[part]
                    same = _same(named[j], x, x + p[r])
                    hits.append((x[same], p[r[same]], np.full(int(same.sum()), 1 << j)))
        if not hits:
            continue
        k, p, block = (np.concatenate(x) for x in zip(*hits))
        held = owner[k]
        # A stretch inside a run whose period divides p is that run again.
        if len(period):
            inside = (held >= 0) & (p % period[held] == 0) & (k + p + block <= at[held] + length[held])
            k, p = k[~inside], p[~inside]
        before, after = extended(named, k, k + p)
        start, size = k - before, before + after + p
        good = size >= np.maximum(least, times * p)
        new = np.unique(np.stack([start[good], size[good], p[good]], axis=1), axis=0)
        for r, (s, n, _) in enumerate(new.tolist(), len(at)):
            owner[s : s + n] = r
        at, length, period = (np.concatenate([old, new[:, c]]) for c, old in enumerate((at, length, period)))
    order = np.lexsort((period, length, at))
    at, length, period = at[order], length[order], period[order]
    own = np.ones(len(at), dtype=bool)
    own[1:] = (np.diff(at) != 0) | (np.diff(length) != 0)  # the same stretch at a multiple of its period
    at, length, period = at[own], length[own], period[own]
    order = np.lexsort((period, at))
    at, length, period = at[order], length[order], period[order]
    return text[at], at - first[text[at]], length, period


def _level(p: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(level of the names that are compared, step of the grid) for periods ``p``."""
    window = np.maximum(least - p, (times - 1) * p)
    m = np.frexp((window + 1) / 2)[1].astype(np.int64) - 1
    return m, window + 1 - (1 << m)


def periodic_runs(docs: DataFrame, *, least: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs, collapsed for every row.

    Words stand between ASCII white space and are compared byte by byte.  ``runs``
    (start, length, period, in words from 0) lists, by start and then period, every
    stretch of at least ``least`` words and ``times`` of its smallest period that
    cannot be made longer at that period.  ``collapsed`` has the words that are left,
    one space between them, if every run keeps its first period only.

    Null and empty texts have no words and no runs, and collapse to the empty text.
    Each row stands for itself: repeated rows and null ids give rows of their own, an
    empty table none, and columns but the two named are not read.  Texts are read
    whole; a task holds the texts of ``SLICE_BYTES`` or one longer text, with four
    bytes for each word and level.  ``times`` is 2 at least.
    """
    if times < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    rows = whole_texts(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for part in slices(batches, "text", SLICE_BYTES):
            words, ids, sizes = word_runs(part.column("text"), SPACE)
            text, start, length, period = find_runs(ids.astype(np.int64), sizes, least, times)
            first = np.cumsum(sizes) - sizes
            dropped = np.zeros(len(ids) + 1, dtype=np.int64)
            np.add.at(dropped, first[text] + start + period, 1)
            np.add.at(dropped, first[text] + start + length, -1)
            kept = np.cumsum(dropped[:-1]) == 0
            left = np.add.reduceat(np.append(kept, False), first, dtype=np.int64) * (sizes > 0) if len(sizes) else sizes
            joined = pc.binary_join(lists(left, words.take(pa.array(ids[kept]))), b" ").cast(pa.string())
            found = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], fields=list(RUN_TYPE))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists(np.bincount(text, minlength=len(sizes)), found), joined], names=["doc_id", "runs", "collapsed"])

    return rows.mapInArrow(run, f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")
