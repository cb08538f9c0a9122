"""Slices of Arrow batches, bounded by bytes rather than by rows, their words as arrays, and a memory of what words gave."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
BATCH_BYTES = 8 << 20
LONG_KEY = 100  # bytes; longer keys are not remembered
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd
#: By byte: ASCII white space, and what lower-casing A-Z makes of it.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)


def whole_texts(docs):
    """``docs``, after a look at the session: batches that take whole texts to Python and back
    hold ``BATCH_BYTES`` at most, however many rows that is."""
    conf = docs.sparkSession.conf
    for way in ("maxBytesPerBatch", "maxBytesPerOutputBatch"):
        name = f"spark.sql.execution.arrow.{way}"
        if not 0 < int(conf.get(name).rstrip("b")) <= BATCH_BYTES:
            conf.set(name, f"{BATCH_BYTES}b")
    return docs


def slices(batches, column: str, most: int = SLICE_BYTES):
    """Slices of at most ``most`` bytes of ``column``, or of one row.  When the
    task's rows end, memory that Python no longer uses goes back to the system,
    since workers live on for other tasks."""
    try:
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(lengths.astype(np.int64)) // most
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield batch.slice(a, b - a)
    finally:
        release()


def text_slices(batches, column: str, most: int = SLICE_BYTES):
    """(slice, texts) for each of the ``slices``; null texts come as empty."""
    for piece in slices(batches, column, most):
        yield piece, [t or "" for t in piece.column(column).to_pylist()]


def release() -> None:
    """Hands memory that is free but still held back to the system, where the C library can do so."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def word_runs(texts: pa.Array, apart: np.ndarray, fold: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words as bytes, number of each word among them, words of each text).

    Words are the runs of bytes that ``apart`` does not name, after ``fold`` has
    mapped every byte; neither may cut a UTF-8 sequence.  Null texts have none.
    """
    raw = pc.fill_null(texts.cast(pa.binary()), b"")
    ends = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    store = raw.buffers()[2]
    data = np.frombuffer(store, dtype=np.uint8)[ends[0] : ends[-1]] if store is not None else np.zeros(0, dtype=np.uint8)
    ends -= ends[0]
    inside = ~apart[data]
    first = np.zeros(len(data) + 1, dtype=bool)  # does a word begin here?
    first[1:-1] = ~inside[:-1]
    first[ends] = True  # also after the last byte
    starts = np.flatnonzero(first[:-1] & inside)
    last = first[1:].copy()  # does a word end here?
    last[:-1] |= ~inside[1:]
    sizes = np.flatnonzero(last & inside) + 1 - starts
    kept = data[inside] if fold is None else fold[data[inside]]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), np.diff(np.searchsorted(starts, ends))


def lists(counts: np.ndarray, values) -> pa.ListArray:
    """Lists of ``counts`` of the ``values``, one after the other."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


class Remembered:
    """Runs of 32-bit numbers by the hash of a key, in sorted arrays: a tenth of the
    room of a dictionary of strings.  Bounded by bytes: when the younger half is full it
    becomes the older one, which goes."""

    def __init__(self):
        self.young = self.old = (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32))

    def find(self, hashed: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start in the ids returned or -1, number, ids)."""
        start, size = np.full(len(hashed), -1, dtype=np.int64), np.zeros(len(hashed), dtype=np.int64)
        for keys, checks, starts, sizes, _, base in ((*self.old, len(self.young[4])), (*self.young, 0)):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
                hit = (keys[at] == hashed) & (checks[at] == check)
                start[hit], size[hit] = base + starts[at[hit]], sizes[at[hit]]
        return start, size, np.concatenate([self.young[4], self.old[4]])

    def keep(self, hashed: np.ndarray, check: np.ndarray, pool: np.ndarray, start: np.ndarray, size: np.ndarray, most: int) -> None:
        keys, checks, starts, sizes, ids = self.young
        more = (hashed, check, len(ids) + np.cumsum(size) - size, size)
        order = np.argsort(np.concatenate([keys, hashed]), kind="stable")
        self.young = (*(np.concatenate(x)[order].astype(x[0].dtype) for x in zip((keys, checks, starts, sizes), more)), np.concatenate([ids, runs(pool, start, size)]).astype(np.uint32))
        if 2 * sum(x.nbytes for x in self.young) > most:
            self.old, self.young = self.young, tuple(x[:0] for x in self.young)


def runs(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """pool[start : start + size] for each run, one after the other."""
    return pool[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def key_hashes(keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64 bits, 32 other bits, has it at most ``LONG_KEY`` bytes) for each key; hashes of longer ones mean nothing."""
    ends = np.frombuffer(keys.buffers()[1], dtype=np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64)
    store = keys.buffers()[2]
    data = np.frombuffer(store, dtype=np.uint8)[ends[0] : ends[-1]] if store is not None else np.zeros(0, dtype=np.uint8)
    size = np.diff(ends)
    inside = np.minimum(np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], size), LONG_KEY)
    found = []
    for weight, power in BYTE_HASHES:
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(weight[data] * power[inside], dtype=np.uint64)])[ends - ends[0]]
        found.append(np.diff(sums) ^ (size.astype(np.uint64) * BASE))
    return found[0], (found[1] >> np.uint64(32)).astype(np.uint32), size <= LONG_KEY


def _byte_hashes() -> list[tuple[np.ndarray, np.ndarray]]:
    """Two times (odd weight of each byte, power of an odd base for each place)."""
    r = np.random.default_rng(5)
    out = []
    for _ in range(2):
        weight = r.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = np.full(LONG_KEY + 1, r.integers(0, 1 << 60, dtype=np.uint64) * np.uint64(8) + np.uint64(5))
        base[0] = 1
        out.append((weight, np.cumprod(base, dtype=np.uint64)))
    return out


BYTE_HASHES = _byte_hashes()


def recalled(cache: Remembered, keys: pa.Array, compute, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, how many for each) of distinct ``keys``: remembered, or else computed and remembered if the key isn't long."""
    hashed, check, short = key_hashes(keys)
    start, size, pool = cache.find(hashed, check)
    new = np.flatnonzero((start < 0) | ~short)
    flat, sizes = compute(keys.take(pa.array(new)))
    start[new], size[new] = len(pool) + np.cumsum(sizes) - sizes, sizes
    pool = np.concatenate([pool, flat])
    kept = new[short[new]]
    cache.keep(hashed[kept], check[kept], pool, start[kept], size[kept], most)
    return runs(pool, start, size), size
