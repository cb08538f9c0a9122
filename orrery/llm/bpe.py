"""Word-level BPE: speculate by longest match, verify by pairs, merge exactly only what fails.

A proposal is the BPE result of a word if and only if no merge crosses the border
of two neighbouring tokens before both are complete.  Whether that is so for two
tokens depends on them alone, so verdicts on pairs are computed for arrays of
pairs at once and remembered.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
from itertools import chain
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from orrery.llm.batches import BASE, SLICE_BYTES, Remembered, lists, recalled, release, slices, whole_texts, word_runs

NEVER = np.int64(1) << 40
NO_RANK = np.int32(2**31 - 1)
#: Beside plain characters, which every Unicode version treats alike: chunks with these, or with what may start a special token, are normalised and split by the library.
ODD = re.compile(r"[^\n!-~¡-¬®-ɏ]|<\|")
#: Chunks end at these bytes.
APART = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0D])
CACHE_BYTES = 64 << 20  # of the chunks and words that a worker remembers
KNOWN_PAIRS = 200_000
SHORT = (3, 2, 1)
LONG_WORD = 40  # characters; longer ones one by one
MERGED_AT_ONCE = 8192


class WordBpe:
    """Encoder and decoder for a tokenizers JSON file of a BPE with word ends."""

    def __init__(self, path: str, cached: int = CACHE_BYTES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.path = spec["model"], path
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.by_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.lines = regex.compile(r"\n|" + split["pattern"]["Regex"])
        vocab = dict(model["vocab"])
        self.names = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for name, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = name
        self.inner = {k: i for k, i in vocab.items() if not k.endswith(self.end)}
        self.final = {k[: -len(self.end)]: i for k, i in vocab.items() if k.endswith(self.end)}
        starts: dict[str, set[int]] = {}
        for name in self.inner:
            starts.setdefault(name[:4], set()).add(len(name))
        #: Lengths of the tokens that may stand at a place, longest first, by its first four characters.
        self.sizes = {k: tuple(sorted(v | {n for n in (1, 2, 3) if k[:n] in self.inner}, reverse=True)) for k, v in starts.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self._learn([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.byte_names = _byte_names()
        self._index()
        self.shown = pa.array(self.names, pa.string())
        self.cached_chunks, self.cached_words = cached * 5 // 8, cached * 3 // 8
        self.chunks, self.words = Remembered(), Remembered()
        self.known: dict[int, bool] = {}
        del spec, model, vocab, starts, pairs
        release()

    @cached_property
    def library(self):
        """For odd chunks, where there are any."""
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self.path)
        library.no_truncation()
        library.no_padding()
        return library

    @cached_property
    def rank(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(rank, token made) by pair, for long words, where there are any."""
        n = len(self.names)
        return {(int(key) // n, int(key) % n): (int(r), int(self.made_by[r])) for key, r in zip(self.keys, self.key_rank)}

    def _learn(self, merges: list[tuple[int, int, int]]) -> None:
        """Merge ranks by pair, and the edges of each token in the order in which they come into being."""
        n = len(self.names)
        made = np.full(n + 1, NEVER)
        left, right = [[i] for i in range(n)], [[i] for i in range(n)]
        inner = np.zeros((len(merges), 2), dtype=np.int64)
        for r, (a, b, c) in enumerate(merges):
            made[c], inner[r] = r, (a, b)
            left[c], right[c] = left[a] + [c], right[b] + [c]
        depth = max(map(len, left + right)) + 1
        self.left, self.right = (np.array([x + [n] * (depth - len(x)) for x in side], dtype=np.int32) for side in (left, right))
        self.made = made  # of the pad n: never
        keys = np.array([a * n + b for a, b, _ in merges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], order.astype(np.int64)
        self.made_by = np.array([c for _, _, c in merges], dtype=np.int64)
        broken = self._crossed(inner[:, 0], inner[:, 1], made[self.made_by])
        self.sound = np.ones(n, dtype=bool)
        for r, (a, b, c) in enumerate(merges):  # a token that its own text does not give is never proposed with success
            self.sound[c] = self.sound[a] and self.sound[b] and not broken[r]

    def _crossed(self, a: np.ndarray, b: np.ndarray, before=NEVER) -> np.ndarray:
        """For each pair of tokens: does a merge over their border, of a rank under
        ``before``, come before both are complete?"""
        n = len(self.names)
        i, j = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
        before = np.broadcast_to(np.asarray(before, dtype=np.int64), a.shape)
        out, live = np.zeros(len(a), dtype=bool), np.arange(len(a))
        while len(live):
            x, y = self.right[a[live], i[live]], self.left[b[live], j[live]]
            x_ends = self.made[self.right[a[live], i[live] + 1]]
            y_ends = self.made[self.left[b[live], j[live] + 1]]
            key = x.astype(np.int64) * n + y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            over = np.where(self.keys[at] == key, self.key_rank[at], NEVER)
            hit = (over < x_ends) & (over <= y_ends) & (over < before[live])  # of equal pairs the leftmost merges first
            out[live[hit]] = True
            go = ~hit & ((x_ends < NEVER) | (y_ends < NEVER))
            first = x_ends <= y_ends
            i[live[go & first]] += 1
            j[live[go & ~first]] += 1
            live = live[go]
        return out

    def _propose(self, word: str) -> list[int]:
        """The longest token at each place, the last one with the word end."""
        out, i, n = [], 0, len(word)
        final, inner, sizes = self.final, self.inner, self.sizes
        while True:
            t = final.get(word[i:])
            if t is not None:
                out.append(t)
                return out
            for size in sizes.get(word[i : i + 4], SHORT):
                if i + size < n:
                    t = inner.get(word[i : i + size])
                    if t is not None:
                        out.append(t)
                        i += size
                        break
            else:
                return []

    def _merge(self, words: list[str]) -> list[bytes]:
        """The exact results: in every word at once the pair of the lowest rank, of
        equal ones the leftmost, merges until no pair is left."""
        n, width, names = len(words), max(map(len, words)), len(self.names)
        ids = np.full((n, width + 1), -1, dtype=np.int32)
        inner, final = self.inner, self.final
        for k, w in enumerate(words):
            ids[k, : len(w)] = [inner[c] for c in w[:-1]] + [final[w[-1]]]
        after = np.tile(np.arange(1, width + 2, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, width, dtype=np.int32), (n, 1))

        def rank(a, b):
            key = a.astype(np.int64) * names + b
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            return np.where((a >= 0) & (b >= 0) & (self.keys[at] == key), self.key_rank[at], NO_RANK).astype(np.int32)

        ranks = rank(ids[:, :-1], ids[:, 1:])
        live = np.arange(n)
        while len(live):
            k = ranks[live].argmin(axis=1)
            best = ranks[live, k]
            go = best < NO_RANK
            live, k, best = live[go], k[go], best[go]
            r = after[live, k]
            ids[live, k], ids[live, r] = self.made_by[best], -1
            ranks[live, np.minimum(r, width - 1)] = NO_RANK  # the last column has no rank
            nxt = after[live, r]
            end = np.minimum(nxt, width)
            after[live, k] = nxt
            before[live, end] = k
            p = before[live, k]
            q = p >= 0
            new = rank(np.concatenate([ids[live, k], ids[live[q], p[q]]]), np.concatenate([ids[live, end], ids[live[q], k[q]]]))
            ranks[live, k] = new[: len(live)]
            ranks[live[q], p[q]] = new[len(live) :]
        kept = ids >= 0
        flat, ends = ids[kept].astype("<u4").tobytes(), np.cumsum(kept.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _merge_long(self, word: str) -> bytes:
        """As ``_merge``, with a heap, for a word of many characters."""
        ids = [self.inner[c] for c in word[:-1]] + [self.final[word[-1]]]
        nxt, prv = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(self.rank[p][0], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            r = nxt[k]
            if ids[k] != a or r >= len(ids) or ids[r] != b:
                continue
            ids[k], ids[r] = self.rank[a, b][1], -1
            nxt[k] = nxt[r]
            if nxt[k] < len(ids):
                prv[nxt[k]] = k
            for at in (prv[k], k):
                if at >= 0 and nxt[at] < len(ids) and (p := (ids[at], ids[nxt[at]])) in self.rank:
                    heapq.heappush(heap, (self.rank[p][0], at, *p))
        return np.array([t for t in ids if t >= 0], dtype="<u4").tobytes()

    def _index(self) -> None:
        """Sorted hashes of the texts of inner and final tokens, and by the hash of four
        characters the set of lengths, as bits, of the inner tokens that start with them."""
        r = np.random.default_rng(3)
        self.weight = r.integers(1, 1 << 63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        n = LONG_WORD + 1
        self.power, self.unpower = np.ones(n, dtype=np.uint64), np.ones(n, dtype=np.uint64)
        self.power[1:], self.unpower[1:] = BASE, pow(int(BASE), -1, 1 << 64)
        self.power, self.unpower = np.cumprod(self.power), np.cumprod(self.unpower)
        def hashed(names):
            return np.array([int(self._sums(name)[-1]) for name in names], dtype=np.uint64)

        def table(names: dict[str, int]):
            some = {k: i for k, i in names.items() if 0 < len(k) <= LONG_WORD}
            keys, ids = hashed(some), np.array(list(some.values()), dtype=np.int64)
            order = np.argsort(keys)
            return keys[order], ids[order]

        self.inner_table, self.final_table = table(self.inner), table(self.final)
        bits = {k: sum(1 << n for n in v if n <= LONG_WORD) for k, v in self.sizes.items() if len(k) == 4}
        keys, masks = hashed(bits), np.array(list(bits.values()), dtype=np.int64)
        order = np.argsort(keys)
        self.start_table = keys[order], masks[order]
        self.text = [k.removesuffix(self.end) for k in self.names]
        self.text_ends = np.cumsum([0, *map(len, self.text)])
        self.text_codes = np.frombuffer("".join(self.text).encode("utf-32-le"), dtype="<u4")

    def _sums(self, word: str) -> np.ndarray:
        codes = np.frombuffer(word.encode("utf-32-le"), dtype="<u4")
        return np.cumsum(self.weight[codes & 511] * self.power[: len(codes)], dtype=np.uint64)

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return np.where(table[0][at] == keys, table[1][at], -1)

    def _propose_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``_propose`` of words of up to ``LONG_WORD`` characters at once: (tokens, number of each word's).

        Texts are compared by hashes of sums, and in the end for themselves: a word
        that its proposal does not spell has none."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        start = np.cumsum(size) - size
        inside = np.arange(len(codes)) - np.repeat(start, size)
        sums = np.cumsum(np.concatenate([np.zeros(1, dtype=np.uint64), self.weight[codes & 511] * self.power[inside]]), dtype=np.uint64)

        def hashed(word, at, length):
            a = start[word] + at
            return (sums[a + length] - sums[a]) * self.unpower[at]

        word, at, owners, tokens, order = np.arange(len(words)), np.zeros(len(words), dtype=np.int64), [], [], []
        lost = np.zeros(len(words), dtype=bool)
        turn = 0
        while len(word):
            rest = size[word] - at
            token = self._look(self.final_table, hashed(word, at, rest))
            ends = token >= 0
            owners.append(word[ends])
            tokens.append(token[ends])
            order.append(np.full(int(ends.sum()), turn))
            word, at, rest = word[~ends], at[~ends], rest[~ends]
            masks = np.full(len(word), 14, dtype=np.int64)  # lengths 1, 2 and 3
            four = np.flatnonzero(rest >= 4)
            found = self._look(self.start_table, hashed(word[four], at[four], 4))
            masks[four] = np.where(found >= 0, found, 14)
            masks &= (np.int64(1) << rest) - 1  # the last character belongs to a final token
            took = np.zeros(len(word), dtype=np.int64)
            token = np.full(len(word), -1, dtype=np.int64)
            left = np.flatnonzero(masks)
            while len(left):
                length = np.frexp(masks[left].astype(np.float64))[1].astype(np.int64) - 1
                t = self._look(self.inner_table, hashed(word[left], at[left], length))
                hit = t >= 0
                token[left[hit]], took[left[hit]] = t[hit], length[hit]
                left, length = left[~hit], length[~hit]
                masks[left] &= ~(np.int64(1) << length)
                left = left[masks[left] != 0]
            go = token >= 0
            lost[word[~go]] = True
            word, at, token, took = word[go], at[go], token[go], took[go]
            owners.append(word)
            tokens.append(token)
            order.append(np.full(len(word), turn))
            at = at + took
            turn += 1
        owner, token = np.concatenate(owners), np.concatenate(tokens)
        sort = np.lexsort((np.concatenate(order), owner))
        owner, token = owner[sort], token[sort]
        keep = ~lost[owner]
        owner, token = owner[keep], token[keep]
        n = self.text_ends[token + 1] - self.text_ends[token]
        spelt = self.text_codes[np.repeat(self.text_ends[token] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        wrong = np.repeat(owner, n)[spelt != codes[~lost[np.repeat(np.arange(len(words)), size)]]]
        if len(wrong):
            keep = ~np.isin(owner, wrong)
            owner, token = owner[keep], token[keep]
        return token, np.bincount(owner, minlength=len(words))

    def words_to_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words already split and in byte characters, as little-endian 32-bit numbers."""
        if any(len(w) > LONG_WORD for w in words):
            proposed = [self._propose(w) for w in words]
            counts = np.fromiter(map(len, proposed), dtype=np.int64, count=len(words))
            flat = np.fromiter(chain.from_iterable(proposed), dtype=np.int64, count=int(counts.sum()))
        else:
            flat, counts = self._propose_all(words)
        owner = np.repeat(np.arange(len(words)), counts)
        bad = counts == 0
        bad[owner[~self.sound[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, dtype=np.int64)
        if len(inner):
            pairs, back = np.unique(flat[inner] * len(self.names) + flat[inner + 1], return_inverse=True)
            known = self.known
            verdict = [known.get(p) for p in pairs.tolist()]
            new = np.array([k for k, v in enumerate(verdict) if v is None], dtype=np.int64)
            if len(new):
                crossed = self._crossed(pairs[new] // len(self.names), pairs[new] % len(self.names))
                if len(known) > KNOWN_PAIRS:
                    known.clear()
                for k, v in zip(new.tolist(), crossed.tolist()):
                    verdict[k] = known[int(pairs[k])] = v
            bad[owner[inner[np.array(verdict, dtype=bool)[back]]]] = True
        data, ends = flat.astype("<u4").tobytes(), np.cumsum(counts) * 4
        out = [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        failed = np.flatnonzero(bad).tolist()
        short = sorted((k for k in failed if len(words[k]) <= LONG_WORD), key=lambda k: len(words[k]))
        for at in range(0, len(short), MERGED_AT_ONCE):
            part = short[at : at + MERGED_AT_ONCE]
            for k, ids in zip(part, self._merge([words[k] for k in part])):
                out[k] = ids
        for k in failed:
            if len(words[k]) > LONG_WORD:
                out[k] = self._merge_long(words[k])
        return out

    def _odd(self, chunk: str) -> bytes:
        """Ids of a chunk that the library normalises and splits; special tokens stand for themselves."""
        out = []
        for part in self.by_special.split(chunk) if self.by_special else [chunk]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                out += self.words_to_ids([w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))])
        return b"".join(out)

    def _new_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of distinct chunks."""
        names = chunks.cast(pa.string()).to_pylist()
        odd = [k for k, c in enumerate(names) if ODD.search(c)] if ODD.search("\n".join(names)) else []
        if odd:
            apart = set(odd)
            plain = [k for k in range(len(names)) if k not in apart]
            parts = [self._odd(names[k]) for k in odd]
            flat, sizes = self._new_chunks(chunks.take(pa.array(plain, pa.int64())))
            sizes = np.concatenate([sizes, np.fromiter(map(len, parts), dtype=np.int64, count=len(odd)) // 4])
            both = lists(sizes, np.concatenate([flat, np.frombuffer(b"".join(parts), dtype="<u4")])).take(pa.array(np.argsort(plain + odd)))
            return both.flatten().to_numpy(), np.diff(both.offsets.to_numpy())
        found = self.lines.findall("\n".join(names).lower() + "\n") if names else []  # words, and a line end after each chunk
        words = pa.array(found, pa.string()).dictionary_encode()
        index = words.indices.to_numpy()
        flat, sizes = recalled(self.words, words.dictionary.cast(pa.binary()), self._new_words, self.cached_words)
        ends = np.flatnonzero(index == words.dictionary.index("\n").as_py()) if names else np.zeros(0, dtype=np.int64)
        until = np.cumsum(sizes[index])[ends] if names else ends
        return lists(sizes, flat).take(words.indices).flatten().to_numpy(), np.diff(until, prepend=0)

    def _new_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of distinct words in lower case; line ends have none."""
        names = [w if w.isascii() else w.encode().decode("latin-1").translate(self.byte_names) for w in words.cast(pa.string()).to_pylist()]
        parts = [b""] * len(names)
        for some in ([k for k, w in enumerate(names) if len(w) <= LONG_WORD and w != "\n"], [k for k, w in enumerate(names) if len(w) > LONG_WORD]):
            for k, ids in zip(some, self.words_to_ids([names[k] for k in some]) if some else ()):
                parts[k] = ids
        return np.frombuffer(b"".join(parts), dtype="<u4"), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text).  Chunks
        between spaces and line ends are encoded once: no word and no
        normalisation reaches over them."""
        collects = gc.isenabled()
        gc.disable()  # only strings and lists of them are made, no cycles to look for
        chunks, index, counts = word_runs(texts, APART)
        flat, sizes = recalled(self.chunks, chunks, self._new_chunks, self.cached_chunks)
        taken = lists(sizes, flat).take(pa.array(index))
        ends = taken.offsets.to_numpy()[np.concatenate([[0], np.cumsum(counts)])]
        if collects:
            gc.enable()
        return taken.values.to_numpy()[ends[0] : ends[-1]], np.diff(ends)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        flat, counts = self.encode_column(pa.array(texts, pa.string()))
        data, ends = flat.astype("<u4").tobytes(), np.cumsum(counts) * 4
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def decode_column(self, flat: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The library's decoding for a file without a decoder: token names between spaces."""
        return pc.binary_join(lists(counts, self.shown.take(pa.array(flat))), " ")


def _byte_names() -> dict[int, str]:
    """Printable stand-ins of byte-level vocabularies: other bytes follow from 256 on, in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


@lru_cache(maxsize=1)
def encoder(path: str) -> WordBpe:
    """One encoder, with its caches, for each Python worker: whoever asks gets the same."""
    return WordBpe(path)


def encode_decode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded for every row, whole texts.

    Null and empty texts have no ids and decode to the empty text.  Null and
    repeated ids pass through; an empty table gives an empty result; other
    columns are not read.  A worker keeps caches of ``CACHE_BYTES`` at most.
    """
    rows = whole_texts(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = encoder(path)
        for piece in slices(batches, "text", SLICE_BYTES // 2):  # decoded texts need room too
            flat, counts = bpe.encode_column(piece.column("text"))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), lists(counts, flat.astype(np.int32)), bpe.decode_column(flat, counts)], names=["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
