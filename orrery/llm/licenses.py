"""Licence scans: phrases, and an exact set-similarity join of text blocks with licence templates."""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orrery.llm.batches import text_slices, whole_texts

#: Words in a row that one block holds at least, beside twice the longest template.
SPAN = 64
THRESHOLD = 0.9  # of a template's tokens; short templates must be there whole

# Phrases that name a licence wherever their words follow each other.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Customary sentences of public licences, by label.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def split_words(text: str) -> list[bytes]:
    """Runs of ASCII digits, letters in lower case, and anything beyond ASCII, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand one after the other."""
    flat = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in phrases.items():
        key, at, counted, n = b" " + phrase.encode() + b" ", -1, 0, 0
        while (at := flat.find(key, at + 1)) >= 0:
            n += flat.count(b" ", counted, at)
            counted = at
            found.append((n, label))
    return found


class TemplateIndex:
    """Templates as token sets in ascending order of their frequency in the whole corpus.

    A block that contains ``threshold`` of a template's tokens must hold one of
    the rarest of them: the prefix of size - needed + 1 tokens.  Only blocks with a
    prefix token are looked at, and only with the templates that have it.  Blocks
    are put into the same order; tokens that no template has cannot match and
    count for nothing.
    """

    def __init__(self, templates: dict[str, list[str]], threshold: float, frequency: dict[bytes, int]):
        self.items, self.prefix = [], {}
        order = lambda t: (frequency.get(t, 0), t)
        found = [(label, split_words(text)) for label, texts in sorted(templates.items()) for text in texts]
        self.place = {t: k for k, t in enumerate(sorted({t for _, words in found for t in words}, key=order))}
        self.longest = max((len(words) for _, words in found), default=1)
        for label, words in found:
            tokens = sorted({self.place[t] for t in words})
            needed = math.ceil(threshold * len(tokens) - 1e-9)
            for at, t in enumerate(tokens[: len(tokens) - needed + 1]):
                self.prefix.setdefault(t, []).append((len(self.items), at))
            self.items.append((label, tokens, needed))
        self.keys = frozenset(t for t, k in self.place.items() if k in self.prefix)

    def matches(self, block: list[bytes]) -> dict[str, float]:
        """Containment by label of all templates that the block contains to the threshold."""
        have = sorted({self.place[t] for t in block if t in self.place})
        shared: dict[int, int] = {}  # tokens of the template's prefix met so far, or -1 for ruled out
        for j, t in enumerate(have):
            for k, i in self.prefix.get(t, ()):
                _, tokens, needed = self.items[k]
                n = shared.get(k, 0)
                if n < 0:
                    continue
                if len(have) < needed:  # length filter
                    shared[k] = -1
                    continue
                # Positional filter: what follows in the shorter of both must still suffice.
                shared[k] = n + 1 if n + min(len(tokens) - i, len(have) - j) >= needed else -1
        out, all_of = {}, set(have)
        for k, n in shared.items():
            if n > 0:
                label, tokens, needed = self.items[k]
                common = sum(t in all_of for t in tokens)
                if common >= needed:
                    out[label] = max(out.get(label, 0.0), common / len(tokens))
        return out


def _parts(words: list[bytes], span: int):
    for a in range(0, max(1, len(words) - span), span) if len(words) > 2 * span else (0,):
        yield a, words[a : a + 2 * span]


def blocks(text: str, span: int = SPAN):
    """(first word, words) of the text's blocks: its lines, and the words over all lines; long
    ones in overlapping parts, so that any ``span`` words in a row stand in one block."""
    at, lines = 0, [split_words(line) for line in text.split("\n")]
    for words in lines:
        yield from ((at + a, part) for a, part in _parts(words, span))
        at += len(words)
    if sum(map(bool, lines)) > 1:
        yield from _parts([w for words in lines for w in words], span)


def token_frequency(docs: DataFrame, tokens: set[bytes], *, text_col: str = "text") -> dict[bytes, int]:
    """How many rows of ``docs`` hold each of ``tokens``; the result is as large as ``tokens``."""
    keys = frozenset(tokens)

    def run(batches):
        count: Counter = Counter()
        for _, texts in text_slices(batches, text_col):
            for t in texts:
                count.update(keys.intersection(split_words(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["token", "n"])

    rows = whole_texts(docs).select(text_col).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["token"]): r["n"] for r in rows}


def scan(docs: DataFrame, *, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, places, matches: phrase places (word, label) in order, and
    (word, label, containment) of each block that meets a template's threshold.

    Blocks are lines, and windows over the words of all lines that hold any
    ``SPAN`` words in a row, or twice the longest template's.  Two passes over the
    whole texts: token frequencies, then the join.  Null and
    empty texts have no words; other columns are not read; repeated rows are
    scanned each.  An empty table gives an empty result.
    """
    wanted = {t for texts in templates.values() for text in texts for t in split_words(text)}
    index = TemplateIndex(templates, threshold, token_frequency(docs, wanted, text_col=text_col))
    span = max(SPAN, 2 * index.longest)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    match = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))
    firsts = frozenset(p.split(" ")[0].encode() for p in phrases)

    def run(batches):
        for part, texts in text_slices(batches, "text"):
            n, places, matches = [], [], []
            for t in texts:
                words = split_words(t)
                n.append(len(words))
                places.append([{"word": w, "label": x} for w, x in sorted(phrase_places(words, phrases))] if not firsts.isdisjoint(words) else [])
                found = []
                if not index.keys.isdisjoint(words):
                    for at, block in blocks(t, span):
                        if not index.keys.isdisjoint(block):
                            found += [{"word": at, "label": x, "containment": c} for x, c in sorted(index.matches(block).items())]
                matches.append(found)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(places, place), pa.array(matches, match)], names=["doc_id", "n_words", "places", "matches"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, places array<struct<word:long,label:string>>, matches array<struct<word:long,label:string,containment:double>>")
