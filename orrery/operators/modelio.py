"""Outputs of text generators: tolerant parsing, and a generator as a source."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame


def balanced(text: str) -> str | None:
    """The first balanced JSON object or array in a text, quotes and escapes heeded."""
    start = next((i for i, c in enumerate(text) if c in "{["), None)
    if start is None:
        return None
    stack, quoted, escaped = [], False, False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            escaped, quoted = (not escaped and c == "\\"), not (c == '"' and not escaped)
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if not stack or stack.pop() != c:
                return None
            if not stack:
                return text[start : i + 1]
    return None


def salvage(text: str | None):
    """JSON from a generator's answer: thoughts and code fences removed, the first balanced
    value, or the complete objects of a list that breaks off; None without any."""
    text = re.sub(r"(?s)<think>.*?</think>", "", text or "").replace("```json", "").replace("```", "").strip()
    whole = balanced(text)
    for candidate in (text, whole):
        try:
            if candidate:
                return json.loads(candidate)
        except ValueError:
            pass
    found, rest = [], text[text.find("[") + 1 :] if "[" in text else ""
    while (part := balanced(rest)) is not None:
        try:
            found.append(json.loads(part))
        except ValueError:
            break
        rest = rest[rest.find(part) + len(part) :]
    return found or None


def parse_answers(answers: DataFrame, key: str, text: str) -> DataFrame:
    """key, parsed (JSON text or null), ok for every answer."""
    kind = answers.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            values = [salvage(t) for t in b.column(text).to_pylist()]
            out = [None if v is None else json.dumps(v, sort_keys=True) for v in values]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(out, pa.string()), pa.array([o is not None for o in out])], names=[key, "parsed", "ok"])

    return answers.select(key, text).mapInArrow(run, f"{key} {kind}, parsed string, ok boolean")


def generate(prompts: DataFrame, key: str, prompt: str, generator: Callable[[list[str]], list[str]]) -> DataFrame:
    """key, answer from a generator called with each batch of prompts."""
    kind = prompts.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(generator([p or "" for p in b.column(prompt).to_pylist()]), pa.string())], names=[key, "answer"])

    return prompts.select(key, prompt).mapInArrow(run, f"{key} {kind}, answer string")


def fit_budget(parts: list[str], budget: int, count: Callable[[str], int]) -> list[str]:
    """Shortens all parts alike, by bisection, until their joint size is at most ``budget``."""
    low, high = 0, max(map(len, parts), default=0)
    while low < high:
        mid = (low + high + 1) // 2
        if sum(count(p[:mid]) for p in parts) <= budget:
            low = mid
        else:
            high = mid - 1
    return [p[:low] for p in parts]
