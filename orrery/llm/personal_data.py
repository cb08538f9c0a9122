"""Personal data: exact patterns, and identifiers found by the contexts that they share with those."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orrery.llm.batches import text_slices, whole_texts
from orrery.session import staged, unstage

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: The expressions of the base, written so that a failing match costs no second look at the same characters.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What may be an identifier, or shows that a context holds other things: spelt-out addresses, groups of digits, other tokens with digits or an @.
SPELT = re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,63}+)+", re.I)
GROUP = re.compile(r"(?<![\w@])[+(]?[0-9](?:[ ().:/-]{0,2}[0-9])*+")  # none if a letter follows
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
SIGN = re.compile(r"[0-9@]|[\[( ]dot[\]) ]", re.I)
WORD = re.compile(r"\S+")
OPENING, CLOSING = "([{<\"'*#$%&", ".,;:!?)]}>\"'*#$%&"  # round a token
EDGE = 80  # characters on either side in which the words of a context are sought


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in characters: the matches of each kind's expression, leftmost first and
    without overlap, that pass its test, by kind and start."""
    out = []
    free = 0  # where the next address may begin
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append((EMAIL, start, m.end()))
            free = m.end()
    for m in ADDRESS.finditer(text):
        if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m.group().split("."))):
            out.append((IP, m.start(), m.end()))
    for m in DIGITS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((CARD, m.start(), m.end()))
    for m in DIALLED.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((PHONE, m.start(), m.end()))
    return out


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def named_value(kind: int, text: str) -> str:
    """What is alike in all spellings of an identifier."""
    if kind == EMAIL:
        plain = re.sub(r" ?(?:\(at\)|\[at\]| at ) ?", "@", text.lower())
        return "e:" + re.sub(r" ?(?:\(dot\)|\[dot\]| dot ) ?", ".", plain)
    return f"i:{text}" if kind == IP else "n:" + _digits(text)


def _bare(word: str) -> str:
    """A word of a context without what stands around its letters, its digits as 0."""
    low = re.sub(r"[0-9]", "0", word.lower())
    return low.strip("".join(c for c in set(low) if not c.isalnum())) or low


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a slot: the word before, the two words before, the words before and after."""
    before = [_bare(w) for w in WORD.findall(text[max(0, start - EDGE) : start])[-2:]]
    after = WORD.search(text, end, end + EDGE)
    if not before or any("0" in w for w in before[-1:]):
        return []
    out = [f"{before[-1]} _"]
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if after:
        out.append(f"{before[-1]} _ {_bare(after.group())}")
    return out


def slots(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """(start, end, value, kind or -1, kinds that its shape allows as bits, contexts) of
    the base's spans that stand alone and of what else looks like an identifier."""
    out, taken = [], []
    for kind, start, end in base:
        taken.append((start, end))
        glued = (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
        if not glued or kind == EMAIL:
            out.append((start, end, named_value(kind, text[start:end]), kind, 1 << kind, contexts(text, start, end)))
    taken = _merged(taken)
    for shape in (SPELT, GROUP, TOKEN):
        found = []
        at = 0
        for m in shape.finditer(text):
            start, end = m.span()
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            if at < len(taken) and taken[at][0] < end:
                continue
            if shape is TOKEN:
                value = m.group().lstrip(OPENING)
                start = end - len(value)
                value = value.rstrip(CLOSING)
                end = start + len(value)
                fits = 1 << EMAIL if re.fullmatch(r"[^\s@]+@[^\s@]+", value) else 1 << IP if re.fullmatch(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}", value) else 0
                name = named_value(EMAIL, value) if fits == 1 << EMAIL else f"t:{value.lower()}"
            elif shape is GROUP:
                if end < len(text) and (text[end].isalnum() or text[end] in "_@"):
                    continue
                n = len(_digits(m.group()))
                fits = (7 <= n <= 15) << PHONE | (13 <= n <= 19) << CARD
                name = named_value(CARD, m.group())
            else:
                fits, name = 1 << EMAIL, named_value(EMAIL, m.group())
            if start < end:
                found.append((start, end))
                out.append((start, end, name, -1, fits, contexts(text, start, end)))
        taken = _merged(taken + found)
    return out


def _merged(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted; parts that overlap as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(parts):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


SPAN = "struct<kind: int, start: long, end: long>"
SLOT = "struct<start: long, end: long, value: string, kind: int, fits: int, contexts: array<string>>"
SPAN_TYPE = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
SLOT_TYPE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("kind", pa.int32()), ("fits", pa.int32()), ("contexts", pa.list_(pa.string()))])
AT_ONCE = 8192  # slots in a batch


def extracted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, base, slot: a row with ``base`` for every row of ``docs``, and a row with
    ``slot`` for each of its text's slots; key is a digest of a text with slots, else null."""
    rows = whole_texts(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def batch(ids, keys, bases, held):
        spans = pa.array([None if b is None else [dict(zip(("kind", "start", "end"), x)) for x in b] for b in bases], pa.list_(SPAN_TYPE))
        slot = pa.array([None if x is None else dict(zip(("start", "end", "value", "kind", "fits", "contexts"), x)) for x in held], SLOT_TYPE)
        return pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.string()), spans, slot], names=["doc_id", "key", "base", "slot"])

    def run(batches):
        for part, texts in text_slices(batches, "text"):
            ids, keys, bases = part.column("doc_id"), [], []
            for t in texts:
                base, key = [], None
                if SIGN.search(t):
                    base = base_spans(t)
                    found = slots(t, base)
                    if found:
                        key = hashlib.blake2b(t.encode(), digest_size=16).hexdigest()
                    for a in range(0, len(found), AT_ONCE):
                        some = found[a : a + AT_ONCE]
                        yield batch(pa.nulls(len(some), ids.type), [key] * len(some), [None] * len(some), some)
                keys.append(key)
                bases.append(base)
            yield batch(ids, keys, bases, [None] * len(keys))

    return rows.mapInArrow(run, f"doc_id {kind}, key string, base array<{SPAN}>, slot {SLOT}")


def _pattern_scores(edges: DataFrame, known: DataFrame, min_support: int, threshold: float, doubt: float) -> DataFrame:
    """pattern, kind, confidence of the patterns that pass.

    A pattern's confidence in a kind is F / (F + other + doubt U): F sums how sure its
    known instances of the kind are, other counts instances known to be of another
    kind or of a shape that the kind does not allow, U those that might be.
    """
    rows = edges.join(known, "value", "left")
    by_kind = []
    for k in range(len(KINDS)):
        own, might = F.col("kind") == k, F.col("kind").isNull() & (F.col("fits").bitwiseAND(1 << k) > 0)
        by_kind += [F.sum(F.when(own, F.col("sure")).otherwise(0.0)).alias(f"f{k}"), F.count(F.when(own, 1)).alias(f"n{k}"), F.count(F.when(might, 1)).alias(f"u{k}")]
    sums = rows.groupBy("pattern").agg(F.count("*").alias("n"), *by_kind)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"f{k}").alias("f"), F.col(f"n{k}").alias("known"), F.col(f"u{k}").alias("u")) for k in range(len(KINDS))]))
    flat = sums.select("pattern", "n", each.alias("x")).select("pattern", "n", "x.*")
    sure = F.col("f") / (F.col("f") + (F.col("n") - F.col("known") - F.col("u")) + doubt * F.col("u"))
    return flat.where(F.col("known") >= min_support).withColumn("confidence", sure).where(F.col("confidence") >= threshold).select("pattern", "kind", "confidence")


def bootstrap(found: DataFrame, *, min_support: int = 3, threshold: float = 0.8, doubt: float = 0.25) -> DataFrame:
    """value, kind, sure: instances and how sure their kind is; seeds are the base's, at 1.

    ``found`` is what ``extracted`` gives.  Patterns and instances form a graph: an
    edge says that a value stands in a context, however often.  Each round scores
    all patterns by their instances, then lets those of ``threshold`` confidence with
    ``min_support`` known instances vouch for the values in them that are unknown and
    of a shape that the kind allows: a value is ``sure`` by 1 - the product of (1 -
    confidence), no pattern counting over 0.99, and is accepted from ``threshold`` on;
    of kinds the surest, then the first listed.  What is accepted stays, so rounds end
    with the first that finds nothing new.
    """
    slot = found.where("slot is not null").select("slot.*")
    values = slot.groupBy("value").agg(F.max("kind").alias("seed"), F.bit_or("fits").alias("fits"))
    edges = slot.select("value", F.explode("contexts").alias("pattern")).distinct().join(values.select("value", "fits"), "value")
    edges = staged(edges.select("pattern", "value", "fits"), "pattern-edges")
    known = staged(values.where("seed >= 0").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("sure")), "instances")
    while True:
        patterns = _pattern_scores(edges, known, min_support, threshold, doubt)
        unknown = edges.where("fits > 0").join(known.select("value"), "value", "left_anti")
        vouched = unknown.join(patterns, "pattern").where(F.col("fits").bitwiseAND(F.expr("shiftleft(1, kind)")) > 0)
        sure = vouched.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.99)))))).alias("sure"))
        best = sure.groupBy("value").agg(F.max_by("kind", F.struct("sure", -F.col("kind"))).alias("kind"), F.max("sure").alias("sure"))
        new = staged(best.where(F.col("sure") >= threshold), "instances")
        if new.isEmpty():
            break
        after = staged(known.unionByName(new), "instances")
        for old in (known, new):
            unstage(old)
        known = after
    unstage(edges)
    return known


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **scoring) -> DataFrame:
    """doc_id, base, added for every row: spans (kind: place in ``KINDS``, start, end in
    characters), by kind and start.

    ``base`` has the exact matches.  ``added`` has the slots, none of which overlaps a
    base span, whose value ``bootstrap`` accepted: other spellings of known identifiers,
    and identifiers in contexts that mostly hold known ones of that kind.  A value counts
    once however often it stands in copies.

    Null texts count as empty: no spans.  Repeated rows and null ids give rows of their
    own with the spans of their texts; an empty table gives none; columns but the two
    named are not read.  ``scoring`` goes to ``bootstrap``.
    """
    found = staged(extracted(docs, id_col=id_col, text_col=text_col), "slots")
    known = bootstrap(found, **scoring)
    open_ = found.where("slot.kind < 0 and slot.fits > 0").select("key", "slot.start", "slot.end", "slot.fits", "slot.value").distinct()
    met = open_.join(known.select("value", "kind"), "value").where(F.col("fits").bitwiseAND(F.expr("shiftleft(1, kind)")) > 0)
    added = met.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    rows = found.where("base is not null").select("doc_id", "key", "base")
    met = rows.where("key is not null").join(added, "key", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))
    return met.unionByName(rows.where("key is null").select("doc_id", "base", none.alias("added")))
