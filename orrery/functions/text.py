"""Text functions on columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Words that carry no meaning for matching labels; they must be these for equal tokens.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "but", "by", "for", "if", "in", "into", "is", "it", "its", "of", "on", "or",
    "that", "the", "their", "then", "there", "these", "this", "to", "was", "were", "which", "with",
)
# Ways to write that nothing is known.
UNRESOLVED = ("", "na", "n/a", "none", "null", "unknown", "unsupported", "unresolved", "not specified", "not applicable")
# Dashes of all widths and the minus sign.
DASHES = "[\u2010\u2011\u2012\u2013\u2014\u2015\u2212-]"
# Words of a header that names a period, and of one that names a unit.
PERIOD = r"(?i)\b(19\d\d|20\d\d|year|years|month|months|quarter|quarters|ended|december|january|february|march|april|may|june|july|august|september|october|november)\b"
UNIT = r"(?is)^\(?\s*(in|dollars?|shares?|millions?|thousands?|except|per|amounts?|unaudited|usd|\$|%)\b.*$"
UNIT_CELLS = ("$", "%", "$ $", "% %")

def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; no stop words, no stemming."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def camel_split(text: Column) -> Column:
    """A space before each capital that starts a word inside another."""
    return F.regexp_replace(F.regexp_replace(text, "([A-Z])([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")


def singular(token: Column) -> Column:
    """Strips a plural: "ies" becomes "y" in words of over four letters, one "s" falls off in words of over three."""
    n = F.length(token)
    return (
        F.when((n > 4) & token.endswith("ies"), F.concat(F.substring(token, F.lit(1), n - 3), F.lit("y")))
        .when((n > 3) & token.endswith("s") & ~token.endswith("ss"), F.substring(token, F.lit(1), n - 1))
        .otherwise(token)
    )


def label_tokens(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Tokens of a text and of its camel-case split, singular, without stop words; a
    word counts once for each of the two readings."""
    text = F.coalesce(text, F.lit(""))
    both = F.concat(text, F.lit(" "), camel_split(text))
    found = F.regexp_extract_all(both, F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.filter(F.transform(found, lambda x: singular(F.lower(x))), lambda x: ~x.isin(*stop_words))


def context_tokens(text: Column) -> Column:
    """Distinct words and decimal numbers."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9]+(?:\.[0-9]+)?"), F.lit(0)))


def squeeze(text: Column) -> Column:
    """One space for each run of any white space, none at the ends; null becomes empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "), "^ | $", "")


def strip_tags(html: Column) -> Column:
    """Cell ends become bars, other tags spaces."""
    return squeeze(F.regexp_replace(F.regexp_replace(html, r"(?i)</t[dh]>", " | "), "<[^>]+>", " "))


def head_and_tail(text: Column, limit: int) -> Column:
    """At most about ``limit`` characters: head and tail around " ... "."""
    left = (limit - 5) // 2
    right = limit - 5 - left
    cut = F.concat(F.rtrim(F.substring(text, 1, left)), F.lit(" ... "), F.ltrim(F.right(text, F.lit(right))))
    return F.when(F.char_length(text) <= limit, text).otherwise(cut)


def with_prefix(tag: Column, prefix: str) -> Column:
    return F.when(tag.startswith(prefix), tag).otherwise(F.concat(F.lit(prefix), tag))


def without_prefix(tag: Column, prefix: str) -> Column:
    return F.when(tag.startswith(prefix), F.substring(tag, F.lit(len(prefix) + 1), F.length(tag))).otherwise(tag)


def plain_code(code: Column) -> Column:
    return F.replace(F.upper(F.trim(code)), F.lit("."), F.lit(""))


def dotted_code(code: Column) -> Column:
    """A dot after the third character of longer codes."""
    c = plain_code(code)
    return F.when(F.length(c) > 3, F.concat(F.substring(c, 1, 3), F.lit("."), F.substring(c, F.lit(4), F.length(c)))).otherwise(c)


def plain_number(text: Column) -> Column:
    """A number's text without quotes around it, then brackets around all of it, then
    dollar and per-cent signs, commas and white space; dashes alike."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    t = F.regexp_replace(F.regexp_replace(t, '^"+|"+$', ""), "^'+|'+$", "")
    t = F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)^\(\s*(.*?)\s*\)$", "$1"), DASHES, "-")
    return F.regexp_replace(t, r"(?U)[$%,\s]", "")


def once(text: Column) -> Column:
    """Squeezed text; its first half alone where both halves have the same words."""
    words = F.split(squeeze(text), " ")
    half = F.floor(F.size(words) / 2).cast("int")
    twice = (F.size(words) % 2 == 0) & (F.slice(words, F.lit(1), half) == F.slice(words, half + 1, half))
    return F.array_join(F.when(twice, F.slice(words, F.lit(1), half)).otherwise(words), " ")


def dataset_number(text: Column) -> Column:
    """The number that a cell shows, for matching: without signs of currency, per
    cent and thousands, brackets, repeats; "" where it shows none or several.
    Character references of HTML are expected to be resolved."""
    shown = F.regexp_replace(once(text), DASHES, "-")
    bare = F.regexp_replace(once(F.regexp_replace(shown, "[$%,]", " ")), r"(?U)\s+", "")
    bare = F.regexp_replace(bare, r"^\((.*)\)$", "$1")
    number = r"[+-]?(?:\d[\d,]*(?:\.\d+)?|\.\d+)|-"
    parts = F.transform(F.regexp_extract_all(shown, F.lit(number), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")))
    rest = F.regexp_replace(F.regexp_replace(shown, number, ""), r"(?U)[\s$%,().]+", "")
    one = F.size(F.array_distinct(parts)) == 1
    plus = lambda x: F.regexp_replace(x, "^[+]+", "")
    return F.when(bare == "-", bare).when(bare.rlike(r"^[+-]?(\d+(\.\d+)?|\.\d+)$"), plus(bare)).when((rest == "") & one, plus(F.get(parts, F.lit(0)))).otherwise(F.lit(""))


def listed(text: Column) -> Column:
    """Parts between commas and semicolons, squeezed, without empty ones."""
    return F.filter(F.transform(F.split(squeeze(text), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def truthy(value: Column) -> Column:
    return F.lower(squeeze(value.cast("string"))).isin("yes", "true", "1", "y")


def by_alias(text: Column, aliases: list[str]) -> Column:
    """The value in a JSON object of the first of ``aliases`` that is a key; keys
    count in lower case, with "-" and " " as "_"."""
    entries = F.map_entries(F.from_json(text, "map<string,string>"))

    def value(alias: str) -> Column:
        return F.get(F.filter(entries, lambda e: F.regexp_replace(F.lower(e["key"]), "[- ]", "_") == alias), F.lit(0))["value"]

    return F.coalesce(*map(value, aliases))


def tag_in(text: Column, tags: Column, pattern: str) -> Column:
    """The first of ``tags`` that a free text names: in full by ``pattern``, or else by what follows its prefix; "" for none."""
    t = F.coalesce(text, F.lit(""))
    bare = lambda x: F.regexp_replace(x, "^[^:]*:", "")
    full = F.get(F.filter(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda x: F.array_contains(tags, x)), F.lit(0))
    suffixes = F.transform(tags, bare)
    word = F.get(F.filter(F.regexp_extract_all(t, F.lit("[A-Za-z][A-Za-z0-9_]{2,}"), F.lit(0)), lambda x: F.array_contains(suffixes, x)), F.lit(0))
    return F.coalesce(full, F.get(F.filter(tags, lambda x: bare(x) == word), F.lit(0)), F.lit(""))


def jaccard(a: Column, b: Column, empty: float) -> Column:
    """Shared over all distinct elements; ``empty`` for two empty arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def coverage(of: Column, by: Column) -> Column:
    """Share of the distinct elements of ``of`` that ``by`` holds; 0 for none."""
    n = F.size(F.array_distinct(of))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(of, by)) / n)


def relaxed_match(a: Column, b: Column, threshold: float) -> Column:
    """Equal, or one holds the other, or alike enough by their distinct words and numbers."""
    x, y = F.lower(squeeze(a)), F.lower(squeeze(b))
    inside = (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))
    return (x == y) | inside | (jaccard(context_tokens(a), context_tokens(b), 1.0) >= threshold)


# What may follow a sentence's end and the white space after it.
NEXT_SENTENCE = "[A-Z0-9($]"


def sentences(text: Column) -> Column:
    """Splits after . ! ? where white space and a capital, a digit, "(" or "$" follow; parts without white space at their ends."""
    parts = F.split(F.coalesce(text, F.lit("")), rf"(?U)(?<=[.!?])\s+(?={NEXT_SENTENCE})")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


# What may follow a mark that ends a sentence, besides the text's end: capitals, digits, an opening quote or mark.
AFTER_MARK = '\\p{IsUppercase}\\p{IsDigit}\u00b2\u00b3\u00b9\u2070\u2074-\u2079\u2080-\u2089"\u00bf\u00a1'


def scanned_sentences(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, pos, start, end, sentence: a mark of . ! ? ends a sentence where, after any white space, the text
    ends or a capital, a digit, a quote or an inverted mark follows, unless it is the dot after a
    capital that itself comes after a dot.  Places are in characters of the text; sentences are squeezed, empty ones left out.

    ``key`` names rows; the sentences of a row are put in order together.
    """
    edge = rf"(?<=[.!?])(?<!\.\p{{IsUppercase}}\.)(?=[\s\x1c-\x1f\x85\xa0]*(?:\z|[{AFTER_MARK}]))"
    parts = rows.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), edge)).alias("_at", "_part"))
    w = W.partitionBy(key).orderBy("_at")
    placed = parts.withColumn("end", F.sum(F.char_length("_part")).over(w)).withColumn("start", F.col("end") - F.char_length("_part")).withColumn("sentence", squeeze(F.col("_part"))).where("sentence <> ''")
    return placed.select(key, (F.row_number().over(w) - 1).cast("long").alias("pos"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "sentence")


def ranges(position: Column) -> Column:
    """"a b;c d" as an array of (start, end)."""
    return F.transform(F.filter(F.split(position, ";"), lambda x: F.trim(x) != ""), lambda x: F.struct(F.split(F.trim(x), r"\s+")[0].cast("int").alias("start"), F.split(F.trim(x), r"\s+")[1].cast("int").alias("end")))


def unresolved(value: Column) -> Column:
    """True for values that say nothing."""
    return F.lower(squeeze(value)).isin(*UNRESOLVED)
