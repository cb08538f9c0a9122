"""Whether a hypothesis contradicts itself or the datatype of its fact."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# The value class that a datatype names, phrases that claim a class, classes
# that shut out others, the balance side of a family, the period type of a qualifier.
DATATYPE_CLASS = {"monetaryitemtype": "monetary", "sharesitemtype": "shares", "pershareitemtype": "per_share", "percentitemtype": "percent"}
CLASS_PHRASES = {
    "shares": ("number of shares", "share count", "shares outstanding", "units outstanding"),
    "per_share": ("per share", "per diluted share", "per basic share", "per unit", "earnings per"),
    "percent": ("percentage", "percent", "rate", "ratio", "yield"),
}
EXCLUSIVE_CLASSES = ("per_share", "percent", "shares")
FAMILY_BALANCE_SIDE = {"asset": "debit", "cash": "debit", "inventory": "debit", "receivable": "debit", "expense": "debit", "liability": "credit", "debt": "credit", "equity": "credit", "revenue": "credit"}
QUALIFIER_PERIOD_TYPE = {"accumulated": "instant", "carrying_amount": "instant", "fair_value": "instant", "weighted_average": "duration"}


def _mapped(values: Column, names: dict[str, str]) -> Column:
    """The distinct names of those values that have one, in order."""
    table = F.create_map(*map(F.lit, chain.from_iterable(names.items())))
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda x: F.try_element_at(table, x)), lambda x: x.isNotNull())))


def datatype_consistent(datatype: Column, text: Column) -> Column:
    """The text claims no exclusive class but that of the datatype; unknown datatypes allow all."""
    own = F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(DATATYPE_CLASS.items()))), F.lower(F.trim(F.coalesce(datatype, F.lit("")))))
    low = F.lower(F.coalesce(text, F.lit("")))
    conflict = F.lit(False)
    for name in EXCLUSIVE_CLASSES:
        claimed = F.lit(False)
        for phrase in CLASS_PHRASES[name]:
            claimed = claimed | F.contains(low, F.lit(phrase))
        conflict = conflict | (claimed & (own != name))
    return own.isNull() | ~conflict


def period_consistent(temporal: Column, qualifiers: Column) -> Column:
    """Categories commit to one of instant and duration at most, and qualifiers imply no other."""
    committed = F.array_intersect(temporal, F.array(F.lit("instant"), F.lit("duration")))
    implied = _mapped(qualifiers, QUALIFIER_PERIOD_TYPE)
    differ = (F.size(committed) == 1) & (F.size(implied) == 1) & ~F.arrays_overlap(committed, implied)
    return (F.size(committed) <= 1) & (F.size(implied) <= 1) & ~differ


def balance_consistent(families: Column) -> Column:
    return F.size(_mapped(families, FAMILY_BALANCE_SIDE)) <= 1


def verdict(datatype: Column, text: Column, families: Column, temporal: Column, qualifiers: Column) -> dict[str, Column]:
    """datatype, period_type, balance and passed, which is all three; null and empty arrays
    contradict nothing."""
    full = lambda x: F.coalesce(x, F.array().cast("array<string>"))
    checks = {"datatype": datatype_consistent(datatype, text), "period_type": period_consistent(full(temporal), full(qualifiers)), "balance": balance_consistent(full(families))}
    return checks | {"passed": checks["datatype"] & checks["period_type"] & checks["balance"]}
