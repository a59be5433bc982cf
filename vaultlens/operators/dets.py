"""Predicates over a file's detections, held as one array column of structs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

DETS = "array<struct<family:string,category:string,confidence:string,validation:string,occurrences:bigint,value_hash:string,location_hints:array<string>>>"
FIELDS = ("family", "category", "confidence", "validation", "occurrences", "value_hash", "location_hints")

# Categories that rules name together.
IDENTITY = ("person_name", "address", "birth_date", "birth_place")


def sure(x: Column) -> Column:
    """At least medium confidence."""
    return x["confidence"].isin("high", "medium")


def valid(x: Column) -> Column:
    return x["validation"] == "valid"


def proven(x: Column) -> Column:
    """A government or payment identifier whose check holds."""
    return x["family"].isin("government", "payment") & valid(x)


def sensitive(x: Column) -> Column:
    return x["family"].isin("special", "biometric")


def subject(x: Column) -> Column:
    """Something that tells who a person is."""
    return x["category"].isin(*IDENTITY) & sure(x)


def trusted(x: Column) -> Column:
    return proven(x) | subject(x)


def template_trusted(x: Column) -> Column:
    return valid(x) | (sure(x) & x["category"].isin("person_name", "address"))


def categories(d: Column) -> Column:
    return F.array_distinct(F.transform(d, lambda x: x["category"]))


def has(cats: Column, names: Iterable[str]) -> Column:
    return F.arrays_overlap(cats, F.array(*map(F.lit, sorted(names))))


def only(cats: Column, names: Iterable[str]) -> Column:
    """No category beyond the named ones (also true of none)."""
    return F.size(F.array_except(cats, F.array(*map(F.lit, sorted(names))))) == 0


def both(cats: Column, names: Iterable[str]) -> Column:
    return F.array_intersect(cats, F.array(*map(F.lit, sorted(names))))


def volume(d: Column, *names: str) -> Column:
    """Occurrences, of some categories if any are named."""
    own = F.filter(d, lambda x: x["category"].isin(*names)) if names else d
    return F.aggregate(own, F.lit(0).cast("bigint"), lambda a, x: a + x["occurrences"])


def ordinary(d: Column) -> Column:
    """Ordinary categories with at least medium confidence."""
    return categories(F.filter(d, lambda x: (x["family"] == "ordinary") & sure(x)))


def anchors(d: Column, names: Iterable[str]) -> Column:
    """Categories that tie data to a person: named ones, names if sure, government unless invalid, payment if valid."""
    fine = (
        lambda x: x["category"].isin(*names)
        & ~((x["family"] == "government") & (x["validation"] == "invalid"))
        & ((x["family"] != "payment") | valid(x))
        & ((x["category"] != "person_name") | sure(x) | (x["family"] != "ordinary"))
    )
    return categories(F.filter(d, fine))


def counts(d: Column, field: str) -> Column:
    """Map of a field's values to their occurrences."""
    keys = F.array_sort(F.array_distinct(F.transform(d, lambda x: x[field])))
    total = lambda k: F.aggregate(F.filter(d, lambda x: x[field] == k), F.lit(0).cast("bigint"), lambda a, x: a + x["occurrences"])
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), total(k).alias("value"))))


def chain(cases: list[tuple[Column, object]], otherwise: object) -> Column:
    """First case that holds."""
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = None
    for condition, v in cases:
        out = F.when(condition, value(v)) if out is None else out.when(condition, value(v))
    return out.otherwise(value(otherwise))
