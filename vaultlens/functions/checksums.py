"""Predicates of identifiers and documents.  All stay in the JVM; each is null for null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import digits

# The weights of the check digits.
SNILS_WEIGHTS = (9, 8, 7, 6, 5, 4, 3, 2, 1)
INN10_WEIGHTS = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_FIRST_WEIGHTS = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_SECOND_WEIGHTS = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
BIRTH_DATE_FORMATS = ("dd.MM.yyyy", "dd-MM-yyyy", "yyyy-MM-dd")


def _weighted(own: Column, weights: Sequence[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + F.substring(own, i + 1, 1).cast("int") * w
    return total


def snils_valid(value: Column) -> Column:
    own = digits(value)
    rest = _weighted(own, SNILS_WEIGHTS) % 101 % 100
    return F.when((F.length(own) == 11) & (own != "0" * 11), rest == F.substring(own, 10, 2).cast("int")).otherwise(value.isNull() & F.lit(None))


def _check(own: Column, weights: Sequence[int]) -> Column:
    return _weighted(own, weights) % 11 % 10 == F.substring(own, len(weights) + 1, 1).cast("int")


def inn_valid(value: Column) -> Column:
    own = digits(value)
    long_ = _check(own, INN12_FIRST_WEIGHTS) & _check(own, INN12_SECOND_WEIGHTS)
    return F.when(F.length(own) == 10, _check(own, INN10_WEIGHTS)).when(F.length(own) == 12, long_).otherwise(value.isNull() & F.lit(None))


def luhn_valid(value: Column) -> Column:
    own = digits(value)
    return F.when(F.length(own).between(13, 19), F.call_function("luhn_check", own)).otherwise(value.isNull() & F.lit(None))


def bik_valid(value: Column) -> Column:
    own = digits(value)
    return own.rlike(r"^\d{9}$") & (own != "0" * 9)


def account_valid(account: Column, bik: Column) -> Column:
    own = digits(account)
    return bik_valid(bik) & own.rlike(r"^\d{20}$") & (own != "0" * 20)


def birth_date_valid(value: Column, as_of: Column) -> Column:
    """A date that is not after as_of and at most 120 calendar years before."""
    day = F.coalesce(*(F.try_to_timestamp(value, F.lit(f)) for f in BIRTH_DATE_FORMATS))
    age = F.year(as_of) - F.year(day)
    return F.when(value.isNotNull(), F.coalesce((day <= as_of) & age.between(0, 120), F.lit(False)))


def mrz_valid(value: Column) -> Column:
    own = F.replace(F.trim(value), F.lit(" "), F.lit(""))
    return own.rlike(r"^[A-Z0-9<]{30,44}$") & own.rlike(r"^(P<|I<|ID|PN)") & F.contains(own, F.lit("<"))
