"""Column functions on text: normalising, masking, hashing and marker counting.  All but marks and nfkc stay in the JVM."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SALT, HASH_LENGTH = "local-dev-salt", 16


def squeeze(text: Column) -> Column:
    """White space runs become one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D+", "")


def phone_digits(text: Column) -> Column:
    """Digits, with the trunk prefix 8 of an 11-digit number as 7."""
    own = digits(text)
    return F.when((F.length(own) == 11) & own.startswith("8"), F.concat(F.lit("7"), F.substring(own, 2, 10))).otherwise(own)


def window(text: Column, start: Column, end: Column, width: int) -> Column:
    """The text from width before start to width after end (places from 0)."""
    first = F.greatest(start - width, F.lit(0))
    return F.substring(text, first + 1, end + width - first)


def keyed_hash(value: Column, secret: str = DEFAULT_SALT, length: int = HASH_LENGTH, enabled: bool = True) -> Column:
    """The first hex digits of HMAC-SHA256, from two SHA-256 with the key's pads worked out beforehand."""
    if not enabled:
        return F.lit(None).cast("string")
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pads = [F.lit(bytes(b ^ x for b in key)) for x in (0x36, 0x5C)]
    inner = F.unhex(F.sha2(F.concat(pads[0], F.encode(value, "UTF-8")), 256))
    return F.when(F.length(value) > 0, F.substring(F.sha2(F.concat(pads[1], inner), 256), 1, length))


def masked(value: Column, prefix: int = 2, suffix: int = 2, shown: bool = True) -> Column:
    """The value's ends with stars between them; short values are all stars."""
    if not shown:
        return F.lit(None).cast("string")
    n = F.length(value)
    stars = F.repeat(F.lit("*"), F.greatest(F.lit(1), n - prefix - suffix).cast("int"))
    ends = F.concat(F.substring(value, 1, prefix), stars, F.substring(value, n - suffix + 1, F.lit(suffix)))
    return F.when(n > prefix + suffix, ends).when(n > 0, F.repeat(F.lit("*"), n))


def marker_count(text: Column, markers: Sequence[str]) -> Column:
    """How many entries of a list are substrings; an entry listed twice counts twice."""
    total = F.lit(0)
    for marker in markers:
        total = total + F.contains(text, F.lit(marker)).cast("int")
    return total


def has_marker(text: Column, markers: Sequence[str]) -> Column:
    found = F.lit(False)
    for marker in markers:
        found = found | F.contains(text, F.lit(marker))
    return found


def markers_found(text: Column, markers: Sequence[str]) -> Column:
    """The entries of a list that are substrings, in the list's order."""
    return F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(text, m))


def any_of(words: Sequence[str]) -> str:
    """A pattern of the texts that have an entry of a list."""
    return "|".join(map(re.escape, sorted(set(words))))


def marks(texts: Sequence[Column], has: Mapping[str, str], count: Mapping[str, Sequence[str]] | None = None) -> Column:
    """struct: for each pattern of has, whether one of the texts has it; for each list of count, how many entries they have.

    An automaton goes through a text once for a whole list, where has_marker and marker_count go through it for each entry;
    entries are told apart only in texts that have any.  Entries and patterns are linear (RE2) and never span two texts.
    An entry listed twice counts twice; if a text is null, so is what is said of it.
    """
    count = dict(count or {})

    def run(*columns: pa.Array) -> pa.Array:
        search = lambda own, pattern: reduce(pc.or_, (pc.match_substring_regex(c, pattern) for c in own))
        out = [search(columns, pattern) for pattern in has.values()]
        for words in count.values():
            some = search(columns, any_of(words))
            at = pc.fill_null(some, False)
            own, n = [c.filter(at) for c in columns], np.zeros(len(some), dtype=np.int32)
            for word, times in Counter(words).items() if len(own[0]) else ():
                found = reduce(pc.or_, (pc.match_substring(c, word) for c in own))
                n[at.to_numpy(zero_copy_only=False)] += times * found.to_numpy(zero_copy_only=False).astype(np.int32)
            out.append(pa.array(n, pa.int32(), mask=some.is_null().to_numpy(zero_copy_only=False)))
        return pa.StructArray.from_arrays(out, [*has, *count])

    fields = ", ".join([*(f"{k} boolean" for k in has), *(f"{k} int" for k in count)])
    return F.arrow_udf(run, f"struct<{fields}>", F.ArrowUDFType.SCALAR)(*texts)


def decoded_path(path: Column) -> Column:
    """Percent-decoded and in lower case; '+' and malformed escapes stay as they are."""
    return F.lower(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path))


def directory(path: Column) -> Column:
    """The parent of a relative path, '.' at the top."""
    parent = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(parent == "", ".").otherwise(parent)


def nfkc(text: Column) -> Column:
    """Unicode compatibility normal form, in Arrow batches: Spark has none."""
    from pyspark.sql.functions import PandasUDFType, pandas_udf

    return pandas_udf(lambda values: values.str.normalize("NFKC"), "string", PandasUDFType.SCALAR)(text)
