"""Whether a labelled value can be what its label says: companies, addresses, birth places, names, pages of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as L
from .text import has_marker, marker_count, squeeze

# Shapes of values and labels that names must not hold.
CYRILLIC_NAME = r"[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?\s+[А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ][а-яё]+)?"
LATIN_NAME = r"[A-Z][a-z]+(?:[-'][A-Z][a-z]+)?(?:\s+[A-Z][a-z]+(?:[-'][A-Z][a-z]+)?){1,2}"
HOUSE_NUMBER, ZIP, UK_POSTCODE = r"\b\d+[A-Za-z]?\b", r"\b\d{5}(?:-\d{4})?\b", r"\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b"
LABELS_IN_NAMES = (
    "first name", "last name", "middle name", "middle initial", "given name", "forename", "surname", "family name",
    "дата рождения", "date of birth", "birth date", "address", "адрес", "phone", "телефон",
)


def _quoted(marker: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in marker)


COMPANY = r"(?U)(?<![\w-])(?:" + "|".join(map(_quoted, L.COMPANY_MARKERS)) + r")(?![\w-])"


def company(value: Column) -> Column:
    return F.lower(value).rlike(COMPANY)


def address(value: Column) -> Column:
    low = F.lower(value)
    english = marker_count(low, L.ENGLISH_ADDRESS_MARKERS)
    detail = F.contains(value, F.lit(",")) | value.rlike("(?U)" + ZIP) | value.rlike("(?U)" + UK_POSTCODE)
    return (marker_count(low, L.ADDRESS_MARKERS) >= 2) | (english >= 2) | ((english >= 1) & value.rlike("(?U)" + HOUSE_NUMBER) & detail)


def birth_place(value: Column) -> Column:
    own = squeeze(value)
    low, tokens = F.lower(own), F.split(own, " ")
    named = has_marker(low, L.BIRTH_PLACE_MARKERS + L.ENGLISH_BIRTH_PLACE_MARKERS) | (F.contains(own, F.lit(",")) & own.rlike("[A-Za-zА-Яа-яЁё]"))
    capitals = F.forall(tokens, lambda t: ~t.rlike(r"^\p{L}") | t.rlike(r"^\p{Lu}"))
    return (own != "") & ~company(own) & (named | (F.size(tokens).between(1, 4) & capitals))


def person_name(value: Column) -> Column:
    own = squeeze(value)
    return (own != "") & ~company(own) & ~has_marker(F.lower(own), LABELS_IN_NAMES) & own.rlike(f"(?U)^(?:{CYRILLIC_NAME}|{LATIN_NAME})$")


def with_page_metrics(df: DataFrame, text: Column) -> DataFrame:
    """df and m, a struct(length, printable_ratio, alpha_ratio, word_count, avg_token_length, score) of the squeezed text.

    Characters are counted by what is left without runs of them, and each count is a column of its own, worked out once.
    """
    x, c = F.col("__x"), F.col
    without = lambda pattern: F.length(x) - F.length(F.regexp_replace(x, pattern, ""))
    counted = df.withColumn("__x", squeeze(text)).withColumns({
        "__n": F.length(x), "__words": F.regexp_count(x, F.lit(r"(?U)\w+")), "__in_words": without(r"(?U)\w+"), "__letters": without(r"\p{L}+"),
        "__blank": without(r"(?U)\s+"), "__odd": without(r"[\p{C}&&[^\t\n\r]]+"),
    })
    n, count, some = c("__n"), c("__words"), c("__n") > 0
    shares = counted.withColumns({
        "__mean": F.when(count > 0, c("__in_words") / count).otherwise(0.0), "__printable": F.when(some, 1 - c("__odd") / n).otherwise(0.0),
        "__alpha": F.when(some, c("__letters") / F.greatest(F.lit(1), n - c("__blank"))).otherwise(0.0),
    })
    mean = c("__mean")
    shape = F.when(count == 0, 0.0).when(mean < 2, mean / 2).when(mean > 15, F.greatest(F.lit(0.0), 1 - (mean - 15) / 15)).otherwise(1.0)
    score = F.least(n / 1200, F.lit(1.0)) * 0.3 + c("__printable") * 0.2 + c("__alpha") * 0.2 + F.least(count / 120, F.lit(1.0)) * 0.2 + shape * 0.1
    m = F.struct(
        n.alias("length"), c("__printable").alias("printable_ratio"), c("__alpha").alias("alpha_ratio"), count.alias("word_count"),
        mean.alias("avg_token_length"), F.when(some, score).otherwise(0.0).alias("score"),
    )
    return shares.withColumn("m", m).drop(*(k for k in shares.columns if k.startswith("__")))


def page_status(m: Column) -> Column:
    good = (m["score"] >= 0.45) & (m["printable_ratio"] >= 0.85) & (m["alpha_ratio"] >= 0.3) & (m["word_count"] >= 5) & m["avg_token_length"].between(2, 15)
    return F.when((m["length"] == 0) | (m["word_count"] == 0), "empty").when(good, "good").otherwise("suspicious")


def page_rank(status: Column) -> Column:
    return F.when(status == "good", 3).when(status == "suspicious", 2).when(status == "empty", 1).otherwise(0)


def ocr_score(text: Column) -> Column:
    """How much recognised text looks like text: good tokens and characters for it, mixed tokens against."""
    own = squeeze(text)
    letters = lambda t: F.regexp_count(t, F.lit(r"\p{L}"))
    numbers = lambda t: F.regexp_count(t, F.lit(r"\p{Nd}"))
    tokens = F.transform(F.split(own, " "), lambda t: F.btrim(t, F.lit(".,:;()[]{}<>\"'")))
    good = F.size(F.filter(tokens, lambda t: (letters(t) >= 3) | (numbers(t) >= 5)))
    both = F.size(F.filter(tokens, lambda t: (letters(t) > 0) & (numbers(t) > 0)))
    total = good * 6 + F.least(F.size(tokens), F.lit(40)) + letters(own) * 0.03 + numbers(own) * 0.08 - both * 1.5
    return F.when(own == "", -1.0).otherwise(total.cast("double"))
