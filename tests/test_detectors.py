from datetime import date

import pytest

from vaultlens.operators import spans
from vaultlens.operators.detect import deduplicate, detect, find_hits
from vaultlens.operators.spans import Settings, hits_of, normal_text

S = Settings(as_of=date(2024, 6, 1))


def found(text, settings=S):
    return [(h["category"], h["normalized_value"], h["validation"]) for h in hits_of(normal_text(text), 0, settings)]


def categories(text):
    return {c for c, _, _ in found(text)}


def test_labelled_row():
    got = found("ФИО: Петров Пётр Петрович | Телефон: 8 (912) 345-67-89 | email: P@Q.ru | СНИЛС 112-233-445 95")
    assert ("person_name", "петров пётр петрович", "unknown") in got
    assert ("phone", "79123456789", "valid") in got
    assert ("email", "p@q.ru", "valid") in got
    assert ("snils", "11223344595", "valid") in got


def test_form_on_several_lines():
    text = "First Name: Anna\nLast Name: Stone\nDate of Birth: 03.04.1985\nHome Address: 12 High Street, Leeds\nPhone: +44 20 7946 0958"
    assert {"person_name", "birth_date", "address", "phone"} <= categories(text)
    assert ("person_name", "anna stone", "unknown") in found(text)


@pytest.mark.parametrize(
    "text,category",
    [
        ("invoice 4539 1488 0343 6467", "bank_card"), ("Паспорт серия 45 10 номер 654321", "passport_series_number"), ("driver license 77 11 123456", "driver_license"),
        ("БИК 044525225", "bik"), ("счет 40702810900000000001", "bank_account"), ("card cvv 123", "cvv_cvc"), ("диагноз: астма", "health_data"),
        ("employee gave fingerprints", "fingerprints"), ("place of birth: Omsk", "birth_place"), ("P<RUS" + "A" * 20 + "<<<<<A", "mrz"), ("ИНН 7707083893", "inn_legal_entity"),
    ],
)
def test_category_is_found(text, category):
    assert category in categories(text)


@pytest.mark.parametrize(
    "text",
    ["order 4539 1488 0343 6467 id: 7", "order 4539148803436467", "call 123-45-67", "233.233.171.252 phone", "1234567890", "seen 01.02.1990", "fingerprints", "Name: Best Bank", "address: nowhere"],
)
def test_nothing_is_found(text):
    assert not categories(text)


def test_traps_are_kept():
    assert [c for c, _, _ in found("phone 8 918 420 10 21")].count("phone") == 2
    assert {v for c, v, _ in found("card 4111 1111 1111 1111 cvv 5")} >= {"4111", "1111"}
    assert ("person_name", "alice monroe place", "unknown") in found("Full Name: Alice Monroe Place of Birth")
    assert "mrz" not in categories("P<RUS" + "A" * 20 + "<" * 9)
    assert ("snils", "11111111111", "invalid") in found("snils 11111111111")


def test_birth_dates_around_the_day():
    for value, fine in (("01.06.2024", True), ("02.06.2024", False), ("31.02.1990", False), ("01.01.1904", True), ("01.01.1903", False)):
        assert found(f"dob {value}") == [("birth_date", value, "valid" if fine else "invalid")]


def test_fragments_hide_values():
    for h in hits_of("ФИО: Петров Пётр | email: secret@host.org | card 4111 1111 1111 1111", 0, S):
        assert "secret@host.org" not in h["fragment"] and "4111 1111 1111 1111" not in h["fragment"]
    assert spans.sanitised("a@b.ru x", Settings(samples=False)) == " x"


def test_masking_off_makes_one_value(spark):
    rows = [("f", 0, "a@b.ru c@d.ru"), ("f", 1, "a@b.ru")]
    df = spark.createDataFrame(rows, "file_id string, raw_idx int, text string")
    assert detect(df, S).count() == 2
    one = detect(df, Settings(masking=False)).collect()
    assert len(one) == 1 and one[0]["occurrences"] == 3 and one[0]["raw_value"] == "a@b.ru"


def test_first_hit_decides_and_blank_chunks_shift(spark):
    rows = [("f", 0, "  "), ("f", 1, "snils 11111111111"), ("f", 2, "snils 11111111111"), ("g", 0, None), ("g", 1, "x")]
    df = spark.createDataFrame(rows, "file_id string, raw_idx int, text string")
    got = [r for r in deduplicate(find_hits(df, S)).collect() if r["category"] == "snils"]
    assert [(r["occurrences"], r["norm_idx"], r["location_hints"]) for r in got] == [(2, 0, ["chunk:0", "chunk:1", "span:6:17"])]


def test_chunk_limit(spark):
    df = spark.createDataFrame([("f", i, f"u{i}@x.org") for i in range(20)], "file_id string, raw_idx int, text string")
    assert detect(df, Settings(max_chunks=7)).count() == 7


def test_checks_agree_with_columns(spark):
    import random

    from pyspark.sql import functions as F

    from vaultlens.functions import checksums

    rnd = random.Random(4)
    values = ["".join(rnd.choice("0123456789") for _ in range(n)) for n in (9, 10, 11, 12, 13, 16, 19, 20) for _ in range(300)] + ["11223344595", "0" * 11, "4111111111111111"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", checksums.snils_valid(F.col("v")), checksums.inn_valid(F.col("v")), checksums.luhn_valid(F.col("v"))).collect()
    for v, snils, inn, luhn in rows:
        assert (snils, inn, luhn) == (spans.snils_ok(v), spans.inn_ok(v), spans.luhn_ok(v)), v
