"""Registered queries over the driver tables, each with its DuckDB statement where SQL can say it.

The driver's tables hold hardly any personal data, so many queries build texts or detections from keys, the same in both
engines, with rows that pass a rule and rows that fail it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultlens.functions import checksums, plausible
from vaultlens.functions import lexicons as L
from vaultlens.functions import text as T
from vaultlens.operators import aggregate, cross_file, quality, scoring
from vaultlens.operators import dets as D
from vaultlens.operators.detect import deduplicate, find_hits
from vaultlens.operators.spans import Settings
from vaultlens.session import table
from vaultlens.sources import formats, reports
from vaultlens.sources.extract import row_chunk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "email_card_by_source"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
AS_OF = date(2000, 1, 1)
SETTINGS = Settings(as_of=AS_OF)


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def quoted(entries: Sequence[str]) -> str:
    return "[" + ", ".join("'" + e.replace("'", "''") + "'" for e in entries) + "]"


def sql_count(text: str, markers: Sequence[str]) -> str:
    return f"len(list_filter({quoted(markers)}, lambda m: contains({text}, m)))"


def sql_weighted(d: str, weights: Sequence[int]) -> str:
    return "(" + " + ".join(f"CAST(substr({d}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(weights)) + ")"


def key_digits(key: Column, factor: int, n: int) -> Column:
    """n digits worked out from a key."""
    return F.lpad((key * factor % 10**n).cast("string"), n, "0")


def sql_digits(key: str, factor: int, n: int) -> str:
    return f"lpad(CAST({key} * {factor} % {10**n} AS VARCHAR), {n}, '0')"


SNILS_SQL = "CASE WHEN {d} = '00000000000' THEN false ELSE {w} % 101 % 100 = CAST(substr({d}, 10, 2) AS INT) END"
INN10_SQL = "({w} % 11 % 10 = CAST(substr({d}, 10, 1) AS INT))"


def snils_sql(d: str) -> str:
    return SNILS_SQL.format(d=d, w=sql_weighted(d, checksums.SNILS_WEIGHTS))


def inn10_sql(d: str) -> str:
    return INN10_SQL.format(d=d, w=sql_weighted(d, checksums.INN10_WEIGHTS))


def inn12_sql(d: str) -> str:
    first, second = (sql_weighted(d, w) for w in (checksums.INN12_FIRST_WEIGHTS, checksums.INN12_SECOND_WEIGHTS))
    return f"({first} % 11 % 10 = CAST(substr({d}, 11, 1) AS INT) AND {second} % 11 % 10 = CAST(substr({d}, 12, 1) AS INT))"


def luhn_sql(d: str) -> str:
    at = f"CAST(substr({d}, len({d}) - i, 1) AS INT)"
    return f"(list_sum(list_transform(range(len({d})), lambda i: CASE WHEN i % 2 = 0 THEN {at} WHEN {at} > 4 THEN 2 * {at} - 9 ELSE 2 * {at} END)) % 10 = 0)"


# --- text -------------------------------------------------------------------------------------------------------------


@query("email_card_by_source", f"""
    WITH d AS (SELECT source, regexp_extract_all(text, '{EMAIL}') AS mails, list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: len(x) BETWEEN 13 AND 19) AS numbers FROM documents),
    mails AS (SELECT source, count(DISTINCT lower(m)) AS n FROM (SELECT source, unnest(mails) AS m FROM d) GROUP BY source),
    cards AS (SELECT source, count(DISTINCT c) AS n FROM (SELECT source, unnest(numbers) AS c FROM d) WHERE {luhn_sql('c')} GROUP BY source)
    SELECT s.source AS source, s.documents, CAST(coalesce(m.n, 0) AS BIGINT) AS emails, CAST(coalesce(c.n, 0) AS BIGINT) AS cards
    FROM (SELECT source, count(*) AS documents FROM documents GROUP BY source) s LEFT JOIN mails m ON s.source = m.source LEFT JOIN cards c ON s.source = c.source
""")  # fmt: skip
def email_card_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different e-mail addresses and Luhn-valid card numbers each source holds; values are hashed, never shown."""
    docs = table(spark, sf_dir, "documents").select("source", "text")
    mails = F.transform(F.regexp_extract_all("text", F.lit(EMAIL), 0), lambda m: F.struct(F.lit("m").alias("kind"), F.lower(m).alias("v")))
    numbers = F.filter(F.regexp_extract_all("text", F.lit("[0-9]+"), 0), lambda x: F.length(x).between(13, 19) & F.call_function("luhn_check", x))
    cards = F.transform(numbers, lambda c: F.struct(F.lit("c").alias("kind"), c.alias("v")))
    found = docs.select("source", F.explode(F.concat(mails, cards)).alias("x")).select("source", "x.kind", T.keyed_hash(F.col("x.v")).alias("h")).distinct()
    counts = found.groupBy("source").agg(F.count_if(F.col("kind") == "m").alias("emails"), F.count_if(F.col("kind") == "c").alias("cards"))
    every = docs.groupBy("source").agg(F.count("*").alias("documents"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(counts, "source", "left").select("source", "documents", zero("emails"), zero("cards"))


@query("email_hits", f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{EMAIL}')) AS BIGINT) AS emails FROM documents WHERE regexp_matches(text, '{EMAIL}')")
def email_hits(spark, sf_dir):
    n = F.regexp_count("text", F.lit(EMAIL)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("emails")).where("emails > 0")


@query("email_domain_topk", f"""
    SELECT domain, count(*) AS n FROM (SELECT lower(split_part(unnest(regexp_extract_all(text, '{EMAIL}')), '@', 2)) AS domain FROM documents)
    GROUP BY domain ORDER BY n DESC, domain LIMIT 10""")  # fmt: skip
def email_domain_topk(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(EMAIL), 0)).alias("m"))
    return found.groupBy(F.lower(F.split_part("m", F.lit("@"), F.lit(2))).alias("domain")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(10)


@query("card_token_luhn", f"""
    SELECT doc_id, c AS token, {luhn_sql('c')} AS valid FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS c FROM documents) WHERE len(c) BETWEEN 13 AND 19""")  # fmt: skip
def card_token_luhn(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), 0)).alias("token"))
    return found.where(F.length("token").between(13, 19)).select("doc_id", "token", checksums.luhn_valid(F.col("token")).alias("valid"))


PHONE_SQL = "CASE WHEN c_custkey % 3 = 0 THEN '8 (9' ELSE '+7 (9' END || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || ') ' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '-' || substr(lpad(CAST(c_custkey * 37 % 10000 AS VARCHAR), 4, '0'), 1, 2) || '-' || substr(lpad(CAST(c_custkey * 37 % 10000 AS VARCHAR), 4, '0'), 3, 2)"


def _phone(key: Column) -> Column:
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    four = pad(key * 37 % 10_000, 4)
    return F.concat(F.when(key % 3 == 0, "8 (9").otherwise("+7 (9"), pad(key % 100, 2), F.lit(") "), pad(key % 1_000, 3), F.lit("-"), F.substring(four, 1, 2), F.lit("-"), F.substring(four, 3, 2))


@query("phone_normalise", f"SELECT c_custkey, CASE WHEN len(d) = 11 AND d[1] = '8' THEN '7' || d[2:] ELSE d END AS phone FROM (SELECT c_custkey, regexp_replace({PHONE_SQL}, '[^0-9]', '', 'g') AS d FROM customer)")
def phone_normalise(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.phone_digits(_phone(F.col("c_custkey"))).alias("phone"))


def _pads() -> tuple[str, str]:
    key = T.DEFAULT_SALT.encode().ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


@query("value_hash_hmac", f"SELECT c_custkey, substr(sha256(unhex('{_pads()[1]}') || unhex(sha256(unhex('{_pads()[0]}') || encode(c_name)))), 1, 16) AS hash FROM customer")
def value_hash_hmac(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.keyed_hash(F.col("c_name")).alias("hash"))


@query("mask_preview", "SELECT p_partkey, CASE WHEN len(v) > 4 THEN left(v, 2) || repeat('*', greatest(1, len(v) - 4)) || right(v, 2) ELSE repeat('*', len(v)) END AS masked FROM (SELECT p_partkey, substr(p_name, 1, CAST(1 + p_partkey % 9 AS INT)) AS v FROM part)")
def mask_preview(spark, sf_dir):
    value = F.substring("p_name", F.lit(1), (1 + F.col("p_partkey") % 9).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.masked(value).alias("masked"))


@query("context_window", "SELECT doc_id, substr(text, CAST(greatest(doc_id % 90 - 60, 0) + 1 AS INT), CAST(doc_id % 90 + 70 - greatest(doc_id % 90 - 60, 0) AS INT)) AS near FROM documents")
def context_window(spark, sf_dir):
    start = (F.col("doc_id") % 90).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", T.window(F.col("text"), start, start + 10, 60).alias("near"))


@query("whitespace_normalise", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS squeezed FROM documents")
def whitespace_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.squeeze(F.col("text"))).alias("squeezed"))


@query("marker_count", f"SELECT page_id, CAST({sql_count('lower(html)', L.NOISE_MARKERS)} AS BIGINT) AS noise, CAST({sql_count('lower(html)', L.PUBLIC_DOC_KEYWORDS)} AS BIGINT) AS public_words FROM pages")
def marker_count(spark, sf_dir):
    low = F.lower("html")
    return table(spark, sf_dir, "pages").select("page_id", T.marker_count(low, L.NOISE_MARKERS).cast("long").alias("noise"), T.marker_count(low, L.PUBLIC_DOC_KEYWORDS).cast("long").alias("public_words"))


ADDRESS_TEXT = "CASE c_custkey % 5 WHEN 0 THEN c_custkey || ' High Street, Springfield' WHEN 1 THEN 'г. Москва, ул. Мира, д. ' || c_custkey WHEN 2 THEN c_name WHEN 3 THEN 'suite of the floor' ELSE 'avenue ' || c_name END"


@query("address_plausible", f"""
    SELECT c_custkey, ({sql_count('l', L.ADDRESS_MARKERS)} >= 2 OR {sql_count('l', L.ENGLISH_ADDRESS_MARKERS)} >= 2
      OR ({sql_count('l', L.ENGLISH_ADDRESS_MARKERS)} >= 1 AND regexp_matches(v, '\\b[0-9]+[A-Za-z]?\\b') AND contains(v, ','))) AS plausible
    FROM (SELECT c_custkey, {ADDRESS_TEXT} AS v, lower({ADDRESS_TEXT}) AS l FROM customer)""")  # fmt: skip
def address_plausible(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", plausible.address(F.expr(ADDRESS_TEXT)).alias("plausible"))


NAME_TEXT = "CASE c_custkey % 6 WHEN 0 THEN 'Ivan Petrov' WHEN 1 THEN 'Anna-Maria Stone' WHEN 2 THEN 'Best Bank' WHEN 3 THEN 'ivan petrov' WHEN 4 THEN 'Phone Number' ELSE 'Al Bo Cy Di' END"


@query("person_name_plausible", f"SELECT c_custkey, c_custkey % 6 < 2 AS plausible FROM (SELECT c_custkey, {NAME_TEXT} AS v FROM customer)")
def person_name_plausible(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", plausible.person_name(F.expr(NAME_TEXT)).alias("plausible"))


# --- checks -----------------------------------------------------------------------------------------------------------


@query("snils_checksum", f"SELECT o_orderkey, {snils_sql(sql_digits('o_orderkey', 48271, 11))} AS valid FROM orders")
def snils_checksum(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", checksums.snils_valid(key_digits(F.col("o_orderkey"), 48271, 11)).alias("valid"))


@query("inn10_checksum", f"SELECT o_orderkey, {inn10_sql(sql_digits('o_orderkey', 7919, 10))} AS valid FROM orders")
def inn10_checksum(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", checksums.inn_valid(key_digits(F.col("o_orderkey"), 7919, 10)).alias("valid"))


@query("inn12_checksum", f"SELECT o_orderkey, {inn12_sql(sql_digits('o_orderkey', 104729, 12))} AS valid FROM orders")
def inn12_checksum(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", checksums.inn_valid(key_digits(F.col("o_orderkey"), 104729, 12)).alias("valid"))


BIK_TEXT = "CASE WHEN s_suppkey % 7 = 0 THEN '000000000' WHEN s_suppkey % 5 = 0 THEN '04452' ELSE lpad(CAST(s_suppkey * 7919 % 1000000000 AS STRING), 9, '0') END"
ACCOUNT_TEXT = "CASE WHEN s_suppkey % 11 = 0 THEN repeat('0', 20) ELSE lpad(CAST(s_suppkey * 104729 AS STRING), 20, '4') END"


@query("bik_check", f"SELECT s_suppkey, (len(b) = 9 AND b <> '000000000') AS valid FROM (SELECT s_suppkey, {BIK_TEXT} AS b FROM supplier)")
def bik_check(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", checksums.bik_valid(F.expr(BIK_TEXT)).alias("valid"))


@query("account_bik", f"SELECT s_suppkey, (len(b) = 9 AND b <> '000000000' AND len(a) = 20 AND a <> repeat('0', 20)) AS valid FROM (SELECT s_suppkey, {BIK_TEXT} AS b, {ACCOUNT_TEXT} AS a FROM supplier)")
def account_bik(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", checksums.account_valid(F.expr(ACCOUNT_TEXT), F.expr(BIK_TEXT)).alias("valid"))


@query("birth_date_check", """
    SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 1 THEN '31.02.' || year(o_orderdate) ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value,
           (o_orderkey % 3 <> 1 AND CAST(o_orderdate AS DATE) <= DATE '1996-01-01') AS valid FROM orders""")  # fmt: skip
def birth_date_check(spark, sf_dir):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    value = F.when(key % 3 == 0, F.date_format(day, "dd.MM.yyyy")).when(key % 3 == 1, F.concat(F.lit("31.02."), F.year(day).cast("string"))).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", value.alias("value"), checksums.birth_date_valid(value, F.lit("1996-01-01").cast("timestamp")).alias("valid"))


MRZ_TEXT = "CASE c_custkey % 4 WHEN 0 THEN 'P<RUS' WHEN 1 THEN 'IDRUS' WHEN 2 THEN 'X<RUS' ELSE 'P<' END || lpad(CAST(c_custkey AS STRING), 9, '0') || repeat('<', CAST(10 + c_custkey % 20 AS INT)) || 'A'"


@query("mrz_check", f"SELECT c_custkey, (len(v) BETWEEN 30 AND 44 AND (starts_with(v, 'P<') OR starts_with(v, 'ID'))) AS valid FROM (SELECT c_custkey, {MRZ_TEXT} AS v FROM customer)")
def mrz_check(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", checksums.mrz_valid(F.expr(MRZ_TEXT)).alias("valid"))


# --- detectors on texts made from keys --------------------------------------------------------------------------------


def detector_query(name: str, source: str, key: str, text: str, expected: str, *categories: str) -> None:
    """Hits of some categories in one chunk a row: (key, category, value, confidence, validation)."""

    def run(spark, sf_dir):
        chunks = table(spark, sf_dir, source).select(F.col(key).cast("string").alias("file_id"), F.lit(0).alias("raw_idx"), F.expr(text).alias("text"))
        hits = find_hits(chunks, SETTINGS, categories)
        return hits.select(F.col("file_id").cast("long").alias(key), "category", F.col("normalized_value").alias("value"), "confidence", "validation")

    query(name, expected)(run)


def spark_digits(key: str, factor: int, n: int) -> str:
    return f"lpad(CAST({key} * {factor} % {10**n} AS STRING), {n}, '0')"


def checked_sql(key: str, source: str, digits: str, valid: str, category: str) -> str:
    return f"""SELECT {key}, {category} AS category, d AS value, CASE WHEN v THEN 'high' ELSE 'low' END AS confidence, CASE WHEN v THEN 'valid' ELSE 'invalid' END AS validation
               FROM (SELECT {key}, d, {valid} AS v FROM (SELECT {key}, {digits} AS d FROM {source}))"""


detector_query("det_snils", "customer", "c_custkey", f"'СНИЛС ' || {spark_digits('c_custkey', 48271, 11)}", checked_sql("c_custkey", "customer", sql_digits("c_custkey", 48271, 11), snils_sql("d"), "'snils'"), "snils")
detector_query("det_inn", "customer", "c_custkey", f"'ИНН: ' || {spark_digits('c_custkey', 7919, 10)}", checked_sql("c_custkey", "customer", sql_digits("c_custkey", 7919, 10), inn10_sql("d"), "'inn_legal_entity'"), "inn_legal_entity", "inn_individual")
detector_query("det_inn_unlabelled", "orders", "o_orderkey", f"'ref ' || {spark_digits('o_orderkey', 104729, 12)}", checked_sql("o_orderkey", "orders", sql_digits("o_orderkey", 104729, 12), inn12_sql("d"), "'inn_individual'") + " WHERE v", "inn_individual", "inn_legal_entity")
detector_query("det_bank_card", "customer", "c_custkey", f"'visa card 4' || {spark_digits('c_custkey', 104729, 15)}", checked_sql("c_custkey", "customer", "'4' || " + sql_digits("c_custkey", 104729, 15), luhn_sql("d"), "'bank_card'"), "bank_card")
detector_query("det_bik", "supplier", "s_suppkey", f"'БИК ' || {BIK_TEXT}", f"SELECT s_suppkey, 'bik' AS category, b AS value, CASE WHEN b <> '000000000' THEN 'high' ELSE 'low' END AS confidence, CASE WHEN b <> '000000000' THEN 'valid' ELSE 'invalid' END AS validation FROM (SELECT s_suppkey, {BIK_TEXT} AS b FROM supplier) WHERE len(b) = 9", "bik")
detector_query("det_account", "supplier", "s_suppkey", f"'счет ' || {ACCOUNT_TEXT} || ' бик ' || {BIK_TEXT}", f"SELECT s_suppkey, 'bank_account' AS category, a AS value, CASE WHEN v THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN v THEN 'valid' ELSE 'unknown' END AS validation FROM (SELECT s_suppkey, {ACCOUNT_TEXT} AS a, len({BIK_TEXT}) = 9 AND {BIK_TEXT} <> '000000000' AND {ACCOUNT_TEXT} <> repeat('0', 20) AS v FROM supplier)", "bank_account")
detector_query("det_cvv", "supplier", "s_suppkey", "CASE WHEN s_suppkey % 2 = 0 THEN 'card ' ELSE '' END || 'cvv ' || CAST(100 + s_suppkey % 900 AS STRING)", "SELECT s_suppkey, 'cvv_cvc' AS category, CAST(100 + s_suppkey % 900 AS VARCHAR) AS value, 'medium' AS confidence, 'unknown' AS validation FROM supplier WHERE s_suppkey % 2 = 0", "cvv_cvc")
detector_query("det_passport_combined", "customer", "c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN 'order ' ELSE 'паспорт серия ' END || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') || ' номер ' || lpad(CAST(c_custkey * 7919 % 1000000 AS STRING), 6, '0')", "SELECT c_custkey, 'passport_series_number' AS category, lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || lpad(CAST(c_custkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS value, 'high' AS confidence, 'valid' AS validation FROM customer WHERE c_custkey % 3 <> 0", "passport_series_number")
detector_query("det_passport_parts", "customer", "c_custkey", "'passport series: ' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') || ' | passport number: ' || lpad(CAST(c_custkey * 7919 % 1000000 AS STRING), 6, '0')", "SELECT c_custkey, 'passport_series' AS category, lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS value, 'medium' AS confidence, 'valid' AS validation FROM customer UNION ALL SELECT c_custkey, 'passport_number', lpad(CAST(c_custkey * 7919 % 1000000 AS VARCHAR), 6, '0'), 'medium', 'valid' FROM customer", "passport_series", "passport_number")
detector_query("det_driver_license", "customer", "c_custkey", f"CASE WHEN c_custkey % 2 = 0 THEN 'driver license ' ELSE 'licence of ' END || {spark_digits('c_custkey', 7919, 10)}", f"SELECT c_custkey, 'driver_license' AS category, {sql_digits('c_custkey', 7919, 10)} AS value, 'medium' AS confidence, 'unknown' AS validation FROM customer WHERE c_custkey % 2 = 0", "driver_license")
detector_query("det_mrz", "customer", "c_custkey", MRZ_TEXT, f"SELECT c_custkey, 'mrz' AS category, v AS value, CASE WHEN f THEN 'high' ELSE 'low' END AS confidence, CASE WHEN f THEN 'valid' ELSE 'invalid' END AS validation FROM (SELECT c_custkey, v, len(v) >= 30 AND contains(v, '<') AS f FROM (SELECT c_custkey, {MRZ_TEXT} AS v FROM customer)) WHERE len(v) BETWEEN 30 AND 44 AND (starts_with(v, 'P<') OR starts_with(v, 'ID'))", "mrz")
detector_query("det_phone", "customer", "c_custkey", f"CASE WHEN c_custkey % 2 = 0 THEN 'phone: ' ELSE 'ref: ' END || {PHONE_SQL.replace('VARCHAR', 'STRING')}", f"SELECT c_custkey, 'phone' AS category, CASE WHEN d[1] = '8' THEN '7' || d[2:] ELSE d END AS value, 'high' AS confidence, 'valid' AS validation FROM (SELECT c_custkey, regexp_replace({PHONE_SQL}, '[^0-9]', '', 'g') AS d FROM customer WHERE c_custkey % 2 = 0) UNION ALL SELECT c_custkey, 'phone', d[2:], 'high', 'valid' FROM (SELECT c_custkey, regexp_replace({PHONE_SQL}, '[^0-9]', '', 'g') AS d FROM customer WHERE c_custkey % 6 = 0)", "phone")
detector_query("det_email", "customer", "c_custkey", "'mail Cust.' || CAST(c_custkey AS STRING) || '@Example.org now'", "SELECT c_custkey, 'email' AS category, 'cust.' || c_custkey || '@example.org' AS value, 'high' AS confidence, 'valid' AS validation FROM customer", "email")
detector_query("det_birth_date", "orders", "o_orderkey", "CASE WHEN o_orderkey % 4 = 0 THEN 'seen ' ELSE 'date of birth: ' END || CASE WHEN o_orderkey % 5 = 0 THEN '31.02.1990' ELSE date_format(o_orderdate, 'dd.MM.yyyy') END", "SELECT o_orderkey, 'birth_date' AS category, v AS value, CASE WHEN f THEN 'high' ELSE 'low' END AS confidence, CASE WHEN f THEN 'valid' ELSE 'invalid' END AS validation FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '31.02.1990' ELSE strftime(o_orderdate, '%d.%m.%Y') END AS v, o_orderkey % 5 <> 0 AND CAST(o_orderdate AS DATE) <= DATE '2000-01-01' AS f FROM orders WHERE o_orderkey % 4 <> 0)", "birth_date")
detector_query("det_address", "customer", "c_custkey", "'Mailing Address: ' || CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS STRING) || ' High Street, Springfield' ELSE 'nowhere' END || ' | x: 1'", "SELECT c_custkey, 'address' AS category, c_custkey || ' high street, springfield' AS value, 'high' AS confidence, 'unknown' AS validation FROM customer WHERE c_custkey % 2 = 0", "address")
detector_query("det_birth_place", "customer", "c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN 'home: Moscow' WHEN c_custkey % 3 = 1 THEN 'Place of birth: Moscow City' ELSE 'place of birth: some llc' END || ' | x'", "SELECT c_custkey, 'birth_place' AS category, 'moscow city' AS value, 'medium' AS confidence, 'unknown' AS validation FROM customer WHERE c_custkey % 3 = 1", "birth_place")
detector_query("det_person_name", "customer", "c_custkey", "CASE c_custkey % 3 WHEN 0 THEN 'ФИО: Иванов Иван Иванович' WHEN 1 THEN 'full name: Alice Monroe | a' ELSE 'name: Bob Stone' END", "SELECT c_custkey, 'person_name' AS category, CASE c_custkey % 3 WHEN 0 THEN 'иванов иван иванович' ELSE 'alice monroe' END AS value, 'high' AS confidence, 'unknown' AS validation FROM customer WHERE c_custkey % 3 < 2", "person_name")
detector_query("det_sensitive_labelled", "customer", "c_custkey", "CASE WHEN c_custkey % 2 = 0 THEN 'диагноз: грипп ' ELSE 'национальность = ' END || CAST(c_custkey AS STRING)", "SELECT c_custkey, 'health_data' AS category, 'диагноз: грипп ' || c_custkey AS value, 'high' AS confidence, 'unknown' AS validation FROM customer WHERE c_custkey % 2 = 0", "health_data", "nationality_data")
detector_query("det_sensitive_context", "customer", "c_custkey", "CASE WHEN c_custkey % 2 = 0 THEN 'employee ' ELSE 'we ' END || 'fingerprints taken'", "SELECT c_custkey, 'fingerprints' AS category, 'fingerprints' AS value, 'medium' AS confidence, 'unknown' AS validation FROM customer WHERE c_custkey % 2 = 0", "fingerprints")


# --- aggregation over detections made from keys -----------------------------------------------------------------------

CASES = (
    ("ordinary", "email", "high", "valid"), ("ordinary", "person_name", "high", "unknown"), ("ordinary", "birth_date", "low", "invalid"),
    ("government", "snils", "high", "valid"), ("government", "inn_individual", "low", "invalid"), ("payment", "bank_card", "high", "valid"),
    ("payment", "bank_account", "medium", "unknown"), ("special", "health_data", "medium", "unknown"),
)


def _case(at: Column, i: int) -> Column:
    return F.element_at(F.array(*(F.lit(c[i]) for c in CASES)), (at + 1).cast("int"))


def made_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hit for each line item: the file is the order's hundred, the value repeats."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    at = (key * 7 + line) % len(CASES)
    return table(spark, sf_dir, "lineitem").select(
        (F.floor(key / 100)).cast("string").alias("file_id"), _case(at, 0).alias("family"), _case(at, 1).alias("category"), F.lit("made").alias("detector_id"),
        _case(at, 2).alias("confidence"), _case(at, 3).alias("validation"), F.concat(F.lit("v"), (key % 13).cast("string")).alias("value_hash"),
        F.lit(None).cast("string").alias("masked_preview"), F.lit(None).cast("string").alias("fragment"), F.lit(None).cast("string").alias("raw_value"),
        (key % 40).cast("int").alias("norm_idx"), line.alias("start"), (line + 1).alias("end"), F.array(F.lit("k"), (line % 3).cast("string")).alias("keywords"),
        F.array(F.concat(F.lit("chunk:"), (key % 40).cast("string")), F.concat(F.lit("span:"), line.cast("string"), F.lit(":"), (line + 1).cast("string"))).alias("location_hints"),
        F.array(F.lit(0), (key % 100).cast("int"), line).alias("order_key"),
    )


_PICK = {i: f"{quoted([c[i] for c in CASES])}[(l_orderkey * 7 + l_linenumber) % {len(CASES)} + 1]" for i in range(4)}
HITS_SQL = f"""
    SELECT CAST(l_orderkey // 100 AS VARCHAR) AS file_id, {_PICK[0]} AS family, {_PICK[1]} AS category, {_PICK[2]} AS confidence, {_PICK[3]} AS validation,
           'v' || l_orderkey % 13 AS value_hash, ['chunk:' || l_orderkey % 40, 'span:' || l_linenumber || ':' || (l_linenumber + 1)] AS hints,
           ['k', CAST(l_linenumber % 3 AS VARCHAR)] AS keywords, l_orderkey % 100 AS a, l_linenumber AS b FROM lineitem"""
DEDUP_SQL = f"""
    WITH h AS ({HITS_SQL}),
    d AS (SELECT file_id, family, category, value_hash, count(*) AS occurrences, list_sort(list_distinct(flatten(list(hints)))) AS hints,
                 list_sort(list_distinct(flatten(list(keywords)))) AS keywords, any_value(confidence) AS confidence, any_value(validation) AS validation, min([a, b]) AS first
          FROM h GROUP BY ALL)"""
DEDUP_SQL = DEDUP_SQL.replace("FROM h GROUP BY ALL)", "FROM h GROUP BY file_id, family, category, value_hash)")


@query("dedup_hits", DEDUP_SQL + " SELECT file_id, category, value_hash, occurrences, array_to_string(hints, ',') AS hints, array_to_string(keywords, ',') AS keywords, confidence, CAST(first[2] AS BIGINT) AS first_line FROM d")
def dedup_hits(spark, sf_dir):
    found = deduplicate(made_hits(spark, sf_dir), ("confidence", "start"))
    joined = lambda c: F.array_join(c, ",")
    return found.select("file_id", "category", "value_hash", "occurrences", joined("location_hints").alias("hints"), joined("keywords").alias("keywords"), "confidence", F.col("start").cast("long").alias("first_line"))


@query("counts_by_category", DEDUP_SQL + " SELECT file_id, category, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM d GROUP BY ALL")
def counts_by_category(spark, sf_dir):
    return aggregate.counts_by(deduplicate(made_hits(spark, sf_dir), ("confidence", "validation")), "category")


@query("counts_by_family", DEDUP_SQL + " SELECT file_id, family, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM d GROUP BY ALL")
def counts_by_family(spark, sf_dir):
    return aggregate.counts_by(deduplicate(made_hits(spark, sf_dir), ("confidence", "validation")), "family")


@query("validated_counts", DEDUP_SQL + " SELECT file_id, category, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM d WHERE validation = 'valid' GROUP BY ALL")
def validated_counts(spark, sf_dir):
    return aggregate.validated_counts(deduplicate(made_hits(spark, sf_dir), ("confidence", "validation")))


@query("entity_counts", DEDUP_SQL + " SELECT file_id, CAST(sum(CASE WHEN validation = 'valid' THEN occurrences ELSE 0 END) AS BIGINT) AS validated, CAST(sum(CASE WHEN validation = 'invalid' OR confidence = 'low' THEN occurrences ELSE 0 END) AS BIGINT) AS suspicious FROM d GROUP BY ALL")
def entity_counts(spark, sf_dir):
    return aggregate.entity_counts(deduplicate(made_hits(spark, sf_dir), ("confidence", "validation")))


@query("confidence_summary", DEDUP_SQL + " SELECT file_id, confidence, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM d GROUP BY ALL")
def confidence_summary(spark, sf_dir):
    return aggregate.counts_by(deduplicate(made_hits(spark, sf_dir), ("confidence", "validation")), "confidence")


FAMILY_SQL = DEDUP_SQL + """,
    e AS (SELECT * FROM d WHERE confidence IN ('high', 'medium') AND (family <> 'payment' OR validation = 'valid') AND NOT (family = 'government' AND validation = 'invalid')),
    f AS (SELECT file_id, family, CAST(sum(occurrences) AS BIGINT) AS occurrences, count(DISTINCT value_hash) AS unique_values, CAST(len(list_distinct(flatten(list(hints)))) AS BIGINT) AS places FROM e GROUP BY file_id, family)"""


@query("family_summary", FAMILY_SQL + " SELECT * FROM f")
def family_summary(spark, sf_dir):
    return aggregate.family_summary(deduplicate(made_hits(spark, sf_dir), ("confidence", "validation")))


@query("large_volume", FAMILY_SQL + """ SELECT file_id, family, CASE family WHEN 'ordinary' THEN unique_values >= 20 OR occurrences >= 100 OR places >= 50
       WHEN 'government' THEN unique_values >= 5 OR occurrences >= 20 OR places >= 10 WHEN 'payment' THEN unique_values >= 3 OR occurrences >= 5 OR places >= 3 ELSE false END AS is_large FROM f""")  # fmt: skip
def large_volume(spark, sf_dir):
    c = F.col
    f = aggregate.family_summary(deduplicate(made_hits(spark, sf_dir), ("confidence", "validation")))
    return f.select("file_id", "family", aggregate.is_large(c("family"), c("unique_values"), c("occurrences"), c("places")).alias("is_large"))


@query("top_files", DEDUP_SQL + " SELECT file_id AS rel_path, CAST(sum(occurrences) AS BIGINT) AS total_hits FROM d GROUP BY file_id ORDER BY total_hits DESC, rel_path LIMIT 10")
def top_files(spark, sf_dir):
    hits = deduplicate(made_hits(spark, sf_dir), ("confidence", "validation")).groupBy(F.col("file_id").alias("rel_path")).agg(F.sum("occurrences").alias("total_hits"))
    return reports.top_files(hits)


# --- quality ----------------------------------------------------------------------------------------------------------

NOISE_SQL = (
    f"({sql_count('lower(html)', L.NOISE_MARKERS)} >= 2 OR len(regexp_extract_all(html, '\\b[A-Za-z0-9_-]{{20,}}\\b')) + len(regexp_extract_all(html, '(?i)\\b[a-f0-9]{{24,}}\\b')) "
    "+ len(regexp_extract_all(html, '(?i)\\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\\b')) >= 3 "
    "OR len(regexp_replace(html, '[^{}\\[\\]=;<>/&]', '', 'g')) / greatest(len(html), 1) >= 0.08)"
)


@query("html_noise", f"SELECT page_id, {NOISE_SQL} AS noise FROM (SELECT page_id, substr(html, CAST(page_id * 17 % 900 AS INT) + 1, 200) AS html FROM pages)")
def html_noise(spark, sf_dir):
    part = F.substring("html", (F.col("page_id") * 17 % 900).cast("int") + 1, F.lit(200))
    return table(spark, sf_dir, "pages").select("page_id", quality.html_noise(part).alias("noise"))


@query("html_noise_whole", f"SELECT page_id, {NOISE_SQL} AS noise FROM pages")
def html_noise_whole(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", quality.html_noise(F.col("html")).alias("noise"))


WEB_TEXT = "CASE c_custkey % 3 WHEN 0 THEN 'Follow Us on Telegram and Twitter ' WHEN 1 THEN 'rss comments ' ELSE 'plain ' END || c_name"


@query("public_web_page", f"SELECT c_custkey, {sql_count('v', L.PUBLIC_WEB_MARKERS)} >= 3 AS public FROM (SELECT c_custkey, lower({WEB_TEXT}) AS v FROM customer)")
def public_web_page(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", quality.public_web(F.expr(WEB_TEXT)).alias("public"))


FORM_TEXT = "CASE c_custkey % 4 WHEN 0 THEN 'Full name: ____ Address: ____ Passport: ____' WHEN 1 THEN '.... ____ .... ____' WHEN 2 THEN 'first name and last name and address' ELSE c_name END"


@query("template_flag", "SELECT c_custkey, c_custkey % 4 < 3 AND c_custkey % 2 = 0 OR c_custkey % 4 = 1 AND c_custkey % 8 <> 1 AS is_template FROM customer")
def template_flag(spark, sf_dir):
    one = lambda family, category, confidence, validation: F.struct(
        F.lit(family).alias("family"), F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), F.lit(validation).alias("validation"),
        F.lit(1).cast("bigint").alias("occurrences"), F.lit("h").alias("value_hash"), F.array().cast("array<string>").alias("location_hints"))
    cand = F.when(F.col("c_custkey") % 8 == 1, F.array(one("ordinary", "email", "high", "valid"))).otherwise(F.array(one("ordinary", "phone", "high", "unknown")))
    return table(spark, sf_dir, "customer").select("c_custkey", quality.template_flag(F.expr(FORM_TEXT), cand)[0].alias("is_template"))




def no_dets() -> Column:
    return F.array().cast(D.DETS)


POLICY_TEXT = "CASE c_custkey % 3 WHEN 0 THEN 'Privacy Policy and terms' WHEN 1 THEN 'the controller has consent' ELSE c_name END"


@query("public_doc_flag", f"SELECT c_custkey, {sql_count('v', L.PUBLIC_DOC_KEYWORDS)} + {sql_count('v', L.LEGAL_MARKERS)} >= 3 AS is_public FROM (SELECT c_custkey, 'files/' || c_custkey || chr(10) || lower({POLICY_TEXT}) AS v FROM customer)")
def public_doc_flag(spark, sf_dir):
    path = F.concat(F.lit("files/"), F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", quality.public_doc_flag(path, F.expr(POLICY_TEXT), no_dets())[0].alias("is_public"))


REF_TEXT = "CASE p_partkey % 3 WHEN 0 THEN 'product: ' || p_name || ' | status: new' WHEN 1 THEN 'address: x | phone: y' ELSE p_name END"


@query("reference_flag", f"""
    SELECT p_partkey, p_partkey % 5 < 4 AND (contains(path, 'catalog') OR {sql_count('v', L.REFERENCE_FIELD_MARKERS)} >= 2 OR len(regexp_extract_all(v, '\\b(?:id|uuid|guid|token|hash|status|code)\\b')) >= 2)
           AND {sql_count('v', L.PERSONAL_FIELD_MARKERS)} <= 1 AS is_reference
    FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'catalog/x' ELSE 'hr/x' END AS path, lower({REF_TEXT}) AS v FROM part)""")  # fmt: skip
def reference_flag(spark, sf_dir):
    key = F.col("p_partkey")
    flag, _ = quality.reference_flag(F.when(key % 2 == 0, "catalog/x").otherwise("hr/x"), F.when(key % 5 < 4, "csv").otherwise("txt"), F.array().cast("array<string>"), F.expr(REF_TEXT), no_dets())
    return table(spark, sf_dir, "part").select("p_partkey", flag.alias("is_reference"))


@query("schema_boost", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'medium' WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 1 THEN 'high' WHEN c_custkey % 3 = 0 THEN 'low' WHEN c_custkey % 3 = 1 THEN 'medium' ELSE 'high' END AS confidence FROM customer")
def schema_boost(spark, sf_dir):
    key = F.col("c_custkey")
    text = F.when(key % 2 == 0, "СНИЛС: 1").otherwise("value: 1")
    conf = F.when(key % 3 == 0, "low").when(key % 3 == 1, "medium").otherwise("high")
    return table(spark, sf_dir, "customer").select("c_custkey", quality.boosted(conf, F.lit("valid"), F.lit("snils"), text, F.lit("csv")).alias("confidence"))


@query("structured_noise", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'SUPPRESSED_STRUCTURED_NOISE:phone' WHEN 2 THEN 'SUPPRESSED_BIRTH_DATE_NO_CONTEXT' ELSE 'SUPPRESSED_STRUCTURED_NOISE:person_name' END AS reason FROM customer")
def structured_noise(spark, sf_dir):
    at = F.col("c_custkey") % 4
    category = F.when(at < 2, "phone").when(at == 2, "birth_date").otherwise("person_name")
    text = F.when(at == 0, "Phone: 1 | id: 2 | status: 3").when(at == 1, "uuid: 1 | status: 3").when(at == 2, "created: 01.01.1990").otherwise("name: x")
    reason = quality.suppress_reason(category, F.lit("x"), F.array(F.lit("k")), text, F.lit("csv"), F.lit("csv"))
    return table(spark, sf_dir, "customer").select("c_custkey", reason.alias("reason"))


# --- gates: detections by the bits of a key, path and text by its remainders -------------------------------------------

GATE_CASES = (
    ("ordinary", "person_name", "high", "unknown"), ("ordinary", "email", "high", "valid"), ("ordinary", "address", "high", "unknown"), ("government", "snils", "high", "valid"),
    ("payment", "bank_card", "low", "invalid"), ("special", "health_data", "medium", "unknown"), ("payment", "bik", "high", "valid"),
)
GATE_PATHS = ("hr/anketa.x", "sites/a.x", "hr/policy.x", "plain.x", "hr/passport and university.x", "реестр.x")
GATE_TEXTS = ("nothing here", "full name and phone of staff", "follow us telegram twitter rss", "университет проректор", "privacy report", "info@ contact us")


def made_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    one = lambda c, i: F.when(F.shiftright(key, i).bitwiseAND(F.lit(1).cast("long")) == 1, F.struct(
        F.lit(c[0]).alias("family"), F.lit(c[1]).alias("category"), F.lit(c[2]).alias("confidence"), F.lit(c[3]).alias("validation"),
        (key % 6 + 1).alias("occurrences"), F.concat(F.lit(c[1]), (key % 7).cast("string")).alias("value_hash"), F.array(F.lit("chunk:0")).alias("location_hints")))
    pick = lambda entries, k: F.element_at(F.array(*map(F.lit, entries)), (k % len(entries) + 1).cast("int"))
    cand = F.filter(F.array(*(one(c, i) for i, c in enumerate(GATE_CASES))), lambda x: x.isNotNull())
    return table(spark, sf_dir, "part").select(key, cand.alias("cand"), pick(GATE_PATHS, key).alias("rel_path"), pick(GATE_TEXTS, F.floor(key / 6)).alias("sample"))


_BIT = lambda i: f"(p_partkey >> {i}) & 1 = 1"
FILES_SQL = f"""
    SELECT p_partkey, {quoted(GATE_PATHS)}[p_partkey % {len(GATE_PATHS)} + 1] AS path, {quoted(GATE_TEXTS)}[(p_partkey // 6) % {len(GATE_TEXTS)} + 1] AS txt, p_partkey % 6 + 1 AS occ,
           {', '.join(f"{_BIT(i)} AS has_{c[1]}" for i, c in enumerate(GATE_CASES))} FROM part"""
FLAGS_SQL = f"""
    WITH f AS ({FILES_SQL}),
    g AS (SELECT *, path || chr(10) || txt AS combined, NOT ({' OR '.join('has_' + c[1] for c in GATE_CASES)}) AS empty, has_email OR has_address AS companion, has_person_name OR has_snils AS anchored,
                 {sql_count("path || chr(10) || txt", L.PDF_PUBLIC_MARKERS)} AS pub, {sql_count("path || chr(10) || txt", L.PDF_OFFICIAL_MARKERS)} AS off, {sql_count('txt', L.PUBLIC_WEB_MARKERS)} >= 3 AS web FROM f),
    h AS (SELECT *, pub >= 2 OR (pub >= 1 AND off >= 1) AS official, has_health_data OR has_snils OR (anchored AND companion) AS docx_strong,
                 NOT (has_snils OR has_bank_card OR has_health_data) AS docx_weak FROM g)"""


def gate_query(name: str, file_format: str, sql: str) -> None:
    def run(spark, sf_dir):
        return quality.with_gate(made_files(spark, sf_dir), F.lit(file_format)).select("p_partkey", "gate.keep", "gate.reason")

    query(name, FLAGS_SQL + f", j AS (SELECT p_partkey, CASE WHEN empty THEN 'keep:' {sql} END AS r FROM h) SELECT p_partkey, r LIKE 'keep:%' AS keep, nullif(substr(r, 6), '') AS reason FROM j")(run)


def _office(prefix: str, extra: str = "") -> str:
    return (
        f"WHEN docx_strong THEN 'keep:{prefix}_STRONG_BUNDLE' WHEN {sql_count('path', L.DOCX_SITE_MARKERS)} > 0 THEN 'drop:{prefix}_SITE_PUBLIC_PATH' "
        f"WHEN {sql_count('path', L.DOCX_EXCLUDE_MARKERS)} > 0 THEN 'drop:{prefix}_PUBLIC_OR_TEMPLATE_PATH' WHEN {sql_count('path', L.DOCX_SHORTLIST_MARKERS)} = 0 THEN 'drop:{prefix}_PATH_NOT_SHORTLISTED' "
        f"WHEN docx_weak THEN 'drop:{prefix}_WEAK_SIGNALS_ONLY' {extra} ELSE 'drop:{prefix}_NO_STRONG_BUNDLE'"
    )


gate_query("gate_docx", "docx", _office("DOCX"))
gate_query("gate_office", "rtf", _office("OFFICE", "WHEN official THEN 'drop:OFFICE_PUBLIC_OR_TEMPLATE_PATH'"))
gate_query("gate_html", "html", f"""
    WHEN (has_person_name AND occ >= 2 AND companion) OR (NOT web AND ((has_snils AND s) OR (anchored AND companion) OR (has_email AND has_address AND s))) THEN 'keep:HTML_STRONG_BUNDLE'
    WHEN web THEN 'drop:HTML_PUBLIC_WEB_NO_STRONG_BUNDLE' WHEN NOT (has_person_name OR has_snils OR has_bank_card OR has_bik) THEN 'drop:HTML_WEAK_SIGNALS_ONLY' ELSE 'keep:'
""".replace(" s)", f" {sql_count('txt', quality.HTML_SUBJECTS)} > 0)"))  # fmt: skip
gate_query("gate_xls", "xls", f"""
    WHEN has_email AND has_person_name AND {sql_count('lower(combined)', L.XLS_ORG_CONTACT_MARKERS)} > 0
         AND (NOT has_snils OR (occ * (has_email::INT + has_person_name::INT) >= 10 AND NOT (has_snils OR has_bank_card OR has_address))) THEN 'drop:XLS_PUBLIC_CONTACTS_WEAK_BUNDLE'
    WHEN has_snils OR (anchored AND companion) THEN 'keep:XLS_STRONG_BUNDLE' WHEN {sql_count('lower(combined)', L.XLS_DECLARATION_MARKERS)} > 0 THEN 'drop:XLS_DECLARATION_WEAK_BUNDLE'
    WHEN NOT (has_address OR has_snils OR has_bank_card OR has_health_data OR has_bik) THEN 'drop:XLS_WEAK_SIGNALS_ONLY' ELSE 'keep:'""")  # fmt: skip
gate_query("gate_pdf", "pdf", f"""
    WHEN {sql_count('path', L.PDF_PUBLIC_SOURCE_MARKERS)} > 0 THEN 'drop:PDF_PUBLIC_SOURCE' WHEN official THEN 'drop:PDF_PUBLIC_LEGAL_OR_REPORT'
    WHEN companion AND NOT anchored AND {sql_count('combined', L.PDF_ORG_CONTACT_MARKERS)} > 0 THEN 'drop:PDF_ORG_CONTACT_ONLY'
    WHEN {sql_count('combined', quality.REGISTRY_WORDS)} > 0 AND has_snils AND NOT has_person_name THEN 'drop:PDF_PUBLIC_REGISTRY_OR_PROTOCOL'
    WHEN NOT (has_person_name OR has_snils OR has_bank_card OR has_health_data) THEN 'drop:PDF_WEAK_SIGNALS_ONLY'
    WHEN NOT (has_person_name OR has_snils OR has_bank_card) THEN 'drop:PDF_NARRATIVE_NO_PERSON_LINKAGE'
    WHEN anchored AND (has_health_data OR companion OR has_snils) THEN 'keep:PDF_STRONG_BUNDLE' ELSE 'drop:PDF_NO_STRONG_BUNDLE'""")  # fmt: skip
gate_query("gate_image", "image", f"""
    WHEN ({sql_count('combined', L.IMAGE_PUBLIC_MARKERS)} > 0 OR official) AND NOT (anchored AND (has_health_data OR companion OR has_snils)) THEN 'drop:IMAGE_PUBLIC_DOC_NO_STRONG_BUNDLE'
    WHEN anchored AND (has_health_data OR companion OR has_snils) THEN 'keep:IMAGE_STRONG_BUNDLE'
    WHEN NOT (has_snils OR has_bank_card OR has_health_data OR has_bik) THEN 'drop:IMAGE_WEAK_SIGNALS_ONLY' ELSE 'drop:IMAGE_NO_STRONG_BUNDLE'""")  # fmt: skip


@query("file_suppression", f"""WITH f AS ({FILES_SQL}), t AS (SELECT *, has_person_name OR has_address OR has_snils OR has_bik AS trusted FROM f)
    SELECT p_partkey, CAST(CASE WHEN p_partkey % 5 IN (0, 2) AND NOT trusted THEN 0
      WHEN p_partkey % 5 = 1 AND NOT (has_person_name OR has_address) THEN has_snils::INT + has_bank_card::INT + has_health_data::INT + has_bik::INT
      ELSE has_person_name::INT + has_email::INT + has_address::INT + has_snils::INT + has_bank_card::INT + has_health_data::INT + has_bik::INT END AS BIGINT) AS kept FROM t""")  # fmt: skip
def file_suppression(spark, sf_dir):
    key = F.col("p_partkey")
    left = quality.after_flags(F.col("cand"), key % 5 == 0, key % 5 == 1, key % 5 == 2)
    return made_files(spark, sf_dir).select("p_partkey", F.size(left).cast("long").alias("kept"))


# --- storage context and level over the same files ----------------------------------------------------------------------


def made_assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    none = F.array().cast("array<string>")
    return made_files(spark, sf_dir).select(
        key, "cand", "rel_path", F.concat("sample", F.when(key % 7 == 0, " acme llc").otherwise("")).alias("sample"), F.when(key % 5 == 0, "pdf").otherwise("txt").alias("format"),
        F.when(key % 3 == 0, "csv").otherwise("txt").alias("extractor"), F.when(key % 4 == 0, F.array(F.lit("customer_name"), F.lit("address"))).otherwise(none).alias("header"),
        (key * 13 % 300).alias("rows_scanned"), (key % 11 == 0).alias("is_template"), (key % 13 == 0).alias("is_public_doc"), (key % 17 == 0).alias("is_reference_data"),
        F.when(key % 8 < 6, F.col("cand")).otherwise(F.array().cast(D.DETS)).alias("final"), none.alias("quality_reasons"),
    )


def _some(text: str, markers: Sequence[str]) -> str:
    return f"{sql_count(text, markers)} > 0"


_HARD, _CASES = "(has_snils OR has_bank_card)", [c[1] for c in GATE_CASES]
DECIDE_SQL = f"""
    WITH f AS ({FILES_SQL}),
    i AS (SELECT *, path || chr(10) || txt || CASE WHEN p_partkey % 7 = 0 THEN ' acme llc' ELSE '' END AS t, CASE WHEN p_partkey % 4 = 0 THEN 'customer_name address' ELSE '' END AS hdr, p_partkey % 3 = 0 AS tab,
                 p_partkey * 13 % 300 AS nrows, p_partkey % 11 = 0 AS tmpl, p_partkey % 13 = 0 AS pubdoc, p_partkey % 17 = 0 AS refd, p_partkey % 8 < 6 AS kept,
                 {_HARD} AS hard, has_email OR has_address AS comp, has_person_name OR has_address OR has_snils OR has_bik AS trusted, NOT ({' OR '.join('has_' + c for c in _CASES)}) AS nothing FROM f),
    a AS (SELECT *, NOT tmpl AND {_some('t', L.PERSONAL_FORM_MARKERS)} AS form, {sql_count('hdr', L.PERSONAL_EXPORT_HEADER_MARKERS)} AS hh FROM i),
    b AS (SELECT *, NOT form AND {_some('t', L.JUSTIFIED_PUBLIC_MARKERS)} AND (has_email OR {_some('t', ('@', 'телефон', 'phone'))}) AND (has_person_name OR trusted OR has_address OR {_some('t', ('ответствен', 'responsible', 'directory'))}) AS contact,
                 NOT form AND {_some('t', L.PUBLIC_REPORT_MARKERS)} AS report, {_some('t', L.ORG_REQUISITE_MARKERS)} OR (has_bik AND NOT (hard OR has_person_name)) AS org,
                 {_some('t', L.INTERNAL_DOC_MARKERS)} AS internal, {_some('t', L.CORRESPONDENCE_MARKERS)} AS corr, p_partkey % 5 = 0 AND (hard OR has_health_data OR {_some('t', scoring.IMAGE_WORDS)}) AS img,
                 tab AND (hard OR (has_person_name AND (comp OR hh >= 2)) OR (nrows >= 50 AND hh >= 2 AND {_some('path', L.PERSONAL_EXPORT_PATH_MARKERS)}) OR (nrows >= 200 AND hdr <> '')) AS export,
                 tab AND NOT hard AND ({_some('hdr', L.COMPANY_EXPORT_MARKERS)} OR {_some('path', L.COMPANY_EXPORT_MARKERS)}) AND {_some('t', L.ORG_SUFFIX_MARKERS)} AND NOT has_person_name AND (nrows >= 20 OR comp) AS company FROM a),
    s AS (SELECT *, 4 * form::INT + 4 * internal::INT + 4 * corr::INT + 5 * img::INT + 5 * export::INT + 4 * hard::INT + 5 * has_health_data::INT + 4 * has_bik::INT + 3 * ((hard OR has_person_name) AND comp)::INT
                    + 2 * (tab AND nrows >= 50 AND (has_person_name OR comp OR hard))::INT AS risk,
                 5 * contact::INT + 4 * (report OR pubdoc)::INT + 3 * company::INT AS just,
                 5 * tmpl::INT + 4 * org::INT + 3 * (refd AND NOT export)::INT + 2 * nothing::INT + (NOT (trusted OR hard OR has_health_data OR has_bik))::INT AS noise,
                 CASE WHEN export THEN 'personal_export' WHEN img THEN 'image_of_personal_doc' WHEN form THEN 'personal_form' WHEN internal THEN 'internal_employee_doc' WHEN corr THEN 'correspondence'
                      WHEN contact THEN 'public_contact_doc' WHEN report OR pubdoc THEN 'public_report' WHEN company THEN 'company_export' WHEN org THEN 'org_requisites_doc' WHEN tmpl THEN 'blank_template' END AS genre,
                 kept AND NOT nothing AS remains FROM b),
    c1 AS (SELECT *, CASE WHEN risk >= 5 AND risk > just + greatest(1, noise // 2) THEN 'T' WHEN just >= 4 AND (trusted OR hard OR comp OR remains) THEN 'J' ELSE 'N' END AS k1 FROM s),
    c2 AS (SELECT *, company AND k1 = 'T' AND NOT hard AND NOT has_health_data AS over FROM c1),
    c3 AS (SELECT *, CASE WHEN over THEN CASE WHEN comp THEN 'J' ELSE 'N' END ELSE k1 END AS k2,
                  CASE WHEN over THEN 'company_export' ELSE coalesce(genre, CASE k1 WHEN 'T' THEN 'personal_record' WHEN 'J' THEN 'justified_public_doc' ELSE 'noise' END) END AS g2 FROM c2),
    c4 AS (SELECT *, (contact OR report) AND k2 = 'T' AND NOT ((has_person_name AND (has_health_data OR hard)) OR form OR internal OR corr OR img OR export) AS pub FROM c3),
    c5 AS (SELECT *, CASE WHEN pub THEN 'J' ELSE k2 END AS k3, CASE WHEN pub THEN CASE WHEN contact THEN 'public_contact_doc' ELSE 'public_report' END ELSE g2 END AS g3 FROM c4),
    c6 AS (SELECT *, CASE WHEN tmpl AND k3 <> 'T' THEN 'N' ELSE k3 END AS k4, CASE WHEN tmpl AND k3 <> 'T' THEN 'blank_template' ELSE g3 END AS g4 FROM c5),
    c7 AS (SELECT *, k4 = 'T' AND NOT remains AND NOT export AS weak FROM c6),
    d AS (SELECT *, CASE WHEN weak THEN 'N' ELSE k4 END AS k, CASE WHEN weak THEN coalesce(genre, 'noise') ELSE g4 END AS g FROM c7)"""


@query("leak_scores", DECIDE_SQL + " SELECT p_partkey, risk, just AS justification, noise FROM d")
def leak_scores(spark, sf_dir):
    done = scoring.decide(scoring.signals(made_assessed(spark, sf_dir)))
    return done.select("p_partkey", "risk", "justification", "noise")


@query("storage_class", DECIDE_SQL + " SELECT p_partkey, CASE k WHEN 'T' THEN 'TARGET_LEAK' WHEN 'J' THEN 'PD_BUT_JUSTIFIED_STORAGE' ELSE 'NON_TARGET' END AS storage_class, g AS primary_genre FROM d")
def storage_class(spark, sf_dir):
    return scoring.decide(scoring.signals(made_assessed(spark, sf_dir))).select("p_partkey", "storage_class", "primary_genre")


@query("uz_level", DECIDE_SQL + """ SELECT p_partkey, CASE WHEN k <> 'T' OR (tmpl AND NOT (remains AND trusted)) OR (pubdoc AND NOT (remains AND (has_health_data OR has_snils OR has_bik))) OR (refd AND NOT (remains AND trusted)) THEN 'NO_PDN'
       WHEN NOT remains THEN 'NO_PDN' WHEN has_health_data THEN 'UZ-1' WHEN has_bik THEN 'UZ-2' WHEN has_snils THEN 'UZ-3' WHEN has_person_name OR has_email OR has_address THEN 'UZ-4' ELSE 'NO_PDN' END AS level FROM d""")  # fmt: skip
def uz_level(spark, sf_dir):
    return scoring.classify(scoring.decide(scoring.signals(made_assessed(spark, sf_dir)))).select("p_partkey", "level")


# --- cross-file rules over verdicts made from keys ---------------------------------------------------------------------

CROSS = (("person_name",), ("address",), ("snils", "email"), ("person_name", "phone"), ("health_data", "person_name", "email"), ("bank_card",), ("inn_legal_entity",))


def made_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    cats = F.element_at(F.array(*(F.array(*map(F.lit, sorted(c))) for c in CROSS)), (key % len(CROSS) + 1).cast("int"))
    n = (key * 3 % 150).cast("bigint")
    return table(spark, sf_dir, "customer").select(
        F.lpad(key.cast("string"), 8, "0").alias("file_id"), F.concat(F.lit("d"), F.floor(key / 5).cast("string"), F.lit("/"), key.cast("string"), F.lit(".csv")).alias("rel_path"),
        F.when(key % 9 == 0, "html").otherwise("csv").alias("format"), F.when(key % 4 == 0, "NON_TARGET").otherwise("TARGET_LEAK").alias("storage_class"),
        F.when(key % 3 == 0, "UZ-4").otherwise("NO_PDN").alias("level"), F.array(F.lit("R")).alias("reasons"), cats.alias("categories"),
        F.map_from_arrays(cats, F.transform(cats, lambda c: n)).alias("counts"),
    )


def made_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two values a file, shared with neighbours of its directory or not."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.lpad(key.cast("string"), 8, "0").alias("file_id"), F.explode(F.array(F.concat(F.lit("a"), F.floor(key / 2).cast("string")), F.concat(F.lit("b"), F.floor(key / 3).cast("string")))).alias("value_hash"))
    return rows.withColumn("category", F.when(F.col("value_hash").startswith("a"), "email").otherwise("phone"))


VERDICT_SQL = f"""
    SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS file_id, 'd' || c_custkey // 5 AS dir, CASE WHEN c_custkey % 9 = 0 THEN 'html' ELSE 'csv' END AS fmt, c_custkey % 4 <> 0 AS target,
           CASE WHEN c_custkey % 3 = 0 THEN 'UZ-4' ELSE 'NO_PDN' END AS level, [{', '.join(quoted(sorted(c)) for c in CROSS)}][c_custkey % {len(CROSS)} + 1] AS cats, c_custkey * 3 % 150 AS n, c_custkey AS k FROM customer"""
CROSS_SQL = f"""
    WITH RECURSIVE v AS ({VERDICT_SQL}),
    shown AS (SELECT *, target AND len(cats) = 1 AND cats[1] IN ('person_name', 'address', 'phone', 'email', 'birth_date', 'birth_place') AS weak FROM v),
    m AS (SELECT * FROM shown WHERE target AND fmt <> 'html'),
    vals AS (SELECT file_id, dir, unnest(['a' || k // 2, 'b' || k // 3]) AS h FROM m),
    e AS (SELECT DISTINCT a.file_id AS u, b.file_id AS w FROM vals a JOIN vals b ON a.dir = b.dir AND a.h = b.h AND a.file_id <> b.file_id),
    walk(u, w) AS (SELECT u, w FROM e UNION SELECT walk.u, e.w FROM walk JOIN e ON walk.w = e.u),
    comp AS (SELECT u AS file_id, least(u, min(w)) AS root FROM walk GROUP BY u),
    cu AS (SELECT root AS g, list_distinct(flatten(list(cats))) AS cats FROM comp JOIN m USING (file_id) GROUP BY root),
    du AS (SELECT dir AS g, list_distinct(flatten(list(cats))) AS cats, count(*) AS files,
                  sum(list_has_any(cats, {quoted([*L.HARD_PERSONAL_CATEGORIES, 'person_name', *L.PERSONAL_COMPANION_CATEGORIES])})::INT) AS adding FROM m GROUP BY dir),
    pairdirs AS (SELECT dir FROM m WHERE len(cats) = 1 AND cats[1] IN ('person_name', 'address') AND n >= 100 GROUP BY dir HAVING count(DISTINCT cats[1]) = 2),
    good AS (SELECT 'c' AS kind, g, cats FROM cu UNION ALL SELECT 'd', g, cats FROM du WHERE files BETWEEN 2 AND 6 AND adding >= 2),
    lev AS (SELECT kind, g, CASE WHEN list_has_any(cats, {quoted(cross_file.HIGHEST)}) THEN 4 WHEN list_contains(cats, 'bank_card') THEN 3 WHEN list_has_any(cats, {quoted(L.HARD_PERSONAL_CATEGORIES)}) THEN 2 ELSE 1 END AS r
            FROM good WHERE list_has_any(cats, {quoted(L.HARD_PERSONAL_CATEGORIES)}) OR (list_contains(cats, 'person_name') AND list_has_any(cats, {quoted(L.PERSONAL_COMPANION_CATEGORIES)}))),
    promo AS (SELECT file_id, 2 AS r, 1 AS rule, '{cross_file.PAIR}' AS why FROM m WHERE len(cats) = 1 AND cats[1] IN ('person_name', 'address') AND n >= 100 AND dir IN (FROM pairdirs)
              UNION ALL SELECT file_id, r, 2, '{cross_file.LINKED}' FROM comp JOIN lev ON kind = 'c' AND g = root
              UNION ALL SELECT file_id, r, 3, '{cross_file.BUNDLE}' FROM m JOIN lev ON kind = 'd' AND g = dir),
    best AS (SELECT file_id, max(r) AS r, list(why ORDER BY rule) AS whys FROM promo GROUP BY file_id),
    base AS (SELECT *, CASE WHEN weak THEN 'NO_PDN' ELSE level END AS l0, CASE WHEN weak THEN ['R', '{cross_file.WEAK_ONLY}'] ELSE ['R'] END AS r0 FROM shown)
    """


@query("final_promotion", CROSS_SQL + """SELECT file_id, CASE WHEN coalesce(r, 0) > CASE l0 WHEN 'UZ-4' THEN 1 ELSE 0 END THEN 'UZ-' || (5 - r) ELSE l0 END AS level, array_to_string(list_concat(r0, coalesce(whys, [])), ';') AS reasons
    FROM base LEFT JOIN best USING (file_id)""")  # fmt: skip
def final_promotion(spark, sf_dir):
    done = cross_file.cross_file(made_verdicts(spark, sf_dir), made_values(spark, sf_dir))
    return done.select("file_id", "level", F.array_join("reasons", ";").alias("reasons"))


@query("singleton_demotion", CROSS_SQL + "SELECT file_id, l0 AS level, array_to_string(r0, ';') AS reasons FROM base")
def singleton_demotion(spark, sf_dir):
    return cross_file.demote_singletons(made_verdicts(spark, sf_dir)).select("file_id", "level", F.array_join("reasons", ";").alias("reasons"))


@query("pair_promotion", CROSS_SQL + "SELECT file_id, why FROM promo WHERE rule = 1")
def pair_promotion(spark, sf_dir):
    return cross_file.pair_promotions(made_verdicts(spark, sf_dir)).select("file_id", "why")


@query("hash_links", CROSS_SQL + "SELECT dir, h AS value_hash, min(file_id) AS file_a, CAST(count(*) - 1 AS BIGINT) AS others FROM vals GROUP BY dir, h HAVING count(*) > 1")
def hash_links(spark, sf_dir):
    edges = cross_file.link_edges(made_verdicts(spark, sf_dir), made_values(spark, sf_dir))
    return edges.groupBy("dir", "value_hash", "file_a").agg(F.count("*").alias("others"))


@query("linkage_components", CROSS_SQL + "SELECT file_id, root FROM comp")
def linkage_components(spark, sf_dir):
    return cross_file.linkage_components(made_verdicts(spark, sf_dir), made_values(spark, sf_dir))


@query("small_dir_bundle", CROSS_SQL + "SELECT file_id, 'UZ-' || (5 - r) AS level FROM promo WHERE rule = 3")
def small_dir_bundle(spark, sf_dir):
    return cross_file.small_directory_promotions(made_verdicts(spark, sf_dir)).select("file_id", F.col("to").alias("level"))


# --- sources and reports ------------------------------------------------------------------------------------------------

EXTENSIONS = (".TXT", ".csv", ".xlsx", ".htm", ".jpeg", ".mp4", ".xyz", "", ".pl")


@query("format_detect", f"SELECT c_custkey, ['txt', 'csv', 'xls', 'html', 'image', 'mp4', 'unknown', 'unknown', 'txt'][c_custkey % {len(EXTENSIONS)} + 1] AS format FROM customer")
def format_detect(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("c_custkey") % len(EXTENSIONS) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", formats.format_of(F.concat(F.lit("a.b/"), F.col("c_custkey").cast("string"), ext)).alias("format"))


@query("row_to_chunk", "SELECT 'n_nationkey: ' || n_nationkey || ' | n_name: ' || n_name || ' | n_regionkey: ' || n_regionkey AS text FROM nation")
def row_to_chunk(spark, sf_dir):
    return row_chunk(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("json_flatten", "SELECT event_id, key AS path, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events) WHERE json_extract_string(props, '$.' || key) IS NOT NULL")
def json_flatten(spark, sf_dir):
    leaves = F.explode(F.from_json("props", "map<string,string>")).alias("path", "value")
    return table(spark, sf_dir, "events").select("event_id", leaves).where(F.col("value").isNotNull())


@query("html_visible_text", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS visible FROM pages")
def html_visible_text(spark, sf_dir):
    """The fast approximation for whole tables; files go through the parser."""
    bare = F.regexp_replace("html", r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"\s+", " "))).alias("visible"))


PAGE_SQL = r"""
    WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents),
    m AS (SELECT doc_id, len(x) AS n, regexp_extract_all(x, '[\p{L}\p{M}\p{Nd}\p{Pc}]+') AS w, len(regexp_replace(x, '[^\p{L}]', '', 'g')) AS letters, len(regexp_replace(x, '\s', '', 'g')) AS visible, len(regexp_replace(x, '[^\p{C}]', '', 'g')) AS odd FROM t),
    r AS (SELECT doc_id, n, len(w) AS words, CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda z: len(z))) / len(w) ELSE 0 END AS mean, letters / greatest(visible, 1) AS alpha, CASE WHEN n > 0 THEN 1 - odd / n ELSE 0 END AS printable FROM m),
    s AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE least(n / 1200, 1) * 0.3 + printable * 0.2 + alpha * 0.2 + least(words / 120, 1) * 0.2 + 0.1 * CASE WHEN words = 0 THEN 0 WHEN mean < 2 THEN mean / 2 WHEN mean > 15 THEN greatest(0, 1 - (mean - 15) / 15) ELSE 1 END END AS score FROM r)
    SELECT doc_id, CAST(words AS BIGINT) AS words, round(CAST(score AS DOUBLE), 6) AS score, CASE WHEN n = 0 OR words = 0 THEN 'empty' WHEN score >= 0.45 AND printable >= 0.85 AND alpha >= 0.3 AND words >= 5 AND mean BETWEEN 2 AND 15 THEN 'good' ELSE 'suspicious' END AS status FROM s"""


@query("page_quality", PAGE_SQL)
def page_quality(spark, sf_dir):
    m = plausible.with_page_metrics(table(spark, sf_dir, "documents"), F.col("text"))
    return m.select("doc_id", F.col("m.word_count").cast("long").alias("words"), F.round("m.score", 6).alias("score"), plausible.page_status(F.col("m")).alias("status"))


@query("best_candidate", """
    SELECT l_orderkey, CAST(arg_max(l_linenumber, [CASE l_linestatus WHEN 'O' THEN 3 ELSE 2 END, l_quantity, l_linenumber]) AS INT) AS best FROM lineitem GROUP BY l_orderkey""")  # fmt: skip
def best_candidate(spark, sf_dir):
    rank = F.struct(plausible.page_rank(F.when(F.col("l_linestatus") == "O", "good").otherwise("suspicious")).alias("r"), F.col("l_quantity"), F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", rank).alias("best"))


OCR_PATHS = ("hr/Scan%201.jpg", "site/Policy.pdf", "a/b.tif", "a/b.jpg", "x/личное.pdf", "plain+name.pdf")


@query("ocr_policy", f"SELECT c_custkey, [true, false, true, false, true, false][c_custkey % {len(OCR_PATHS)} + 1] AS image, ([true, false, false, false, true, false][c_custkey % {len(OCR_PATHS)} + 1] OR (c_custkey % {len(OCR_PATHS)} <> 1 AND c_custkey % 5 <= 2)) AS pdf FROM customer")
def ocr_policy(spark, sf_dir):
    key = F.col("c_custkey")
    path = F.element_at(F.array(*map(F.lit, OCR_PATHS)), (key % len(OCR_PATHS) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", formats.ocr_image(path).alias("image"), formats.ocr_pdf(path, key % 5, page_limit=2).alias("pdf"))


@query("result_rows", """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '{}' WHEN 1 THEN '{"обычные": ' || c_custkey || '}' ELSE '{"государственные": 2, "обычные": ' || c_custkey || '}' END AS categories FROM customer""")
def result_rows(spark, sf_dir):
    key = F.col("c_custkey")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    counts = F.when(key % 3 == 0, empty).when(key % 3 == 1, F.create_map(F.lit("ordinary"), key)).otherwise(F.create_map(F.lit("ordinary"), key, F.lit("government"), F.lit(2).cast("bigint")))
    return table(spark, sf_dir, "customer").select("c_custkey", reports.family_text(counts).alias("categories"))


@query("summary_pairs", "SELECT c_custkey, 'a=' || c_custkey || ';b=1' AS shown FROM customer")
def summary_pairs(spark, sf_dir):
    counts = F.create_map(F.lit("b"), F.lit(1).cast("bigint"), F.lit("a"), F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", reports.pairs(counts).alias("shown"))


# --- the whole scan over tables: rows-only, its stages are compared above ------------------------------------------------


def document_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as text files in a folder for each source."""
    docs = table(spark, sf_dir, "documents")
    name = F.col("doc_id").cast("string")
    files = docs.select(
        name.alias("file_id"), F.concat(F.coalesce("source", F.lit("_")), F.lit("/"), name, F.lit(".txt")).alias("rel_path"), F.lit("txt").alias("format"), F.lit("txt").alias("extractor"),
        F.array().cast("array<string>").alias("header"), F.lit(0).cast("bigint").alias("rows_scanned"), F.octet_length("text").cast("bigint").alias("size_bytes"),
        F.when(F.length(F.trim("text")) > 0, "ok").otherwise("empty").alias("status"), F.array().cast("array<string>").alias("errors"),
    )
    return files, docs.select(name.alias("file_id"), F.lit(0).alias("raw_idx"), F.coalesce("text", F.lit("")).alias("text"))


@query("scan_verdicts")
def scan_verdicts(spark, sf_dir):
    from vaultlens.plans.scan import scan

    done = scan(*document_files(spark, sf_dir), SETTINGS)
    return done.select("file_id", "storage_class", "primary_genre", "risk", "justification", "noise", "level", F.array_join("reasons", ";").alias("reasons"), "total_hits")


@query("run_metrics")
def run_metrics(spark, sf_dir):
    from vaultlens.plans.scan import verdicts
    from vaultlens.session import use_shared_dir

    use_shared_dir(spark)
    return aggregate.run_metrics(verdicts(*document_files(spark, sf_dir), SETTINGS))


@query("stream_windows", """
    SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")  # fmt: skip
def stream_windows(spark, sf_dir):
    """streaming.windowed_counts over the events as a stream, run until all that is there is read."""
    import uuid

    from vaultlens.session import use_shared_dir
    from vaultlens.streaming.detect import windowed_counts

    place = f"{use_shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    known = table(spark, sf_dir, "events").select("ts", "event_type").schema
    # as a pattern: without one, a stream takes directories only
    events = spark.readStream.schema(known).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = windowed_counts(events, "ts", "event_type")
    written = counts.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{place}/out"))
    written.option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/out").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
