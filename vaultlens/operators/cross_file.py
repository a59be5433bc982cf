"""Findings that only become meaningful together: rules over the files of a directory.

All rules are set operations over (directory, file): window aggregates for what a directory holds, star edges instead of
pairs for shared values, and connected components for files that share them.  A directory or a value with very many
files is one key of an aggregation that combines before it shuffles, never a group of pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultlens.functions import lexicons as L
from vaultlens.functions.text import directory

from . import dets as D
from .graph import components
from .scoring import TARGET

# Formats that are compared, categories that link and that raise the level.
STRUCTURED = ("csv", "json", "parquet", "xls")
COMPARED = (*STRUCTURED, "txt", "docx", "rtf", "pdf", "image", "doc")
WEAK_ALONE = ("person_name", "address", "phone", "email", "birth_date", "birth_place")
LINKING = ("person_name", *L.HARD_PERSONAL_CATEGORIES, "phone", "email")
HIGHEST = ("health_data", "religious_beliefs", "political_beliefs", "race_data", "nationality_data")
SMALL_DIRECTORY = (2, 6)
RANKS = {"UZ-1": 4, "UZ-2": 3, "UZ-3": 2, "UZ-4": 1, "NO_PDN": 0}
WEAK_ONLY, PAIR, LINKED, BUNDLE = "WEAK_ORDINARY_ONLY", "CROSS_FILE_PERSON_ADDRESS_BUNDLE", "CROSS_FILE_SHARED_LINKAGE_BUNDLE", "CROSS_FILE_SMALL_DIRECTORY_BUNDLE"


def rank(level: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv)), level), F.lit(0))


def promotable(cats: Column) -> Column:
    """A hard identifier, or a name with something to reach or place the person."""
    return D.has(cats, L.HARD_PERSONAL_CATEGORIES) | (F.array_contains(cats, "person_name") & D.has(cats, L.PERSONAL_COMPANION_CATEGORIES))


def target_level(cats: Column) -> Column:
    return D.chain([(D.has(cats, HIGHEST), "UZ-1"), (F.array_contains(cats, "bank_card"), "UZ-2"), (D.has(cats, L.HARD_PERSONAL_CATEGORIES), "UZ-3")], "UZ-4")


def demote_singletons(verdicts: DataFrame) -> DataFrame:
    """Files in a risky place with nothing but one weak category have no level, whatever they had."""
    alone = (F.col("storage_class") == TARGET) & (F.size("categories") == 1) & F.col("categories")[0].isin(*WEAK_ALONE)
    return verdicts.withColumn("level", F.when(alone, "NO_PDN").otherwise(F.col("level"))).withColumn(
        "reasons", F.when(alone, F.array_union("reasons", F.array(F.lit(WEAK_ONLY)))).otherwise(F.col("reasons"))
    )


def _members(verdicts: DataFrame) -> DataFrame:
    known = verdicts.where(F.col("format").isin(*COMPARED) & (F.col("storage_class") == TARGET))
    return known.select("file_id", directory(F.col("rel_path")).alias("dir"), "format", "categories", "counts")


def pair_promotions(verdicts: DataFrame, least: int = 100) -> DataFrame:
    """Large name-only and address-only tables of a directory that has both."""
    m = _members(verdicts).where(F.col("format").isin(*STRUCTURED) & (F.size("categories") == 1))
    lone = m.select("file_id", "dir", F.col("categories")[0].alias("category"), F.element_at("counts", F.col("categories")[0]).alias("n"))
    lone = lone.where(F.col("category").isin("person_name", "address") & (F.col("n") >= least))
    dirs = lone.groupBy("dir").agg(F.count_distinct("category").alias("kinds")).where(F.col("kinds") == 2)
    return lone.join(dirs, "dir", "left_semi").select("file_id", F.lit("UZ-3").alias("to"), F.lit(PAIR).alias("why"), F.lit(1).alias("rule"))


def link_edges(verdicts: DataFrame, detections: DataFrame) -> DataFrame:
    """(dir, hash, file_a, file_b): files of a directory that share a value; each file is tied to the value's least file."""
    found = detections.where(F.col("category").isin(*LINKING) & F.col("value_hash").isNotNull() & (F.col("value_hash") != ""))
    held = found.select("file_id", "value_hash").distinct().join(_members(verdicts).select("file_id", "dir"), "file_id")
    least = held.groupBy("dir", "value_hash").agg(F.min("file_id").alias("file_a"), F.count("*").alias("n")).where(F.col("n") > 1)
    return held.join(least, ["dir", "value_hash"]).where(F.col("file_id") != F.col("file_a")).select("dir", "value_hash", "file_a", F.col("file_id").alias("file_b"))


def linkage_components(verdicts: DataFrame, detections: DataFrame) -> DataFrame:
    """(file_id, root) of files in components of at least two; the root is the least file."""
    roots = components(link_edges(verdicts, detections).select(F.col("file_b").alias("u"), F.col("file_a").alias("v")).distinct())
    return roots.select(F.col("node").alias("file_id"), "root").union(roots.select(F.col("root").alias("file_id"), "root").distinct())


def _union_of(rows: DataFrame, key: str) -> DataFrame:
    """The categories that the files of a key have, and how many files there are and add some."""
    adds = D.has(F.col("categories"), (*L.HARD_PERSONAL_CATEGORIES, "person_name", *L.PERSONAL_COMPANION_CATEGORIES))
    named = rows.select(key, F.explode("categories").alias("category")).groupBy(key).agg(F.collect_set("category").alias("cats"))
    return rows.groupBy(key).agg(F.count("*").alias("files"), F.sum(adds.cast("int")).alias("adding")).join(named, key)


def linkage_promotions(verdicts: DataFrame, detections: DataFrame) -> DataFrame:
    member = linkage_components(verdicts, detections).join(verdicts.select("file_id", "categories"), "file_id")
    good = _union_of(member, "root").where(promotable(F.col("cats")))
    return member.join(good, "root").select("file_id", target_level(F.col("cats")).alias("to"), F.lit(LINKED).alias("why"), F.lit(2).alias("rule"))


def small_directory_promotions(verdicts: DataFrame) -> DataFrame:
    m = _members(verdicts).where(F.size("categories") > 0)
    good = _union_of(m, "dir").where(F.col("files").between(*SMALL_DIRECTORY) & promotable(F.col("cats")) & (F.col("adding") >= 2))
    return m.join(good, "dir").select("file_id", target_level(F.col("cats")).alias("to"), F.lit(BUNDLE).alias("why"), F.lit(3).alias("rule"))


def promote(verdicts: DataFrame, promotions: DataFrame) -> DataFrame:
    """Levels only rise; a rule's reason is added once, in the rules' order."""
    best = promotions.groupBy("file_id").agg(F.max(rank(F.col("to"))).alias("most"), F.array_sort(F.collect_set(F.struct("rule", "why"))).alias("w"))
    names = F.create_map(*(F.lit(x) for level, r in RANKS.items() for x in (r, level)))
    out = verdicts.join(best, "file_id", "left")
    return out.select(
        *(F.col(c) for c in verdicts.columns if c not in ("level", "reasons")),
        F.when(F.col("most") > rank(F.col("level")), F.element_at(names, F.col("most"))).otherwise(F.col("level")).alias("level"),
        F.when(F.col("w").isNotNull(), F.array_union("reasons", F.transform("w", lambda x: x["why"]))).otherwise(F.col("reasons")).alias("reasons"),
    )


def cross_file(verdicts: DataFrame, detections: DataFrame, least: int = 100) -> DataFrame:
    """verdicts(file_id, rel_path, format, storage_class, level, reasons, categories, counts) after all rules.

    detections(file_id, category, value_hash) are what was left of each file's.
    """
    shown = demote_singletons(verdicts)
    found = pair_promotions(shown, least).union(linkage_promotions(shown, detections)).union(small_directory_promotions(shown))
    return promote(shown, found)
