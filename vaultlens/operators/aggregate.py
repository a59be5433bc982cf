"""Counts over detections: by category and family, validated ones, confidence, families' volumes, and a run's metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_by(detections: DataFrame, field: str) -> DataFrame:
    """(file_id, field, occurrences)."""
    return detections.groupBy("file_id", field).agg(F.sum("occurrences").alias("occurrences"))


def validated_counts(detections: DataFrame) -> DataFrame:
    return counts_by(detections.where(F.col("validation") == "valid"), "category")


def entity_counts(detections: DataFrame) -> DataFrame:
    """(file_id, validated, suspicious): suspicious ones are invalid or of low confidence."""
    doubtful = (F.col("validation") == "invalid") | (F.col("confidence") == "low")
    of = lambda c: F.sum(F.when(c, F.col("occurrences")).otherwise(0))
    return detections.groupBy("file_id").agg(of(F.col("validation") == "valid").alias("validated"), of(doubtful).alias("suspicious"))


def counted(detections: DataFrame) -> DataFrame:
    """Detections that count towards a family's volume."""
    return detections.where(
        F.col("confidence").isin("high", "medium") & ((F.col("family") != "payment") | (F.col("validation") == "valid"))
        & ~((F.col("family") == "government") & (F.col("validation") == "invalid"))
    )


def family_summary(detections: DataFrame) -> DataFrame:
    """(file_id, family, occurrences, unique_values, places): places are different location hints.

    Hints and values are items of one list, told apart and counted in one pass; detections are made once.
    """
    item = lambda is_place, name, n: F.struct(F.lit(is_place).alias("is_place"), name.alias("item"), n.cast("bigint").alias("n"))
    places = F.transform(F.coalesce("location_hints", F.array().cast("array<string>")), lambda h: item(True, h, F.lit(None)))
    items = F.concat(F.array(item(False, F.col("value_hash"), F.col("occurrences"))), places)
    told = counted(detections).select("file_id", "family", F.explode(items).alias("x")).select("file_id", "family", "x.*")
    once = told.groupBy("file_id", "family", "is_place", "item").agg(F.sum("n").alias("n"))
    place, c = F.col("is_place"), F.col("item")
    return once.groupBy("file_id", "family").agg(
        F.sum("n").alias("occurrences"), F.count_if(~place & (c != "")).alias("unique_values"), F.count_if(place & c.isNotNull()).alias("places")
    )


def is_large(family: Column, unique: Column, occurrences: Column, places: Column, ordinary=(20, 100, 50), government=(5, 20, 10), payment=(3, 5, 3)) -> Column:
    over = lambda most: (unique >= most[0]) | (occurrences >= most[1]) | (places >= most[2])
    return F.when(family == "ordinary", over(ordinary)).when(family == "government", over(government)).when(family == "payment", over(payment)).otherwise(F.lit(False))


def scan_status(extraction: Column, n_errors: Column) -> Column:
    return F.when((extraction == "error") | (n_errors > 0), "error").when(extraction == "unsupported", "skipped").otherwise("ok")


def run_metrics(verdicts: DataFrame) -> DataFrame:
    """(kind, name, n): files by format and level, occurrences by category, files with detections and errors.  One pass."""
    base = verdicts.select("format", "level", "counts", (F.size("final") > 0).cast("int").alias("found"), (F.col("scan_status") == "error").cast("int").alias("failed"))
    one = lambda kind, name, n: F.struct(F.lit(kind).alias("kind"), name.alias("name"), n.cast("bigint").alias("n"))
    pairs = F.concat(
        F.array(
            one("format", F.col("format"), F.lit(1)), one("level", F.col("level"), F.lit(1)), one("files", F.lit("processed"), F.lit(1)),
            one("files", F.lit("with_detections"), F.col("found")), one("files", F.lit("with_errors"), F.col("failed")),
        ),
        F.transform(F.map_entries("counts"), lambda e: one("category", e["key"], e["value"])),
    )
    return base.select(F.explode(pairs).alias("p")).select("p.*").groupBy("kind", "name").agg(F.sum("n").alias("n"))
