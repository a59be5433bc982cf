"""The whole scan: files and chunks -> detections -> quality -> storage context -> level -> cross-file rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlens.operators import dets as D
from vaultlens.operators import quality, scoring
from vaultlens.operators.aggregate import scan_status
from vaultlens.operators.cross_file import cross_file
from vaultlens.operators.detect import detect
from vaultlens.operators.scoring import Thresholds
from vaultlens.operators.spans import Settings

#: What files(…) must have; chunks(file_id, raw_idx, text) hold their texts.
FILES = "file_id string, rel_path string, format string, extractor string, header array<string>, rows_scanned bigint, size_bytes bigint, status string, errors array<string>"


def verdicts(files: DataFrame, chunks: DataFrame, settings: Settings | None = None, thresholds: Thresholds | None = None, templates: bool = True) -> DataFrame:
    """One row for each file: its detections, storage class, level and reasons, before the cross-file rules."""
    readable = files.where(~F.col("status").isin("error", "unsupported")).select("file_id")
    found = detect(chunks, settings, readable)
    adjusted = quality.adjust(found, chunks, files)
    wide = quality.assess(quality.per_file(files, chunks, adjusted), templates)
    out = scoring.classify(scoring.decide(scoring.signals(wide)), thresholds)
    return out.withColumns({
        "counts": D.counts(F.col("final"), "category"), "counts_by_family": D.counts(F.col("final"), "family"),
        "validated_counts": D.counts(F.filter("final", D.valid), "category"), "confidence_summary": D.counts(F.col("final"), "confidence"),
        "validated": D.volume(F.filter("final", D.valid)),
        "suspicious": D.volume(F.filter("final", lambda x: (x["validation"] == "invalid") | (x["confidence"] == "low"))),
        "total_hits": D.volume(F.col("final")), "categories": F.array_sort(D.categories(F.col("final"))),
        "scan_status": scan_status(F.col("status"), F.size("errors")),
    })


def scan(files: DataFrame, chunks: DataFrame, settings: Settings | None = None, thresholds: Thresholds | None = None, templates: bool = True) -> DataFrame:
    """verdicts after the cross-file rules.  They are written to the shared folder once: the rules read them several times."""
    from vaultlens.session import use_shared_dir

    use_shared_dir(files.sparkSession)
    t = thresholds or Thresholds()
    own = verdicts(files, chunks, settings, t, templates).drop("s", "sample").checkpoint()
    left = own.select("file_id", F.explode("final").alias("d")).select("file_id", "d.category", "d.value_hash")
    return cross_file(own, left, t.ordinary[1])
