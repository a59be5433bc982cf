"""The four reports of a scan.  None holds raw or normalised values, or texts."""

from __future__ import annotations

import csv
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How families are named in the short result.
FAMILY_NAMES = {"ordinary": "обычные", "government": "государственные", "payment": "платёжные", "biometric": "биометрические", "special": "специальные"}
NO_SIGNS = "нет признаков"
NOTES = ("report is privacy-safe and excludes raw PII", "OCR is not part of the default path")


def pairs(counts: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")


def summary_rows(verdicts: DataFrame, run_id: str) -> DataFrame:
    c, joined = F.col, lambda name: F.array_join(name, ";")
    return verdicts.select(
        F.lit(run_id).alias("run_id"), "rel_path", "format", "size_bytes", "scan_status", c("status").alias("extraction_status"), c("level").alias("assigned_uz"),
        "storage_class", "primary_genre", joined("genre_tags").alias("genre_tags"), c("risk").alias("risk_score"), c("justification").alias("justification_score"),
        c("noise").alias("noise_score"), c("total_hits").alias("detections_total"), pairs(c("counts")).alias("counts_by_category"),
        pairs(c("validated_counts")).alias("validated_counts_by_category"), c("validated").alias("validated_entities_count"),
        c("suspicious").alias("suspicious_entities_count"), pairs(c("confidence_summary")).alias("confidence_summary"), "is_template", "is_public_doc", "is_reference_data",
        c("is_template").alias("template_like"), F.lit(False).alias("ocr_used"), joined("reasons").alias("classification_reasons"), F.size("errors").alias("error_count"),
    )


def family_text(counts: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in FAMILY_NAMES.items() for x in kv))
    shown = F.filter(F.array_sort(F.map_entries(counts)), lambda e: e["value"] > 0)
    parts = F.transform(shown, lambda e: F.concat(F.lit('"'), F.coalesce(F.try_element_at(names, e["key"]), e["key"]), F.lit('": '), e["value"].cast("string")))
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))


def result_rows(verdicts: DataFrame) -> DataFrame:
    level = F.when(F.col("level") == "NO_PDN", NO_SIGNS).otherwise(F.col("level"))
    return verdicts.select(F.col("rel_path").alias("path"), family_text(F.col("counts_by_family")).alias("categories"), level.alias("uz"), "total_hits", F.col("format").alias("ext"))


def top_files(verdicts: DataFrame, n: int = 10) -> DataFrame:
    """The files with most hits; ties in the order of their paths."""
    return verdicts.orderBy(F.desc("total_hits"), "rel_path").limit(n)


def shown(verdicts: DataFrame) -> DataFrame:
    """What reports may have of the verdicts."""
    return verdicts.drop("cand", "final", "quality_reasons", "context_reasons", "dropped")


def write_tables(verdicts: DataFrame, run_id: str, out: str) -> list[str]:
    """The reports' rows by Spark's writers, for scans of any size, in three folders of out."""
    summary_rows(verdicts, run_id).write.mode("overwrite").option("header", True).csv(f"{out}/summary")
    result_rows(verdicts).write.mode("overwrite").option("header", True).csv(f"{out}/result")
    shown(verdicts).write.mode("overwrite").json(f"{out}/files")
    return ["summary", "result", "files"]


def _write_csv(place: Path, verdicts: DataFrame, run_id: str) -> list[str]:
    tables = {"summary.csv": (summary_rows(verdicts, run_id), "rel_path"), "result.csv": (result_rows(verdicts), "path")}
    for name, (rows, order) in tables.items():
        with (place / name).open("w", encoding="utf-8", newline="") as handle:
            writer = csv.writer(handle)
            writer.writerow(rows.columns)
            writer.writerows(tuple(r) for r in rows.orderBy(order).toLocalIterator())
    return list(tables)


def _write_json(place: Path, verdicts: DataFrame, run_id: str, totals: dict, facts: dict) -> list[str]:
    rows = shown(verdicts)
    with (place / "report.json").open("w", encoding="utf-8") as handle:
        handle.write('{"summary": ' + json.dumps({"run_id": run_id, "totals": totals, "notes": NOTES, **facts}, ensure_ascii=False) + ', "files": [')
        for i, r in enumerate(rows.orderBy("rel_path").select(F.to_json(F.struct(*rows.columns)).alias("j")).toLocalIterator()):
            handle.write((", " if i else "") + r["j"])
        handle.write("]}\n")
    return ["report.json"]


def _write_markdown(place: Path, verdicts: DataFrame, run_id: str, totals: dict) -> list[str]:
    lines = ["# Scan report", "", f"- Run ID: `{run_id}`", *(f"- Files {k}: `{v}`" for k, v in sorted(totals.get("files", {}).items())), "", "## Levels", ""]
    lines += [f"- {k}: {v}" for k, v in sorted(totals.get("level", {}).items())] or ["- no results"]
    lines += ["", "## Top files", ""]
    for r in top_files(verdicts).collect():
        flags = [name for name, on in (("template", r["is_template"]), ("public_doc", r["is_public_doc"]), ("reference_data", r["is_reference_data"])) if on]
        flags += [r["storage_class"].lower()] if r["storage_class"] != "NON_TARGET" else []
        lines.append(
            f"- `{r['rel_path']}` -> {r['level']}, storage={r['storage_class']}, genre={r['primary_genre']}, detections={r['total_hits']}, validated={r['validated']}, "
            f"suspicious={r['suspicious']}, flags={','.join(flags) or 'none'}, reasons={','.join(r['reasons'][:3]) or 'none'}, "
            f"categories={', '.join(f'{k}={v}' for k, v in sorted(r['counts'].items())) or 'none'}"
        )
    lines += ["", "## Notes", "", *(f"- {n}" for n in NOTES)]
    (place / "report.md").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return ["report.md"]


KINDS = ("csv", "json", "markdown")


def write_files(verdicts: DataFrame, metrics: DataFrame, run_id: str, out: str, facts: dict | None = None, kinds: Sequence[str] = KINDS) -> list[str]:
    """summary.csv, result.csv, report.json and report.md as single files of the driver, row by row from the executors.

    facts: more of the run for the summary (version, folders, times).  kinds: which of csv, json and markdown to write.
    """
    place = Path(out)
    place.mkdir(parents=True, exist_ok=True)
    totals: dict[str, dict[str, int]] = {}
    for r in metrics.collect():  # formats, levels and categories: a few rows
        totals.setdefault(r["kind"], {})[r["name"]] = r["n"]
    names = _write_csv(place, verdicts, run_id) if "csv" in kinds else []
    names += _write_json(place, verdicts, run_id, totals, facts or {}) if "json" in kinds else []
    return names + (_write_markdown(place, verdicts, run_id, totals) if "markdown" in kinds else [])
