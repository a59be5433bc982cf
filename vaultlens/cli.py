"""Command line: version, validate-config and scan."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import uuid
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from . import __version__

SECTIONS = {
    "scan": {"include_hidden": False, "max_file_size_mb": None, "continue_on_error": True},
    "feature_flags": {"include_masked_samples": True, "enable_sensitive_detectors": True, "enable_template_heuristics": True, "enable_ocr": False},
    "detection": {"context_window": 60, "phone_min_digits": 10, "phone_max_digits": 11, "max_text_chunks_per_file": 2000},
    "ocr": {"mode": "off", "auto_pdf_page_limit": 0, "shortlist_path_contains": [], "skip_path_contains": []},
    "reporting": {"create_csv": True, "create_json": True, "create_markdown": True, "create_tables": False},
    "masking": {"enabled": True, "secret_env_var": "VAULTLENS_MASKING_SECRET", "default_salt": "local-dev-salt", "hash_length": 16, "preview_prefix": 2, "preview_suffix": 2},
    "uz_thresholds": {
        "ordinary_large_unique": 20, "ordinary_large_occurrences": 100, "ordinary_large_rows": 50,
        "government_large_unique": 5, "government_large_occurrences": 20, "government_large_rows": 10,
    },
}


@dataclass
class Config:
    """A scan's settings by section; sections and keys that aren't known are an error."""

    sections: dict[str, dict] = field(default_factory=lambda: {k: dict(v) for k, v in SECTIONS.items()})

    def settings(self):
        from .operators.spans import Settings

        d, m, f = self.sections["detection"], self.sections["masking"], self.sections["feature_flags"]
        return Settings(
            context=d["context_window"], phone_min=d["phone_min_digits"], phone_max=d["phone_max_digits"], max_chunks=d["max_text_chunks_per_file"],
            sensitive=f["enable_sensitive_detectors"], masking=m["enabled"], samples=f["include_masked_samples"],
            secret=os.environ.get(m["secret_env_var"], m["default_salt"]), hash_length=m["hash_length"], prefix=m["preview_prefix"], suffix=m["preview_suffix"],
        )

    def recognition(self):
        from .sources.formats import Recognition

        o = self.sections["ocr"]
        mode = o["mode"] if self.sections["feature_flags"]["enable_ocr"] else "off"
        return Recognition(mode, o["auto_pdf_page_limit"], tuple(o["shortlist_path_contains"]), tuple(o["skip_path_contains"]))

    def thresholds(self):
        from .operators.scoring import Thresholds

        t = self.sections["uz_thresholds"]
        of = lambda name: tuple(t[f"{name}_large_{k}"] for k in ("unique", "occurrences", "rows"))
        return Thresholds(of("ordinary"), of("government"))


def load_config(path: str | None) -> Config:
    """YAML (if its library is there) or JSON over the defaults."""
    config = Config()
    if not path:
        return config
    text = open(path, encoding="utf-8").read()
    try:
        import yaml

        given = yaml.safe_load(text) or {}
    except ImportError:
        given = json.loads(text)
    for section, values in given.items():
        if section not in config.sections or set(values) - set(config.sections[section]):
            raise ValueError(f"unknown setting in {section}: {sorted(set(values) - set(config.sections.get(section, {})))}")
        config.sections[section] |= values
    return config


def run_scan(spark, root: str, out: str, config: Config | None = None, readers: dict | None = None) -> list[str]:
    """Scan a folder and write its reports; returns their names.

    readers: a site's own, by format; the one of images is left out unless recognition is enabled.  With create_tables the
    rows also go to out by Spark's writers, which a scan of any size can use with the single files turned off.
    """
    from .operators.aggregate import run_metrics
    from .plans.scan import scan
    from .sources.errors import ScanError
    from .sources.extract import chunks_of, extract, list_files
    from .sources.reports import write_files, write_tables

    config, started = config or Config(), datetime.now(UTC)
    s = config.sections["scan"]
    size = s["max_file_size_mb"]
    files = list_files(spark, root, hidden=s["include_hidden"], max_bytes=size * 2**20 if size else None)
    usable = {form: r for form, r in (readers or {}).items() if form != "image" or config.sections["feature_flags"]["enable_ocr"]}
    found = extract(files, most=config.sections["detection"]["max_text_chunks_per_file"], readers=usable, policy=config.recognition())
    from .session import use_shared_dir

    use_shared_dir(spark)
    found = found.checkpoint()
    if not s["continue_on_error"] and not found.where("status = 'error'").isEmpty():
        raise ScanError("extraction_error", "extract", "a file could not be read", recoverable=False)
    done = scan(found.drop("chunks"), chunks_of(found), config.settings(), config.thresholds(), config.sections["feature_flags"]["enable_template_heuristics"]).checkpoint()
    metrics, finished = run_metrics(done), datetime.now(UTC)
    facts = {
        "version": __version__, "input_dir": root, "output_dir": out, "started_at": started.isoformat(), "finished_at": finished.isoformat(),
        "duration_seconds": (finished - started).total_seconds(), "files_discovered": found.count(),
    }
    run_id, r = uuid.uuid4().hex[:12], config.sections["reporting"]
    tables = write_tables(done, run_id, out) if r["create_tables"] else []
    return write_files(done, metrics, run_id, out, facts, kinds=[k for k in ("csv", "json", "markdown") if r[f"create_{k}"]]) + tables


def main(argv: list[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(levelname)s %(message)s")
    parser = argparse.ArgumentParser(prog="vaultlens")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version")
    commands.add_parser("validate-config").add_argument("config")
    scan = commands.add_parser("scan")
    scan.add_argument("root")
    scan.add_argument("--out", required=True)
    scan.add_argument("--config")
    a = parser.parse_args(argv)
    if a.command == "version":
        print(__version__)
    elif a.command == "validate-config":
        print(json.dumps(asdict(load_config(a.config)), ensure_ascii=False, indent=1))
    else:
        from pyspark.sql import SparkSession

        logging.info("wrote %s", ", ".join(run_scan(SparkSession.builder.appName("vaultlens").getOrCreate(), a.root, a.out, load_config(a.config))))
    return 0


if __name__ == "__main__":
    sys.exit(main())
