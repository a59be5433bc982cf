import pytest
from pyspark.sql import functions as F

from vaultlens.functions import plausible
from vaultlens.operators.detect import deduplicate, hits_in, places_of
from vaultlens.operators.spans import Settings
from vaultlens.sources import ocr, pages
from vaultlens.sources.extract import extract, extract_bytes, list_files
from vaultlens.sources.formats import Recognition

GOOD, POOR = "plain words of a page that reads well " * 20, "1 2 3"
PDF = b"%PDF-1.7 ..."


def backend(name, *texts):
    return name, lambda raw: [(lambda t=t: t if isinstance(t, str) else 1 / t) for t in texts]


@pytest.mark.parametrize("text", ["", GOOD, POOR, "....", "a\x01b \x02", "я" * 40, "x " * 300, "слово и ещё слово, ещё раз"])
def test_measures_agree_with_columns(spark, text):
    m = plausible.with_page_metrics(spark.createDataFrame([(text,)], "t string"), F.col("t")).select("m", plausible.page_status(F.col("m")).alias("s")).first()
    own = pages.measured(text)
    assert (own.status, own.words, len(own.text)) == (m["s"], m["m"]["word_count"], m["m"]["length"])
    assert own.score == pytest.approx(m["m"]["score"])


def test_kinds():
    kinds = {b"": "empty_file", b"\x00\n %PDF-": "pdf", b" [1]": "json", b"\n<HTML>": "html", b"zz": "non_pdf"}
    assert {raw: pages.kind(raw) for raw in kinds} == kinds
    x = extract_bytes("pdf", b"<html>")
    assert x.status == "empty" and x.warnings == ["not a PDF: html"]


def test_cascade_takes_the_best_candidate():
    asked = []

    def recognise(raw, i):
        asked.append(i)
        return GOOD if i == 2 else ""

    read = pages.PdfReader([backend("a", GOOD, POOR, "", 0), backend("b", "never", GOOD, POOR, 0)], recognise, page_limit=4)
    x = extract_bytes("pdf", PDF, readers={"pdf": read})
    assert x.chunks == [GOOD.strip(), GOOD.strip(), GOOD.strip(), ""] and x.status == "ok" and asked == [2, 3]
    assert x.warnings == ["Selective OCR may help on pages: 4"]
    asked.clear()
    x = extract_bytes("pdf", PDF, readers={"pdf": read}, policy=pages.NEVER)
    assert x.chunks[2:] == [POOR, ""] and x.status == "partial" and not asked
    assert len(extract_bytes("pdf", PDF, most=3, readers={"pdf": read}).chunks) == 3
    assert extract_bytes("pdf", PDF, readers={"pdf": pages.PdfReader([backend("a", "", "")])}).status == "empty"
    assert extract_bytes("pdf", PDF, readers={"pdf": pages.PdfReader([backend("a", 0, 0)])}).status == "empty"
    assert extract_bytes("pdf", PDF, readers={"pdf": pages.PdfReader([("a", lambda raw: 1 / 0)])}).status == "error"
    assert extract_bytes("pdf", PDF, readers={"pdf": pages.PdfReader([])}).status == "unsupported"


def test_recognition_is_bounded_and_goes_by_pages():
    asked = []
    read = pages.PdfReader([backend("a", *[""] * 9)], lambda raw, i: asked.append(i) or "", page_limit=8, most_recognised=5)
    extract_bytes("pdf", PDF, readers={"pdf": read}, policy=pages.IF_SHORT)
    assert asked == []
    extract_bytes("pdf", PDF, readers={"pdf": read}, policy=pages.ALWAYS)
    assert asked == [0, 1, 2, 3, 4]


def test_policy_follows_paths(spark):
    rows = [("a/scan passport.pdf", "pdf"), ("a/plain.pdf", "pdf"), ("a/скан.png", "image"), ("a/tree.png", "image"), ("a/x.txt", "txt")]
    files = spark.createDataFrame([(p, f, 1, bytearray(PDF if f == "pdf" else b"BM..")) for p, f in rows], "rel_path string, format string, size_bytes long, content binary")
    readers = {
        "pdf": pages.PdfReader([backend("a", "")], lambda raw, i: "read", page_limit=1),
        "image": ocr.image_reader(lambda raw: iter("abc"), lambda *a: "seen", most_frames=2),
    }
    texts = lambda policy: {r["rel_path"]: (r["status"], [c for c in r["chunks"] if c]) for r in extract(files, readers=readers, policy=policy).collect()}
    off = texts(Recognition("off"))
    assert [off[p] for p, _ in rows[:4]] == [("empty", [])] * 4
    auto = texts(Recognition("auto", page_limit=1))
    assert auto["a/plain.pdf"] == ("ok", ["read"]) and auto["a/скан.png"] == ("ok", ["seen", "seen"]) and auto["a/tree.png"] == ("empty", [])
    assert texts(Recognition("auto", page_limit=0))["a/plain.pdf"] == ("empty", [])
    assert texts(Recognition("auto", shortlist=("tree",)))["a/tree.png"][0] == "ok"
    assert texts(None)["a/tree.png"][0] == "ok"


def test_large_files_have_a_row(spark, tmp_path):
    (tmp_path / "small.txt").write_text("a@b.org")
    (tmp_path / "large.txt").write_text("x" * 100)
    found = {r["rel_path"]: r for r in extract(list_files(spark, str(tmp_path), max_bytes=50)).collect()}
    assert found["small.txt"]["chunks"] == ["a@b.org"]
    assert (found["large.txt"]["status"], found["large.txt"]["size_bytes"], found["large.txt"]["chunks"]) == ("unsupported", 100, [])


def test_reports_as_tables(spark, tmp_path):
    from vaultlens.cli import Config, run_scan

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("write to secret@host.org")
    config = Config()
    config.sections["reporting"] |= {"create_csv": False, "create_markdown": False, "create_tables": True}
    out = str(tmp_path / "out")
    assert run_scan(spark, str(tmp_path / "in"), out, config) == ["report.json", "summary", "result", "files"]
    assert spark.read.option("header", True).csv(f"{out}/result").first()["path"] == "a.txt"
    assert "secret@host.org" not in spark.read.json(f"{out}/files").toJSON().first()
    assert not (tmp_path / "out/summary.csv").exists()


def test_every_place_of_a_value(spark):
    chunks = spark.createDataFrame([("f", 0, "a@b.org, a@b.org"), ("f", 1, "a@b.org"), ("g", 0, "c@d.org")], "file_id string, norm_idx int, text string")
    hits = hits_in(chunks, Settings(), ("email",))
    places = {(r["file_id"], r["chunk_index"], r["start_char"]) for r in places_of(hits).collect()}
    assert places == {("f", 0, 0), ("f", 0, 9), ("f", 1, 0), ("g", 0, 0)}
    assert {r["file_id"]: r["occurrences"] for r in deduplicate(hits).collect()} == {"f": 3, "g": 1}
