import io
import zipfile

import pytest
from pyspark.sql import functions as F

from vaultlens.functions import plausible
from vaultlens.functions import text as T
from vaultlens.sources import formats
from vaultlens.sources.extract import EXTRACTED, chunks_of, extract, extract_bytes


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def sheet(rows):
    cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{c}</t></is></c>' for c in r) + "</row>" for r in rows)
    return zipped({"xl/workbook.xml": f'<workbook {M}><sheets><sheet name="People"/></sheets></workbook>', "xl/worksheets/sheet1.xml": f"<worksheet {M}><sheetData>{cells}</sheetData></worksheet>"})


def test_docx():
    part = f"<w:document {W}><w:p><w:r><w:t>One</w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:t>Three</w:t></w:p></w:document>"
    assert extract_bytes("docx", zipped({"word/document.xml": part, "word/other.xml": "<x/>"})).chunks == ["One two", "Three"]
    assert extract_bytes("docx", b"plain").status == "empty"


def test_xlsx():
    x = extract_bytes("xls", sheet([["First Name", "Last Name", "Phone Number"], ["Ann", "Stone", "+7 999"], ["", "", ""]]))
    assert x.chunks == ["sheet: People | first name: Ann | last name: Stone | телефон: +7 999"] and x.rows == 1
    assert x.header == ["first name", "last name", "телефон"]
    assert extract_bytes("xls", b"<html>404 Not Found</html>").status == "empty"
    table = b"<html><table><tr><th>Name</th><th>Email</th></tr><tr><td>Ann</td><td>a@b.org</td></tr></table></html>"
    assert extract_bytes("xls", table).chunks == ["sheet: table_1 | ФИО: Ann | email: a@b.org"]
    assert extract_bytes("xls", b"\xd0\xcf\x11\xe0....").status in ("unsupported", "error")


def test_text_formats():
    assert extract_bytes("csv", "a;b;c\n1;2;3\n4;5;6\n7;8;9\n".encode()).chunks == ["a: 1 | b: 2 | c: 3", "a: 4 | b: 5 | c: 6", "a: 7 | b: 8 | c: 9"]
    assert extract_bytes("csv", b"a,b\n1,2\n3,4\n5,6\n7\n").chunks[-2:] == ["a: 5 | b: 6", "7"]
    x = extract_bytes("csv", b"a,b\n" + b"1,2\n" * 5, most=3)
    assert len(x.chunks) == 3 and x.rows == 4
    assert extract_bytes("json", b'{"a": {"b": [1, null, "x"]}, "c": true}').chunks == ["a.b[0]: 1", "a.b[2]: x", "c: True"]
    assert extract_bytes("json", b"{").status == "error"
    assert extract_bytes("html", b"<p>Hi <b>you</b><script>no()</script></p>").chunks == ["Hi you"]
    assert extract_bytes("rtf", b"{\\rtf1{\\fonttbl{\\f0 A;}}One\\par Two \\'e9}").chunks == ["One", "Two é"]
    assert extract_bytes("txt", "привет".encode("cp1251")).status == "ok"
    assert extract_bytes("txt", b" \n").status == "empty"
    assert extract_bytes("pdf", b"<html>").status == "empty"
    assert extract_bytes("mp4", b"x").status == "unsupported"
    assert extract_bytes("image", b"x", readers={"image": lambda raw, most: 1 / 0}).status == "error"


def test_parquet(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"Name": ["Ann", None], "Tags": [["b", "a"], None], "Raw": [b" x  y", b""]}), tmp_path / "t.parquet")
    x = extract_bytes("parquet", (tmp_path / "t.parquet").read_bytes())
    assert x.chunks == ['Name: Ann | Tags: ["b", "a"] | Raw: x y'] and x.header == ["Name", "Tags", "Raw"]


def test_batches(spark):
    files = spark.createDataFrame([("a/x.txt", "txt", 2, bytearray(b"hi")), ("b.json", "json", 1, bytearray(b"{"))], "rel_path string, format string, size_bytes long, content binary")
    done = extract(files)
    assert done.schema.simpleString().startswith("struct<file_id:string") and [f.split(" ")[0] for f in EXTRACTED.split(", ")] == done.columns
    assert [tuple(r) for r in chunks_of(done).collect()] == [("a/x.txt", 0, "hi")]


def test_kinds_of_content(spark):
    rows = [(b"%PDF-1.4", "pdf"), (b"\x00\n %PDF-", "pdf"), (b"", "empty_file"), (b" [1]", "json"), (b"\n<HTML>", "html"), (b"zz", "non_pdf")]
    df = spark.createDataFrame([(bytearray(a), b) for a, b in rows], "c binary, e string")
    assert all(r[0] == r[1] for r in df.select(formats.pdf_kind(F.col("c")), "e").collect())
    png = spark.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\n..."),), (bytearray(b"<svg>"),)], "c binary").select(formats.image_kind(F.col("c"))).collect()
    assert [r[0] for r in png] == ["image", "html"]


def test_paths(spark):
    rows = [("a%20b+c.PDF", "a b+c.pdf"), ("50%_x", "50%_x"), ("Я.txt", "я.txt")]
    df = spark.createDataFrame(rows, "p string, e string")
    assert all(r[0] == r[1] for r in df.select(T.decoded_path(F.col("p")), "e").collect())


@pytest.mark.parametrize("text,status", [("", "empty"), ("word " * 200, "good"), ("1 2 3", "suspicious"), ("....", "empty")])
def test_pages(spark, text, status):
    m = plausible.with_page_metrics(spark.createDataFrame([(text,)], "t string"), F.col("t"))
    assert m.select(plausible.page_status(F.col("m"))).first()[0] == status


def test_ocr_score(spark):
    rows = spark.createDataFrame([("",), ("hello world",), ("a1 b2",)], "t string").select(plausible.ocr_score(F.col("t"))).collect()
    assert [round(r[0], 3) for r in rows] == [-1.0, 14.3, round(2 + 2 * 0.03 + 2 * 0.08 - 3.0, 3)]


def test_stream(spark, tmp_path):
    from vaultlens.streaming.detect import stream_hits, windowed_counts

    spark.createDataFrame([("f", 0, "a@b.org")], "file_id string, raw_idx int, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("file_id string, raw_idx int, text string").parquet(str(tmp_path / "in"))
    done = stream_hits(stream).writeStream.format("memory").queryName("hits_now").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    done.awaitTermination(60)
    assert [r["category"] for r in spark.table("hits_now").collect()] == ["email"]
    rows = spark.createDataFrame([("2024-01-01 10:05:00", "a"), ("2024-01-01 10:50:00", "a")], "t string, k string").withColumn("t", F.col("t").cast("timestamp"))
    assert windowed_counts(rows, "t", "k").first()["n"] == 2


def test_recognition_picks_the_best_text():
    from vaultlens.sources import ocr

    assert ocr.languages("rus+eng", ("eng", "deu")) == ("eng", ["partial match for 'rus+eng': 'eng'"])
    assert ocr.languages("rus", ("deu",))[0] == "deu" and ocr.languages("rus", ()) == ("", ["no languages available"])
    engine = lambda frame, variant, mode, language: {"sharp": "passport number", "base": "p4ss n0m"}.get(variant, "") if mode == 11 else "x"
    read = ocr.image_reader(lambda raw: ["f"], engine)
    assert extract_bytes("image", b"GIF89a...", readers={"image": read}).chunks == ["passport number"]
    assert extract_bytes("image", b"<html>", readers={"image": read}).status == "empty"
    bad = ocr.image_reader(lambda raw: ["f"], lambda *a: 1 / 0)
    assert extract_bytes("image", b"BM..", readers={"image": bad}).status == "error"


def test_scores_agree(spark):
    from vaultlens.sources.ocr import text_score

    texts = ["", "hello world", "a1 b2", "(passport) 12345, x", "..."]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(plausible.ocr_score(F.col("t"))).collect()
    assert [round(r[0], 6) for r in rows] == [round(text_score(t), 6) for t in texts]


def test_errors():
    from vaultlens.sources.errors import ScanError, as_row

    assert as_row(ValueError("x"), "extract", "a")["code"] == "runtime_error"
    own = ScanError("walker_error", "walk", "gone", "p")
    assert str(own) == "walker_error: gone" and as_row(own, "other", "q")["path"] == "p" and as_row(own, "other")["stage"] == "walk"
    with pytest.raises(ValueError):
        ScanError("nothing", "s", "m")


def test_normal_form(spark):
    assert spark.createDataFrame([("ﬁ\u2460",), (None,)], "t string").select(T.nfkc(F.col("t"))).collect()[0][0] == "fi1"
