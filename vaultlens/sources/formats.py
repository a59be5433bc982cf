"""Format of a file by its name, kind of content by its first bytes, and whether to try character recognition."""

from __future__ import annotations

import mimetypes
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from vaultlens.functions import lexicons as L
from vaultlens.functions.text import decoded_path, has_marker

# Formats by extension and by MIME type, and signatures of content.
BY_EXTENSION = {
    "txt": "txt", "csv": "csv", "json": "json", "parquet": "parquet", "pdf": "pdf", "doc": "doc", "docx": "docx", "rtf": "rtf", "xls": "xls", "xlsx": "xls",
    "html": "html", "htm": "html", "jpg": "image", "jpeg": "image", "png": "image", "gif": "image", "tif": "image", "tiff": "image", "bmp": "image", "mp4": "mp4",
}
BY_MIME = {
    "text/plain": "txt", "text/csv": "csv", "application/json": "json", "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/msword": "doc", "application/rtf": "rtf",
    "application/vnd.ms-excel": "xls", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xls", "text/html": "html",
    "application/xhtml+xml": "html", "image/jpeg": "image", "image/png": "image", "image/gif": "image", "image/tiff": "image", "video/mp4": "mp4",
}
IMAGE_SIGNATURES = (b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n", b"GIF87a", b"GIF89a", b"BM", b"II*\x00", b"MM\x00*")
MARKUP_SIGNATURES = (b"<!doctype", b"<html", b"<?xml", b"<svg", b"<h1>")
#: Bytes that may stand before a signature.
LEADING_BLANKS = b"\x00\t\r\n\f "
SCAN_WORDS = ("архив сканы", "scan", "скан", "passport", "паспорт")

#: Extensions that only their MIME type tells: worked out from the standard table.
GUESSED = {ext[1:]: BY_MIME[mime] for ext, mime in mimetypes.MimeTypes().types_map[True].items() if mime in BY_MIME}


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def format_of(path: Column) -> Column:
    """By extension, else by the MIME type that the extension stands for, else unknown."""
    known = F.create_map(*(F.lit(x) for kv in (GUESSED | BY_EXTENSION).items() for x in kv))
    return F.coalesce(F.try_element_at(known, extension_of(path)), F.lit("unknown"))


def _starts(head: Column, signatures: tuple[bytes, ...]) -> Column:
    found = F.lit(False)
    for s in signatures:
        found = found | F.startswith(head, F.lit(s.hex().upper()))
    return found


def content_kind(content: Column, wanted: str, signatures: tuple[bytes, ...], read: int) -> Column:
    """wanted, or what the first bytes are instead: empty_file, json, html or non_<wanted>."""
    head = F.regexp_replace(F.hex(F.substring(content, 1, read)), r"^(?:00|09|0A|0C|0D|20)+", "")
    low = F.upper(F.hex(F.lower(F.decode(F.unhex(F.substring(head, 1, 256)), "ISO-8859-1"))))
    return (
        F.when(F.length(content) == 0, "empty_file").when(_starts(head, signatures), wanted).when(_starts(head, (b"{", b"[")), "json")
        .when(_starts(low, MARKUP_SIGNATURES), "html").otherwise(f"non_{wanted}")
    )


def pdf_kind(content: Column) -> Column:
    return content_kind(content, "pdf", (b"%PDF-",), 1024)


def image_kind(content: Column) -> Column:
    return content_kind(content, "image", IMAGE_SIGNATURES, 128)


def _policy(path: Column, mode: str, enabled: bool, shortlist: tuple[str, ...], skip: tuple[str, ...], otherwise: Column) -> Column:
    if not enabled or mode == "off":
        return F.lit(False)
    if mode in ("force", "full"):
        return F.lit(True)
    own = F.replace(decoded_path(path), F.lit("\\"), F.lit("/"))
    low = lambda entries: tuple(e.lower() for e in entries if e.strip())
    vetoed = has_marker(own, (*L.OCR_PUBLIC_SKIP_MARKERS, *low(skip)))
    return ~vetoed & (has_marker(own, (*L.OCR_SHORTLIST_MARKERS, *low(shortlist))) | otherwise)


def ocr_pdf(path: Column, pages: Column, *, mode: str = "auto", enabled: bool = True, page_limit: int = 0, shortlist: tuple = (), skip: tuple = ()) -> Column:
    """Whether a PDF's pages go to character recognition: never on public paths, always on shortlisted ones, else if it is short."""
    return _policy(path, mode, enabled, shortlist, skip, (F.lit(page_limit) > 0) & (pages <= page_limit))


@dataclass(frozen=True)
class Recognition:
    """When files go to character recognition: mode off, auto, force or full, pages of a short PDF, more words of paths."""

    mode: str = "auto"
    page_limit: int = 0
    shortlist: tuple = ()
    skip: tuple = ()


def recognition(path: Column, form: Column, policy: Recognition) -> Column:
    """What a file's path allows: 0 nothing, 1 if it turns out to be short, 2 at any length."""
    words = {"mode": policy.mode, "shortlist": policy.shortlist, "skip": policy.skip}
    pdf = lambda pages: ocr_pdf(path, F.lit(pages), page_limit=policy.page_limit, **words)
    by_pages = F.when(pdf(2**31 - 1), 2).when(pdf(0), 1).otherwise(0)
    return F.when(form == "pdf", by_pages).when((form == "image") & ocr_image(path, **words), 2).otherwise(0)


def ocr_image(path: Column, *, mode: str = "auto", enabled: bool = True, shortlist: tuple = (), skip: tuple = ()) -> Column:
    ext = extension_of(path)
    scanned = ext.isin("jpg", "jpeg", "png", "bmp") & has_marker(F.replace(decoded_path(path), F.lit("\\"), F.lit("/")), SCAN_WORDS)
    return _policy(path, mode, enabled, shortlist, skip, ext.isin("tif", "tiff") | scanned)
