"""PDF files page by page: the first reader's text, a second one's where that isn't good, recognition where neither is.

A backend is (name, open): open(bytes) gives a sequence with one function a page, which returns the page's text.  Those that
are installed are found by ``installed()``; a site may pass its own.  The best candidate of a page is its text.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from .extract import Extract
from .formats import LEADING_BLANKS, MARKUP_SIGNATURES

Backend = tuple[str, Callable[[bytes], Sequence[Callable[[], str]]]]
RANKS = {"good": 3, "suspicious": 2, "empty": 1, "error": 0}
#: What the path of a file lets recognition do: nothing, only files of few pages, or any.
NEVER, IF_SHORT, ALWAYS = 0, 1, 2


@dataclass(frozen=True)
class Page:
    """A candidate for a page's text, squeezed, with the measures that functions.plausible takes of columns."""

    text: str
    status: str
    score: float = 0.0
    words: int = 0
    error: str = ""

    @property
    def rank(self) -> tuple:
        return RANKS[self.status], self.score, self.words, len(self.text)


def measured(text: str) -> Page:
    """The plain form of functions.plausible.with_page_metrics and page_status."""
    own = " ".join(text.split())
    n, words = len(own), re.findall(r"\w+", own)
    if not words:
        return Page(own, "empty", 0.0 if not n else 0.3 * min(n / 1200, 1) + 0.2 * _printable(own), 0)
    mean = sum(map(len, words)) / len(words)
    printable, alpha = _printable(own), sum(map(str.isalpha, own)) / max(1, n - own.count(" "))
    shape = mean / 2 if mean < 2 else max(0.0, 2 - mean / 15) if mean > 15 else 1.0
    score = 0.3 * min(n / 1200, 1) + 0.2 * (printable + alpha + min(len(words) / 120, 1)) + 0.1 * shape
    good = score >= 0.45 and printable >= 0.85 and alpha >= 0.3 and len(words) >= 5 and 2 <= mean <= 15
    return Page(own, "good" if good else "suspicious", score, len(words))


def _printable(text: str) -> float:
    return sum(c.isprintable() or c.isspace() for c in text) / len(text)


def attempt(read: Callable[[], str]) -> Page:
    try:
        return measured(read() or "")
    except Exception as error:  # one bad page must not end a file
        return Page("", "error", error=str(error))


def best(candidates: Sequence[Page]) -> Page:
    """By status, score, words and length; the earlier backend's of equals."""
    return max(candidates, key=lambda page: page.rank)


def kind(raw: bytes) -> str:
    """The plain form of formats.pdf_kind: pdf, or what the first bytes are instead."""
    head = raw[:1024].lstrip(LEADING_BLANKS)
    if not raw:
        return "empty_file"
    if head.startswith(b"%PDF-"):
        return "pdf"
    if head.startswith((b"{", b"[")):
        return "json"
    return "html" if head[:128].lower().startswith(MARKUP_SIGNATURES) else "non_pdf"


def installed() -> list[Backend]:
    """The readers that this machine has, in the order they are tried."""
    found: list[Backend] = []
    try:
        import pypdf

        found.append(("pypdf", lambda raw: [page.extract_text for page in pypdf.PdfReader(io.BytesIO(raw)).pages]))
    except ImportError:
        pass
    try:
        import pdfplumber

        found.append(("pdfplumber", lambda raw: [page.extract_text for page in pdfplumber.open(io.BytesIO(raw)).pages]))
    except ImportError:
        pass
    return found


class PdfReader:
    """A reader for ``extract(readers={"pdf": ...})``.

    recognise(bytes, page number from 0) returns text; it is called for at most most_recognised pages of a file, where no
    backend's text is good and the file's path allows it (``extract`` works the policy out; a file is short with up to
    page_limit pages).  Pages keep their places: one without text is an empty chunk.  A page that only fails makes the file
    partial; no page with text, empty.
    """

    takes_policy = True

    def __init__(self, backends: Sequence[Backend] | None = None, recognise: Callable[[bytes, int], str] | None = None, *, page_limit: int = 0, most_recognised: int = 5):
        self.backends, self.recognise, self.page_limit, self.most_recognised = backends, recognise, page_limit, most_recognised

    def __call__(self, raw: bytes, most: int, policy: int = NEVER) -> Extract:
        if (own := kind(raw)) != "pdf":
            return Extract("empty", warnings=[f"not a PDF: {own}"])
        backends = installed() if self.backends is None else self.backends
        if not backends:
            return Extract("unsupported", warnings=["no PDF reader is available"])
        (_, first), *others = backends
        opened: dict[str, Sequence[Callable[[], str]]] = {}
        pages = first(raw)[:most]
        allowed = self.recognise is not None and (policy == ALWAYS or (policy == IF_SHORT and len(pages) <= self.page_limit))
        chosen, recognised = [], 0
        for i, read in enumerate(pages):
            candidates = [attempt(read)]
            for name, open_ in others:
                if candidates[-1].status == "good":
                    break
                candidates.append(attempt(lambda: (opened.get(name) or opened.setdefault(name, open_(raw)))[i]()))  # noqa: B023
            if allowed and recognised < self.most_recognised and all(c.status != "good" for c in candidates):
                recognised += 1
                candidates.append(attempt(lambda: self.recognise(raw, i)))  # noqa: B023
            chosen.append(best(candidates))
        poor = [str(i) for i, page in enumerate(chosen, 1) if page.status in ("empty", "suspicious")]
        out = Extract(chunks=[page.text for page in chosen])
        out.warnings += [f"Selective OCR may help on pages: {','.join(poor[:20])}"] if poor else []
        out.warnings += [f"page {i}: {page.error}" for i, page in enumerate(chosen, 1) if page.error]
        if not any(page.text and page.status in ("good", "suspicious") for page in chosen):
            out.status = "empty"
        elif any(page.status == "error" for page in chosen):
            out.status = "partial"
        return out
