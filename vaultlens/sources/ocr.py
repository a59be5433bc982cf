"""Character recognition with an engine of the site's own: languages, variants and page modes, and the best text of all.

engine(frame, variant, mode, language) returns text; it may call a program or a library on the executor.
``image_reader(frames_of, engine, ...)`` is a reader for ``sources.extract.extract(readers={"image": ...})``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from itertools import islice

from .extract import Extract
from .formats import IMAGE_SIGNATURES, LEADING_BLANKS

# Preparations of a picture, page modes tried after the wanted one, and what is stripped off tokens.
VARIANTS = ("base", "sharp", "binary")
MODES = (6, 11, 4)
EDGES = ".,:;()[]{}<>\"'"

Engine = Callable[[object, str, int, str], str]


def languages(wanted: str, available: Sequence[str]) -> tuple[str, list[str]]:
    """The wanted languages that are there, else English or the first there is, and what to say about it."""
    asked = [part.strip() for part in wanted.split("+") if part.strip()]
    chosen = [lang for lang in asked if lang in available]
    if chosen:
        return "+".join(chosen), [] if len(chosen) == len(asked) else [f"partial match for '{wanted}': '{'+'.join(chosen)}'"]
    if not available:
        return "", ["no languages available"]
    spare = "eng" if "eng" in available else min(available)
    return spare, [f"none of '{wanted}' is available, using '{spare}'"]


def text_score(text: str) -> float:
    """The plain form of functions.plausible.ocr_score."""
    tokens = [t.strip(EDGES) for t in text.split()]
    if not tokens:
        return -1.0
    kinds = [(sum(map(str.isalpha, t)), sum(map(str.isdigit, t))) for t in tokens]
    letters, digits = (sum(map(test, "".join(text.split()))) for test in (str.isalpha, str.isdigit))
    good, mixed = sum(a >= 3 or d >= 5 for a, d in kinds), sum(bool(a and d) for a, d in kinds)
    return good * 6 + min(len(tokens), 40) + letters * 0.03 + digits * 0.08 - mixed * 1.5


def recognise(frame: object, engine: Engine, language: str, *, mode: int = 6, variants: Sequence[str] = VARIANTS) -> str:
    """The text that scores best over variants and page modes; the longer one of equals."""
    modes = dict.fromkeys((mode, *MODES))
    return max((engine(frame, v, m, language) for v in variants for m in modes), key=lambda t: (text_score(t), len(t)))


def image_reader(frames_of: Callable[[bytes], Iterable[object]], engine: Engine, *, wanted: str = "rus+eng", available: Sequence[str] = ("eng",), most_frames: int = 10):
    """A reader of pictures: signature, then policy, then up to most_frames frames; a frame that fails makes the file partial."""

    def read(raw: bytes, most: int, policy: int = 2) -> Extract:
        if not raw[:128].lstrip(LEADING_BLANKS).startswith(IMAGE_SIGNATURES):
            return Extract("empty", warnings=["not an image"])
        if not policy:
            return Extract("empty", warnings=["Image OCR skipped by shortlist policy"])
        language, said = languages(wanted, available)
        out = Extract(warnings=said)
        for i, frame in enumerate(islice(frames_of(raw), most_frames + 1)):
            if i == most_frames:
                out.warnings.append("Image OCR frame limit reached")
                break
            try:
                text = " ".join(recognise(frame, engine, language).split())
            except Exception as error:  # one bad frame must not end a file
                out.errors.append(f"extraction_error: {error}")
                continue
            if text:
                out.chunks.append(text)
        out.status = ("partial" if out.errors else "ok") if out.chunks else ("error" if out.errors else "empty")
        return out

    read.takes_policy = True
    return read
