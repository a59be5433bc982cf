"""Detectors that need places in a text: hits of personal data in chunks, in Arrow batches.

Each detector yields finds; one function turns a find into a hit with its hash, mask, fragment and hints.  Emission order
is family, chunk, detector, place; it is kept in order_key, since the first hit of a value decides what is kept of it.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, date, datetime

from vaultlens.functions import lexicons as L
from vaultlens.functions.checksums import INN10_WEIGHTS, INN12_FIRST_WEIGHTS, INN12_SECOND_WEIGHTS, SNILS_WEIGHTS
from vaultlens.functions.plausible import CYRILLIC_NAME, HOUSE_NUMBER, LABELS_IN_NAMES, LATIN_NAME, UK_POSTCODE, ZIP

# The patterns that define what is found.
EMAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
PHONE = r"(?<!\d)(?:\+7|8)\s*(?:\(\d{3}\)|\d{3})[\s.-]*\d{3}[\s.-]*\d{2}[\s.-]*\d{2}(?!\d)"
INTL_PHONE = r"(?<!\d)(?:\+\d{1,3}[\s().-]*)?(?:\(?\d{2,4}\)?[\s().-]*){2,4}\d{2,4}(?!\d)"
DATE = r"\b\d{2}[.\-]\d{2}[.\-]\d{4}\b"
SNILS = r"\b\d{3}-\d{3}-\d{3}\s\d{2}\b|\b\d{11}\b"
INN = r"\b\d{10}\b|\b\d{12}\b"
PASSPORT = (
    r"(?:(?:паспорт(?:\s*рф)?|passport)[^0-9]{0,25})?(?:серия\s*[:#]?\s*|passport series\s*[:#]?\s*)?"
    r"(\d{2}\s?\d{2})(?:[^\d]{0,12}(?:номер|number|no\.?|№)\s*[:#]?\s*|[^\d]{0,6})(\d{6})"
)
PASSPORT_SERIES = r"(?:серия(?:\s+паспорта)?|passport series)\s*[:#]?\s*(\d{2}\s?\d{2})"
PASSPORT_NUMBER = r"(?:номер(?:\s+паспорта)?|passport number|passport\s+no\.?|passport\s*#)\s*[:#]?\s*(\d{6})"
DRIVER_LICENSE = r"\b\d{2}\s?\d{2}\s?\d{6}\b|\b\d{10}\b"
DRIVER_CONTEXT = r"водительское удостоверение|вод\.\s*удостоверение|driver license|driving license|driving licence|\bву\b"
MRZ = r"\b(?:P<|I<|ID)[A-Z0-9<]{28,42}\b"
CARD = r"\b(?:\d[ -]*?){13,19}\b"
NUMERIC_TOKEN = r"\b(?:\d[ -]*?){6,20}\b"
LABEL_END = r"(?=(?:\s+[A-Za-zА-Яа-яЁё_][A-Za-zА-Яа-яЁё_ .()/-]{1,40}\s*:)|\||$)"
GENERIC_ADDRESS = r"(?:^|\||\s)(?:[A-Za-zА-Яа-яЁё_ .()/-]{0,40})?(?:address|адрес)(?:[A-Za-zА-Яа-яЁё_ .()/-]{0,40})?\s*:\s*([\s\S]+?)" + LABEL_END
NAME_VALUE = (
    r"([А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?(?:[ \t]+[А-ЯЁ][а-яё]+){1,2}|"
    r"[A-Z][a-z]+(?:[-'][A-Z][a-z]+)?(?:[ \t]+[A-Z][a-z]+(?:[-'][A-Z][a-z]+)?){1,2})"
)
NAME_LABELS = (
    "first name", "last name", "middle name", "middle initial", "given name", "forename", "surname", "family name",
    "customer_name", "customer name", "получатель", r"заказчик(?:\s+пропуска\s*\(житель\))?", "фио", r"employee(?:\s+name)?",
    "requester", "requestor", "applicant", "recipient", "contact person", "full name", "name",
)
HIGH, MEDIUM, LOW = "high", "medium", "low"
VALID, INVALID, UNKNOWN = "valid", "invalid", "unknown"
FAMILIES = ("ordinary", "government", "payment", "sensitive")

I = re.IGNORECASE  # noqa: E741
RE = {name: re.compile(pattern, flags) for name, pattern, flags in (
    ("email", EMAIL, 0), ("phone", PHONE, 0), ("intl", INTL_PHONE, 0), ("date", DATE, 0), ("snils", SNILS, 0), ("inn", INN, 0),
    ("passport", PASSPORT, I), ("series", PASSPORT_SERIES, I), ("number", PASSPORT_NUMBER, I), ("license", DRIVER_LICENSE, 0),
    ("license_context", DRIVER_CONTEXT, I), ("mrz", MRZ, 0), ("card", CARD, 0), ("token", NUMERIC_TOKEN, 0), ("generic_address", GENERIC_ADDRESS, I),
    ("nine", r"\b\d{9}\b", 0), ("twenty", r"\b\d{20}\b", 0), ("cvv", r"\b\d{3,4}\b", 0), ("fours", r"\d{4}[ -]\d{4}[ -]\d{4}", 0),
    ("cyrillic", rf"\b{CYRILLIC_NAME}\b", 0), ("latin", rf"\b{LATIN_NAME}\b", 0), ("house", HOUSE_NUMBER, 0), ("zip", f"{ZIP}|{UK_POSTCODE}", 0),
    ("company", r"(?<![\w-])(?:" + "|".join(map(re.escape, L.COMPANY_MARKERS)) + r")(?![\w-])", 0),
    ("label_name", rf"(?:{'|'.join(NAME_LABELS)})\s*:\s*{NAME_VALUE}", I), ("line_name", rf"(?:{'|'.join(NAME_LABELS)})\s*:\s*\n+\s*{NAME_VALUE}", I),
    ("from_name", rf"(?:^|\n)от [^\n]{{1,80}}\n\s*{NAME_VALUE}", I), ("emergency", rf"контакт на случай чс\s*:\s*{NAME_VALUE}", I),
)}


@dataclass(frozen=True)
class Settings:
    """What detection can be told."""

    context: int = 60
    phone_min: int = 10
    phone_max: int = 11
    max_chunks: int = 2_000
    sensitive: bool = True
    masking: bool = True
    samples: bool = True
    secret: str = "local-dev-salt"
    hash_length: int = 16
    prefix: int = 2
    suffix: int = 2
    as_of: date = field(default_factory=lambda: datetime.now(UTC).date())


@dataclass
class Find:
    """One place where a detector found something."""

    family: str
    category: str
    detector: str
    confidence: str
    validation: str
    raw: str
    normalized: str
    start: int
    end: int
    keywords: list[str]


@dataclass
class Chunk:
    text: str
    settings: Settings

    def __post_init__(self) -> None:
        self.low = self.text.lower()

    def around(self, start: int, end: int, width: int | None = None, after: int | None = None) -> str:
        width = self.settings.context if width is None else width
        return self.text[max(0, start - width) : end + (width if after is None else after)]

    def words(self, entries: tuple[str, ...]) -> list[str]:
        return [w for w in entries if w in self.low]


def tidy(text: str) -> str:
    return " ".join(text.split())


def only_digits(text: str) -> str:
    return re.sub(r"\D+", "", text)


def phone_number(text: str) -> str:
    own = only_digits(text)
    return "7" + own[1:] if len(own) == 11 and own[0] == "8" else own


def masked(value: str, s: Settings) -> str | None:
    if not value or not s.samples:
        return None
    hidden = len(value) - s.prefix - s.suffix
    return "*" * len(value) if hidden <= 0 else value[: s.prefix] + "*" * hidden + value[-s.suffix :]


def keyed_hash(value: str, s: Settings) -> str | None:
    if not s.masking or not value:
        return None
    return hmac.new(s.secret.encode(), value.encode("utf-8"), hashlib.sha256).hexdigest()[: s.hash_length]


def _sum(own: str, weights: tuple[int, ...]) -> int:
    return sum(int(d) * w for d, w in zip(own, weights, strict=False))


def snils_ok(own: str) -> bool:
    return len(own) == 11 and own != "0" * 11 and _sum(own, SNILS_WEIGHTS) % 101 % 100 == int(own[9:])


def inn_ok(own: str) -> bool:
    checks = {10: (INN10_WEIGHTS,), 12: (INN12_FIRST_WEIGHTS, INN12_SECOND_WEIGHTS)}.get(len(own), ())
    return bool(checks) and all(_sum(own, w) % 11 % 10 == int(own[len(w)]) for w in checks)


def luhn_ok(own: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(own))]
    return 13 <= len(own) <= 19 and sum(x // 10 + x % 10 for x in doubled) % 10 == 0


def birth_date_ok(value: str, as_of: date) -> bool:
    for form in ("%d.%m.%Y", "%d-%m-%Y", "%Y-%m-%d"):
        try:
            day = datetime.strptime(value, form).date()
        except ValueError:
            continue
        return day <= as_of and 0 <= as_of.year - day.year <= 120
    return False


def company(value: str) -> bool:
    return bool(RE["company"].search(value.lower()))


def person_name(value: str) -> bool:
    own = tidy(value)
    blocked = not own or company(own) or any(label in own.lower() for label in LABELS_IN_NAMES)
    return not blocked and bool(RE["cyrillic"].fullmatch(own) or RE["latin"].fullmatch(own))


def address(value: str) -> bool:
    low = value.lower()
    russian, english = (sum(m in low for m in markers) for markers in (L.ADDRESS_MARKERS, L.ENGLISH_ADDRESS_MARKERS))
    return russian >= 2 or english >= 2 or bool(english and RE["house"].search(value) and ("," in value or RE["zip"].search(value)))


def birth_place(value: str) -> bool:
    own = tidy(value)
    low, tokens = own.lower(), own.split()
    if not own or company(own):
        return False
    marked = any(m in low for m in L.BIRTH_PLACE_MARKERS + L.ENGLISH_BIRTH_PLACE_MARKERS) or ("," in own and re.search("[A-Za-zА-Яа-яЁё]", own))
    return bool(marked) or (len(tokens) <= 4 and all(t[0].isupper() for t in tokens if t[0].isalpha()))


def labelled(text: str, labels: tuple[str, ...]) -> str | None:
    """What follows the first label and its colon, up to the next label, bar or end."""
    found = re.search(rf"(?:{'|'.join(map(re.escape, labels))})\s*:\s*([\s\S]+?)" + LABEL_END, text, I)
    return found[1].strip() if found else None


@dataclass(frozen=True)
class Gate:
    """What a text must have for a detector to find anything: one entry of each group, and the pattern.

    Groups and patterns are held against texts in lower case before they are normalised, so they are necessary conditions only.
    """

    groups: tuple[tuple[str, ...], ...] = ()
    pattern: str | None = None


@dataclass(frozen=True)
class Detector:
    find: Callable[[Chunk], Iterator[Find]]
    family: str
    categories: tuple[str, ...]
    gate: Gate


DETECTORS: list[Detector] = []


def detector(family: str, *categories: str, words: tuple[tuple[str, ...], ...] = (), pattern: str | None = None):
    """Registers a detector of some categories."""

    def keep(f: Callable[[Chunk], Iterator[Find]]) -> Callable[[Chunk], Iterator[Find]]:
        DETECTORS.append(Detector(f, family, categories, Gate(words, pattern)))
        return f

    return keep


def wanted(s: Settings, categories: tuple[str, ...] | None = None) -> list[Detector]:
    """The detectors that can find one of the categories (None: any)."""
    return [d for d in DETECTORS if (s.sensitive or d.family != FAMILIES[-1]) and (categories is None or set(categories) & set(d.categories))]


@detector("ordinary", "email", pattern="@")
def emails(c: Chunk) -> Iterator[Find]:
    for m in RE["email"].finditer(c.text):
        yield Find("ordinary", "email", "ordinary.email.regex", HIGH, VALID, m[0], m[0].lower(), m.start(), m.end(), [])


@detector("ordinary", "phone", words=(L.PHONE_KEYWORDS,), pattern=r"(?s)(?:\d\D*+){10}")
def phones(c: Chunk) -> Iterator[Find]:
    seen = set()
    for kind in ("phone", "intl"):
        for m in RE[kind].finditer(c.text):
            value = tidy(m[0])
            own, place = phone_number(value), (*m.span(), phone_number(value))
            bare = kind == "intl" and "+" not in value and "(" not in value and value.count("-") + value.count(" ") < 2
            if not 10 <= len(own) <= 15 or bare or place in seen:
                continue
            seen.add(place)
            most = 15 if value.startswith("+") else c.settings.phone_max
            near = c.around(*m.span()).lower()
            words = [w for w in L.PHONE_KEYWORDS if w in near]
            if words and c.settings.phone_min <= len(own) <= most:
                yield Find("ordinary", "phone", "ordinary.phone.regex", HIGH, VALID, value, own, *m.span(), words)


def name_candidates(text: str) -> list[str]:
    first, last, middle = ("first name", "given name", "forename"), ("last name", "surname", "family name"), ("middle name", "middle initial")
    direct = [m[1] for kind in ("label_name", "line_name", "from_name") if (m := RE[kind].search(text))]
    russian = [labelled(text, (label,)) for label in ("фамилия", "имя", "отчество")]
    english = [labelled(text, labels) for labels in (first, middle, last)]
    triples = [" ".join(russian)] if all(russian) else []
    triples += [" ".join(filter(None, english))] if english[0] and english[2] else []
    after = [m[1]] if (m := RE["emergency"].search(text)) else []
    return list(dict.fromkeys(tidy(v) for v in direct + triples + after if person_name(v)))


@detector("ordinary", "person_name", words=(L.NAME_KEYWORDS,))
def person_names(c: Chunk) -> Iterator[Find]:
    words = c.words(L.NAME_KEYWORDS)
    if not words or (words == ["name"] and not c.words(L.PERSON_MARKERS)):
        return
    for value in name_candidates(c.text):
        at = c.text.find(value)  # -1 for names put together from parts
        yield Find("ordinary", "person_name", "ordinary.person_name.context", HIGH, UNKNOWN, value, value.lower(), at, at + len(value), words)


@detector("ordinary", "address", words=(L.ADDRESS_KEYWORDS,))
def addresses(c: Chunk) -> Iterator[Find]:
    words = c.words(L.ADDRESS_KEYWORDS)
    if not words:
        return
    value = labelled(c.text, L.ADDRESS_KEYWORDS)
    if value is None:
        found = RE["generic_address"].search(c.text)
        value = found[1].strip() if found else c.text
    value = tidy(value)
    if address(value):
        at = c.text.find(value)
        start, end = (at, at + len(value)) if at >= 0 else (0, len(c.text))
        yield Find("ordinary", "address", "ordinary.address.context", HIGH, UNKNOWN, value, value.lower(), start, end, words)


@detector("ordinary", "birth_place", words=(L.BIRTH_PLACE_KEYWORDS,))
def birth_places(c: Chunk) -> Iterator[Find]:
    words = c.words(L.BIRTH_PLACE_KEYWORDS)
    value = labelled(c.text, L.BIRTH_PLACE_KEYWORDS) if words else None
    if value is not None and birth_place(value):
        own, at = tidy(value), c.low.find(value.lower())
        end = at + len(value) if at >= 0 else len(c.text)
        yield Find("ordinary", "birth_place", "ordinary.birth_place.context", MEDIUM, UNKNOWN, own, own.lower(), max(at, 0), end, words)


@detector("ordinary", "birth_date", words=(L.BIRTH_DATE_KEYWORDS,), pattern=r"\d{4}")
def birth_dates(c: Chunk) -> Iterator[Find]:
    words = c.words(L.BIRTH_DATE_KEYWORDS)
    m = RE["date"].search(c.text) if words else None
    if m:
        fine = birth_date_ok(m[0], c.settings.as_of)
        yield Find("ordinary", "birth_date", "ordinary.birth_date.context", HIGH if fine else LOW, VALID if fine else INVALID, m[0], m[0], *m.span(), words)


def _checked(c: Chunk, kind: str, words: list[str], fine: Callable[[str], bool], family: str, category: Callable[[str], str], name: str) -> Iterator[Find]:
    """Tokens that pass their check, and those that don't where the text names them."""
    for m in RE[kind].finditer(c.text):
        own = only_digits(m[0])
        ok = fine(own)
        if ok or words:
            yield Find(family, category(own), name, HIGH if ok else LOW, VALID if ok else INVALID, m[0], own, *m.span(), words)


@detector("government", "snils", pattern=r"\d{3}-\d{3}-\d{3}|\d{11}")
def snils_numbers(c: Chunk) -> Iterator[Find]:
    yield from _checked(c, "snils", c.words(("снилс", "snils")), snils_ok, "government", lambda _: "snils", "government.snils.regex")


@detector("government", "inn_legal_entity", "inn_individual", pattern=r"\d{10}")
def tax_numbers(c: Chunk) -> Iterator[Find]:
    category = lambda own: "inn_legal_entity" if len(own) == 10 else "inn_individual"
    yield from _checked(c, "inn", c.words(("инн", "inn")), inn_ok, "government", category, "government.inn.regex")


@detector("government", "passport_series_number", "passport_series", "passport_number", words=(L.PASSPORT_KEYWORDS,), pattern=r"\d{2}")
def passports(c: Chunk) -> Iterator[Find]:
    for m in RE["passport"].finditer(c.text):
        near = c.around(*m.span(), 30, 12).lower()
        if "паспорт" in near or "passport" in near or ("серия" in near and "номер" in near):
            words = [w for w in L.PASSPORT_KEYWORDS if w in near]
            own = only_digits(m[1]) + only_digits(m[2])
            yield Find("government", "passport_series_number", "government.passport.combined", HIGH, VALID, tidy(m[0]), own, *m.span(), words)
    for kind, category, default in (("series", "passport_series", "серия"), ("number", "passport_number", "номер")):
        for m in RE[kind].finditer(c.text):
            near = c.around(*m.span()).lower()
            words = [w for w in L.PASSPORT_KEYWORDS if w in near] or [default]
            yield Find("government", category, f"government.passport.{kind}", MEDIUM, VALID, m[1], only_digits(m[1]), *m.span(1), words)


LICENSE_WORDS = ("водительское", "вод.", "driver", "driving", "ву")


@detector("government", "driver_license", words=(LICENSE_WORDS,), pattern=r"\d{2}")
def driver_licenses(c: Chunk) -> Iterator[Find]:
    if RE["license_context"].search(c.low):
        for m in RE["license"].finditer(c.text):
            yield Find("government", "driver_license", "government.driver_license.context", MEDIUM, UNKNOWN, m[0], only_digits(m[0]), *m.span(), ["driver_license_context"])


@detector("government", "mrz", pattern="(?:p<|i<|id)[a-z0-9<]{28}")
def machine_zones(c: Chunk) -> Iterator[Find]:
    for m in RE["mrz"].finditer(c.text):
        fine = 30 <= len(m[0]) <= 44 and m[0].startswith(("P<", "I<", "ID", "PN")) and "<" in m[0]
        yield Find("government", "mrz", "government.mrz.regex", HIGH if fine else LOW, VALID if fine else INVALID, m[0], m[0], *m.span(), ["mrz"])


@detector("payment", "bank_card", pattern=r"(?:\d[\s\x0B\x1C-\x1F-]*+){13}")
def cards(c: Chunk) -> Iterator[Find]:
    for m in RE["card"].finditer(c.text):
        own = only_digits(m[0])
        near = c.around(*m.span()).lower()
        words, fine = [w for w in L.CARD_KEYWORDS if w in near], luhn_ok(own)
        alone = fine and RE["fours"].search(m[0]) and not any(w in near for w in L.IDENTIFIER_KEYWORDS)
        if 13 <= len(own) <= 19 and (words or alone):
            yield Find("payment", "bank_card", "payment.card.regex", HIGH if fine else LOW, VALID if fine else INVALID, m[0], own, *m.span(), words)


@detector("payment", "bik", words=(L.BIK_KEYWORDS,), pattern=r"\d{9}")
def bank_codes(c: Chunk) -> Iterator[Find]:
    words = c.words(L.BIK_KEYWORDS)
    if words:
        yield from _checked(c, "nine", words, lambda own: own != "0" * 9, "payment", lambda _: "bik", "payment.bik.context")


@detector("payment", "bank_account", words=(L.ACCOUNT_KEYWORDS,), pattern=r"\d{20}")
def bank_accounts(c: Chunk) -> Iterator[Find]:
    words = c.words(L.ACCOUNT_KEYWORDS)
    if not words:
        return
    code = next((m[0] for m in RE["nine"].finditer(c.text) if "бик" in c.text[max(0, m.start() - 6) : m.start()].lower()), "")
    for m in RE["twenty"].finditer(c.text):
        fine = code not in ("", "0" * 9) and m[0] != "0" * 20
        yield Find("payment", "bank_account", "payment.bank_account.context", HIGH if fine else MEDIUM, VALID if fine else UNKNOWN, m[0], m[0], *m.span(), words + (["бик"] if code else []))


@detector("payment", "cvv_cvc", words=(L.CVV_KEYWORDS, L.CARD_KEYWORDS), pattern=r"\d{3}")
def card_codes(c: Chunk) -> Iterator[Find]:
    words = c.words(L.CVV_KEYWORDS)
    if words and c.words(L.CARD_KEYWORDS):
        for m in RE["cvv"].finditer(c.text):
            yield Find("payment", "cvv_cvc", "payment.cvv.context", MEDIUM, UNKNOWN, m[0], m[0], *m.span(), words)


@detector("sensitive", *(category for _, category, _ in L.LABELED_PATTERNS), words=(tuple(p for _, _, phrases in L.LABELED_PATTERNS for p in phrases),))
def sensitive_phrases(c: Chunk) -> Iterator[Find]:
    about_someone = bool(c.words(L.SUBJECT_MARKERS))
    for family, category, phrases in L.LABELED_PATTERNS:
        for phrase in phrases:
            m = re.search(rf"{re.escape(phrase)}\s*:\s*([^\n|;]+)", c.text, I)
            if m:
                yield Find(family, category, "sensitive.labeled_phrase", HIGH, UNKNOWN, m[0], m[0].lower(), *m.span(), [phrase])
        for phrase in phrases if about_someone else ():
            at = c.low.find(phrase)
            if at >= 0:
                raw = c.text[at : at + len(phrase)]
                yield Find(family, category, "sensitive.context_phrase", MEDIUM, UNKNOWN, raw, raw.lower(), at, at + len(phrase), [phrase])


def sanitised(fragment: str, s: Settings) -> str:
    for kind in ("email", "phone", "token", "cyrillic"):
        fragment = RE[kind].sub(lambda m: masked(m[0], s) or "", fragment)
    return fragment


def normal_text(text: str) -> str:
    return tidy(unicodedata.normalize("NFKC", text))


def hits_of(text: str, index: int, s: Settings, detectors: list[Detector] | None = None) -> Iterator[dict]:
    """The hits of one normalised chunk; order_key counts what the detectors in use find."""
    c = Chunk(text, s)
    own = wanted(s) if detectors is None else detectors
    for rank, family in enumerate(FAMILIES):
        number = 0
        for find in (f for d in own if d.family == family for f in d.find(c)):
            yield {
                "family": find.family, "category": find.category, "detector_id": find.detector, "confidence": find.confidence,
                "validation": find.validation, "start": find.start, "end": find.end, "raw_value": find.raw, "normalized_value": find.normalized,
                "value_hash": keyed_hash(find.normalized, s), "masked_preview": masked(find.raw, s),
                "fragment": sanitised(c.around(find.start, find.end), s), "keywords": sorted(set(find.keywords)),
                "location_hints": [f"chunk:{index}", f"span:{find.start}:{find.end}"],
                "order_key": [rank, index, number],
            }
            number += 1
