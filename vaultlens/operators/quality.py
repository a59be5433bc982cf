"""Quality: hits that are noise are suppressed, files are flagged, and each format has a gate that keeps or drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultlens.functions import lexicons as L
from vaultlens.functions.text import decoded_path, has_marker, marker_count, marks

from . import dets as D

# Patterns and small lists of the rules.
UUID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
LONG_TOKEN, HEX_TOKEN = r"\b[A-Za-z0-9_-]{20,}\b", r"(?i)\b[a-f0-9]{24,}\b"
MARKUP = r"[{}\[\]=;<>/&]"
PLACEHOLDERS = (
    r"(?iuU)\b(?:фио|full name|first name|last name|address|адрес|подпись|дата рождения|date of birth|паспорт|passport|series|номер|number|заявитель|телефон|phone|email|e-mail)\b"
    r"[^.\n:]{0,24}(?:[:\-]\s*)?(?:_{3,}|\.{3,}|[- ]{6,})",
    r"(?iuU)\bсерия\b[^.\n]{0,12}_{2,}[^.\n]{0,12}\bномер\b[^.\n]{0,12}_{2,}",
)
BLANKS = r"(?:_{3,}|\.{4,})"
#: What a text has in which PLACEHOLDERS or BLANKS could be found.
GAP = r"_{2}|\.{3}|[- ]{6}"
ID_FIELD = r"(^|[_\-.])(?:id|uuid|guid|token|hash|code|status|key)($|[_\-.])"
ID_WORD = r"(?U)\b(?:id|uuid|guid|token|hash|status|code)\b"
NUMBERS = ("inn_individual", "inn_legal_entity", "snils", "bank_card", "phone")
HTML_NAME_LABELS = ("фио", "employee", "full name", "first name", "last name", "requester", "applicant", "recipient")
SITE_WORDS = ("privacy", "rules", "policy", "cookies", "journal")
HTML_SUBJECTS = (
    "фио", "full name", "employee", "staff", "profile", "contact", "контакт", "phone", "email", "адрес", "passport", "паспорт", "snils", "снилс", "inn", "инн",
)
HTML_GENERIC = ("health_data", "religious_beliefs", "political_beliefs", "race_data", "nationality_data", "special_category_other", "address", "email")
XLS_TRUSTED = ("passport_series", "passport_number", "passport_series_number", "snils", "mrz", "bank_card", "birth_date", "birth_place", "address")
DOCX_WEAK = ("person_name", "email", "phone", "address", "bank_account", "bik", "inn_legal_entity")
PDF_WEAK = ("email", "phone", "address", "bank_account", "bik", "inn_legal_entity")
IMAGE_WEAK = ("email", "phone", "address", "inn_legal_entity", "person_name")
REGISTRY_WORDS = ("протокол", "реестр", "реестров", "выписка", "registry", "extract")
TABULAR = ("csv", "json", "parquet")
SAMPLE_CHUNKS = 20


def _hinted(category: Column, low: Column) -> Column:
    """Whether a chunk's text has a schema hint of the category."""
    found = F.lit(False)
    for name, hints in L.STRONG_SCHEMA_HINTS.items():
        found = found | ((category == name) & has_marker(low, hints))
    return found


def html_noise(text: Column) -> Column:
    tokens = sum(F.regexp_count(text, F.lit(p)) for p in (LONG_TOKEN, HEX_TOKEN, UUID))
    share = F.regexp_count(text, F.lit(MARKUP)) / F.greatest(F.length(text), F.lit(1))
    return (marker_count(F.lower(text), L.NOISE_MARKERS) >= 2) | (tokens >= 3) | (share >= 0.08)


def public_web(text: Column) -> Column:
    return marker_count(F.lower(text), L.PUBLIC_WEB_MARKERS) >= 3


def suppress_reason(category: Column, raw: Column, keywords: Column, text: Column, file_format: Column, extractor: Column) -> Column:
    """Why a detection is dropped, looking at its chunk; null if it stays."""
    low, tabular = F.lower(text), F.lower(extractor).isin(*TABULAR)
    name, hinted = category == "person_name", _hinted(category, low)
    web_name = name & ((has_marker(low, L.WEB_DOC_MARKERS) & ~has_marker(low, HTML_NAME_LABELS)) | F.contains(low, F.lit("живого журнала")))
    html = (
        (public_web(text) & category.isin(*L.PUBLIC_WEB_SUPPRESSED_CATEGORIES))
        | (category.isin(*NUMBERS) & (text.rlike(UUID) | text.rlike(LONG_TOKEN) | F.contains(low, F.lit("token"))))
        | web_name | (html_noise(text) & (F.size(keywords) == 0))
    )
    nobody = F.contains(F.lower(F.coalesce(raw, F.lit(""))), F.lit("живого журнала")) | (has_marker(low, SITE_WORDS) & ~has_marker(low, L.PERSON_NAME_SCHEMA_HINTS))
    noise = ~hinted & (
        (category.isin(*NUMBERS) & (marker_count(low, L.ID_HEAVY_FIELD_MARKERS) >= 2)) | (category == "birth_date")
        | (name & F.contains(low, F.lit("name:")) & ~has_marker(low, (*L.PERSON_NAME_SCHEMA_HINTS, "person")))
    )
    return D.chain(
        [
            ((file_format == "html") & html, F.concat(F.lit("SUPPRESSED_HTML_NOISE:"), category)),
            (name & nobody, "SUPPRESSED_NON_PERSON_NAME"),
            ((category == "birth_date") & ~has_marker(low, L.STRONG_SCHEMA_HINTS["birth_date"]), "SUPPRESSED_BIRTH_DATE_NO_CONTEXT"),
            (tabular & noise, F.concat(F.lit("SUPPRESSED_STRUCTURED_NOISE:"), category)),
        ],
        F.lit(None).cast("string"),
    )


def boosted(confidence: Column, validation: Column, category: Column, text: Column, extractor: Column) -> Column:
    """Confidence raised where a table's field names agree with the category."""
    agreed = F.lower(extractor).isin(*TABULAR) & _hinted(category, F.lower(text))
    return F.when(agreed & (confidence == "low"), "medium").when(agreed & (confidence == "medium") & (validation == "valid"), "high").otherwise(confidence)


def adjust(detections: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """detections with reason (why dropped, or null) and the boosted confidence.

    The chunk looked at is the one of the first hint in string order, counted over all chunks, blank ones included.
    """
    first = F.array_min(F.filter("location_hints", lambda h: h.rlike(r"^chunk:\d+")))
    placed = detections.withColumn("raw_idx", F.try_element_at(F.regexp_extract_all(first, F.lit(r"\d+"), 0), F.lit(1)).cast("int"))
    seen = placed.join(chunks.select("file_id", "raw_idx", F.col("text").alias("chunk")), ["file_id", "raw_idx"], "left")
    seen = seen.join(files.select("file_id", F.col("format").alias("file_format"), "extractor"), "file_id", "left").withColumn("chunk", F.coalesce("chunk", F.lit("")))
    c = F.col
    reason = suppress_reason(c("category"), c("raw_value"), c("keywords"), c("chunk"), c("file_format"), F.coalesce("extractor", F.lit("")))
    more = boosted(c("confidence"), c("validation"), c("category"), c("chunk"), F.coalesce("extractor", F.lit("")))
    return seen.select(*(more.alias(x) if x == "confidence" else c(x) for x in detections.columns), reason.alias("reason"))


def per_file(files: DataFrame, chunks: DataFrame, adjusted: DataFrame) -> DataFrame:
    """files with sample (their first chunks), cand (what stayed) and dropped (reasons of what didn't)."""
    sample = (
        chunks.where(F.col("raw_idx") < SAMPLE_CHUNKS).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("raw_idx", "text"))).alias("s"))
        .select("file_id", F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("sample"))
    )
    one = F.struct("order_key", F.struct(*(F.col(f) for f in D.FIELDS)).alias("d"))
    held = adjusted.groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("reason").isNull(), one))).alias("kept"), F.array_distinct(F.collect_list("reason")).alias("dropped")
    )
    cand = F.coalesce(F.transform("kept", lambda x: x["d"]), F.array().cast(D.DETS))
    return files.join(sample, "file_id", "left").join(held, "file_id", "left").select(
        *files.columns, F.coalesce("sample", F.lit("")).alias("sample"), cand.alias("cand"), F.coalesce("dropped", F.array().cast("array<string>")).alias("dropped")
    )


def _reasons(cases: list[tuple[Column, str]], flag: Column) -> Column:
    found = F.filter(F.array(*(F.when(c, F.lit(r)) for c, r in cases)), lambda r: r.isNotNull())
    return F.when(flag, found).otherwise(F.array().cast("array<string>"))


def template_marks(sample: Column) -> Column:
    return marks([F.lower(sample)], {"gap": GAP}, {"form": L.FORM_MARKERS})


def public_marks(path: Column, sample: Column) -> Column:
    return marks([F.lower(path), F.lower(sample)], {}, {"words": L.PUBLIC_DOC_KEYWORDS, "legal": L.LEGAL_MARKERS})


def reference_marks(extractor: Column, sample: Column) -> Column:
    """Null for what is no table: only tables are looked through."""
    return marks([F.when(F.lower(extractor).isin(*TABULAR), F.lower(sample))], {}, {"reference": L.REFERENCE_FIELD_MARKERS, "personal": L.PERSONAL_FIELD_MARKERS})


def template_flag(sample: Column, cand: Column, found: Column | None = None) -> tuple[Column, Column]:
    """found: template_marks, if they are known; so of the other flags."""
    own = template_marks(sample) if found is None else found
    times = lambda *patterns: F.when(own["gap"], sum(F.regexp_count(sample, F.lit(p)) for p in patterns)).otherwise(0)
    cases = [
        (times(*PLACEHOLDERS) >= 2, "TEMPLATE_PLACEHOLDER_FIELDS"), (times(BLANKS) >= 4, "TEMPLATE_BLANK_FIELDS"), (own["form"] >= 3, "TEMPLATE_FORM_MARKERS"),
    ]
    flag = (cases[0][0] | cases[1][0] | cases[2][0]) & ~F.exists(cand, D.template_trusted)
    return flag, _reasons(cases, flag)


def public_doc_flag(path: Column, sample: Column, cand: Column, found: Column | None = None) -> tuple[Column, Column]:
    both = public_marks(path, sample) if found is None else found
    words, legal = both["words"], both["legal"]
    flag = (words + legal >= 3) & ~F.exists(cand, D.trusted)
    return flag, _reasons([(words >= 2, "PUBLIC_DOC_KEYWORDS"), (legal >= 1, "PUBLIC_DOC_LEGAL_TEXT")], flag)


def reference_flag(path: Column, extractor: Column, header: Column, sample: Column, cand: Column, found: Column | None = None) -> tuple[Column, Column]:
    own = reference_marks(extractor, sample) if found is None else found
    low, names, tabular = F.lower(sample), F.transform(header, F.lower), F.lower(extractor).isin(*TABULAR)
    ids = F.size(F.filter(names, lambda n: n.rlike(ID_FIELD))) + F.regexp_count(low, F.lit(ID_WORD))
    cases = [
        (marker_count(F.lower(path), L.REFERENCE_PATH_MARKERS) >= 1, "REFERENCE_DATA_PATH"),
        (own["reference"] >= 2, "REFERENCE_DATA_SCHEMA"), (ids >= 2, "REFERENCE_DATA_ID_HEAVY"),
    ]
    some = cases[0][0] | cases[1][0] | cases[2][0]
    flag = tabular & some & ~F.exists(cand, D.trusted) & (own["personal"] <= 1)
    return flag, _reasons(cases, flag)


def official(text: Column) -> Column:
    public = marker_count(text, L.PDF_PUBLIC_MARKERS)
    return (public >= 2) | ((public >= 1) & has_marker(text, L.PDF_OFFICIAL_MARKERS))


def with_gate(df: DataFrame, file_format: Column) -> DataFrame:
    """df(rel_path, sample, cand) and gate, a struct(keep, reason): what a file's format makes of its detections.

    reason is null where nothing is said.  What several rules look at is a column of its own, worked out once, and texts
    are only looked at where there are detections.
    """
    c = F.col
    some = lambda text: F.when(F.size("cand") > 0, text)
    first = df.withColumns({
        "__low": some(F.lower("sample")), "__decoded": decoded_path(c("rel_path")), "__cats": D.categories(c("cand")),
        "__anchors": D.anchors(c("cand"), L.PERSONAL_ANCHOR_CATEGORIES), "__near": D.both(D.ordinary(c("cand")), L.PERSONAL_COMPANION_CATEGORIES),
        "__special": F.exists("cand", D.sensitive), "__names": D.volume(F.filter("cand", D.sure), "person_name"),
    }).withColumns({
        "__web": some(marker_count(c("__low"), L.PUBLIC_WEB_MARKERS) >= 3),
        "__text": F.concat("__decoded", F.lit("\n"), "__low"), "__image": F.concat("rel_path", F.lit("\n"), "__low"),
        "__plain": some(F.lower(F.concat("rel_path", F.lit("\n"), "sample"))), "__linked": D.both(c("__anchors"), L.PDF_LINKABLE_ANCHORS),
    })
    facts = first.withColumns({
        "__official": F.when(file_format.isin("pdf", "rtf", "doc"), official(c("__text"))).when(file_format == "image", official(c("__image"))),
        "__site": has_marker(c("__decoded"), L.DOCX_SITE_MARKERS), "__excluded": has_marker(c("__decoded"), L.DOCX_EXCLUDE_MARKERS),
        "__listed": has_marker(c("__decoded"), L.DOCX_SHORTLIST_MARKERS),
    })
    return facts.withColumn("gate", _gate(file_format)).drop(*(x for x in facts.columns if x.startswith("__")))


def _gate(file_format: Column) -> Column:
    low, cats, decoded, text, plain, cand, anchors, companions, linked = map(F.col, ("__low", "__cats", "__decoded", "__text", "__plain", "cand", "__anchors", "__near", "__linked"))
    accompanied, standalone = F.size(companions) > 0, D.has(anchors, L.PERSONAL_STANDALONE_STRONG_CATEGORIES)
    anchored, special, web, names = F.size(anchors) > 0, F.col("__special"), F.col("__web"), F.col("__names")
    spoken = has_marker(low, HTML_SUBJECTS)
    html_strong = (names >= 2) & accompanied | ~web & ((standalone & spoken) | (anchored & accompanied) | ((F.size(companions) >= 2) & spoken))
    docx_strong = special | standalone | (anchored & accompanied)
    pdf_strong = (F.size(linked) > 0) & (special | accompanied | D.has(linked, ("snils", "mrz")))
    image_strong = anchored & (special | accompanied | D.has(anchors, ("snils", "mrz", "passport_series_number", "bank_card")))
    org_xls = D.has(cats, ("email", "phone")) & F.array_contains(cats, "person_name") & has_marker(plain, L.XLS_ORG_CONTACT_MARKERS)
    mass_xls = (D.volume(cand, "email", "phone", "person_name") >= 10) & ~D.has(cats, XLS_TRUSTED)
    keep = lambda reason: F.struct(F.lit(True).alias("keep"), F.lit(reason).cast("string").alias("reason"))
    drop = lambda reason: F.struct(F.lit(False).alias("keep"), F.lit(reason).alias("reason"))

    def office(prefix: str, more: list[tuple[Column, object]]) -> Column:
        return D.chain([
            (docx_strong, keep(f"{prefix}_STRONG_BUNDLE")), (F.col("__site"), drop(f"{prefix}_SITE_PUBLIC_PATH")),
            (F.col("__excluded"), drop(f"{prefix}_PUBLIC_OR_TEMPLATE_PATH")),
            (~F.col("__listed"), drop(f"{prefix}_PATH_NOT_SHORTLISTED")),
            (D.only(cats, DOCX_WEAK), drop(f"{prefix}_WEAK_SIGNALS_ONLY")), *more,
        ], drop(f"{prefix}_NO_STRONG_BUNDLE"))

    html = D.chain([
        (html_strong, keep("HTML_STRONG_BUNDLE")), (web, drop("HTML_PUBLIC_WEB_NO_STRONG_BUNDLE")), (D.only(cats, HTML_GENERIC), drop("HTML_WEAK_SIGNALS_ONLY")),
    ], keep(None))
    xls = D.chain([
        (org_xls & (D.only(anchors, ("person_name",)) | mass_xls), drop("XLS_PUBLIC_CONTACTS_WEAK_BUNDLE")),
        (standalone | (anchored & accompanied), keep("XLS_STRONG_BUNDLE")), (has_marker(plain, L.XLS_DECLARATION_MARKERS), drop("XLS_DECLARATION_WEAK_BUNDLE")),
        (D.only(cats, ("person_name", "email", "phone")), drop("XLS_WEAK_SIGNALS_ONLY")),
    ], keep(None))
    pdf = D.chain([
        (has_marker(decoded, L.PDF_PUBLIC_SOURCE_MARKERS), drop("PDF_PUBLIC_SOURCE")), (F.col("__official"), drop("PDF_PUBLIC_LEGAL_OR_REPORT")),
        (D.has(cats, ("email", "phone", "address")) & ~anchored & has_marker(text, L.PDF_ORG_CONTACT_MARKERS), drop("PDF_ORG_CONTACT_ONLY")),
        (has_marker(text, REGISTRY_WORDS) & D.has(cats, ("snils", "passport_series_number", "inn_individual")) & ~D.has(cats, ("person_name", "birth_date", "birth_place")),
         drop("PDF_PUBLIC_REGISTRY_OR_PROTOCOL")),
        (D.only(cats, PDF_WEAK), drop("PDF_WEAK_SIGNALS_ONLY")), (D.only(cats, L.PDF_NARRATIVE_ONLY_CATEGORIES), drop("PDF_NARRATIVE_NO_PERSON_LINKAGE")),
        (pdf_strong, keep("PDF_STRONG_BUNDLE")),
    ], drop("PDF_NO_STRONG_BUNDLE"))
    public_image = has_marker(F.col("__image"), L.IMAGE_PUBLIC_MARKERS) | F.col("__official")
    image = D.chain([
        (public_image & ~image_strong, drop("IMAGE_PUBLIC_DOC_NO_STRONG_BUNDLE")), (image_strong, keep("IMAGE_STRONG_BUNDLE")),
        (D.only(cats, IMAGE_WEAK), drop("IMAGE_WEAK_SIGNALS_ONLY")),
    ], drop("IMAGE_NO_STRONG_BUNDLE"))
    return D.chain([
        (F.size(cand) == 0, keep(None)), (file_format == "html", html), (file_format == "xls", xls), (file_format == "docx", office("DOCX", [])),
        (file_format.isin("rtf", "doc"), office("OFFICE", [(F.col("__official"), drop("OFFICE_PUBLIC_OR_TEMPLATE_PATH"))])), (file_format == "pdf", pdf), (file_format == "image", image),
    ], keep(None))


def after_flags(kept: Column, template: Column, public: Column, reference: Column) -> Column:
    """What the file's flags leave of its detections."""
    none = F.array().cast(D.DETS)
    distrusted = ~F.exists(kept, D.trusted)
    return D.chain([
        (template & distrusted, none), (public & ~F.exists(kept, D.subject), F.filter(kept, lambda x: ~x["category"].isin("email", "phone"))),
        (reference & distrusted, none),
    ], kept)


def assess(wide: DataFrame, templates: bool = True) -> DataFrame:
    """per_file's rows with is_template, is_public_doc, is_reference_data, final (what is left) and quality_reasons."""
    c, extractor, header = F.col, F.coalesce("extractor", F.lit("")), F.coalesce("header", F.array().cast("array<string>"))
    flags = {
        "t": template_flag(c("sample"), c("cand"), c("__t")), "p": public_doc_flag(c("rel_path"), c("sample"), c("cand"), c("__p")),
        "r": reference_flag(c("rel_path"), extractor, header, c("sample"), c("cand"), c("__r")),
    }
    if not templates:
        flags["t"] = (F.lit(False), F.array().cast("array<string>"))
    out = wide.withColumns({"__t": template_marks(c("sample")), "__p": public_marks(c("rel_path"), c("sample")), "__r": reference_marks(extractor, c("sample"))})
    for name, (flag, why) in flags.items():
        out = out.withColumn(f"is_{name}", flag).withColumn(f"why_{name}", why)
    out = with_gate(out, c("format"))
    kept = F.when(c("gate.keep"), c("cand")).otherwise(F.array().cast(D.DETS))
    said = F.filter(F.array("gate.reason"), lambda r: r.isNotNull())
    return (
        out.withColumn("kept", kept).withColumn("final", after_flags(c("kept"), c("is_t"), c("is_p"), c("is_r")))
        .withColumn("quality_reasons", F.concat("dropped", "why_t", "why_p", "why_r", said))
        .withColumnsRenamed({"is_t": "is_template", "is_p": "is_public_doc", "is_r": "is_reference_data"})
        .drop("why_t", "why_p", "why_r", "gate", "kept", "__t", "__p", "__r")
    )
