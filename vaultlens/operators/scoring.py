"""Storage context: how risky, justified or noisy the place of personal data is, its storage class, genre and level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultlens.functions import lexicons as L
from vaultlens.functions.text import any_of, decoded_path, has_marker, marks

from . import dets as D

TARGET, JUSTIFIED, NON_TARGET = "TARGET_LEAK", "PD_BUT_JUSTIFIED_STORAGE", "NON_TARGET"

# What each signal adds, and the order in which a genre names a file.
RISK = {
    "personal_form": 4, "internal_employee_doc": 4, "correspondence": 4, "image_of_personal_doc": 5, "personal_export": 5, "hard": 4, "special": 5,
    "payment": 4, "bundle": 3, "rows": 2,
}
JUSTIFICATION = {"public_contact_doc": 5, "public_report": 4, "company_export": 3}
NOISE = {"blank_template": 5, "org_requisites_doc": 4, "reference": 3, "nothing": 2, "untrusted": 1}
GENRES = (
    "personal_export", "image_of_personal_doc", "personal_form", "internal_employee_doc", "correspondence", "public_contact_doc", "public_report",
    "company_export", "org_requisites_doc", "blank_template",
)
REASONS = {
    "blank_template": "TEMPLATE", "public_contact_doc": "PUBLIC_CONTACT_DOC", "public_report": "PUBLIC_REPORT", "org_requisites_doc": "ORG_REQUISITES",
    "personal_form": "PERSONAL_FORM", "internal_employee_doc": "INTERNAL_DOC", "correspondence": "CORRESPONDENCE", "image_of_personal_doc": "DOCUMENT_IMAGE",
    "personal_export": "PERSONAL_EXPORT", "company_export": "COMPANY_EXPORT", "hard": "HARD_ANCHOR", "special": "SPECIAL_OR_BIOMETRIC",
    "payment": "VALIDATED_PAYMENT", "bundle": "PERSONAL_BUNDLE", "rows": "SUBJECT_LEVEL_ROWS", "reference": "REFERENCE_DATA", "nothing": "NO_PERSONAL_SIGNAL",
}
PRIVATE = ("personal_form", "internal_employee_doc", "correspondence", "image_of_personal_doc", "personal_export")
IMAGE_WORDS = tuple(m for m in L.IMAGE_DOC_MARKERS if m not in ("scan", "скан"))


#: What signals look for in a file's path and sample.
WORDS = {
    "form": L.PERSONAL_FORM_MARKERS, "public": L.JUSTIFIED_PUBLIC_MARKERS, "contact": ("@", "телефон", "phone"),
    "responsible": ("ответствен", "responsible", "directory"), "report": L.PUBLIC_REPORT_MARKERS, "image": IMAGE_WORDS, "org": L.ORG_SUFFIX_MARKERS,
    "requisites": L.ORG_REQUISITE_MARKERS, "internal": L.INTERNAL_DOC_MARKERS, "correspondence": L.CORRESPONDENCE_MARKERS,
}


@dataclass(frozen=True)
class Thresholds:
    """When a family's volume is large."""

    ordinary: tuple[int, int, int] = (20, 100, 50)  # different values, occurrences, places
    government: tuple[int, int, int] = (5, 20, 10)


def signals(wide: DataFrame) -> DataFrame:
    """wide (quality.assess's rows) with s, a struct of boolean signals."""
    c, said = F.col, F.col("__said")
    path = decoded_path(c("rel_path"))
    names = F.transform(F.coalesce("header", F.array().cast("array<string>")), F.lower)
    heading = F.array_join(names, " ")
    cats, rows = D.categories(c("cand")), F.coalesce("rows_scanned", F.lit(0))
    hard, companion = D.has(cats, L.HARD_PERSONAL_CATEGORIES), D.has(cats, L.PERSONAL_COMPANION_CATEGORIES)
    named, special = F.array_contains(cats, "person_name"), F.exists("cand", D.sensitive)
    trusted, payment = F.exists("cand", D.trusted), F.exists("cand", lambda x: (x["family"] == "payment") & D.valid(x))
    tabular = F.lower(F.coalesce("extractor", F.lit(""))).isin("csv", "json", "parquet", "xls")
    template = c("is_template")
    form = ~template & said["form"]
    contact = (
        ~form & said["public"] & ((D.volume(c("cand"), "email", "phone") >= 1) | said["contact"])
        & (named | trusted | F.array_contains(cats, "address") | said["responsible"])
    )
    report = ~form & said["report"]
    finance = D.has(cats, ("inn_legal_entity", "bank_account", "bik")) & ~D.has(cats, (*L.HARD_PERSONAL_CATEGORIES, "person_name", "birth_date", "birth_place"))
    image = c("format").isin("image", "pdf") & (hard | special | said["image"])
    in_header = F.lit(0)
    for marker in L.PERSONAL_EXPORT_HEADER_MARKERS:
        in_header = in_header + F.contains(F.array_join(names, "\n"), F.lit(marker)).cast("int")
    export = tabular & (
        hard | (named & (companion | (in_header >= 2))) | ((rows >= 50) & (in_header >= 2) & has_marker(path, L.PERSONAL_EXPORT_PATH_MARKERS))
        | ((rows >= 200) & has_marker(heading, ("customer_name", "destination_address")))
    )
    company = (
        tabular & ~hard & (has_marker(heading, L.COMPANY_EXPORT_MARKERS) | has_marker(path, L.COMPANY_EXPORT_MARKERS)) & said["org"]
        & ~named & ((rows >= 20) | D.has(cats, ("email", "phone", "address")))
    )
    found = {
        "blank_template": template, "public_contact_doc": contact, "public_report": report | c("is_public_doc"), "own_report": report,
        "org_requisites_doc": said["requisites"] | finance, "personal_form": form,
        "internal_employee_doc": said["internal"], "correspondence": said["correspondence"],
        "image_of_personal_doc": image, "personal_export": export, "company_export": company, "hard": hard, "special": special, "payment": payment,
        "bundle": (hard | named) & companion, "rows": tabular & (rows >= 50) & (named | companion | hard), "reference": c("is_reference_data") & ~export,
        "nothing": F.size("cand") == 0, "untrusted": ~(trusted | hard | special | payment), "trusted": trusted, "companion": companion, "named": named,
        "tabular": tabular, "blocking": D.has(cats, L.PUBLIC_OVERRIDE_BLOCKERS),
    }
    looked = wide.withColumn("__said", marks([path, F.lower("sample")], {k: any_of(words) for k, words in WORDS.items()}))
    return looked.withColumn("s", F.struct(*(F.coalesce(v, F.lit(False)).alias(k) for k, v in found.items()))).drop("__said")


def points(s: Column, weights: dict[str, int]) -> Column:
    total = F.lit(0)
    for name, w in weights.items():
        total = total + F.when(s[name], w).otherwise(0)
    return total


def first_genre(s: Column, default: str) -> Column:
    return D.chain([(s[g], g) for g in GENRES], default)


def decide(scored: DataFrame) -> DataFrame:
    """signals' rows with risk, justification, noise, storage_class, primary_genre, genre_tags and context_reasons."""
    c, s = F.col, F.col("s")
    out = scored.withColumns({"risk": points(s, RISK), "justification": points(s, JUSTIFICATION), "noise": points(s, NOISE)})
    left = F.size("final") > 0
    target = (c("risk") >= 5) & (c("risk") > c("justification") + F.greatest(F.lit(1), F.floor(c("noise") / 2)))
    justified = (c("justification") >= 4) & (s["trusted"] | s["hard"] | s["companion"] | left)
    say = lambda cls, genre: F.struct(F.lit(cls).alias("cls") if isinstance(cls, str) else cls.alias("cls"), (F.lit(genre) if isinstance(genre, str) else genre).alias("genre"))
    out = out.withColumn("a", D.chain([
        (target, say(TARGET, first_genre(s, "personal_record"))), (justified, say(JUSTIFIED, first_genre(s, "justified_public_doc"))),
    ], say(NON_TARGET, first_genre(s, "noise"))))
    # overrides, each of what the one before decided
    company = s["company_export"] & (c("a.cls") == TARGET) & ~s["hard"] & ~s["special"]
    out = out.withColumn("o_company", company).withColumn("b", F.when(company, say(F.when(s["companion"], JUSTIFIED).otherwise(NON_TARGET), "company_export")).otherwise(c("a")))
    private = s["named"] & (s["special"] | s["blocking"])
    for g in PRIVATE:
        private = private | s[g]
    public = (s["public_contact_doc"] | s["own_report"]) & (c("b.cls") == TARGET) & ~private
    out = out.withColumn("o_public", public).withColumn("d", F.when(public, say(JUSTIFIED, F.when(s["public_contact_doc"], "public_contact_doc").otherwise("public_report"))).otherwise(c("b")))
    out = out.withColumn("e", F.when(c("is_template") & (c("d.cls") != TARGET), say(NON_TARGET, "blank_template")).otherwise(c("d")))
    weak = (c("e.cls") == TARGET) & ~left & ~s["personal_export"]
    out = out.withColumn("o_weak", weak).withColumn("f", F.when(weak, say(NON_TARGET, first_genre(s, "noise"))).otherwise(c("e")))
    why = [F.when(s[k], F.lit(f"LEAK_CONTEXT_{r}")) for k, r in REASONS.items()]
    why += [F.when(c("o_company"), F.lit("LEAK_CONTEXT_COMPANY_EXPORT_OVERRIDES")), F.when(c("o_public"), F.lit("LEAK_CONTEXT_PUBLIC_JUSTIFIED_OVERRIDES"))]
    why += [F.when(c("o_weak"), F.lit("LEAK_CONTEXT_WEAK_TARGET_DOWNGRADED"))]
    tags = F.array_sort(F.filter(F.array(*(F.when(s[g], F.lit(g)) for g in GENRES)), lambda g: g.isNotNull()))
    return out.withColumns({
        "storage_class": c("f.cls"), "primary_genre": c("f.genre"), "genre_tags": F.when(F.size(tags) > 0, tags).otherwise(F.array("f.genre")),
        "context_reasons": F.array_sort(F.filter(F.array(*why), lambda r: r.isNotNull())),
    }).drop("a", "b", "d", "e", "f", "o_company", "o_public", "o_weak")


def eligible(d: Column) -> Column:
    """What counts towards a family's volume."""
    return F.filter(d, lambda x: D.sure(x) & ((x["family"] != "payment") | D.valid(x)) & ~((x["family"] == "government") & (x["validation"] == "invalid")))


def family_volume(d: Column, family: str) -> Column:
    """struct(occurrences, unique, rows): rows are different location hints, of which each hit has two."""
    own = F.filter(eligible(d), lambda x: x["family"] == family)
    hashes = F.filter(F.transform(own, lambda x: x["value_hash"]), lambda h: h.isNotNull() & (h != ""))
    return F.struct(
        D.volume(own).alias("occurrences"), F.size(F.array_distinct(hashes)).alias("unique"),
        F.size(F.array_distinct(F.flatten(F.transform(own, lambda x: x["location_hints"])))).alias("rows"),
    )


def large(v: Column, most: tuple[int, int, int]) -> Column:
    return (v["unique"] >= most[0]) | (v["occurrences"] >= most[1]) | (v["rows"] >= most[2])


def classify(decided: DataFrame, thresholds: Thresholds | None = None) -> DataFrame:
    """decide's rows with level and reasons."""
    t, c, d = thresholds or Thresholds(), F.col, F.col("final")
    cls, distrusted = c("storage_class"), ~F.exists(d, D.trusted)
    present = lambda family: F.exists(eligible(d), lambda x: x["family"] == family)
    say = lambda level, why: F.struct(F.lit(level).alias("level"), F.lit(why).alias("why"))
    outcome = D.chain([
        (cls == JUSTIFIED, say("NO_PDN", "JUSTIFIED_STORAGE_SUPPRESSED")), (cls != TARGET, say("NO_PDN", "NON_LEAK_CONTEXT_SUPPRESSED")),
        (c("is_template") & distrusted, say("NO_PDN", "TEMPLATE_SUPPRESSED")),
        (c("is_public_doc") & ~F.exists(d, lambda x: D.sensitive(x) | D.proven(x)), say("NO_PDN", "PUBLIC_DOC_SUPPRESSED")),
        (c("is_reference_data") & distrusted, say("NO_PDN", "REFERENCE_DATA_SUPPRESSED")),
        (present("special") | present("biometric"), say("UZ-1", "LEAK_SPECIAL_OR_BIOMETRIC")),
        (F.exists(d, lambda x: (x["family"] == "payment") & D.valid(x)), say("UZ-2", "LEAK_VALIDATED_PAYMENT")),
        (large(family_volume(d, "government"), t.government), say("UZ-2", "LEAK_GOVERNMENT_LARGE_VOLUME")),
        (present("government"), say("UZ-3", "LEAK_GOVERNMENT_PRESENT")),
        (large(family_volume(d, "ordinary"), t.ordinary), say("UZ-3", "LEAK_ORDINARY_LARGE_VOLUME")), (present("ordinary"), say("UZ-4", "LEAK_ORDINARY_PRESENT")),
    ], say("NO_PDN", "LEAK_CONTEXT_WITHOUT_TRUSTED_PDN"))
    state = F.array(
        F.concat(F.lit("STORAGE_CLASS:"), cls), F.concat(F.lit("PRIMARY_GENRE:"), c("primary_genre")), F.concat(F.lit("RISK_SCORE:"), c("risk").cast("string")),
        F.concat(F.lit("JUSTIFICATION_SCORE:"), c("justification").cast("string")), F.concat(F.lit("NOISE_SCORE:"), c("noise").cast("string")), c("outcome.why"),
    )
    out = decided.withColumn("outcome", outcome)
    return out.withColumn("level", c("outcome.level")).withColumn("reasons", F.array_sort(F.array_distinct(F.concat("quality_reasons", "context_reasons", state)))).drop("outcome")
