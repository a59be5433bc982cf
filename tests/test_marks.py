"""Entries of word lists are looked for by automata, a text once for a list; what can't hold a hit is never shuffled."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from vaultlens.functions import lexicons as L
from vaultlens.functions.text import any_of, has_marker, marker_count, marks
from vaultlens.operators import quality, scoring
from vaultlens.operators.detect import find_hits, gates, hits_in
from vaultlens.operators.spans import DETECTORS, Settings
from vaultlens.plans.scan import FILES, verdicts

TWICE = ("a.b", "a.b", "(x|y)", "и т.д.", "no. 5", "[-]", "\\d", "@")


def test_marks_are_what_the_markers_say(spark):
    rnd = random.Random(3)
    pool = (*L.PUBLIC_DOC_KEYWORDS, *L.PERSONAL_FIELD_MARKERS, *TWICE, "axb", "x", "7", "é", "Ё", "İſK", "\n", "")
    texts = [(i, *(None if rnd.random() < 0.05 else " ".join(rnd.choice(pool) for _ in range(rnd.randrange(6))) for _ in range(2))) for i in range(500)]
    df = spark.createDataFrame(texts, "i int, a string, b string")
    lists, whole = {"words": L.PUBLIC_DOC_KEYWORDS, "twice": TWICE}, F.concat("a", F.lit("\n"), "b")
    m = marks([F.col("a"), F.col("b")], {"fields": any_of(L.PERSONAL_FIELD_MARKERS)}, lists)
    got = df.select("i", m.alias("m")).select("i", "m.fields", "m.words", "m.twice")
    want = df.select("i", has_marker(whole, L.PERSONAL_FIELD_MARKERS), *(marker_count(whole, x) for x in lists.values()))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gate_comes_before_the_shuffle(spark):
    chunks = spark.createDataFrame([("f", 0, "a@b.org"), ("f", 1, " "), ("f", 2, "nothing"), ("f", 3, "c@d.org"), ("g", 0, "e@f.org")], "file_id string, raw_idx int, text string")
    found = find_hits(chunks, Settings(), ("email",), spark.createDataFrame([("f",)], "file_id string"))
    assert sorted((r["file_id"], r["norm_idx"], r["raw_value"]) for r in found.collect()) == [("f", 0, "a@b.org"), ("f", 2, "c@d.org")]
    plan = plan_of(found)
    assert "Contains(" not in plan and 0 < plan.index("Window") < plan.index("ArrowEvalPython")


def test_flags_and_signals_go_through_samples_once_for_a_list(spark):
    files, chunks = spark.createDataFrame([], FILES), spark.createDataFrame([], "file_id string, raw_idx int, text string")
    wide = quality.per_file(files, chunks, spark.createDataFrame([], "file_id string, order_key array<int>, reason string, family string, category string, confidence string, "
                            "validation string, occurrences bigint, value_hash string, location_hints array<string>"))  # fmt: skip
    c = F.col
    flags = [quality.template_flag(c("sample"), c("cand"))[0], quality.public_doc_flag(c("rel_path"), c("sample"), c("cand"))[0]]
    assert "Contains(" not in plan_of(wide.select(*(f.alias(str(i)) for i, f in enumerate(flags))))
    s = scoring.signals(quality.assess(wide)).select("s")
    assert "Contains(lower(sample" not in plan_of(s).replace("#", "") and "Contains(concat(" not in plan_of(s)


def test_unreadable_files_have_no_hits(spark):
    files = spark.createDataFrame([(k, f"hr/{k}.txt", "txt", "txt", [], 0, 1, k, []) for k in ("ok", "error", "unsupported")], FILES)
    chunks = spark.createDataFrame([(k, 0, "write to a@b.org") for k in ("ok", "error", "unsupported")], "file_id string, raw_idx int, text string")
    got = {r["file_id"]: r["total_hits"] for r in verdicts(files, chunks).collect()}
    assert got == {"ok": 1, "error": 0, "unsupported": 0}


def test_only_detectors_whose_gate_holds_look_at_a_text(spark):
    texts = ["a@b.org", "7707083893 and a@b.org", "ПАСПОРТ 1234 567890", "ﬁ", "nothing", None]
    may = dict(zip((d.find.__name__ for d in DETECTORS), (m.tolist() for m in gates(pa.array(texts), DETECTORS)), strict=True))
    assert may["emails"] == [True, True, False, True, False, False]
    assert may["tax_numbers"] == [False, True, False, True, False, False]
    assert may["passports"] == [False, False, True, True, False, False]
    chunks = spark.createDataFrame([(str(i), 0, t) for i, t in enumerate(texts)], "file_id string, norm_idx int, text string")
    assert sorted((r["file_id"], r["category"]) for r in hits_in(chunks, Settings()).collect()) == [("0", "email"), ("1", "email"), ("1", "inn_legal_entity"), ("2", "passport_series_number")]
