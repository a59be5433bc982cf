"""Gates of the detectors: no text in which a detector finds something may be kept back."""

import random

from pyspark.sql import functions as F

from vaultlens.functions import lexicons as L
from vaultlens.operators.detect import find_hits, may_have
from vaultlens.operators.spans import DETECTORS, Settings, hits_of, normal_text, wanted

S = Settings()
PARTS = [
    "a.b@c.de", "+7 (912) 345-67-89", "8 912 345 67 89", "112-233-445 95", "11223344595", "7707083893", "500100732259", "4111 1111 1111 1111", "4111-1111\n1111\t1111", "044525225",
    "40702810900000012345", "01.02.1990", "1234 567890", "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<", "４１１１ １１１１ １１１１ １１１１", "ﬁngerprints", "ФИО: Иванов Иван Иванович", "name: Alice Monroe",
    "ПАСПОРТ  РФ", " ", "№", "123", "cvv", "é", "12 High Street, Springfield", ": Moscow",
]


def texts():
    rnd = random.Random(5)
    entries = [w for group in (L.PHONE_KEYWORDS, L.NAME_KEYWORDS, L.ADDRESS_KEYWORDS, L.BIRTH_DATE_KEYWORDS, L.BIRTH_PLACE_KEYWORDS, L.PASSPORT_KEYWORDS, L.CARD_KEYWORDS, L.ACCOUNT_KEYWORDS, L.BIK_KEYWORDS, L.CVV_KEYWORDS, L.SUBJECT_MARKERS) for w in group]
    entries += [p for _, _, phrases in L.LABELED_PATTERNS for p in phrases] + ["водительское удостоверение", "driver license", "ву"]
    out = []
    for _ in range(1_500):
        picked = [rnd.choice(rnd.choice((PARTS, entries))) for _ in range(rnd.randrange(1, 5))]
        picked = [rnd.choice((str, str.upper, lambda x: x.replace(" ", " \n ")))(p) for p in picked]
        out.append(rnd.choice((" ", ": ", "\n")).join(picked))
    return out


def test_gates_keep_nothing_back(spark):
    every = texts()
    df = spark.createDataFrame(list(enumerate(every)), "i int, text string")
    passed = {d.find.__name__: {r["i"] for r in df.where(may_have(F.col("text"), [d])).select("i").collect()} for d in DETECTORS}
    found = 0
    for i, text in enumerate(every):
        for d in DETECTORS:
            if list(hits_of(normal_text(text), 0, S, [d])):
                found += 1
                assert i in passed[d.find.__name__], (d.find.__name__, text)
    assert found > 500 and sum(len(p) for p in passed.values()) < 0.8 * len(every) * len(DETECTORS)


def test_wanted_categories(spark):
    chunks = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts()[:300])], "file_id string, raw_idx int, text string")
    fields = ("norm_idx", "category", "raw_value", "start", "end", "confidence")
    every = [tuple(r[c] for c in fields) for r in find_hits(chunks, S).collect()]
    for categories in (("email", "snils"), ("passport_series",), ("health_data",)):
        own = [tuple(r[c] for c in fields) for r in find_hits(chunks, S, categories).collect()]
        assert sorted(own) == sorted(h for h in every if h[1] in categories)
    assert [d.find.__name__ for d in wanted(S, ("email",))] == ["emails"] and len(wanted(Settings(sensitive=False))) == len(DETECTORS) - 1
