"""Every operator against a plain version of itself, on rows that are null, empty, long, tied, repeated or few."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from conftest import SF
from oracle import compare, connect
from pyspark.sql import functions as F

from vaultlens.llm import chat_format, components, decontam, license_scan, mixing, quality_fm, queries, simhash, suffix_dedup, token_store, topk, url_reputation
from vaultlens.llm.shared import new_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: As the operators' own working columns are called, to clash with them.
CLASH = ("unit", "group", "pack", "size", "copies", "fp", "seg", "salt", "part", "block", "rank", "score", "label", "draw")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def edge_docs(seed=1, n=60):
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "gamma,", "DELTA", "é", "naïve", "x1", "\u3000", "zz."]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 20, 80])))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "word " * 5_000), (n + 4, docs[0][1]), (n + 4, docs[0][1]), (n + 5, docs[3][1]), (None, "no id"), (n + 6, "\x00\x1c odd\x85")]
    return docs


def frame(spark, docs, clash=True):
    rows = [(i, t, "en", None if (i or 0) % 4 == 0 else f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in docs]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("x") for c in CLASH}) if clash else df


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_statement(spark, duck, name):
    assert compare(queries.QUERIES[name](spark, SF), duck, queries.ORACLE[name])


# --- 1 quality -----------------------------------------------------------------------------------------------------------


def test_quality_learns_and_holds_out(spark):
    rows = queries.op1_quality(spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_pairs_in_linear_time_are_the_pairs():
    rng = np.random.default_rng(2)
    m = quality_fm.Machine(0.3, rng.normal(size=9).astype(np.float32), rng.normal(size=(9, quality_fm.RANK)).astype(np.float32))
    index, value = np.array([1, 4, 7, 2]), np.array([0.5, 1.0, 2.0, 1.5], np.float32)
    raw, _ = m.raw(np.array([0, 3, 4]), index, value)
    plain = 0.3 + sum(m.linear[i] * x for i, x in zip(index[:3], value[:3])) + sum(m.factors[index[a]] @ m.factors[index[b]] * value[a] * value[b] for a in range(3) for b in range(a + 1, 3))
    assert raw[0] == pytest.approx(plain, rel=1e-4) and raw[1] == pytest.approx(0.3 + m.linear[2] * 1.5, rel=1e-4)


def test_quality_edges(spark):
    docs = frame(spark, edge_docs())
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (1, 0)], "doc_id long, label int")
    m = quality_fm.fit(docs, labels)
    assert quality_fm.score(docs, m).count() == docs.count()
    again = quality_fm.fit(docs, labels)
    assert np.array_equal(m.linear, again.linear)
    assert sorted(quality_fm.keep_good(docs, m, 0.0).columns) == sorted(docs.columns)
    nothing = quality_fm.fit(docs.limit(0), labels.limit(0))
    assert {r["score"] for r in quality_fm.score(docs, nothing).collect()} == {0.5}
    assert quality_fm.score(docs.limit(0), m).collect() == []


# --- 2 licences ----------------------------------------------------------------------------------------------------------


def test_licences_are_inherited_from_the_nearest_directory(spark):
    rows = [
        ("LICENSE", "Released under the MIT License."), ("a/x.py", "code"), ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("a/b/c/y.py", "no words"), ("a/b/z.py", "text\nLicensed under the Apache License, Version 2.0.\nmore text here and there"), ("q", None), (None, "x"), ("a/x.py", "code"), ("a/b/c/e.py", ""),
    ]
    df = spark.createDataFrame(rows, "path string, text string").withColumns({"licence": F.lit("x"), "at": F.lit(1), "term": F.lit("t")})
    got = sorted(((r["path"] or "~", r["licence"], r["found_by"], r["from_path"]) for r in license_scan.scan_licences(df).collect()), key=str)
    assert ("a/x.py", "mit", "directory", "LICENSE") in got and len([g for g in got if g[0] == "a/x.py"]) == 2
    assert ("a/b/c/y.py", "gpl-3.0", "directory", "a/b/COPYING") in got and ("a/b/z.py", "apache-2.0", "own", "a/b/z.py") in got
    assert ("q", "mit", "directory", "LICENSE") in got and ("~", None, None, None) in got and len(got) == len(rows)
    assert license_scan.scan_licences(df.limit(0)).collect() == []


def test_licence_scores_are_cosines(spark):
    import math

    bodies = ["Licensed under the Apache License, Version 2.0.", "all rights reserved under some copyright", "Released under the MIT License"]
    df = spark.createDataFrame([(f"f{i}", f"a\n{b}\nc") for i, b in enumerate(bodies)], "path string, text string")
    got = {r["path"]: (r["licence"], r["score"]) for r in license_scan.own_licences(df, least=0.0).collect()}
    terms = lambda t: collections.Counter(re.findall("[a-z0-9]+", t.lower()))
    every = [terms(b) for b in bodies] + [terms(t) for t in license_scan.TEMPLATES.values()]
    n = len(every)
    idf = {t: math.log((n + 1) / (sum(t in e for e in every) + 1)) + 1 for e in every for t in e}
    weigh = lambda c: {t: k * idf[t] for t, k in c.items()}
    norm = lambda w: math.sqrt(sum(x * x for x in w.values()))
    for i, b in enumerate(bodies):
        a = weigh(terms(b))
        scores = {}
        for name, text in license_scan.TEMPLATES.items():
            t = weigh(terms(text))
            scores[name] = round(sum(a[k] * t.get(k, 0) for k in a) / norm(a) / norm(t), 6)
        best = min(scores, key=lambda k: (-scores[k], k))
        assert got[f"f{i}"][0] == best and got[f"f{i}"][1] == pytest.approx(scores[best], abs=1e-5)


# --- 3 tokens ------------------------------------------------------------------------------------------------------------


def plain_tokens(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    return [[*e.ids, 2] for e in tokenizer.encode_batch([t or "" for _, t in docs], add_special_tokens=False)]


TRICKY = [
    "İstanbul ΣΑΣ ς ÀÉ é e\u0301 ﬁ", "a.b,c. d, !. e... f.\ng,\th .", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "1,2. 3.14 don't I'LL we've", "a\x1cb \x0b\x0c \x85 \u00a0 \u2028 z", "ÅÅ K K",
    "one\r\ntwo", "x" * 3_000, "日本語。 テスト、 ok.", "!! && $$$.", "", "  ",
]


def test_words_have_the_ids_of_whole_texts():
    rnd = random.Random(9)
    chars = "aAbZé.,! \n'1٣Σςß\u0301\u00a0<|>\u200d"
    texts = TRICKY + ["".join(rnd.choice(chars) for _ in range(rnd.randrange(60))) for _ in range(400)]
    own = token_store.WordEncoder(queries.tokenizer_path(), 2, most=50)
    for _ in range(2):  # with a full table of words, then again
        got = [np.frombuffer(x, own.dtype).tolist() for x in own.encode([t.encode() for t in texts])]
        assert got == plain_tokens([(0, t) for t in texts])


def test_store_round_trip(spark):
    docs = edge_docs() + [(1_000 + i, t) for i, t in enumerate(TRICKY)]
    path = new_folder(spark, "t")
    token_store.write_store(frame(spark, docs), path, queries.tokenizer_path(), end_id=2, block_bytes=400)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_store.read_digests(spark, path).collect())
    start = 0
    known = collections.defaultdict(collections.Counter)
    for (i, _), ids in zip(docs, plain_tokens(docs), strict=True):
        known[i][(len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))] += 1
    order = []
    for at, i, n, crc in got:
        assert at == start and known[i][(n, crc)] > 0
        known[i][(n, crc)] -= 1
        start += n
        order.append(-1 if i is None else i)
    assert order == sorted(order) and len(got) == len(docs)
    some = {r["doc_id"]: list(r["ids"]) for r in token_store.read_documents(spark, path, [5, 1_002, 77_777]).collect()}
    want = {i: x for (i, _), x in zip(docs, plain_tokens(docs), strict=True) if i in (5, 1_002)}
    assert some == want


def test_store_of_nothing(spark):
    path = new_folder(spark, "t")
    token_store.write_store(frame(spark, []), path, queries.tokenizer_path(), end_id=2)
    assert token_store.read_digests(spark, path).collect() == []


# --- 4 search ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("sizes", [(8_192, 16_384), (7, 3)])
def test_search(spark, sizes):
    rnd = random.Random(5)
    rows = [(i, [rnd.choice([0.0, 0.5, -0.25, 0.1, 1.0]) for _ in range(rnd.choice([3, 5]))]) for i in range(60)]
    rows += [(60, None), (61, [1.0, None]), (62, [float("nan")]), (63, [float("inf")]), (64, []), (0, rows[1][1]), (10, rows[10][1]), (65, rows[10][1]), (66, rows[10][1]), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("rank", "score", "group", "pack", "key")})
    vectors = df.select("*", topk.quantised(F.col("embedding")).alias("terms"))
    got = collections.defaultdict(list)
    for r in sorted(topk.exact_topk(vectors, F.col("vec_id") % 10 == 0, k=4, group_rows=sizes[0], pack_rows=sizes[1]).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    fine = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = collections.defaultdict(list)
    for q in dict.fromkeys((i, tuple(v)) for i, v in fine if i % 10 == 0):
        scores = sorted((-sum(a * b for a, b in zip(q[1], v)), i) for i, v in fine if i != q[0])[:4]
        want[q[0]] += [(k, i, -s) for k, (s, i) in enumerate(scores, 1)]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert topk.exact_topk(vectors.limit(0), F.col("vec_id") % 10 == 0).collect() == []


# --- 5 mix ---------------------------------------------------------------------------------------------------------------


def test_budgets():
    rnd = random.Random(6)
    for _ in range(300):
        sizes = rnd.sample(range(0, 40), rnd.randrange(1, 8))
        counts = [rnd.randrange(1, 6) for _ in sizes]
        budget = rnd.randrange(0, 200)
        take = mixing.fit_budget(sizes, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True)) and sum(s * t for s, t in zip(sizes, take, strict=True)) <= budget
    for _ in range(200):  # the programme alone is exact
        sizes, counts = np.array(rnd.sample(range(1, 12), 4)), np.array([rnd.randrange(1, 4) for _ in range(4)])
        budget = rnd.randrange(1, 40)
        own = mixing._knapsack(sizes, counts, budget)
        sums = {0}
        for s, c in zip(sizes, counts, strict=True):
            sums = {x + int(s) * k for x in sums for k in range(int(c) + 1)}
        assert int((own * sizes).sum()) == max(x for x in sums if x <= budget)


@pytest.mark.parametrize("how", [{}, {"broadcast_rows": 0, "slice_rows": 2, "salts": 3}])
def test_mix(spark, how):
    rnd = random.Random(7)
    docs = [(i, " ".join(["w"] * rnd.choice([0, 1, 2, 3, 5, 8, 13, 40]))) for i in range(400)] + [(400, None), (401, "")]
    df = frame(spark, docs)
    rows = mixing.mix_sources(df.drop("size", "copies"), **how).collect()
    assert len(rows) == len(docs)
    total, by = 0, collections.defaultdict(lambda: [0, 0, 0])
    for r in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert r["size"] == n and r["taken"] == r["copies"] * n <= 3 * n
        own = by[r["source"]]
        own[0] += r["taken"]
        own[1], own[2] = r["target"], r["source_size"]
        total += n
    known = sorted(by, key=lambda s: (s is None, s or ""))
    assert [by[s][1] for s in known] == mixing.targets([(s, by[s][2]) for s in known], (1, 2, 3), 3)
    assert all(abs(v[0] - v[1]) <= max(1, 0.001 * v[1]) for v in by.values()) and sum(v[1] for v in by.values()) == pytest.approx(total)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(df.drop("size", "copies").repartition(3), **how).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_targets_and_empty_mix(spark):
    assert mixing.targets([("a", 10), ("b", 90)], (9, 1), 3) == [30.0, 70.0]
    assert mixing.targets([("a", 0), (None, 0)], (1, 2), 3) == [0.0, 0.0]
    assert mixing.mix_sources(frame(spark, [], clash=False)).collect() == []


# --- 6 decontamination ---------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(docs, items, window=10):
    windows = {}
    for i, t in items:
        w = WORD.findall(low(t))
        m = min(window, len(w))
        for k in range(len(w) - m + 1) if w else ():
            windows.setdefault(tuple(w[k : k + m]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, ids = WORD.findall(low(t)), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                x = tuple(w[k : k + m])
                if x in windows:
                    hit.update(range(k, k + m))
                    ids |= windows[x]
        ids.discard(None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard,block", [(10**6, 10**6), (50, 60)])
@pytest.mark.parametrize("short", [False, True])
def test_decontamination(spark, shard, block, short):
    rnd = random.Random(8)
    text = lambda n, words: " ".join(rnd.choice(words) for _ in range(n))
    two = ["a", "B."]
    items = [(i, text(rnd.choice([9, 10, 11, 14, 25]), two)) for i in range(20)] + [(30, None), (31, "--"), (None, text(12, two)), (5, text(12, two))]
    items += [(40, "Zed"), (41, "q1-é"), (42, "q1 É")] if short else []
    docs = [(i, text(rnd.choice([0, 3, 12, 30, 200]), [*two, "zed", "q1 é"])) for i in range(40)] + [(100, None), (101, ""), (102, ".."), (3, "a b"), (3, "a b"), (103, "a b " * 3_000)]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, item_id string, words string")
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    found = decontam.find_matches(df, bench, shard_bytes=shard, block_bytes=block)
    assert sorted((tuple(r) for r in decontam.digests(found).collect()), key=str) == plain_hits(docs, items)
    kept = decontam.decontaminate(df, bench, shard_bytes=shard, block_bytes=block)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in plain_hits(docs, items) if not r[5])


def test_longest_matches_are_whole(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"x y {passage} z"), (2, "clean words only")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, f"before {passage} after")], "item_id long, text string")
    got = {r["doc_id"]: [m.asDict() for m in r["matches"]] for r in decontam.find_matches(docs, bench).collect()}
    assert got == {1: [{"item_ids": [7], "first_word": 2, "n_words": 30}], 2: []}
    assert [r["n_hit"] for r in decontam.digests(decontam.find_matches(docs, bench.limit(0))).collect()] == [0, 0]
    assert decontam.find_matches(docs.limit(0), bench).collect() == []


# --- 7 urls --------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    urls = ["http://WWW.Example.com/en/a?x", "http://a.b.example.com/en/", "https://x.net/es/1#t", "http://x.org", "no scheme", None, "a://b://c/d", "http://net/fr/", "http://xnet/fr/", "http://e.com", "://?q", "http://h/p\nq?z"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(0, urls[0], "x", "y")], "page_id long, url string, rule string, n string")
    outcomes = spark.createDataFrame([(3, 0), (3, 0), (None, 1), (4, None)], "page_id long, good int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_reputation.judge_urls(pages, outcomes, url_reputation.RULES).collect()}
    assert got[0] == ("www.example.com", "/en/a", "www.example.com/en/") and got[1][2] == "example.com/en/" and got[2] == ("x.net", "/es/1", "net/es/")
    assert got[3] == ("x.org", "", None) and got[4] == got[5] == ("", "", None) and got[6] == ("b:", "//c/d", None) and got[7][2] == "net/fr/" and got[8][2] is None
    assert got[9] == ("e.com", "", None) and got[10] == ("", "", None) and got[11] == ("h", "/p\nq", None)
    assert url_reputation.judge_urls(pages, outcomes, url_reputation.RULES).count() == len(urls) + 1
    assert url_reputation.judge_urls(pages.limit(0), outcomes, ()).collect() == []
    assert {r["verdict"] for r in url_reputation.judge_urls(pages, outcomes.limit(0), ()).collect()} <= {"allow", "block"}


def test_reputation_shrinks_towards_parents(spark):
    rows = [(i, f"http://h{i % 10}.{'good' if i % 2 else 'bad'}.org/") for i in range(400)] + [(400, "http://new.good.org/"), (401, "http://new.bad.org/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    outcomes = spark.createDataFrame([(i, i % 2) for i in range(400)], "page_id long, good int")
    r = {x["host"]: x for x in url_reputation.host_reputation(pages, outcomes).collect()}
    assert r["new.good.org"]["mean"] > 0.7 > 0.3 > r["new.bad.org"]["mean"] and r["new.good.org"]["verdict"] == "allow" and r["new.bad.org"]["verdict"] == "block"
    assert all(x["bound"] < x["mean"] for x in r.values()) and r["h1.good.org"]["domain"] == "good.org" and r["h1.good.org"]["suffix"] == "org"


# --- 8 repeats -----------------------------------------------------------------------------------------------------------


def plain_repeats(docs, length):
    texts = [(i, (t or "").encode()) for i, t in docs]
    seen = collections.Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length,gram,unit", [(40, None, 10**6), (40, 7, 900), (40, 40, 900), (12, 4, 2_000), (1, 1, 10**6)])
def test_repeats(spark, length, gram, unit):
    rnd = random.Random(10)
    base = ["".join(rnd.choice("ab") for _ in range(250)) for _ in range(3)]
    docs = []
    for i in range(70):
        b, k = rnd.choice(base), rnd.randrange(200)
        docs.append((i, rnd.choice(["".join(rnd.choice("abcdefgh é") for _ in range(rnd.choice([0, 39, 40, 41, 150]))), b[k : k + 80] + "xyz" * rnd.randrange(20) + b[:90], "a" * rnd.randrange(20, 120), b])))
    docs += [(200, None), (201, ""), (3, docs[3][1]), (3, docs[3][1]), (202, "é" * 30), (None, base[0])]
    got = suffix_dedup.digests(suffix_dedup.remove_repeats(frame(spark, docs), length=length, gram=gram, unit_bytes=unit))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_repeats(docs, length)


def test_repeats_of_nothing(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [])).collect() == []
    one = suffix_dedup.digests(suffix_dedup.remove_repeats(frame(spark, [(1, "x" * 50_000)]), length=400)).first()
    assert one["n_removed"] == 50_000 and one["n_spans"] == 1


# --- 9 chat --------------------------------------------------------------------------------------------------------------


def plain_digests(rows):
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        own = out.setdefault(conv, ["", "", 0])
        own[0] += f"{role or ''}\n{text or ''}\n"
        own[1] += (text or "") if role == "assistant" else ""
        own[2] += 1
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (n, sha(a), len(b), sha(b)) for c, (a, b, n) in out.items()}


@pytest.mark.parametrize("budget,history", [(1, 0), (12, 2), (40, 1), (10_000, 3)])
def test_chat(spark, budget, history):
    rnd = random.Random(12)
    parts = ["###", "### user: x", "</turn>", " </turn>\n", "\\", "\\\\", ": ", "#", "plain words", "é\n", "", " ", "<"]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "tool:#<\\"]), "".join(rnd.choice(parts) for _ in range(rnd.randrange(6)))) for c in range(12) for t in range(rnd.randrange(1, 12))]
    rows += [(50, None, None, None), (50, 1, "assistant", None), (50, 1, "assistant", "tie"), (50, 1, "assistant", "tie"), (None, 0, "user", "hi"), (51, 0, "assistant", "word " * 3_000), (-7, 0, "user", queries.HOSTILE)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"window": F.lit(1), "spans": F.lit("x")})
    windows = chat_format.format_conversations(df, budget=budget, history=history)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.read_back(windows).collect()}
    assert got == plain_digests(rows)
    for w in windows.collect():
        assert w["n_tokens"] <= budget or w["n_new"] == 1
        turns = chat_format.parse_window(w["text"])
        assert len(turns) == w["n_repeated"] + w["n_new"] and w["n_repeated"] <= history + 1


def test_system_turn_and_history_are_repeated_and_masked():
    turns = [("system", "be kind"), ("user", "a b c"), ("assistant", "d e f"), ("user", "g h i"), ("assistant", "j k l")]
    windows = list(chat_format.windows_of(turns, budget=28, history=2, share=0.5, tokens=chat_format.count_tokens))
    shown = [chat_format.parse_window(w[4]) for w in windows]
    assert all(s[0] == ("system", "be kind") for s in shown) and len(windows) > 1
    assert [w[4][s["start"] : s["end"]] for w in windows for s in w[5]] == ["d e f", "j k l"]
    assert any(("assistant", "d e f") in s[: w[1]] for s, w in zip(shown, windows, strict=True))


def test_chat_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.format_conversations(df)).collect() == []


# --- 10 fingerprints -----------------------------------------------------------------------------------------------------


def plain_fingerprint(text, words):
    from xxhash import xxh64_intdigest

    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance):
    roots = list(range(len(fps)))

    def root(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= distance:
                x, y = root(i), root(j)
                roots[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(fps))]


def test_fingerprints(spark):
    docs = edge_docs()
    rows = simhash.near_duplicates(frame(spark, docs), words=3, distance=2).select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("h"), "component_id").collect()
    fps = [plain_fingerprint(t, 3) for _, t in docs]
    groups = collections.defaultdict(list)
    for (i, _), g in zip(docs, plain_components(fps, 2), strict=True):
        groups[g].append(i)
    want = []
    for (i, _), f, g in zip(docs, fps, plain_components(fps, 2), strict=True):
        want.append((i, f"{f:016x}", min((x for x in groups[g] if x is not None), default=None)))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert simhash.near_duplicates(frame(spark, []), words=3).collect() == []
    kept = simhash.keep_first(frame(spark, docs), words=3, distance=2)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({w[2] for w in want if w[2] is not None})


def test_long_texts_are_counted_in_runs(monkeypatch):
    text = " ".join(f"w{i * i % 997}" for i in range(3_000))
    monkeypatch.setattr(simhash, "RUN", 500)
    got = simhash.fingerprints_of([text.encode(), b"", b"one two", text.encode()], 5).view(np.uint64).tolist()
    assert got == [plain_fingerprint(t, 5) for t in (text, "", "one two", text)]


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
@pytest.mark.parametrize("crowded", [64, 3, 0])
def test_links(spark, distance, crowded):
    rng = np.random.default_rng(distance)
    fps = {int(x) for x in rng.integers(0, 2**63, 12, dtype=np.uint64)}
    for b in list(fps)[:5]:
        for _ in range(12):
            x = b
            for k in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(k)
            fps.add(x)
    fps |= {(5 << 32) | int(rng.integers(0, 256)) for _ in range(25)}
    fps = sorted(fps)
    signed = {i: x - 2**64 if x >= 2**63 else x for i, x in enumerate(fps)}
    df = spark.createDataFrame([(x,) for x in signed.values()], "fp long")
    edges = simhash.links(df, distance=distance, crowded=crowded)
    roots = {r["node"]: r["root"] for r in components.components(edges).collect()}
    own, want = collections.defaultdict(list), collections.defaultdict(list)
    for i, x in signed.items():
        own[roots.get(x, x)].append(i)
    for i, g in enumerate(plain_components(fps, distance)):
        want[g].append(i)
    assert sorted(own.values()) == sorted(want.values())


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (5, 3)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


# --- the pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for i, (name, stage) in enumerate(pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept[name] = docs.collect()
        ids = sorted(r["doc_id"] for r in kept[name])
        if name != "token store":
            assert docs.columns == columns and all(before[r["doc_id"]] == r["text"] for r in kept[name])
        if name == "near-duplicates":
            order = sorted(before)
            fps = [plain_fingerprint(before[d], pipeline.SHINGLE_WORDS) for d in order]
            assert ids == sorted({order[g] for g in plain_components(fps, pipeline.DISTANCE)})
        if name == "benchmark decontamination":
            assert ids == sorted(r[0] for r in plain_hits(list(before.items()), bench) if not r[5])
        if name == "source mix":
            assert max(collections.Counter(ids).values()) <= 3
    texts = [(r["doc_id"], r["text"]) for r in kept["source mix"]]
    want = collections.Counter((d, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for (d, _), x in zip(texts, plain_tokens(texts), strict=True))
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in kept["token store"]) == want
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in {r["doc_id"] for r in kept["quality classifier"]} for d in good) >= 0.99 * len(good)


@pytest.mark.parametrize("rows", ["edges", "none"])
def test_pipeline_stages_take_any_rows(spark, rows):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = frame(spark, edge_docs() if rows == "edges" else [], clash=False)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        got = out.collect()
        assert name == "token store" or out.columns == docs.columns
        if rows == "none":
            assert got == []
        elif name == "near-duplicates":
            assert len({r["doc_id"] for r in got if r["doc_id"] is not None}) == len([r for r in got if r["doc_id"] is not None])
        elif name == "token store":
            assert len(got) == docs.count()
