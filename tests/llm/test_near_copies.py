"""Near copies against all pairs of shingle sets."""

import random

import pytest
from test_ops import edge_docs, frame, low

from vaultlens.llm import near_copies


def plain_set(text, words=5):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return frozenset(" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def plain_firsts(rows, words=5):
    """The least (id, text) of every row's component, where sets of similarity 0.8 are linked."""
    sets = sorted({plain_set(t, words) for _, t in rows}, key=sorted)
    roots = list(range(len(sets)))

    def root(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * min(len(a), len(sets[j])) >= 4 * max(len(a), len(sets[j])) and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = root(i), root(j)
                roots[max(x, y)] = min(x, y)
    return [root(sets.index(plain_set(t, words))) for _, t in rows]


def kept_of(rows, words=5):
    """Ids that stay, without null ones."""
    first = {}
    for (i, _), g in zip(rows, plain_firsts(rows, words), strict=True):
        if i is not None:
            first[g] = min(i, first.get(g, i))
    return sorted(first.values())


def edited(rnd, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"edit{rnd.randrange(1000)}"
    return " ".join(words)


def edited_docs(seed):
    rnd = random.Random(seed)
    base = [" ".join(f"w{rnd.randrange(3_000)}" for _ in range(rnd.choice([40, 150, 400]))) for _ in range(12)]
    return [(i, edited(rnd, base[i % 12], rnd.randrange(7))) for i in range(96)]


def test_edited_copies_are_found(spark):
    docs = edited_docs(1)
    kept = sorted(r["doc_id"] for r in near_copies.keep_first(frame(spark, docs)).collect())
    assert kept == kept_of(docs) and len(kept) < 60


@pytest.mark.parametrize("pivots", [(8,), (1, 8, 64)])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, pivots):
    monkeypatch.setattr(near_copies, "PIVOTS", pivots)
    monkeypatch.setattr(near_copies, "buckets_of", lambda sets: near_copies.np.full((len(sets), 1), 7, "uint64"))  # one bucket for all
    docs = edited_docs(2)[:30]
    assert sorted(r["doc_id"] for r in near_copies.keep_first(frame(spark, docs)).collect()) == kept_of(docs)


def test_given_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    assert sorted(r["doc_id"] for r in near_copies.keep_first(table).collect()) == kept_of(docs)


def test_edges(spark):
    docs = edge_docs()
    got = near_copies.keep_first(frame(spark, docs))
    assert got.columns == frame(spark, docs).columns
    ids = [r["doc_id"] for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == kept_of(docs) and ids.count(None) == 1
    assert near_copies.keep_first(frame(spark, [])).collect() == []


def test_rows_of_one_id_have_fates_of_their_own(spark):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = [(1, one), (2, one), (2, two), (3, "x"), (3, "y"), (3, "x")]
    got = sorted((r["doc_id"], r["text"]) for r in near_copies.keep_first(frame(spark, docs)).collect())
    assert got == sorted([(1, one), (2, two), (3, "x"), (3, "y")])
