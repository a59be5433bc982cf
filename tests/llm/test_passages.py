"""Passages of words that rows share, against all their windows."""

import collections
import random
import re

import pytest
from test_ops import frame

from vaultlens.llm import suffix_dedup


def plain_shared(docs, size):
    """Words of each row inside a run of size words that another row has."""
    rows = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    seen = collections.defaultdict(set)
    for i, w in enumerate(rows):
        for k in range(len(w) - size + 1):
            seen[tuple(w[k : k + size])].add(i)
    out = []
    for (d, _), w in zip(docs, rows, strict=True):
        hit = {j for k in range(len(w) - size + 1) if len(seen[tuple(w[k : k + size])]) > 1 for j in range(k, k + size)}
        out.append((d, len(hit)))
    return sorted(out, key=str)


def passage_docs(seed):
    rnd = random.Random(seed)
    fresh = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    shared = [fresh(n) for n in (4, 5, 6, 9, 14)]
    docs = [(i, f"{fresh(rnd.randrange(8))} {rnd.choice(shared)}\n{fresh(rnd.randrange(8))}\t{rnd.choice(shared)}") for i in range(50)]
    own = fresh(12)
    docs += [(100, f"{own} {own}"), (101, "a b " * 40), (102, "b a " * 9), (103, "c " * 60), (104, None), (105, ""), (None, docs[2][1]), (3, docs[3][1]), (3, docs[3][1]), (106, "é" * 900)]
    return docs


@pytest.mark.parametrize("size", [1, 2, 5, 8])
@pytest.mark.parametrize("unit", [10**6, 300])
def test_shared_words(spark, size, unit):
    docs = passage_docs(size)
    kept = suffix_dedup.remove_repeats(frame(spark, docs), length=400, unit_bytes=unit, passage_words=size)
    assert sorted(((r["doc_id"], r["n_shared_words"]) for r in kept.collect()), key=str) == plain_shared(docs, size)


def test_no_passages_are_asked_for(spark):
    kept = suffix_dedup.remove_repeats(frame(spark, passage_docs(1)))
    assert {r["n_shared_words"] for r in kept.collect()} == {None}
    assert suffix_dedup.remove_repeats(frame(spark, []), passage_words=5).collect() == []
