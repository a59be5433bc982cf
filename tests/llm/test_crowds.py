"""One passage in many benchmark items and many documents, and long repetitive texts."""

import random
import time
import tracemalloc

import numpy as np
import pytest
from test_ops import plain_hits

from vaultlens.llm import decontam
from vaultlens.llm.hashing import BASE, Powers


def searched(docs, items, window=10):
    test = decontam.TestBlock(items, window)
    texts = [t.encode() for t in docs]
    words = decontam.words_of(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), Powers(BASE))
    return test, decontam.longest_matches(words, test, decontam.Chains(test))


def test_work_grows_with_words_and_not_with_pairs():
    rnd = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(12))
    fresh = lambda n: " ".join(f"w{rnd.randrange(10**7)}" for _ in range(n))
    items = [(i, f"{fresh(5)} {passage} {fresh(5)}") for i in range(1_000)]
    docs = [f"{fresh(9)} {passage} {fresh(9)}" for _ in range(1_000)]
    tracemalloc.start()
    began = time.time()
    test, found = searched(docs, items)
    took, (_, peak) = time.time() - began, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(found) == 1_000 and all(m[1:3] == (9, 12) and len(m[3]) == 1_000 for m in found)
    assert peak < 60e6 and took < 20, (peak, took)


def test_periodic_texts():
    items = [(1, "a " * 500), (2, "b a " * 100), (3, "a " * 11 + "b")]
    docs = ["a " * 20_000, "a b " * 5_000, "b " + "a " * 30 + "b"]
    test, found = searched(docs, items)
    hit = [set() for _ in docs]
    named = [set() for _ in docs]
    for d, a, n, own in found:
        words = docs[d].split()[a : a + n]
        assert n >= 10 and all(" ".join(words) in items[test.ids[k][0] - 1][1] for k in own)
        hit[d].update(range(a, a + n))
        named[d] |= {test.ids[k][0] for k in own}
    want = plain_hits(list(enumerate(docs)), items)
    assert [len(h) for h in hit] == [w[2] for w in want] and [len(n) for n in named] == [w[3] for w in want]
    assert len(found) < 20_000


@pytest.mark.parametrize("block", [10**6, 200])
def test_columns_called_like_its_own(spark, block):
    text = " ".join(f"p{i}" for i in range(12))
    rows = [(1, f"x {text} y", 7, "m", "k"), (2, "clean", 8, "n", "l"), (2, "clean", 9, None, "l"), (None, None, 0, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, matches string, k1 string")
    bench = spark.createDataFrame([(i, f"{i} {text}") for i in range(20)], "item_id long, text string")
    kept = decontam.decontaminate(df, bench, block_bytes=block)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(rows[1:], key=str)
    found = {r["doc_id"]: r for r in decontam.find_matches(df, bench, block_bytes=block).collect()}
    assert found[1]["n_words"] == 14 and found[1]["k1"] == "k" and {i for m in found[1]["matches"] for i in m["item_ids"]} == set(range(20))
