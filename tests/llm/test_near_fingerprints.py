"""Near copies by operator 10's fingerprints: found without min-hashes, held against the shingle sets."""

import random

from test_near_copies import edited_docs, kept_of
from test_ops import frame, plain_fingerprint

from vaultlens.llm import near_copies


def ids_of(got):
    return sorted(r["doc_id"] for r in got.collect())


def test_copies_within_the_bits_need_no_shared_bucket(spark, monkeypatch):
    rnd = random.Random(5)
    text = " ".join(f"w{rnd.randrange(10_000)}" for _ in range(2_000))
    near = next(t for t in (f"{text} edit{i}" for i in range(100)) if 0 < (plain_fingerprint(t, 5) ^ plain_fingerprint(text, 5)).bit_count() <= near_copies.BITS)
    docs = [(1, text), (2, near), (3, " ".join(f"v{i}" for i in range(50)))]
    assert kept_of(docs) == [1, 3]
    monkeypatch.setattr(near_copies, "buckets_of", lambda sets: near_copies.np.array([[near_copies.set_key(s)] for s in sets], "uint64"))  # none for two
    assert ids_of(near_copies.keep_first(frame(spark, docs))) == [1, 3]


def test_one_fingerprint_is_no_link_between_unlike_texts(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "fingerprints_of_hashes", lambda every, n: near_copies.np.array([7 for _ in every], "int64"))
    docs = edited_docs(3)
    assert ids_of(near_copies.keep_first(frame(spark, docs))) == kept_of(docs)
