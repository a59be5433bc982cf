"""The mix with columns called like its own, and targets on a table."""

import random

import pytest
from pyspark.sql import functions as F
from test_ops import frame

from vaultlens.llm import mixing

NAMES = ("n_words", "matches", "size", "copies", "taken", "target", "source_size", "__copy", "__salt", "row", "salt", "take", "Slices")


@pytest.mark.parametrize("how", [{}, {"broadcast_rows": 0, "salts": 3}])
def test_rows_are_repeated_whole(spark, how):
    rnd = random.Random(7)
    docs = [(i, " ".join(["w"] * rnd.choice([0, 1, 2, 3, 5, 8, 40]))) for i in range(200)] + [(200, None), (201, ""), (3, "w w"), (3, "w w")]
    df = frame(spark, docs, clash=False).withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for c in NAMES})
    got = mixing.repeat_sources(df, **how)
    assert got.columns == df.columns
    plain = mixing.mix_sources(frame(spark, docs, clash=False), **how)
    want = sorted((r["doc_id"], r["text"] or "") for r in plain.collect() for _ in range(r["copies"]))
    rows = got.collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in rows) == want
    assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in NAMES)
    assert set(mixing.ADDED) <= set(mixing.mix_sources(df, **how).columns)
    assert mixing.repeat_sources(df.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_targets_of_many_sources(spark, seed):
    rnd = random.Random(seed)
    known = [(f"s{i:03d}é", rnd.choice([0, 1, 5, 100, 10_000])) for i in range(rnd.randrange(1, 300))] + [(None, 50), ("", 3), ("Z", 7), ("\U0001f600", 9), ("￿", 2)]
    order = sorted(known, key=lambda x: (x[0] is None, x[0] or ""))
    weights = (1, 2, 3)
    got = {r["source"]: (r["source_size"], r["target"]) for r in mixing._aims(spark.createDataFrame(known, "source string, source_size long"), weights, 3).collect()}
    assert got == {s: (n, t) for (s, n), t in zip(order, mixing.targets(order, weights, 3), strict=True)}
