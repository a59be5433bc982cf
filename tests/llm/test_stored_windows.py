"""Windows that were stored are read back from any partitions."""

import hashlib
import random

from vaultlens.llm import chat_format


def test_read_back_after_storing(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(c if c else None, t, rnd.choice(["system", "user", "assistant"]), " ".join(f"w{rnd.randrange(99)}" for _ in range(rnd.randrange(30)))) for c in range(40) for t in range(rnd.randrange(1, 25))]
    windows = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=60)
    windows.repartition(7).write.parquet(str(tmp_path / "w"))
    stored = spark.read.parquet(str(tmp_path / "w"))
    want = {}
    for c, _, role, text in rows:
        want.setdefault(c, []).append(f"{role}\n{text}\n")
    for df in (stored, stored.repartition(7), stored.orderBy("text"), windows):
        got = chat_format.read_back(df).collect()
        assert len(got) == len(want) and {r["conv_id"]: (r["n_turns"], r["turns_sha256"]) for r in got} == {c: (len(t), hashlib.sha256("".join(t).encode()).hexdigest()) for c, t in want.items()}
