"""What a worker holds while sets are compared, and between operators."""

import random
import sys
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from vaultlens.llm import decontam, near_copies, quality_fm


class Caught:
    """A table that only catches the function it is mapped with."""

    schema = None

    def __init__(self):
        self.sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value)))

    def __getattr__(self, _):
        return lambda *args, **kept: self

    def mapInArrow(self, run, *_):
        self.run = run
        return self


def mapped(operator):
    if operator == "quality":
        return quality_fm.keep_good(Caught(), quality_fm.learn([]), 0.3).run
    if operator == "decontamination":
        return decontam._search(SimpleNamespace(value=vars(decontam.TestBlock([(1, "a b c")], 10))), 1_000, "n", "m", [])
    own = Caught()
    (near_copies._marked(own, 5) if operator == "marks" else near_copies._sets(own, own, 5))
    return own.run


@pytest.mark.parametrize("operator", ["quality", "decontamination", "marks", "sets"])
def test_no_encoder_stays_in_a_worker_of_another_operator(spark, monkeypatch, operator):
    monkeypatch.setitem(sys.modules, "_vaultlens_process", SimpleNamespace(encoder="600,000 words"))
    assert not list(mapped(operator)(iter([])))
    assert "_vaultlens_process" not in sys.modules


def test_many_short_sets_are_compared_in_bounded_memory():
    rnd = random.Random(7)
    base = [[rnd.getrandbits(60) for _ in range(9)] for _ in range(1_500)]
    sets = [sorted([*own, rnd.getrandbits(60)]) for own in base for _ in range(4)]  # 9 of 11 are common: similar, by fours
    sid, asks = np.arange(len(sets)), np.arange(len(sets)) % 2 == 0
    table = pa.table({"asks": asks, "sid": sid, "root": sid, "shingles": pa.array(sets, pa.list_(pa.int64()))})
    tracemalloc.start()
    got = near_copies._tile((), table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(zip(got["u"].to_pylist(), got["v"].to_pylist(), strict=True)) == [(i, i - i % 4) for i in range(len(sets)) if i % 4]
    assert peak < 100e6, peak
